"""Suffix-array dedup: every byte that a string of ``LENGTH`` bytes covers which also starts earlier.

Strings are compared as windows of ``LENGTH`` bytes, one at each byte. Windows are taken together in runs: neighbours whose
smallest hash of ``gram`` bytes (their leading token) is the same. A run stands for the suffixes that begin in it, and its key is the
leading token's fingerprint and then the fingerprint of all its bytes. Splitters from a bounded sample of documents
range-partition the keys; each bucket sorts its keys locally by multikey quicksort (by the first character of the key, then, only among
equals, by the next) and compares neighbours:

- a run whose bytes are those of an earlier run is repeated, with all its windows;
- a run that shares its leading token with other runs, but not its bytes, may hold repeated windows: it goes to the next
  level, where the grams are longer and runs shorter, down to single windows, where it is decided;
- a run whose leading token nobody shares has no repeated window, unless it repeats itself, which sends it on as well.

A leading token on a splitter lies in two buckets: its runs all go on, which decides the same and needs no comparison
across the boundary; equal keys are always in one bucket. A task first merges its own equal runs, so that a passage that
a third of all documents share sends a row a task, and not one a document. Fingerprints have 112 bits together (64 and 48).

Fingerprints stand for bytes in this order: with the bytes themselves a key would be a hundred bytes, and the keys several
times the input. Buckets are as many as the sample says that BUCKET_KEYS keys each need, and at least the session's shuffle width.

Defined results: a null text is empty; a text shorter than ``LENGTH`` bytes has no window; matches never cross rows; rows of
one id are documents of their own, in the order of their texts' SHA-1, and where id and text are the same, all but one repeat
that one; a null id comes before all others; ids may be of any type that has an order; an empty table gives an empty table; other columns don't matter.
Whole numbers that are there and differ are the documents' own order; otherwise rows get hidden numbers first, which takes one more shuffle of the texts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import bounded_batches, cut, partitions_for, ragged, release, slices, text_bytes
from ledgerline.operators.textchecks import numbered

LENGTH = 100
#: Bytes of the leading token, level by level; the last is a whole window.
GRAMS = (48, 80)
#: Documents whose keys give the splitters, about.
SAMPLE = 2000
SLICE = 1 << 20
#: Keys of a bucket, about.
BUCKET_KEYS = 4_000_000
#: Rows that the quicksort leaves to a plain sort, character by character.
SMALL = 1 << 15
REPEATED, OPEN, SELF = 1, 2, 3

_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_INT = np.iinfo(np.int64)
_ROWS = "bucket int, packed binary"
#: Keys that a task merges and packs at a time.
WAITING = 1_500_000
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _power.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 20), np.uint64(base % 2**64))
        got[0] = 1
        _power[base] = got = np.multiply.accumulate(got)
    return got[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


class _Hash:
    """Fingerprints of any stretch of bytes, by prefix sums."""

    def __init__(self, flat: np.ndarray, base: int, add: int):
        n = len(flat) + 1
        self.sums = np.zeros(n, np.uint64)
        table = _mix((np.arange(256, dtype=np.uint64) + np.uint64(add)) * np.uint64(0xA24BAED4963EE407))
        np.cumsum(table[flat] * _powers(base, n)[: n - 1], out=self.sums[1:])
        self.inverse = _powers(pow(base, -1, 2**64), n)

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def runs(flat: np.ndarray, offsets: np.ndarray, gram: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(piece, start in the piece, windows, leading fingerprint, fingerprint of all bytes, repeats itself) of the runs of all pieces."""
    n = len(flat) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty, np.zeros(0, bool)
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(length, n + length) <= offsets[piece + 1]
    first = _Hash(flat, _P, 1)
    second = _Hash(flat, _Q, 77)
    width = length - gram + 1
    if width <= 1:
        start = stop = np.flatnonzero(valid)
        leading = first.of(start, start + length)
        again = np.zeros(len(start), bool)
    else:
        h = first.of(slice(0, len(flat) - gram + 1), slice(gram, None))
        low, span = h, 1
        while span * 2 <= width:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        low = np.minimum(low[:n], low[width - span : width - span + n])
        same = (low[1:] == low[:-1]) & valid[1:] & valid[:-1] & (piece[1:] == piece[:-1])
        start = np.flatnonzero(valid & np.concatenate([[True], ~same]))
        stop = np.flatnonzero(valid & np.concatenate([~same, [True]]))
        leading = low[start]
        at_head = np.concatenate([[0], np.cumsum(h[:n] == low)])
        again = at_head[stop] > at_head[start]  # a window begins with the leading token and isn't the last
    whole = second.of(start, stop + length)
    own = piece[start]
    return own, start - offsets[own], stop - start + 1, leading.view(np.int64), (whole & np.uint64((1 << 48) - 1)).view(np.int64), again


def bucket_of(g: np.ndarray, c: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The number of splitters (rows g, c in order) that are below or equal, as keys."""
    if not len(splitters):
        return np.zeros(len(g), np.int32)
    out = np.searchsorted(splitters[:, 0], g, side="right").astype(np.int32)
    tied = np.flatnonzero((out > 0) & (splitters[np.maximum(out - 1, 0), 0] == g))
    for i in tied.tolist():  # only leading tokens that are splitters
        lo = int(np.searchsorted(splitters[:, 0], g[i], side="left"))
        out[i] = lo + int(np.searchsorted(splitters[lo : out[i], 1], c[i], side="right"))
    return out


def multikey_order(keys: list[np.ndarray], small: int = SMALL) -> np.ndarray:
    """The order of rows by the characters ``keys``, by multikey quicksort: parts below, at and above a pivot, and only those at it go on to the next character."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(keys):
            continue
        own = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = own[_plain_order([k[own] for k in keys[depth:]])]
            continue
        k = keys[depth][own]
        sample = np.sort(k[:: max(1, len(k) // 101)])
        pivot = sample[len(sample) // 2]
        below, above = k < pivot, k > pivot
        parts = own[below], own[~(below | above)], own[above]
        order[lo:hi] = np.concatenate(parts)
        i, j = lo + len(parts[0]), hi - len(parts[2])
        todo += [(lo, i, depth), (i, j, depth + 1), (j, hi, depth)]
    return order


def _plain_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of few rows: by the first character, then equal stretches by the rest."""
    order = np.argsort(keys[0], kind="quicksort")
    for depth in range(1, len(keys)):
        same = np.ones(len(order), bool)
        for k in keys[:depth]:
            s = k[order]
            same[1:] &= s[1:] == s[:-1]
        same[:1] = False
        group = np.cumsum(~same)
        tied = np.flatnonzero(same | np.append(same[1:], False))  # rows of stretches of two and more
        if not len(tied):
            break
        own = order[tied]
        order[tied] = own[np.lexsort((keys[depth][own], group[tied]))]
    return order


def _firsts(g: np.ndarray, c: np.ndarray, doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows, and in it: whether a row repeats an earlier one, and whether its leading token has several keys."""
    order = multikey_order([g, c, doc, s])
    g, c, doc, s = g[order], c[order], doc[order], s[order]
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    new = new_g | np.concatenate([[True], c[1:] != c[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    repeated = (doc != doc[head]) | (s != s[head])
    group = np.cumsum(new_g) - 1
    several = np.bincount(group, weights=new)[group] > 1
    return order, repeated, several


def _mapper(gram: int, length: int, splitters: np.ndarray, first: bool):
    """Texts (and their open stretches) to rows of _ROWS: what is known to repeat, and keys to compare, packed by bucket."""

    def flush(keys: list[tuple[np.ndarray, ...]], known: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        g, c, doc, s, n, again = (np.concatenate(x) for x in zip(*keys)) if keys else (np.zeros(0, np.int64),) * 6
        if len(g):
            order, repeated, _ = _firsts(g, c, doc, s)
            g, c, doc, s, n, again = (x[order] for x in (g, c, doc, s, n, again))
            known.append((doc[repeated], s[repeated], n[repeated]))
            g, c, doc, s, n, again = (x[~repeated] for x in (g, c, doc, s, n, again))
        rows = []
        bucket = bucket_of(g, c, splitters)
        order = np.lexsort((s, doc, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(len(splitters) + 2))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[b] : cuts[b + 1]]
            rows.append((b, _pack(doc[own], s[own], n[own], np.where(again[own], SELF, OPEN), g[own], c[own])))
        doc, s, n = _joined(*(np.concatenate(x) for x in zip(*known))) if known else (np.zeros(0, np.int64),) * 3
        spread = doc.view(np.uint64) % np.uint64(len(splitters) + 1)
        for b in np.unique(spread).tolist():
            own = spread == b
            rows.append((b, _pack(doc[own], s[own], n[own])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[np.ndarray, ...]] = []
        known: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                flat, offsets = text_bytes(part.column(1))
                if first:
                    piece_row, base = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                else:
                    lists = part.column(2)
                    row = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
                    each = lists.flatten()
                    flag, s, n = (np.asarray(each.field(i)).astype(np.int64) for i in range(3))
                    old = flag == REPEATED
                    known.append((ids[row[old]], s[old], n[old]))
                    piece_row, base = row[~old], s[~old]
                    flat, offsets = ragged(flat, offsets[piece_row] + base, n[~old] + length - 1)
                    waiting += int(old.sum())
                piece, s, n, g, c, again = runs(flat, offsets, gram, length)
                keys.append((g, c, ids[piece_row[piece]], s + base[piece], n, again))
                waiting += len(g)
                if waiting > WAITING:
                    yield from flush(keys, known)
                    keys, known, waiting = [], [], 0
        yield from flush(keys, known)
        del keys, known
        release()

    return run


def _pack(doc: np.ndarray, s: np.ndarray, n: np.ndarray, flag: np.ndarray | None = None, g: np.ndarray | None = None, c: np.ndarray | None = None) -> bytes:
    """Rows in order of doc and s; places are compressed, fingerprints aren't."""
    steps = np.diff(doc, prepend=0)
    place = np.diff(s, prepend=0)
    place[steps != 0] = s[steps != 0]
    columns = [steps.astype(np.int64), place.astype(np.int32), n.astype(np.int32), (np.full(len(doc), REPEATED) if flag is None else flag).astype(np.int8)]
    # bytes of equal significance stand together
    small = zlib.compress(b"".join(x.view(np.uint8).reshape(len(doc), -1).T.tobytes() for x in columns), 1)
    keys = b"" if g is None else g.tobytes() + c.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return struct.pack("<qq", len(doc), len(small)) + small + keys


def _unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    """flag, g, c, doc, s, n; g and c are 0 where none were packed."""
    rows, size = struct.unpack_from("<qq", packed)
    small = np.frombuffer(zlib.decompress(packed[16 : 16 + size]), np.uint8)
    out, at = [], 0
    for kind, width in ((np.int64, 8), (np.int32, 4), (np.int32, 4), (np.int8, 1)):
        out.append(np.ascontiguousarray(small[at : at + rows * width].reshape(width, rows).T).view(kind)[:, 0].astype(np.int64))
        at += rows * width
    steps, place, n, flag = out
    doc = np.cumsum(steps)
    head = np.flatnonzero((steps != 0) | (np.arange(rows) == 0))
    total = np.cumsum(place)
    s = total - np.repeat(total[head] - place[head], np.diff(np.append(head, rows)))
    keys = packed[16 + size :]
    if not keys:
        return flag, np.zeros(rows, np.int64), np.zeros(rows, np.int64), doc, s, n
    c = np.zeros((rows, 8), np.uint8)
    c[:, :6] = np.frombuffer(keys, np.uint8, offset=8 * rows).reshape(rows, 6)
    return flag, np.frombuffer(keys, np.int64, rows), c.view(np.int64)[:, 0], doc, s, n


def _joined(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join stretches that touch."""
    if not len(doc):
        return doc, s, n
    order = np.lexsort((s, doc))
    doc, s, n = doc[order], s[order].astype(np.int64), n[order].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] > s[:-1] + n[:-1])])
    at = np.flatnonzero(new)
    stop = np.maximum.reduceat(s + n, at)
    return doc[at], s[at], stop - s[at]


def _bucket(last: bool, splitters: np.ndarray):
    """Sort a bucket's keys and compare neighbours; what is decided or open, without keys."""
    edges = np.unique(splitters[:, 0]) if len(splitters) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(x) for b in batches for x in b.column(1).to_pylist()]
        if not parts:
            return
        flag, g, c, doc, s, n = (np.concatenate(x) for x in zip(*parts))
        done = flag == REPEATED
        out = [(np.full(int(done.sum()), REPEATED), doc[done], s[done], n[done])]
        flag, g, c, doc, s, n = (x[~done] for x in (flag, g, c, doc, s, n))
        if len(g):
            order, repeated, several = _firsts(g, c, doc, s)
            flag, g, doc, s, n = flag[order], g[order], doc[order], s[order], n[order]
            out.append((np.full(int(repeated.sum()), REPEATED), doc[repeated], s[repeated], n[repeated]))
            if not last:
                open_ = ~repeated & (several | (flag == SELF) | np.isin(g, edges))
                out.append((np.full(int(open_.sum()), OPEN), doc[open_], s[open_], n[open_]))
        cols = [np.concatenate([o[i] for o in out]) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int8)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], ["flag", "doc", "s", "n"])

    return run


def splitters_of(docs: DataFrame, parts: int | None, gram: int, length: int = LENGTH, sample: int = SAMPLE) -> np.ndarray:
    """Keys that cut those of a sample of about ``sample`` documents evenly, to ``parts`` buckets or as many as the sample says are needed; columns doc, text."""
    share = min(1.0, sample / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                _, _, _, g, c, _ = runs(*text_bytes(part.column(1)), gram, length)
                keep = np.unique(np.linspace(0, len(g) - 1, min(len(g), 40 * part.num_rows)).astype(np.int64)) if len(g) else np.zeros(0, np.int64)
                stands = np.full(len(keep), len(g) / max(1, len(keep)))
                yield pa.RecordBatch.from_arrays([pa.array(g[keep]), pa.array(c[keep]), pa.array(stands)], ["g", "c", "stands"])

    keys = docs.sample(False, share, 7).mapInArrow(run, "g long, c long, stands double").toArrow()
    g, c, stands = (keys.column(i).to_numpy() for i in ("g", "c", "stands"))
    parts = parts or max(partitions_for(docs.sparkSession), int(stands.sum() / share / BUCKET_KEYS) + 1)
    order = multikey_order([g, c]) if len(g) else np.zeros(0, np.int64)
    at = np.unique((np.arange(1, parts) * len(g)) // parts)
    at = at[at < len(g)]
    return np.unique(np.stack([g[order][at], c[order][at]], 1), axis=0) if len(g) else np.zeros((0, 2), np.int64)


def repeated_stretches(docs: DataFrame, length: int = LENGTH, levels: tuple[int, ...] = GRAMS, parts: int | None = None) -> DataFrame:
    """(doc, found: array of (flag, s, n)): the starts s .. s + n - 1 of repeated windows of each document that has any; columns doc, text."""
    splitters = splitters_of(docs, parts, levels[0], length)
    parts = max(parts or partitions_for(docs.sparkSession), len(splitters) + 1)
    steps = (*levels, length)
    known: DataFrame | None = None
    for i, gram in enumerate(steps):
        first, last = i == 0, i == len(steps) - 1
        own = splitters if first else np.stack([np.linspace(_INT.min, _INT.max, parts + 1)[1:-1].astype(np.int64), np.full(parts - 1, _INT.min)], 1) if parts > 1 else np.zeros((0, 2), np.int64)
        texts = docs if first else docs.join(known.hint("shuffle_hash"), "doc")
        rows = texts.mapInArrow(_mapper(gram, length, own, first), _ROWS)
        rows = rows.repartitionById(len(own) + 1, F.col("bucket")).mapInArrow(_bucket(last, own), "flag byte, doc long, s int, n int")
        known = rows.groupBy("doc").agg(F.collect_list(F.struct("flag", "s", "n")).alias("found"))  # of one document
    return known


def dedup(docs: DataFrame, id_column: str = "doc_id", column: str = "text", length: int = LENGTH, levels: tuple[int, ...] = GRAMS) -> DataFrame:
    """id, n_bytes, spans (array of (start, stop) of the bytes to remove, in order), kept (the remaining bytes) of every row."""
    return _removed(docs, id_column, column, length, levels, False)


def digests(docs: DataFrame, id_column: str = "doc_id", column: str = "text", length: int = LENGTH, levels: tuple[int, ...] = GRAMS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _removed(docs, id_column, column, length, levels, True)


def _numbers(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, text) with hidden numbers, a row for all rows of the same id and text, and what they number: (doc, id, copies); columns id, text."""
    rows = docs.withColumn("sha", F.sha1(F.coalesce("text", F.lit("")).cast("binary")))
    named = cut(numbered(rows.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies")), ["id", "sha"], "doc"))
    key = F.xxhash64("id", "sha").alias("key")
    one = rows.dropDuplicates(["id", "sha"]).select(key, F.col("id").alias("id_"), F.col("sha").alias("sha_"), "text")
    same = (F.col("key") == F.col("key_")) & F.col("id_").eqNullSafe(F.col("id")) & (F.col("sha_") == F.col("sha"))  # nulls alone would meet in one task
    texts = one.join(named.select(key.alias("key_"), "id", "sha", "doc"), same).select(F.col("doc").cast("long"), "text")
    return cut(texts), named.select(F.col("doc").cast("long"), "id", "copies")


def _removed(docs: DataFrame, id_column: str, column: str, length: int, levels: tuple[int, ...], digest: bool) -> DataFrame:
    kind = docs.schema[id_column].dataType
    given = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").alias("text"))
    bounded_batches(docs.sparkSession)
    if isinstance(kind, T.IntegralType) and given.groupBy("id").count().filter("id is null or count > 1").isEmpty():
        own, named = given.select(F.coalesce(F.col("id").cast("long"), F.lit(int(_INT.min))).alias("doc"), "text"), None  # never null, so that all joins read one exchange
    else:
        own, named = _numbers(given)
    found = repeated_stretches(own, length, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, offsets = text_bytes(part.column(1))
                lists = part.column(2)
                row = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
                each = lists.flatten()
                s, n = np.asarray(each.field(1)).astype(np.int64), np.asarray(each.field(2)).astype(np.int64)
                at = np.zeros(len(flat) + 1, np.int32)
                np.add.at(at, offsets[row] + s, 1)
                np.add.at(at, offsets[row] + s + n + length - 1, -1)
                gone = np.cumsum(at[:-1]) > 0
                start = np.flatnonzero(gone & (np.concatenate([[True], ~gone[:-1]]) | _heads(offsets, len(flat))))
                count = np.searchsorted(start, offsets)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[offsets[1:]] - total[offsets[:-1]]
                kept = [flat[a:b][~gone[a:b]].tobytes() if r else flat[a:b].tobytes() for a, b, r in zip(offsets, offsets[1:], removed)]
                first = [part.column(0), pa.array(np.diff(offsets), pa.int64())]
                if digest:
                    yield pa.RecordBatch.from_arrays([*first, pa.array(removed, pa.int64()), pa.array(np.diff(count), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                else:
                    ends = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]]) | np.concatenate([_heads(offsets, len(flat))[1:], [True]]))) + 1
                    spans = [[(int(a - o), int(b - o)) for a, b in zip(start[i:j], ends[i:j])] for i, j, o in zip(count, count[1:], offsets)]
                    yield pa.RecordBatch.from_arrays([*first, _spans(spans), pa.array(kept, pa.binary())], ["doc", "n_bytes", "spans", "kept"])

    joined = own.join(found.hint("shuffle_hash"), "doc", "left")
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "doc long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    out = joined.mapInArrow(run, schema)
    if named is None:
        return out.withColumn("doc", F.col("doc").cast(kind)).withColumnRenamed("doc", id_column)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    each = out.join(named, "doc").select("*", copy).withColumn("gone", (F.col("copy") > 1) & (F.col("n_bytes") >= length))
    nothing = F.lit("").cast("binary")
    if digest:
        whole = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.sha2(nothing, 256)}
    else:
        whole = {"spans": F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))), "kept": nothing}
    return each.select(F.col("id").alias(id_column), "n_bytes", *(F.when(F.col("gone"), v).otherwise(F.col(k)).alias(k) for k, v in whole.items()))


def _heads(offsets: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[offsets[:-1][offsets[:-1] < n]] = True
    return out


def _spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.array([[{"start": a, "stop": b} for a, b in row] for row in spans], kind)
