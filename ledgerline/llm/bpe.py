"""Byte-level BPE encoding and decoding (the tokenizers library over Arrow batches).

The vocabulary is a file of ranks (base64 bytes and a number a line). Bytes map to printable characters,
as byte-level BPE does; merges are all splits of every token, so that the library merges as ranks say.

A text is cut before those single spaces and newlines where the pattern always begins a match; the distinct pieces are
encoded once, many of them in one string, as a cut that is safe in a text is safe in that string, too. This changes no id. Where a
cut wouldn't be safe (white space on both sides) the text is one piece. Bytes and digits of ids are taken a batch at a time.

Defined results: a null text is empty and has no tokens; repeated and very long texts encode alike; an empty table
gives an empty table; extra columns of the input are kept by ``encode`` and ``decode`` unless their names are those
of the outputs, which replace them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerline.llm.common import bounded_batches, release, slices

#: Distinct pieces remembered by a task; when full, the memory starts anew. It bounds memory, not results.
REMEMBER = 400_000
#: Bytes of pieces that are encoded as one string, about.
JOINED_BYTES = 1 << 14

_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b\x1c-\x1f]"
#: Units that hold a blank, or nothing: encoded alone.
_INNER = rf"^\x00?$|^\x00?{_BLANK}|.{_BLANK}"
#: Texts that aren't cut: a space or newline between blanks, or the mark that stands for a newline.
_UNCUT = rf"{_BLANK}[ \n]{_BLANK}|\x00"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes pieces with the tokenizers library and decodes ids with the reversed byte table."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        chars = byte_chars()
        shown = {t: "".join(chars[b] for b in t) for t in self.ranks}
        merges, tied = [], set()
        for token, _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks]
            splits.sort(key=lambda s: (self.ranks[s[0]], self.ranks[s[1]]))
            merges += [(shown[a], shown[b]) for a, b in splits]
            # two splits x+y and y+z of one token can overlap in x y z: the library would then go by their order, ranks go leftmost
            tied |= {token + b[1] for a in splits for b in splits if a[1] == b[0] and a != b}
        self.tied = ahocorasick.Automaton()
        for t in tied:
            self.tied.add_word(t.decode("latin-1"), True)
        self.tied.make_automaton()
        self.library = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in self.ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = max(self.ranks.values(), default=-1) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.all_bytes = pa.array(self.bytes, pa.binary())
        self.all_digits = pa.array([b"%d," % i for i in range(size)], pa.binary())

    def by_rank(self, piece: bytes) -> list[int]:
        """Merge the leftmost pair of the lowest rank until none is left."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=None)
            if best is None or best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, pieces: list[str], joinable: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has. The first ``joinable`` pieces begin with the only blank that they have, so that they are encoded together."""
        sizes = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
        joined, width = [], max(1, JOINED_BYTES * joinable // max(1, int(sizes[:joinable].sum())))
        for i in range(0, joinable, width):
            joined.append("".join(pieces[i : min(joinable, i + width)]))
        parts = [np.array(e.ids, np.int32) for i in range(0, len(joined), 64) for e in self.library.encode_batch_fast(joined[i : i + 64], add_special_tokens=False)]
        rest = [e.ids for i in range(joinable, len(pieces), 4096) for e in self.library.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]
        ids = np.concatenate([*parts, np.fromiter(chain.from_iterable(rest), np.int32)])
        # a token ends in the piece in which its last byte is
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), side="right")
        counts = np.diff(ends, prepend=0)
        if not len(self.tied) or not len(pieces):
            return ids, counts
        hits = np.fromiter((end for end, _ in self.tied.iter("".join(pieces).encode().decode("latin-1"))), np.int64)
        out, at = [], 0
        for i in np.unique(np.searchsorted(np.cumsum(sizes), hits, side="right")).tolist():  # also where the hit lies across two pieces: that's only slower
            own = np.array(self.exactly(pieces[i]), np.int32)
            out += [ids[at : ends[i] - counts[i]], own]
            at = ends[i]
        exact = [len(x) for x in out[1::2]]
        counts[np.unique(np.searchsorted(np.cumsum(sizes), hits, side="right"))] = exact
        return np.concatenate([*out, ids[at:]]), counts

    def exactly(self, text: str) -> list[int]:
        """Ids of a text by the ranks alone, for pieces with repeats in which ties can occur."""
        return [i for m in self.pattern.finditer(text) for i in (_long(m[0].encode(), self) if len(m[0]) > 256 else self.by_rank(m[0].encode()))]

    def taken(self, values: pa.Array, ids: np.ndarray, rows: np.ndarray) -> Iterator[memoryview]:
        """What ``values`` has for the ids of each row, one after the other."""
        got = values.take(pa.array(ids))
        bounds = np.frombuffer(got.buffers()[1], np.int32)[got.offset : got.offset + len(got) + 1][rows].tolist() if len(got) else [0] * len(rows)
        data = memoryview(got.buffers()[2] or b"") if len(got) else memoryview(b"")
        return (data[a:b] for a, b in zip(bounds, bounds[1:]))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def starts(self, ids: list[int], text: str) -> list[int]:
        """For each id, the character in which it begins; tokens that split a character share its number."""
        encoded = text.encode()
        lead = np.cumsum([(b & 0xC0) != 0x80 for b in encoded]) - 1 if encoded else np.zeros(0, int)
        at = np.cumsum([0, *(len(self.bytes[i]) for i in ids)])[:-1]
        return lead[at].tolist() if len(at) else []


def _long(piece: bytes, codec: Codec) -> list[int]:
    """As by_rank with a heap, for long pieces: n log n."""
    import heapq

    if piece in codec.ranks:
        return [codec.ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))
    nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (r := codec.ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or (j := nxt[i]) >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    return [codec.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


class _Memory:
    """Ids of pieces seen by a task, flat: piece k has ids[start[k]:start[k] + length[k]]."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.start, self.length = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.n = self.pieces = 0

    def add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        total, k = len(ids), len(keys)
        self.ids = _grown(self.ids, self.n + total)
        self.start, self.length = _grown(self.start, self.pieces + k), _grown(self.length, self.pieces + k)
        self.ids[self.n : self.n + total] = ids
        self.start[self.pieces : self.pieces + k] = self.n + np.cumsum(lengths) - lengths
        self.length[self.pieces : self.pieces + k] = lengths
        self.slot.update(zip(keys, range(self.pieces, self.pieces + k)))
        self.n += total
        self.pieces += k


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.empty(max(n, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def encode_texts(texts: pa.Array, code: Codec, memory: _Memory) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts and the n+1 offsets of its rows."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    whole = np.asarray(pc.match_substring_regex(texts, _UNCUT).to_numpy(zero_copy_only=False), bool)
    lists = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(whole), "", texts), "\n", " \x00"), " ")
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    index = np.asarray(coded.indices).astype(np.int64)
    units = ["\n" + u[1:] if u[:1] == "\x00" else " " + u for u in coded.dictionary.to_pylist()]
    first = bounds[:-1]
    heads = [t if w else u[1:] for t, w, u in zip(_picked(texts, whole), whole, (units[i] for i in index[first]))] if len(first) else []
    own: dict[str, int] = {}
    for h in heads:
        own.setdefault(h, len(own))
    keys = units + list(own)
    index[first] = [len(units) + own[h] for h in heads]
    if len(memory.slot) > REMEMBER or memory.n > 16 * REMEMBER:
        memory.clear()
    blank = pc.match_substring_regex(coded.dictionary, _INNER).to_numpy(zero_copy_only=False) if len(units) else np.zeros(0, bool)
    fresh = [u for u, other in zip(units, blank) if not other and u not in memory.slot]
    joinable = len(fresh)
    others = dict.fromkeys(chain((u for u, other in zip(units, blank) if other), own))
    fresh += [k for k in others if k not in memory.slot]
    fresh = list(dict.fromkeys(fresh))  # a head may be a unit, which is among the first
    memory.add(fresh, *code.encode(fresh, joinable))
    slots = np.fromiter(map(memory.slot.__getitem__, keys), np.int64, len(keys))
    for k in fresh:
        if len(k) > 200:  # very long pieces aren't remembered
            del memory.slot[k]
    index = slots[index]
    n = memory.length[index]
    ends = np.cumsum(n)
    at = np.repeat(memory.start[index] - (ends - n), n)
    at += np.arange(len(at))
    return memory.ids[at], np.concatenate([[0], ends])[bounds]


def _picked(texts: pa.Array, mask: np.ndarray) -> Iterator[str | None]:
    """The texts under the mask, else None."""
    for i, m in enumerate(mask):
        yield texts[i].as_py() if m else None


def _encoded(df: DataFrame, path: str, pattern: str, column: str, make, schema) -> DataFrame:
    """Map with Arrow; ``make`` turns (batch, ids, rows, codec) to a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, memory = codec(path, pattern), _Memory()
        for batch in batches:
            for part in slices(batch, column):
                ids, rows = encode_texts(part.column(column), code, memory)
                yield make(part, ids, rows, code)
        del memory
        release()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", offsets: bool = False) -> DataFrame:
    """All columns, and ``ids`` array<int>; with ``offsets``, also ``starts`` array<int>, the character in which each token begins."""
    drop = {"ids", "starts"} if offsets else {"ids"}
    kept = [f for f in df.schema.fields if f.name not in drop or f.name == column]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("starts", T.ArrayType(T.IntegerType(), False))] if offsets else [])])

    def make(part: pa.RecordBatch, ids: np.ndarray, rows: np.ndarray, code: Codec) -> pa.RecordBatch:
        listed = [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids))]
        if offsets:
            texts = part.column(column).to_pylist()
            listed.append(pa.array([code.starts(ids[a:b].tolist(), t or "") for t, a, b in zip(texts, rows, rows[1:])], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *listed], schema.fieldNames())

    return _encoded(df.select(*[f"`{f.name}`" for f in kept]), path, pattern, column, make, schema)


def encode_checked(df: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """All columns but the text, and ids array<int>, n_tokens, round_trips (decoding the ids gives the text's bytes), in one pass."""
    kept = [f for f in df.schema.fields if f.name not in {column, "ids", "n_tokens", "round_trips"}]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("round_trips", T.BooleanType())])

    def make(part: pa.RecordBatch, ids: np.ndarray, rows: np.ndarray, code: Codec) -> pa.RecordBatch:
        texts = part.column(column).cast(pa.binary()).to_pylist()
        same = [bytes(d) == (t or b"") for t, d in zip(texts, code.taken(code.all_bytes, ids, rows))]
        listed = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), listed, pa.array(np.diff(rows)), pa.array(same)], schema.fieldNames())

    return _encoded(df.select(*[f"`{f.name}`" for f in kept], f"`{column}`"), path, pattern, column, make, schema)


def decode(df: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """All columns, and ``decoded`` binary and ``decoded_text`` string (a character that the ids split is U+FFFD)."""
    kept = [f for f in df.schema.fields if f.name not in {"decoded", "decoded_text"}]
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in batches:
            out = [code.decode(x or []) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], schema.fieldNames())

    return df.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: id, n_tokens, ids_sha256, decoded_sha256, round_trips (the decoded bytes are the text's)."""
    kind = df.schema[id_column].dataType.simpleString()

    def make(part: pa.RecordBatch, ids: np.ndarray, rows: np.ndarray, code: Codec) -> pa.RecordBatch:
        listed = [hashlib.sha256(d[:-1]).hexdigest() for d in code.taken(code.all_digits, ids, rows)]
        decoded = [bytes(d) for d in code.taken(code.all_bytes, ids, rows)]
        same = [d == (t or b"") for d, t in zip(decoded, part.column(column).cast(pa.binary()).to_pylist())]
        return pa.RecordBatch.from_arrays([part.column(id_column), pa.array(np.diff(rows)), pa.array(listed), pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array(same)], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trips"])

    out = _encoded(df.select(f"`{id_column}`", f"`{column}`"), path, pattern, column, make, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trips boolean")
    return out.withColumnRenamed("id", id_column)
