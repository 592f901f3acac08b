"""LM scoring: prediction by partial matching.

A trie of byte contexts up to order ORDER is pretrained on the training documents; every document gets its code length
under it, by escape estimation (method D: a context's each distinct symbol gives half an occurrence to the escape) and symbol exclusion
(after an escape, the symbols of the longer context are no longer possible).

The trie is a table of byte strings and counts. Level by level, one join and one window (of 256 rows at most: a
context's symbols) give each string of ORDER + 1 bytes that occurs anywhere its log-probability. Documents look it up in a
broadcast table of the ``held`` most frequent strings, a bound that is a parameter; strings beyond it are resolved by a
join, so that results don't depend on the bound. The same holds for the words of the base score.

Texts are lower-cased (A-Z), begin with ORDER bytes 2 and end with a byte 3, which is predicted, too.

Defined results: a null text is empty: one token, and the probability of ending at once; rows count as often as they
occur; with no training documents, all bytes are equally likely; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches, cut, release, slices, split_bytes, text_bytes

ORDER = 5
#: Entries of each broadcast table, at most; 12 bytes each, 24 with a hash table's room.
HELD_GRAMS = 3_000_000
HELD_WORDS = 4_000_000
SLICE = 2 << 20
START, END = 2, 3
#: The key of the token that ends every text; no word has it, as keys of words are odd.
END_KEY = 0

_P = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, and offsets."""
    flat, offsets = text_bytes(texts)
    return _LOWER[flat], offsets


def grams(flat: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each text's end: the order + 1 bytes that end there, as a number; and the n+1 offsets of the texts."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    buffer = np.full(len(flat) + n * (order + 1), START, np.uint8)
    row = np.repeat(np.arange(n), length)
    buffer[np.arange(len(flat)) + row * (order + 1) + order] = flat
    ends = offsets[1:] + np.arange(1, n + 1) * (order + 1) - 1
    buffer[ends] = END
    codes = np.zeros(max(0, len(buffer) - order), np.uint64)
    for i in range(order + 1):
        codes <<= np.uint64(8)
        codes |= buffer[i : len(buffer) - order + i]
    skip = np.zeros(len(codes), bool)
    for i in range(1, order + 1):  # strings that reach over a text's end
        at = ends[:-1] + i - order
        skip[at] = True
    bounds = offsets + np.arange(n + 1)
    return codes[~skip].astype(np.int64), bounds


def word_keys(distinct: pa.Array) -> np.ndarray:
    """An odd 64-bit hash of each word."""
    n = len(distinct)
    if not n:
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + n + 1]
    flat = np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    start, length = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.full(int(length.max()), _P)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    x = np.add.reduceat(flat * powers[np.arange(len(flat)) - np.repeat(start, length)], start) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return (x | np.uint64(1)).view(np.int64)


class _Counts:
    """Sums by key, merged as they come."""

    def __init__(self, columns: int):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.columns, self.waiting = columns, 0

    def add(self, keys: np.ndarray, column: int) -> None:
        if not len(keys):
            return
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.zeros((len(first), self.columns), np.int64)
        counts[:, column] = np.diff(np.concatenate([first, [len(keys)]]))
        self.keys.append(keys[first])
        self.counts.append(counts)
        self.waiting += len(first)
        if self.waiting > 3_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros((0, self.columns), np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = [keys[first]], [np.add.reduceat(counts[order], first)]
        self.waiting = 0
        return self.keys[0], self.counts[0]


def _held_out(ids: pa.Array, held_out: Callable[[object], bool]) -> np.ndarray:
    return np.fromiter((held_out(i) for i in ids.to_pylist()), bool, len(ids))


def every_fifth(i: object) -> bool:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a null id doesn't."""
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def gather(docs: DataFrame, held_out: Callable[[object], bool], order: int = ORDER) -> DataFrame:
    """(kind 'g' or 'w', key, train, other): occurrences of byte strings and words in training and held-out documents; columns id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {"g": _Counts(2), "w": _Counts(2)}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, offsets = lowered(part.column(1))
                held = _held_out(part.column(0), held_out)
                codes, bounds = grams(flat, offsets, order)
                of = np.repeat(held, np.diff(bounds))
                code, distinct, rows = split_bytes(flat, offsets)
                keys = word_keys(distinct)[code]
                word_of = np.repeat(held, np.diff(rows))
                for column, mask, words in ((0, ~of, ~word_of), (1, of, word_of)):
                    found["g"].add(codes[mask], column)
                    found["w"].add(keys[words], column)
                found["w"].add(np.full(int((~held).sum()), END_KEY, np.int64), 0)
                found["w"].add(np.full(int(held.sum()), END_KEY, np.int64), 1)
        for kind, counts in found.items():
            keys, n = counts.merge()
            for a in range(0, len(keys), 100_000):
                own = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own)), pa.array(own), pa.array(n[a : a + 100_000, 0]), pa.array(n[a : a + 100_000, 1])], ["kind", "key", "train", "other"])
        found.clear()
        release()

    parts = docs.mapInArrow(run, "kind string, key long, train long, other long")
    return parts.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("other").alias("other"))


def _lower(c: Column, t: Column, d: Column, r: Column, x: Column, e: Column) -> Column:
    """Log-probability at a level with count c, total t, distinct symbols d and the levels below r, when symbols of mass x, e of them, are excluded."""
    total, left = t - x, d - e
    return F.when(total <= 0, r).when(c > 0, F.log10((c - 0.5) / total)).otherwise(F.log10(left / 2 / total) + r)


def train(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n, logp): each byte string of order + 1, its occurrences anywhere, log10 P(last byte | the others); counts: key, train, other."""
    none = F.lit(0).cast("long")
    level = None
    for k in range(order + 1):
        mask = (1 << 8 * (k + 1)) - 1
        own = counts if k == order else counts.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("train").alias("train"), F.sum("other").alias("other"))
        own = own.withColumn("context", F.shiftright("key", 8))
        if level is None:
            own = own.withColumns({"lc": none, "lt": none, "ld": none, "lr": F.lit(0.0)})
        else:
            below = level.select(F.col("key").alias("suffix"), F.col("train").alias("lc"), F.col("t").alias("lt"), F.col("d").alias("ld"), F.col("r").alias("lr"))
            own = own.join(below, F.col("key").bitwiseAND(F.lit(mask >> 8)) == F.col("suffix")).drop("suffix")
        w = Window.partitionBy("context")  # a context has 256 symbols at most
        seen = F.col("train") > 0
        own = own.withColumns({"t": F.sum("train").over(w), "d": F.sum(seen.cast("long")).over(w), "x": F.sum(F.when(seen, F.col("lc")).otherwise(none)).over(w)})
        if level is None:
            own = own.withColumn("r", F.when(F.col("d") < 256, -F.log10(256 - F.col("d"))).otherwise(0.0))
        else:
            own = own.withColumn("r", _lower(F.col("lc"), F.col("lt"), F.col("ld"), F.col("lr"), F.col("x"), F.col("d")))
        level = own.select("key", "train", "other", "t", "d", "r")
    return level.select("key", (F.col("train") + F.col("other")).alias("n"), _lower(F.col("train"), F.col("t"), F.col("d"), F.col("r"), none, none).alias("logp"))


class Lookup:
    """Values by 64-bit keys: an open hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        self.steps = 0
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            where = slot[left[free]]
            self.keys[where] = keys[left[free]]  # the last of equals stays
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _P) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and the places of the keys that have none."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = self.values[slot]
        wrong = np.flatnonzero(got != keys)
        out[wrong] = 0
        missing = [wrong[got[wrong] == -1]]
        wrong = wrong[got[wrong] != -1]
        for _ in range(self.steps):
            if not len(wrong):
                break
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[wrong]]
            hit = got == keys[wrong]
            out[wrong[hit]] = self.values[slot[wrong[hit]]]
            missing.append(wrong[got == -1])
            wrong = wrong[~hit & (got != -1)]
        missing.append(wrong)
        return out, np.concatenate(missing)


_TABLES: dict[int, tuple[Lookup, Lookup]] = {}


def _tables(key: int, held: Broadcast) -> tuple[Lookup, Lookup]:
    """The tables of a broadcast, built once a worker."""
    if key not in _TABLES:
        _TABLES.clear()
        gk, gv, wk, wv = held.value
        _TABLES[key] = Lookup(gk, gv), Lookup(wk, wv)
    return _TABLES[key]


def _most(table: DataFrame, by: str, value: str, held: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Keys and values of the most frequent rows (those of the largest ``by``), ``held`` at most, and whether these are all.

    Sixteenths of powers of two say how far down fits, so that nothing is sorted and no task gets all rows on their way to the driver.
    """
    step = F.floor(F.log2(F.col(by)) * 16).cast("int")
    steps = sorted(((r["step"], r["rows"]) for r in table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)  # 1,024 rows at most
    low, total = None, 0
    for at, rows in steps:
        if total + rows > held:
            break
        low, total = at, total + rows
    whole = total == sum(rows for _, rows in steps)
    got = (table if whole else table.filter(step >= low) if low is not None else table.limit(0)).select("key", value).toArrow()
    return got.column("key").to_numpy(), got.column(value).to_numpy().astype(np.float32), whole


def score(docs: DataFrame, id_column: str = "doc_id", column: str = "text", held_out: Callable[[object], bool] = every_fifth, order: int = ORDER, held_grams: int = HELD_GRAMS, held_words: int = HELD_WORDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    own = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").alias("text"))
    counts = cut(gather(own, held_out, order))
    model = cut(train(counts.filter("kind = 'g'").drop("kind"), order))
    words = counts.filter("kind = 'w' and train > 0").select("key", "train")
    total = words.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, base = int(total["n"]), total["n"] + 0.5 * (total["v"] + 1)
    gram_keys, gram_values, all_grams = _most(model, "n", "logp", held_grams)
    word_keys_, word_counts, all_words = _most(words, "train", "train", held_words)
    held = spark.sparkContext.broadcast((gram_keys, gram_values, word_keys_, word_counts))
    mark = uuid.uuid4().int
    # a count that float32 can't hold exactly still gives its logarithm to 7 digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_gram, by_word = _tables(mark, held)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, offsets = lowered(part.column(1))
                n = part.num_rows
                codes, bounds = grams(flat, offsets, order)
                logp, lost = by_gram(codes)
                sums = np.concatenate([[0.0], np.cumsum(logp, dtype=np.float64)])
                value = sums[bounds[1:]] - sums[bounds[:-1]]
                code, distinct, rows = split_bytes(flat, offsets)
                keys = np.append(word_keys(distinct), END_KEY)
                c, absent = by_word(keys)
                known = c > 0
                word_log = np.log10((c.astype(np.float64) + 0.5) / base)
                open_ = np.zeros(len(keys), bool)
                if not all_words:
                    open_[absent] = True
                    word_log[absent] = 0.0
                cs = np.concatenate([[0.0], np.cumsum(word_log[code])])
                ks = np.concatenate([[0], np.cumsum(known[code])])
                n_tokens = np.diff(rows) + 1
                tails = [_tail(lost, bounds, codes, n) if not all_grams else [None] * n, _tail(np.flatnonzero(open_[code]), rows, keys[code], n) if not all_words else [None] * n]
                ends_open = bool(open_[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(_held_out(part.column(0), held_out)),
                        pa.array(n_tokens, pa.int64()),
                        pa.array(ks[rows[1:]] - ks[rows[:-1]] + int(known[-1]), pa.int64()),
                        pa.array(cs[rows[1:]] - cs[rows[:-1]] + (0.0 if ends_open else word_log[-1])),
                        pa.array(value),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(tails[0], pa.list_(pa.int64())),
                        pa.array([t if not ends_open else [*(t or []), END_KEY] for t in tails[1]], pa.list_(pa.int64())),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "lost_grams", "lost_words"],
                )

    out = own.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, lost_grams array<long>, lost_words array<long>")
    if not (all_grams and all_words):
        out = _resolved(out, model, words, base)
    return out.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")


def _tail(places: np.ndarray, bounds: np.ndarray, keys: np.ndarray, n: int) -> list[list[int] | None]:
    """The keys at ``places``, by text."""
    out: list[list[int] | None] = [None] * n
    places = np.sort(places)
    cut_at = np.searchsorted(places, bounds)
    for i in np.flatnonzero(np.diff(cut_at)).tolist():
        out[i] = keys[places[cut_at[i] : cut_at[i + 1]]].tolist()
    return out


def _resolved(scored: DataFrame, model: DataFrame, words: DataFrame, base: float) -> DataFrame:
    """Add what lies beyond the broadcast tables, by joins on it; frequent keys are all within those, so no key is hot."""
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    gram = scored.select("row", F.explode("lost_grams").alias("key")).groupBy("row", "key").count()
    gram = gram.join(model.select("key", "logp"), "key").groupBy("row").agg(F.sum(F.col("count") * F.col("logp")).alias("more_score"))
    word = scored.select("row", F.explode("lost_words").alias("key")).groupBy("row", "key").count().join(words, "key", "left")
    known = F.coalesce(F.col("train"), F.lit(0))
    word = word.groupBy("row").agg(F.sum(F.col("count") * F.log10((known + 0.5) / F.lit(base))).alias("more_base"), F.sum(F.when(known > 0, F.col("count")).otherwise(0)).alias("more_known"))
    out = scored.join(gram, "row", "left").join(word, "row", "left")
    zero = F.lit(0.0)
    return out.withColumns({"score": F.col("score") + F.coalesce("more_score", zero), "base_score": F.col("base_score") + F.coalesce("more_base", zero), "n_known": F.col("n_known") + F.coalesce(F.col("more_known"), F.lit(0))})
