"""Exact top-k search: incremental multi-index hashing for binary codes.

A code has as many bits as the longest vector has elements, in words of 64. Each word is cut to segments of about log2(codes)
bits, so that a segment's value has about one code. Round r looks up, for every query that isn't settled, the values at distance r of its
segments, one segment after the other. Once the first a + 1 of ``m`` segments are looked up in round r, every code within
``m * r + a`` bits has been met, as one that differs by less has a segment that was looked up. A query whose kth verified distance is D
needs no more segments than reach D; it is settled when D is covered, so that nothing nearer, and no tie, can be missing.

The values of a segment are grouped to blocks by all but their LOW last bits. A round sends each query to the blocks
that its values lie in; a task has a block's codes by value and looks the values up there. A pair is sent on only from the lowest segment
that meets it and only in the round that does, if it isn't farther than the query's kth distance so far, and only the ``k + 1``
nearest of a block are. A block of more than CHUNK codes is cut to chunks, and its queries are asked in each of them.

Rows of the same code are one entry with its ``k + 1`` smallest ids, which is all that any query can need; so hot codes
are no hot keys.

Defined results: ties go to the smaller id; a query doesn't find its own row, but other rows of the same code; with fewer
than k other rows, all are found; a null or empty vector has code 0; null and missing elements count as not positive; repeated
ids are one row, with the smallest of its codes; rows without an id neither ask nor are found; ids are whole numbers (a TypeError
else); an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import cut, partitions_for

#: Last bits of a segment's value that a block holds all values of.
LOW = 12
CHUNK = 1 << 16
#: Lookups and pairs that a task has at once.
AT_ONCE = 1 << 18
_SENT = "segment int, block long, kind int, code binary, first long, n int"


def binaries(words: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as binary values."""
    n, width = len(words), words.shape[1] * 8
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(words))])


def words_of(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of ``width`` 64-bit words each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def sign_codes(vectors: DataFrame, width: int) -> DataFrame:
    """(id, code): bit i of the code is whether element i is positive; columns id, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0), np.int64)
            positive = np.asarray(pa.compute.fill_null(batch.column(1).flatten().cast(pa.float64()), 0.0)) > 0
            bits = np.zeros((batch.num_rows, width * 64), bool)
            bits[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(positive)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = positive
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))], ["id", "code"])

    return vectors.mapInArrow(run, "id long, code binary")


class Segments:
    """The segments of codes of ``width`` words: (word, first bit, bits)."""

    def __init__(self, width: int, codes: int):
        each = -(-64 // min(32, max(8, round(log2(max(2, codes))))))
        cuts = [64 * i // each for i in range(each + 1)]
        self.cuts = [(w, a, b - a) for w in range(width) for a, b in zip(cuts, cuts[1:])]
        self.count = len(self.cuts)
        self.longest = max(bits for _, _, bits in self.cuts)
        self.low = [min(LOW, bits) for _, _, bits in self.cuts]

    def value(self, words: np.ndarray, i: int) -> np.ndarray:
        """Segment i of rows of words."""
        word, first, bits = self.cuts[i]
        return (words[:, word] >> np.uint64(first)) & np.uint64((1 << bits) - 1)


def masks(bits: int, ones: int) -> np.ndarray:
    """All numbers of so many bits with so many ones."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), ones)], np.uint64)


def entries(codes: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k + 1 smallest ids of each code, sorted; columns id, code. Pre-aggregated in steps, so that no task gets all rows of a code."""
    w = Window.partitionBy("code", "part").orderBy("id")
    part = codes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).distinct()
    some = part.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    return some.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))  # 64 * (k + 1) ids at most


def _posted(segments: Segments, width: int):
    """Codes to a row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(0), width)
            for i in range(segments.count):
                block = (segments.value(words, i) >> np.uint64(segments.low[i])).astype(np.int64)
                n = len(block)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(block), pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), batch.column(2)], ["segment", "block", "kind", "code", "first", "n"])

    return run


def _probes(segments: Segments, width: int, radius: int):
    """Queries (q, bound) to a row for each block that holds values at distance ``radius`` of a segment that the bound needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bound = words_of(batch.column(0), width), batch.column(1).to_numpy()
            for i in range(segments.count):
                low = segments.low[i]
                high = segments.cuts[i][2] - low
                needed = np.flatnonzero(bound >= segments.count * radius + i)
                for ones in range(max(0, radius - low), min(high, radius) + 1):
                    flips = masks(high, ones)
                    step = max(1, AT_ONCE // len(flips))
                    for at in range(0, len(needed), step):
                        own = needed[at : at + step]
                        block = (segments.value(words[own], i) >> np.uint64(low))[:, None] ^ flips[None, :]
                        n = block.size
                        row = np.repeat(own, len(flips))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(block.ravel().astype(np.int64)), pa.array(np.ones(n, np.int32)), batch.column(0).take(pa.array(row)), pa.array(bound[row].astype(np.int64)), pa.array(np.zeros(n, np.int32))], ["segment", "block", "kind", "code", "first", "n"])

    return run


class _Block:
    """A block's codes by the last bits of a segment's value."""

    def __init__(self, segments: Segments, i: int, words: np.ndarray, first: np.ndarray, n: np.ndarray):
        self.segments, self.i = segments, i
        value = segments.value(words, i)
        order = np.argsort(value, kind="stable")
        self.words, self.first, self.n = words[order], first[order], n[order]
        self.block = int(value[0] >> np.uint64(segments.low[i]))
        ends = value[order] & np.uint64((1 << segments.low[i]) - 1)
        self.starts = np.searchsorted(ends, np.arange((1 << segments.low[i]) + 1, dtype=np.uint64))

    def met(self, queries: np.ndarray, bound: np.ndarray, radius: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, entry, distance): the k + 1 nearest of each query that it meets here first."""
        value = self.segments.value(queries, self.i)
        low = self.segments.low[self.i]
        high = np.bitwise_count((value >> np.uint64(low)) ^ np.uint64(self.block))
        for ones in np.unique(high).tolist():
            flips = masks(low, radius - ones)
            who = np.flatnonzero(high == ones)
            step = max(1, AT_ONCE // len(flips))
            for at in range(0, len(who), step):
                own = who[at : at + step]
                asked = ((value[own] & np.uint64((1 << low) - 1))[:, None] ^ flips[None, :]).astype(np.int64)
                start = self.starts[asked]
                count = self.starts[asked + 1] - start
                # queries in turn, so that no more than about AT_ONCE pairs are there
                total = np.cumsum(count.sum(1))
                a = 0
                while a < len(own):
                    b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, side="right")))
                    yield from self._nearest(own[a:b], start[a:b].ravel(), count[a:b], queries, bound, radius, k)
                    a = b

    def _nearest(self, own: np.ndarray, start: np.ndarray, count: np.ndarray, queries: np.ndarray, bound: np.ndarray, radius: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        query = np.repeat(own, count.sum(1))
        count = count.ravel()
        entry = np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)
        if not len(entry):
            return
        differ = queries[query] ^ self.words[entry]
        distance = np.bitwise_count(differ).sum(1, dtype=np.int64)
        fit = distance <= bound[query]
        query, entry, differ, distance = query[fit], entry[fit], differ[fit], distance[fit]
        fresh = np.ones(len(query), bool)
        for j in range(self.segments.count):
            if j != self.i:
                fresh &= np.bitwise_count(self.segments.value(differ, j)) >= radius + (j < self.i)
        query, entry, distance = query[fresh], entry[fresh], distance[fresh]
        order = np.lexsort((self.first[entry], distance, query))
        query, entry, distance = query[order], entry[order], distance[order]
        head = np.searchsorted(query, query)
        keep = np.arange(len(query)) - head <= k
        yield query[keep], entry[keep], distance[keep]


def _looked_up(segments: Segments, width: int, radius: int, k: int):
    """Blocks, codes before queries, to (q, d, code, first, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple[np.ndarray, ...]] = []
        block: _Block | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("segment", "block", "chunk", "kind")], 1)
            words, first, n = words_of(batch.column("code"), width), batch.column("first").to_numpy(), batch.column("n").to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                own, kind = tuple(keys[a, :3].tolist()), keys[a, 3]
                if own != key:
                    key, held, block = own, [], None
                if not kind:
                    held.append((words[a:b], first[a:b], n[a:b]))
                    continue
                if held:
                    block = _Block(segments, own[0], *(np.concatenate(x) for x in zip(*held)))
                    held = []
                if block is None:
                    continue
                for query, entry, distance in block.met(words[a:b], first[a:b], radius, k):
                    yield pa.RecordBatch.from_arrays([binaries(words[a:b][query]), pa.array(distance.astype(np.int32)), binaries(block.words[entry]), pa.array(block.first[entry]), pa.array(block.n[entry])], ["q", "d", "code", "first", "n"])

    return run


def _in_chunks(rows: DataFrame, long: DataFrame | None, all_of_them: bool) -> DataFrame:
    """Rows with their chunk: one by the code's hash, or all of the block's."""
    if long is None:
        return rows.withColumn("chunk", F.lit(0))
    joined = rows.join(long, ["segment", "block"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)) if all_of_them else F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")
    return joined.withColumn("chunk", chunk).drop("chunks")


def search(codes: DataFrame, queries: DataFrame, width: int = 1, k: int = 10, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, id, distance), exactly; columns id (long), code (binary of ``width`` 64-bit words) of both."""
    spark = codes.sparkSession
    parts = partitions_for(spark)
    index = cut(entries(codes.select("id", "code"), k))
    segments = Segments(width, index.count())
    posted = cut(index.select("code", F.col("ids")[0].alias("first"), F.size("ids").alias("n")).mapInArrow(_posted(segments, width), _SENT))
    long = cut(posted.groupBy("segment", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select("segment", "block", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    long = None if long.isEmpty() else long
    posted = _in_chunks(posted, long, False)
    # equal codes are one query, with the ids that ask it; their answers leave out the own id
    asked = queries.select("id", "code").distinct()
    most = width * 64
    active = cut(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(most)))
    best: DataFrame | None = None
    settled: list[DataFrame] = []
    for radius in range(segments.longest + 1):
        probed = _in_chunks(active.select("q", "bound").mapInArrow(_probes(segments, width, radius), _SENT), long, True)
        sent = posted.unionByName(probed).repartition(parts, "segment", "block", "chunk").sortWithinPartitions("segment", "block", "chunk", "kind")
        met = sent.mapInArrow(_looked_up(segments, width, radius, k), "q binary, d int, code binary, first long, n int")
        if best is not None:
            met = met.unionByName(best)
        w = Window.partitionBy("q").orderBy("d", "first", "code")
        # the nearest k + 1 codes hold the nearest k + 1 rows: every code has a row
        near = met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1)
        near = cut(near.withColumn("rows", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))))
        bounds = near.groupBy("q").agg(F.min(F.when(F.col("rows") >= k + 1, F.col("d"))).alias("reached"))
        # covered: with all segments of this round, or with those that the former bound needed
        covered = F.least(F.lit(segments.count * (radius + 1) - 1), F.col("bound"))
        active = active.join(bounds, "q", "left").withColumn("done", F.coalesce(F.col("reached") <= covered, F.lit(False)) | F.lit(radius == segments.longest))
        active = cut(active.select("q", F.least("bound", F.coalesce("reached", "bound")).alias("bound"), "done"))
        near = near.select("q", "d", "code", "first", "n")
        settled.append(near.join(active.filter("done").select("q"), "q", "left_semi"))
        best = near.join(active.filter("not done").select("q"), "q", "left_semi")
        active = active.filter("not done").drop("done")
        if active.isEmpty():
            break
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    found = found.join(index, "code").select("q", F.col("d").alias("distance"), F.explode("ids").alias("id"))
    answers = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(found, "q").filter("id <> query_id")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return answers.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def nearest(vectors: DataFrame, k: int = 10, every: int = 20, id_column: str = "vec_id", column: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """Every row whose id is divisible by ``every`` asks for its k nearest rows, by the signs of the vectors."""
    kind = vectors.schema[id_column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids must be whole numbers, {id_column} is {kind.simpleString()}")
    own = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").alias("vector")).filter("id is not null")
    width = max(1, -(-(own.agg(F.max(F.size("vector"))).first()[0] or 0) // 64))
    codes = cut(sign_codes(own, width).groupBy("id").agg(F.min("code").alias("code")))
    out = search(codes, codes.filter(F.col("id") % every == 0), width, k, chunk)
    return out.select(*(F.col(c).cast(kind).alias(c) if c in ("query_id", "id") else c for c in out.columns))
