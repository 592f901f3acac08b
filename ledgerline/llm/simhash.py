"""SimHash near-dedup by the recursion of May and Ozerov.

A document's fingerprint has BITS bits: the majority, bit by bit, over the hashes of its distinct words and pairs of
neighbouring words (lower-cased, without punctuation at the end). Documents are linked when their fingerprints differ in
``radius`` bits at most; classes are the connected components of links.

Links are found by filtering. A repetition permutes the coordinates and cuts them to strips; random centres are drawn for each
strip, and a fingerprint passes a centre's filter when its partial weight (its distance from the centre on the strip) is small enough.
Who passes is filtered again on the next strip, until lists are expected to be small; lists are compared by brute force. ``Plan``
computes exactly how probably a pair meets in a list of a repetition, from the chance of at least one common centre on each
strip; repetitions are as many as it takes for a pair at ``radius`` bits, the hardest link, to meet with probability ``recall``. Of
the plans of that recall (bits of a strip, weight, centres, strips) the one is taken that costs least for so many fingerprints.

Documents of one fingerprint are one entry from the start, so that copies are no hot group. A list that is far longer
than expected (near copies of one text) is cut to pieces, and each two pieces are compared as a block, so that no task gets
a whole list and every pair of it is compared. A block sends its components as stars, not as pairs.

Defined results: null and empty texts are one class; rows of one id are one document; a null id takes part under a
negative class number if nobody else in its class has an id; the class is the smallest id in it; ids are whole numbers (a TypeError
else); an empty table gives an empty table; ``kept`` passes all other columns on, whatever their names.

``n_links`` compares all pairs of a class, in blocks: exact, and quadratic in a class's distinct fingerprints. ``kept`` leaves it out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import bounded_batches, cut, partitions_for, release, slices
from ledgerline.llm.quality import Words

BITS = 128
RADIUS = 26
RECALL = 0.99
#: Strips' bits and partial weights that a plan may have, and the centres that a fingerprint passes on a strip on average.
FILTERS = ((8, 1), (16, 3), (24, 5), (24, 6), (32, 8), (32, 9), (42, 12), (64, 20), (64, 21))
PASSES = (1, 2, 3)
#: Seconds that a list's entry, a comparison with a centre and one of two entries take, about; they choose among plans of equal recall.
ENTRY_S, CENTRE_S, PAIR_S = 4e-6, 3e-9, 7e-9
LONG = 1 << 14
SEED = 77
SLICE = 1 << 19
CENTRES_AT_ONCE = 1 << 19
#: The bits of each byte as the bytes of a 64-bit number, in memory's order.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
_TRIM = np.zeros(256, bool)
_TRIM[[*b".,;:!?\"'()"]] = True


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bit_sums(hashes: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many of each text's hashes (rows of 16 bytes; a text's begin at ``at``) have each of the bits: eight sums at once, as the bytes of a 64-bit sum of 255 rows at most."""
    pieces = -(-count // 255)
    heads = np.cumsum(pieces) - pieces
    starts = np.repeat(at - 255 * heads, pieces) + 255 * np.arange(int(pieces.sum()))
    out = np.empty((len(at), BITS), np.int64)
    for i in range(BITS // 8):
        part = np.add.reduceat(_SPREAD[hashes[:, i]], starts)
        out[:, 8 * i : 8 * i + 8] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(n, 2) 64-bit halves."""
    words = Words.of(texts, _TRIM)
    n = len(words.rows) - 1
    if not len(words.code):
        return np.zeros((n, 2), np.int64)
    h = words.hashes[:, 0].astype(np.uint64)[words.code]
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(words.rows))
    pair = _mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:], 3)
    keep = row[1:] == row[:-1]
    key = np.concatenate([_mix(h, 5) >> np.uint64(24), pair[keep] >> np.uint64(24)]) | np.concatenate([row, row[1:][keep]]) << np.uint64(40)
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    own = (key >> np.uint64(40)).astype(np.int64)
    feature = key & np.uint64((1 << 40) - 1)
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    count = np.diff(np.append(at, len(own)))
    sums = _bit_sums(np.stack([_mix(feature, 11), _mix(feature, 13)], 1).view(np.uint8), at, count)
    out = np.zeros((n, 2), np.int64)
    out[own[at]] = np.packbits(sums * 2 > count[:, None], axis=1).view(np.int64)
    return out


def fingerprint_column(docs: DataFrame) -> DataFrame:
    """id, a, b of every row; columns id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                f = fingerprints(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())], ["id", "a", "b"])
        release()

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, "id long, a long, b long")


@cache
def both_pass(strip: int, weight: int, differ: int) -> float:
    """P(a random centre passes both of two fingerprints that differ in ``differ`` bits of the strip)."""
    both = 0
    for x in range(min(differ, weight) + 1):  # of the bits that differ, those in which the centre differs from the first
        for rest in range(min(strip - differ, weight - max(x, differ - x)) + 1):
            both += comb(differ, x) * comb(strip - differ, rest)
    return both / 2**strip


@dataclass(frozen=True)
class Plan:
    """How a repetition filters: ``strips`` strips of ``strip`` bits, on each the centres within ``weight``."""

    strip: int
    weight: int
    centres: int
    strips: int

    @property
    def rate(self) -> float:
        """The share of all fingerprints that pass a filter."""
        return both_pass(self.strip, self.weight, 0)

    def meeting(self, bits: int) -> float:
        """P(two fingerprints that differ in ``bits`` bits share a list of a repetition): on each strip at least one centre passes both."""
        common = [1 - (1 - both_pass(self.strip, self.weight, x)) ** self.centres for x in range(self.strip + 1)]
        left = {bits: 1.0}  # differing bits that the strips so far don't hold, by the probability of having met
        for i in range(self.strips):
            rest, after = BITS - i * self.strip, {}
            for d, p in left.items():
                for x in range(max(0, d - rest + self.strip), min(self.strip, d) + 1):
                    after[d - x] = after.get(d - x, 0.0) + p * common[x] * comb(d, x) * comb(rest - d, self.strip - x) / comb(rest, self.strip)
            left = after
        return sum(left.values())

    def repetitions(self, radius: int = RADIUS, recall: float = RECALL) -> int:
        """As many as a pair at the radius needs to meet with probability ``recall``."""
        return max(4, ceil(log(1 - recall) / log1p(-min(self.meeting(radius), 1 - 1e-9))))

    def cost(self, entries: int, repetitions: int) -> float:
        """Seconds a fingerprint."""
        passed = [(self.centres * self.rate) ** i for i in range(self.strips + 1)]
        return repetitions * (passed[-1] * (ENTRY_S + entries * self.rate**self.strips / 2 * PAIR_S) + sum(passed[:-1]) * self.centres * CENTRE_S)


@cache
def plan_for(entries: int, radius: int = RADIUS, recall: float = RECALL) -> Plan:
    """The cheapest plan for so many fingerprints; all have the same recall."""
    plans = [Plan(m, w, max(1, round(mu / both_pass(m, w, 0))), k) for m, w in FILTERS for mu in PASSES for k in range(1, BITS // m + 1)]
    usable = [p for p in plans if p.meeting(radius) > 1e-6]
    return min(usable, key=lambda p: p.cost(entries, p.repetitions(radius, recall)))


def _leaves(plan: Plan, repetitions: int, seed: int = SEED):
    """Entries to (leaf, a, b, node): the lists that each entry is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CENTRES_AT_ONCE // plan.centres)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, node = (batch.column(i).to_numpy() for i in range(3))
            bits = np.unpackbits(np.stack([a, b], 1).view(np.uint8), axis=1)
            for r in range(repetitions):
                rng = np.random.default_rng([seed, r])
                order = rng.permutation(BITS)
                centres = rng.integers(0, 1 << plan.strip, (plan.strips, plan.centres), dtype=np.uint64, endpoint=False) if plan.strip < 64 else rng.integers(0, 2**64 - 1, (plan.strips, plan.centres), dtype=np.uint64, endpoint=True)
                at, leaf = np.arange(len(a)), np.full(len(a), r, np.uint64)
                for i in range(plan.strips):
                    strip = np.zeros((len(a), 64), np.uint8)
                    strip[:, : plan.strip] = bits[:, order[i * plan.strip : (i + 1) * plan.strip]]
                    value = np.packbits(strip, axis=1, bitorder="little").view(np.uint64)[:, 0][at]
                    found = [np.nonzero(np.bitwise_count(value[j : j + step, None] ^ centres[i][None, :]) <= plan.weight) for j in range(0, len(value), step)]
                    who = np.concatenate([f[0] + j for f, j in zip(found, range(0, len(value), step))]) if found else np.zeros(0, np.int64)
                    centre = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                    at, leaf = at[who], _mix(leaf[who] * np.uint64(plan.centres) + centre.astype(np.uint64), i + 1)
                key = _mix(leaf, r).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a[at]), pa.array(b[at]), pa.array(node[at])], ["leaf", "a", "b", "node"])

    return run


def near(a: np.ndarray, b: np.ndarray, half: int, radius: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, matrix) of who is within ``radius`` bits of whom, each pair once: all pairs, or, where ``half`` is less than all, the first half's with the others."""
    a, b = a.view(np.uint64), b.view(np.uint64)  # bitwise_count takes absolute values
    one = half == len(a)
    for i in range(0, half, 512):
        j, k = min(half, i + 512), i if one else half
        found = np.empty((j - i, len(a) - k), bool)
        for h in range(i, j, 32):  # what these rows need stays in the cache
            m = min(j, h + 32)
            differ = np.bitwise_count(a[h:m, None] ^ a[None, k:])
            differ += np.bitwise_count(b[h:m, None] ^ b[None, k:])
            np.less_equal(differ, radius, out=found[h - i : m - i])
        yield i, k, np.triu(found, 1) if one else found


def components(a: np.ndarray, b: np.ndarray, node: np.ndarray, radius: int, half: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) of the components of entries within ``radius`` bits (see ``near``)."""
    order = np.argsort(np.argsort(node, kind="stable"), kind="stable")
    label = np.arange(len(a))
    for i, k, found in near(a, b, len(a) if half is None else half, radius):
        x, y = np.nonzero(found)
        if not len(x):
            continue
        # pairs of these rows and the stars so far, so that no more than these are held
        x, y = np.concatenate([order[x + i], np.arange(len(a))]), np.concatenate([order[y + k], label])
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]  # follow the smallest to its own smallest
            if (new == label).all():
                break
            label = new
    by_rank = np.sort(node, kind="stable")
    moved = by_rank[label] != by_rank
    return by_rank[moved], by_rank[label][moved]


def blocks(lists: DataFrame, key: str, sizes: DataFrame, long: int) -> DataFrame:
    """(key, block, side, a, b, node): lists as blocks that compare each of their pairs once.

    A list of up to ``long`` entries is one block. A longer one is cut to pieces, and each two pieces are a block of two sides, each piece one
    of one side. sizes: key, n.
    """
    whole = [F.lit(0).alias("block"), F.lit(0).alias("side")]
    sizes = cut(sizes.filter(F.col("n") > long).select(key, F.ceil(F.col("n") / long).cast("int").alias("pieces")))
    if sizes.isEmpty():
        return lists.select(key, *whole, "a", "b", "node")
    own, pieces = F.col("piece"), F.col("pieces")
    with_piece = lists.join(sizes, key, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", F.pmod(F.xxhash64("a", "b", key), pieces).cast("int"))
    met = F.transform(F.sequence(F.lit(0), pieces - 1), lambda q: F.struct((F.least(own, q) * pieces + F.greatest(own, q)).alias("block"), F.when(q < own, 1).otherwise(0).alias("side")))
    return with_piece.select(key, F.explode(met).alias("m"), "a", "b", "node").select(key, "m.block", "m.side", "a", "b", "node")


def compared(blocked: DataFrame, key: str, fn: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` of the arrays (key, block, side, a, b, node) and the bounds of the blocks in them, over whole blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            return fn(rows, np.concatenate([[0], cuts, [len(rows[0])]]))

        held: list[np.ndarray] | None = None
        for batch in batches:
            own = [c.to_numpy() for c in batch.columns]
            if held is not None:
                own = [np.concatenate([x, y]) for x, y in zip(held, own)]
            if not len(own[0]):
                continue
            # the last block may go on in the next batch
            ended = np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1]))
            last = int(ended[-1]) + 1 if len(ended) else 0
            if last:
                yield from of([x[:last] for x in own])
            held = [x[last:] for x in own]
        if held is not None and len(held[0]):
            yield from of(held)

    parts = partitions_for(blocked.sparkSession)
    return blocked.repartition(parts, key, "block").sortWithinPartitions(key, "block", "side").mapInArrow(run, schema)


def _half(side: np.ndarray) -> int:
    """Entries of a block's first side; all, where it has one side."""
    return int(np.searchsorted(side, 1))


def _stars(radius: int):
    """Blocks to edges (u, v)."""

    def edges(rows: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, _, side, a, b, node = rows
        out = [components(a[i:j], b[i:j], node[i:j], radius, _half(side[i:j])) for i, j in zip(cuts, cuts[1:]) if j - i > 1]
        if out:
            u, v = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
            if len(u):
                uv = np.unique(np.stack([u, v], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0].copy()), pa.array(uv[:, 1].copy())], ["u", "v"])

    return edges


def _partners(radius: int):
    """Blocks to (a, b, n): how many others of the block are within ``radius`` of an entry that has any."""

    def counts(rows: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, _, side, a, b, _ = rows
        n = np.zeros(len(a), np.int64)
        for i, j in zip(cuts, cuts[1:]):
            own = n[i:j]
            for row, column, found in near(a[i:j], b[i:j], _half(side[i:j]), radius):
                own[row : row + found.shape[0]] += found.sum(1)
                own[column : column + found.shape[1]] += found.sum(0)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some]), pa.array(n[some])], ["a", "b", "n"])

    return counts


def link_counts(labelled: DataFrame, radius: int = RADIUS, long: int = LONG) -> DataFrame:
    """(a, b, n_links): the entries within ``radius`` of each that has any, exactly; entries a, b, node, class_id. Links lie within classes, so each class's entries are compared."""
    sizes = cut(labelled.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = labelled.join(sizes.select("class_id"), "class_id", "left_semi")
    found = compared(blocks(shared, "class_id", sizes, long), "class_id", _partners(radius), "a long, b long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n_links"))


def find_links(entries: DataFrame, n: int, radius: int = RADIUS, recall: float = RECALL, long: int = LONG, plan: Plan | None = None) -> DataFrame:
    """Distinct (u, v), v the smaller: links that join entries (a, b, node) to components."""
    plan = plan or plan_for(n, radius, recall)
    lists = entries.select("a", "b", "node").mapInArrow(_leaves(plan, plan.repetitions(radius, recall)), "leaf long, a long, b long, node long")
    blocked = blocks(lists, "leaf", lists.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), long)
    return compared(blocked, "leaf", _stars(radius), "u long, v long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component; edges u, v."""
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("low"))
        stepped = labels.join(near, "node").select("node", F.least("label", "low").alias("next"), "label")
        jumped = cut(stepped.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("old")))
        moved = not jumped.filter("label != old").isEmpty()
        labels = jumped.select("node", "label")
        if not moved:
            return labels


def _judged(docs: DataFrame, id_column: str, column: str, radius: int = RADIUS, recall: float = RECALL, links: bool = True) -> DataFrame:
    """id, a, b (the fingerprint), class_id, copies of every row, and n_links if asked for."""
    kind = docs.schema[id_column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids must be whole numbers, {id_column} is {kind.simpleString()}")
    prints = cut(fingerprint_column(docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").alias("text"))))
    entries = cut(prints.groupBy("a", "b").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.coalesce("low", -F.abs(F.col("a") % (1 << 62)) - 1)))
    edges = cut(find_links(entries, entries.count(), radius, recall))
    known = entries.join(connected(edges), "node", "left").withColumn("class_id", F.coalesce("label", "node"))
    columns = ["a", "b", "copies", "class_id"]
    if links:
        labelled = cut(known)
        known = labelled.join(link_counts(labelled, radius), ["a", "b"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
        columns.append("n_links")
    return prints.join(known.select(*columns), ["a", "b"])


def classes(docs: DataFrame, id_column: str = "doc_id", column: str = "text", **options: object) -> DataFrame:
    """id, class_id, n_links (other fingerprints within the radius), copies (rows of the same fingerprint), keep (the class's first) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()
    out = _judged(docs, id_column, column, **options)
    return out.select(F.col("id").cast(kind).alias(id_column), "class_id", "n_links", "copies", F.col("id").eqNullSafe(F.col("class_id")).alias("keep"))


def _free(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    while name in df.columns:
        name += "_"
    return name


def _with_prints(docs: DataFrame, column: str, first: str, second: str) -> DataFrame:
    """All columns and rows, and the fingerprint in two columns of these names."""
    names = [*docs.columns, first, second]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, SLICE):
                f = fingerprints(part.column(column))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())], names)
        release()

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(first, T.LongType()), T.StructField(second, T.LongType())]))


def kept(docs: DataFrame, id_column: str = "doc_id", column: str = "text", **options: object) -> DataFrame:
    """One document of each class, with its own columns: one of its smallest id. Where no row of a class has an id, one of them stays."""
    judged = cut(_judged(docs, id_column, column, links=False, **options))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")
    stay_id, stay_a, stay_b, own_class, print_a, print_b = (_free(docs, n) for n in ("_stay_id", "_stay_a", "_stay_b", "_class_id", "_print_a", "_print_b"))
    stay = cut(judged.groupBy("class_id").agg(F.min(first).alias("s")).select(F.col("class_id").alias(own_class), F.col("s.id").alias(stay_id), F.col("s.a").alias(stay_a), F.col("s.b").alias(stay_b)))
    own = F.col(f"`{id_column}`").cast("long")
    # an id of one row names it; of ids of more rows, and of none, the fingerprint says which row
    rows = judged.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select(F.col("id").alias("more_id"))
    unsure = cut(stay.join(rows, F.col(stay_id).eqNullSafe(F.col("more_id")), "left_semi"))
    if unsure.isEmpty():
        return docs.join(stay.select(stay_id), own == F.col(stay_id), "left_semi")
    named = stay.join(unsure.select(own_class), own_class, "left_anti").select(stay_id)
    asked = docs.join(unsure.select(stay_id).distinct(), own.eqNullSafe(F.col(stay_id)), "left_semi")
    same = own.eqNullSafe(F.col(stay_id)) & (F.col(print_a) == F.col(stay_a)) & (F.col(print_b) == F.col(stay_b))
    found = _with_prints(asked, column, print_a, print_b).join(unsure, same).dropDuplicates([own_class]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.join(named, own == F.col(stay_id), "left_semi").unionByName(found)
