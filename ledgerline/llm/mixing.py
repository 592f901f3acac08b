"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

``targets``: each source's words by weight, at most ``most`` times its own, the excess shared anew by weight. A source's
documents lie in blocks of about ``block_words`` words, by a hash of their ids. The mix takes all blocks as often as the target
holds the source, and of one permutation of the blocks as many more as fit. ``quotas``: these exact counts of each source's
blocks are split among the output shards by a binary tree, at each node by a multivariate-hypergeometric draw; every
shard then draws the next blocks of each source's permutation, so that draws are disjoint. A document is taken as often as its
block is drawn. ``mix``: the documents themselves, copied, a partition a shard, and shuffled there.

Where the target falls into a block, that block is cut up to smaller ones in the same way, until EDGE_WORDS words are left; among
the documents of these, the largest that still fits is taken, again and again. So a source misses its target by less than the smallest
document that is left there. What the driver holds is a row a source and at most about MOST_BLOCKS rows of blocks; blocks and
shards (up to MOST_SHARDS) grow where the input would need more. No task holds a source, and no text is shuffled but to its shard.

Defined results: a null text has size 0 and is never taken; null is a source of its own, the last; rows of the same id,
source and length share one fate; a source of size 0 has target 0; an empty table gives an empty table; sources are a setting's
keys, far fewer than documents. Of other columns only ``mix`` passes any on; its outputs mix_shard and mix_copy replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, cut

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Words of a shard and of a block, about.
SHARD_WORDS = 1 << 22
BLOCK_WORDS = 1 << 14
MOST_SHARDS = 1 << 16
#: Blocks at once, beside LEAST_BLOCKS a source.
MOST_BLOCKS = 1 << 17
LEAST_BLOCKS = 64
EDGE_WORDS = 1 << 15
SEED = 20240229


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD.replace("\\x0D", "\\x0d"))), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> np.ndarray:
    """Share the sum of ``sizes`` by weight; who would exceed ``most`` times the own size stops there, the rest is shared anew."""
    size, weight = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    total, cap = size.sum(), most * size
    done = np.zeros(len(size), bool)
    out = np.zeros(len(size))
    while not done.all():
        left = max(0.0, total - cap[done].sum())
        out = np.where(done, cap, left * weight / weight[~done].sum())
        over = ~done & (out > cap)
        if not over.any():
            break
        done |= over
        out = np.where(done, cap, out)
    return out


def quotas(blocks: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); sums are exact, and shards differ by one block at most."""
    out = np.zeros((shards, len(blocks)), np.int64)

    def split(lo: int, hi: int, counts: np.ndarray, sizes: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, int(sizes[: mid - lo].sum()), method="marginals") if counts.sum() else counts
        split(lo, mid, left, sizes[: mid - lo])
        split(mid, hi, counts - left, sizes[mid - lo :])

    counts = np.asarray(blocks, np.int64)
    total = int(counts.sum())
    split(0, shards, counts, np.array([total * (i + 1) // shards - total * i // shards for i in range(shards)], np.int64))
    return out


def block_of(blocks: Column, level: int, seed: int = SEED) -> Column:
    """The block of a row by its id and bytes, of so many at that level; with the bytes, rows without an id spread."""
    return F.shiftrightunsigned(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "id", "bytes"), 32) * blocks, 32)


def _largest_first(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the largest document on, each that still fits the source's rest is taken once more."""
    rows = rows.assign(all=rows["size"] * rows["n"]).sort_values(["all", "h", "bytes"], ascending=[False, True, True])
    left, taken = float(rows["rest"].iloc[0]), []
    for size in rows["all"].to_numpy():
        taken.append(0 < size <= left)
        left -= size if taken[-1] else 0
    return rows[taken][["rank", "id", "bytes", "size"]]


@dataclass
class Level:
    """Blocks of some documents (all, or those of the blocks in which targets fell one level up), and what becomes of each.

    blocks: of each source, how many; table: rank, block, fate, shards. A block of fate 0 is decided: its documents' copies go to
    ``shards``. With 1 the next level decides whether there is one copy more, with 2 the list of the documents taken.
    """

    blocks: np.ndarray
    table: pa.Table


def _walk(words: np.ndarray, rest: float, edge_words: int, order: np.ndarray) -> tuple[int, int]:
    """How many blocks in ``order`` fit the rest, and how many after them are the edge."""
    ends = np.cumsum(words[order])
    fit = int(np.searchsorted(ends, rest, side="right"))
    base = ends[fit - 1] if fit else 0
    if fit == len(order) or rest - base <= 0:
        return fit, 0
    return fit, max(1, int(np.searchsorted(ends[fit:] - base, edge_words, side="right")))


def _sums(sizes: DataFrame, blocks: np.ndarray, level: int, seed: int) -> list[np.ndarray]:
    """The words of each block, by source; a row a block comes to the driver."""
    known = _counted(sizes, blocks)
    rows = known.groupBy("rank", block_of(F.col("blocks"), level, seed).alias("block")).agg(F.sum("size").alias("words")).toArrow()
    out = [np.zeros(int(b), np.int64) for b in blocks]
    for rank, block, words in zip(*(rows.column(i).to_numpy() for i in range(3))):
        out[rank][block] = words
    return out


def _counted(df: DataFrame, blocks: np.ndarray) -> DataFrame:
    """With the column blocks: of the row's source."""
    counts = df.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "rank_ int, blocks long")  # a row a source
    return df.join(F.broadcast(counts), F.col("rank") == F.col("rank_")).drop("rank_")


def _table(rank: np.ndarray, block: np.ndarray, fate: np.ndarray, shards: list[list[int]]) -> pa.Table:
    return pa.table({"rank_": pa.array(rank, pa.int32()), "block_": pa.array(block, pa.int64()), "fate": pa.array(fate, pa.int32()), "shards": pa.array(shards, pa.list_(pa.int32()))})


@dataclass
class Mix:
    """A plan: sources in order, their sizes and targets, and the levels' blocks."""

    sources: list
    kinds: tuple[str, str]
    size: np.ndarray
    target: np.ndarray
    shards: int
    levels: list[Level]
    taken: DataFrame | None
    seed: int

    def placed(self, df: DataFrame, size: Column, some: Column) -> DataFrame:
        """Rows with id, source, bytes and others, and source_size, target and shards (array, one by copy); ``size``: the row's words, ``some``: whether it has any.

        A row's block decides, but for the rows of edge blocks, which are joined with those taken from them.
        """
        spark = df.sparkSession
        facts = [(i, x, int(n), float(t)) for i, (x, n, t) in enumerate(zip(self.sources, self.size, self.target))]
        sources = spark.createDataFrame(facts, f"rank int, source_ {self.kinds[1]}, source_size long, target double")  # a row a source
        rows = df.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("shards", F.array().cast("array<int>"))
        done: list[DataFrame] = []
        keep = rows.columns
        for i, level in enumerate(self.levels):
            blocks = spark.createDataFrame(level.table).withColumnRenamed("shards", "more")
            rows = _counted(rows, level.blocks).withColumn("block", block_of(F.col("blocks"), i, self.seed))
            rows = rows.join(F.broadcast(blocks), (F.col("rank") == F.col("rank_")) & (F.col("block") == F.col("block_")), "left")
            rows = rows.withColumn("shards", F.concat("shards", F.coalesce("more", F.array().cast("array<int>")))).withColumn("fate", F.coalesce("fate", F.lit(0)))
            done.append(rows.filter("fate = 0").select(keep))
            edge = rows.filter("fate = 2").select(*keep, size.alias("words_"))
            if self.taken is not None:
                done.append(edge.join(self.taken, (F.col("rank") == F.col("rank_")) & F.col("id").eqNullSafe(F.col("id_")) & F.col("bytes").eqNullSafe(F.col("bytes_")) & (F.col("words_") == F.col("size_")), "left").withColumn("shards", F.concat("shards", F.coalesce("more", F.array().cast("array<int>")))).select(keep))
            rows = rows.filter("fate = 1").select(keep)
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out.withColumn("shards", F.when(some, F.col("shards")).otherwise(F.array().cast("array<int>")))


def drawn(words: list[np.ndarray], target: np.ndarray, shards: int, seed: int = SEED, most: float = MOST, edge_words: int = EDGE_WORDS) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The table of a first level from each source's blocks' words; the rest of each source's target at its edge; and the shard that has the edge."""
    permuted, fits, edges, fulls = [], [], [], []
    rests = np.zeros(len(words))
    for i, own in enumerate(words):
        size = int(own.sum())
        full = min(int(target[i] // size), int(most)) if size else 0
        rest = float(target[i] - full * size) if size and full < most else 0.0
        laps = [np.random.default_rng([seed, i, lap]).permutation(len(own)) for lap in range(full + 1)]
        fit, edge = _walk(own, rest, edge_words, laps[-1])
        rests[i] = rest - own[laps[-1][:fit]].sum()
        permuted.append(laps), fits.append(fit), edges.append(edge), fulls.append(full)
    counts = [full * len(own) + fit + (edge > 0) for own, full, fit, edge in zip(words, fulls, fits, edges)]
    ends = np.cumsum(quotas(counts, shards, seed), 0)
    rank, block, fate, lists, edge_shard = [], [], [], [], np.zeros(len(words), np.int64)
    for i, (own, laps, fit, edge, full) in enumerate(zip(words, permuted, fits, edges, fulls)):
        n = len(own)
        shard = np.searchsorted(ends[:, i], np.arange(counts[i]), side="right")
        columns = []
        for lap, order in enumerate(laps):
            at = np.empty(n, np.int64)
            at[order] = np.arange(n)
            columns.append(shard[lap * n + at] if lap < full else np.where(at < fit, shard[np.minimum(lap * n + at, max(0, counts[i] - 1))] if counts[i] else 0, -1))
        fates = np.zeros(n, np.int32)
        if edge:
            edge_shard[i] = shard[-1]
            own_edge = laps[-1][fit : fit + edge]
            fates[own_edge] = 1 if own[own_edge].sum() > 2 * edge_words else 2
        rank += [i] * n
        block += range(n)
        fate += fates.tolist()
        lists += [[int(x) for x in row if x >= 0] for row in zip(*(c.tolist() for c in columns))]
    return _table(np.array(rank, np.int32), np.array(block, np.int64), np.array(fate, np.int32), lists), rests, edge_shard


def _refined(words: list[np.ndarray], rests: np.ndarray, edge_shard: np.ndarray, level: int, seed: int, edge_words: int) -> tuple[pa.Table, np.ndarray]:
    """The same for the blocks in which targets fell: as many smaller ones as fit go to the edge's shard."""
    rank, block, fate, lists = [], [], [], []
    rests = rests.copy()
    for i, own in enumerate(words):
        order = np.random.default_rng([seed, i, 1000 + level]).permutation(len(own))
        fit, edge = _walk(own, rests[i], edge_words, order)
        rests[i] -= own[order[:fit]].sum()
        fates = np.zeros(len(own), np.int32)
        own_edge = order[fit : fit + edge]
        edge_size = own[own_edge].sum()
        fates[own_edge] = 1 if 2 * edge_words < edge_size < own.sum() else 2  # what smaller blocks don't divide are rows of one fate
        more: list[list[int]] = [[] for _ in own]
        for j in order[:fit].tolist():
            more[j] = [int(edge_shard[i])]
        rank += [i] * len(own)
        block += range(len(own))
        fate += fates.tolist()
        lists += more
    return _table(np.array(rank, np.int32), np.array(block, np.int64), np.array(fate, np.int32), lists), rests


def _edge(sizes: DataFrame, level: Level, i: int, fate: int, seed: int) -> DataFrame:
    """The rows of the level's blocks of that fate."""
    mask = pa.compute.equal(level.table.column("fate"), fate)
    blocks = sizes.sparkSession.createDataFrame(level.table.filter(mask).select(["rank_", "block_"]))
    rows = _counted(sizes, level.blocks).withColumn("block", block_of(F.col("blocks"), i, seed))
    return rows.join(F.broadcast(blocks), (F.col("rank") == F.col("rank_")) & (F.col("block") == F.col("block_"))).select(sizes.columns)


def plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED, edge_words: int | None = None, most_blocks: int | None = None) -> Mix:
    """Which blocks and documents the mix takes, and where they go; columns id, source, bytes, size (a table that is cheap to read again)."""
    edge_words, most_blocks = edge_words or EDGE_WORDS, most_blocks or MOST_BLOCKS
    kinds = tuple(sizes.schema[c].dataType.simpleString() for c in ("id", "source"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()  # a row a source
    rows.sort(key=lambda r: (r["source"] is None, str(r["source"]).encode()))
    own = np.array([r["size"] for r in rows], np.int64)
    target = targets(own, [weights[i % len(weights)] for i in range(len(rows))], most)
    shards = shards or min(MOST_SHARDS, max(1, -(-int(target.sum()) // SHARD_WORDS)))
    words = max(block_words, -(-int(own.sum()) // most_blocks))
    blocks = np.maximum(-(-own // words), np.minimum(LEAST_BLOCKS, [r["rows"] for r in rows])).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    facts = sizes.sparkSession.createDataFrame([(i, r["source"]) for i, r in enumerate(rows)], f"rank int, source_ {kinds[1]}")
    ranked = sizes.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    table, rests, edge_shard = drawn(_sums(ranked, blocks, 0, seed), target, shards, seed, most, edge_words)
    levels, taken, left = [Level(blocks, table)], [], ranked
    while len(rows):
        i, level = len(levels) - 1, levels[-1]
        fates = np.asarray(level.table.column("fate"))
        if (fates == 2).any():
            small = _edge(left, level, i, 2, seed).groupBy("rank", "id", "bytes", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64(F.lit(seed), "id"))
            rest = sizes.sparkSession.createDataFrame([(j, float(x)) for j, x in enumerate(rests)], "rank_ int, rest double")
            small = small.join(F.broadcast(rest), F.col("rank") == F.col("rank_")).select("rank", "id", "bytes", "size", "n", "h", "rest")
            # a group has EDGE_WORDS words, or one document of more
            taken.append(small.groupBy("rank").applyInPandas(_largest_first, f"rank int, id {kinds[0]}, bytes int, size long"))
        if not (fates == 1).any():
            break
        left = cut(_edge(left, level, i, 1, seed))
        size = {r["rank"]: r["size"] for r in left.groupBy("rank").agg(F.sum("size").alias("size")).collect()}
        inside = np.array([size.get(j, 0) for j in range(len(rows))], np.int64)
        words = max(block_words, edge_words // 4, -(-int(inside.sum()) // most_blocks))
        more = np.where(inside > 0, np.maximum(2, -(-inside // words)), 0)
        table, rests = _refined(_sums(left, more, i + 1, seed), np.where(inside > 0, rests, 0.0), edge_shard, i + 1, seed, edge_words)
        levels.append(Level(more, table))
    chosen = None
    if taken:
        chosen = taken[0]
        for more_taken in taken[1:]:
            chosen = chosen.unionByName(more_taken)
        to = sizes.sparkSession.createDataFrame([(j, [int(x)]) for j, x in enumerate(edge_shard)], "rank_ int, more array<int>")
        chosen = cut(chosen.select(F.col("rank").alias("rank_"), F.col("id").alias("id_"), F.col("bytes").alias("bytes_"), F.col("size").alias("size_")).join(F.broadcast(to), "rank_"))
    return Mix([r["source"] for r in rows], kinds, own, target, shards, levels, chosen, seed)


def _sizes(docs: DataFrame, id_column: str, source_column: str, column: str) -> DataFrame:
    return cut(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("source"), F.octet_length(F.col(f"`{column}`")).alias("bytes"), size_of(F.col(f"`{column}`")).alias("size")))


def report(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", column: str = "text", **options: object) -> DataFrame:
    """A row a document: id, size, source_size, target, taken, copies, shards (comma-joined)."""
    sizes = _sizes(docs, id_column, source_column, column)
    out = plan(sizes, **options).placed(sizes, F.col("size"), F.col("size") > 0).withColumn("copies", F.size("shards").cast("long"))
    return out.select(F.col("id").alias(id_column), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.array_join("shards", ",").alias("shards"))


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", column: str = "text", columns: Iterable[str] | None = None, seed: int = SEED, **options: object) -> DataFrame:
    """The mix: all columns of the documents taken, a row a copy, mix_shard and mix_copy; a partition a shard, shuffled within it."""
    planned = plan(_sizes(docs, id_column, source_column, column), seed=seed, **options)
    names = list(columns or [c for c in docs.columns if c not in {"mix_shard", "mix_copy"}])
    own = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("source"), F.octet_length(F.col(f"`{column}`")).alias("bytes"), F.col(f"`{column}`").alias("text_"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("own"))
    placed = planned.placed(own, size_of(F.col("text_")), F.col("text_").rlike(WORD))
    copies = placed.select("id", "own", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed), F.col("shard"), F.col("copy"), F.col("id"))
    spread = copies.repartitionById(planned.shards, F.col("shard")).sortWithinPartitions("shard", order)
    return spread.select(*(F.col(f"own.c{i}").alias(c) for i, c in enumerate(names)), F.col("copy").alias("mix_copy"), F.col("shard").alias("mix_shard"))
