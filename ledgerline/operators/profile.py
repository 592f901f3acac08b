"""Profiles: a row a column.

Counts, ends, means and deviations are one aggregation. Cardinalities and exact quartiles come from the counts of each column's distinct
values: these are cut to ranges, and sums over the ranges say in which range and at which value a quartile lies, so
that no task holds a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.functions.lineage import cut

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _is_number(kind: str) -> bool:
    return kind.split("(")[0] in NUMBERS


def _text(c: Column, kind: str) -> Column:
    """A value as text; nested ones as JSON."""
    return F.to_json(c) if kind.split("<")[0] in ("struct", "array", "map", "variant") else F.base64(c) if kind == "binary" else c.cast("string")


def value_counts(df: DataFrame, kinds: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, v, s, n): each distinct value of each column, numbers in v and others in s, and how often it occurs; missing ones left out."""
    cells = []
    for name, kind in kinds.items():
        c = F.col(f"`{name}`")
        there = ~X.missing(c, kind)
        v, s = (F.when(there, c.cast("double")), F.lit(None).cast("string")) if _is_number(kind) else (F.lit(None).cast("double"), F.when(there, _text(c, kind)))
        cells.append(F.struct(F.lit(name).alias("column_name"), v.alias("v"), s.alias("s")))
    cell = df.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*").filter("v is not null or s is not null")
    return cell.groupBy(*by, "column_name", "v", "s").agg(F.count(F.lit(1)).alias("n"))


def quartiles(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, cardinality, p25, p50, p75) from value_counts; quartiles are interpolated linearly."""
    keys = [*by, "column_name"]
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # texts are all one in v, and go by their hashes, without themselves
    hashed = counts.select(*keys, "v", "n", F.when(F.col("v").isNull(), F.xxhash64("s")).alias("_h"))
    ranged = cut(hashed.repartitionByRange(parts, *keys, "v", "_h")).withColumn("_part", F.spark_partition_id())
    # a row a range and column
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(w), "cardinality": F.sum("_d").over(w)})
    # only ranges in which a quartile lies are looked into
    at = {q: (F.col("_all") - 1) * share for q, share in QUARTILES.items()}
    inside = lambda low, n, x: (low <= x) & (x < low + n)
    ends = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    asked = sums.withColumn("_asked", F.exists(F.array(*ends), lambda x: inside(F.col("_before"), F.col("_n"), x)))
    within = ranged.filter("v is not null").join(asked.filter("_asked").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_before", "_all"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_part") == F.col("_p")])
    placed = within.withColumn("_low", F.col("_before") + F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    picks = [F.max(F.when(inside(F.col("_low"), F.col("n"), f(x)), F.col("v"))).alias(f"{q}{e}") for q, x in at.items() for e, f in (("a", F.floor), ("b", F.ceil))]
    picked = placed.groupBy(*keys).agg(F.first("_all").alias("_all"), *picks)
    values = [(F.col(f"{q}a") + (F.col(f"{q}b") - F.col(f"{q}a")) * (x - F.floor(x))).alias(q) for q, x in at.items()]
    cardinality = sums.select(*keys, "cardinality").distinct()
    found = picked.select(*[F.col(k).alias(f"_{k}") for k in keys], *values)
    return cardinality.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(*keys, "cardinality", *QUARTILES)


def profile(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """column_name, rows, null_fraction, cardinality, and of numbers min, max, mean, std and exact quartiles; by groups if asked."""
    kinds = {c: k for c, k in df.dtypes if c not in by and (columns is None or c in columns)}
    aggs, parts = [F.count(F.lit(1)).alias("rows")], []
    for i, (name, kind) in enumerate(kinds.items()):
        c = F.col(f"`{name}`")
        gone = X.missing(c, kind)
        aggs.append(F.count_if(gone).alias(f"g{i}"))
        row = [F.lit(name).alias("column_name"), F.col("rows"), F.round(F.coalesce(F.try_divide(F.col(f"g{i}"), F.col("rows")), F.lit(0.0)), digits).alias("null_fraction")]
        if _is_number(kind):
            v = F.when(~gone, c.cast("double"))
            aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
            more = [F.col(f"a{i}") + 0.0, F.col(f"b{i}") + 0.0, F.col(f"m{i}"), F.col(f"s{i}")]
        else:
            more = [F.lit(None).cast("double")] * 4
        row += [F.round(x, digits).alias(n) for x, n in zip(more, ("min_value", "max_value", "mean_value", "std_value"))]
        parts.append(F.struct(*row))
    one = df.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*parts)).alias("p")).select(*by, "p.*")
    keys = [*by, "column_name"]
    more = quartiles(value_counts(df, kinds, by), by).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("cardinality").alias("_cardinality"), *QUARTILES)
    both = one.join(more, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return both.select(*keys, "rows", "null_fraction", F.coalesce("_cardinality", F.lit(0)).alias("cardinality"), "min_value", "max_value", "mean_value", "std_value", *[F.round(q, digits).alias(q) for q in QUARTILES])


def sample_values(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The smallest distinct values of a column, in order."""
    return df.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value is not null").distinct().orderBy("value").limit(limit)


def first_values(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 5) -> DataFrame:
    """(column_name, place, value): each column's first few distinct values as they come in the files (a sample report)."""
    kinds = {c: k for c, k in df.dtypes if columns is None or c in columns}
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(~X.missing(F.col(f"`{c}`"), k), _text(F.col(f"`{c}`"), k)).alias("value")) for c, k in kinds.items()])
    cell = df.select(F.monotonically_increasing_id().alias("ord"), F.explode(cells).alias("cell")).select("ord", "cell.*").filter("value is not null")
    first = cell.groupBy("column_name", "value").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("column_name").orderBy("ord")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("column_name", "place", "value")


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Baseline statistics: column_name, n, mean_value, std_value, min_value, max_value, null_fraction, cardinality; columns with under two numbers have none."""
    aggs, parts, cells = [F.count(F.lit(1)).alias("rows")], [], []
    for i, name in enumerate(columns):
        v = X.number(F.col(f"`{name}`"))
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
        parts.append(F.struct(F.lit(name).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean_value"), F.col(f"s{i}").alias("std_value"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value"), (1 - F.try_divide(F.col(f"n{i}"), F.col("rows"))).alias("null_fraction")))
        cells.append(F.struct(F.lit(name).alias("column_name"), v.alias("v")))
    one = df.agg(*aggs).select(F.explode(F.array(*parts)).alias("p")).select("p.*").filter("n >= 2")
    distinct = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("v is not null").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("cardinality"))
    return one.join(distinct, "column_name")
