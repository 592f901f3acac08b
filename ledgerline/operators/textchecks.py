"""Checks of texts and of model outputs: bags of words, vectors, JSON schemas, violation rates, quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.lineage import cut
from ledgerline.plans.contract import Config


def bag(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, token, weight): the mean over non-blank texts of each token's share of a text's words; lower case, split at white space."""
    words = F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda w: w != "")
    texts = df.select(*by, words.alias("w")).filter(F.size("w") > 0).withColumn("share", 1 / F.size("w"))
    totals = texts.groupBy(*by).agg(F.count(F.lit(1)).alias("texts"))
    sums = texts.select(*by, "share", F.explode("w").alias("token")).groupBy(*by, "token").agg(F.sum("share").alias("s"))
    joined = sums.join(totals, list(by)) if by else sums.crossJoin(totals)  # without groups, one row
    return joined.select(*by, "token", (F.col("s") / F.col("texts")).alias("weight"))


def cosine_distance(a: DataFrame, b: DataFrame, key: str = "token", weight: str = "weight") -> DataFrame:
    """One row: 1 - cosine of two vectors in long form, 1 where one has no length; rounded to 6 digits."""
    dot = a.select(key, F.col(weight).alias("x")).join(b.select(key, F.col(weight).alias("y")), key, "full_outer")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    n = dot.agg(F.sum(x * y).alias("d"), F.sqrt(F.sum(x * x)).alias("a"), F.sqrt(F.sum(y * y)).alias("b"))
    return n.select(F.round(F.when((F.coalesce("a", F.lit(0.0)) == 0) | (F.coalesce("b", F.lit(0.0)) == 0), 1.0).otherwise(1 - F.col("d") / (F.col("a") * F.col("b"))), 6).alias("distance"))


def drift_status(distance: Column, config: Config = Config()) -> Column:
    """FAIL, WARN or PASS of a distance; the limits themselves count."""
    return F.when(distance >= config.embedding_fail, "FAIL").when(distance >= config.embedding_warn, "WARN").otherwise("PASS")


def centroids(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, place, value): the mean vector of each group."""
    return df.select(by, F.posexplode(column).alias("place", "v")).groupBy(by, "place").agg(F.avg(F.col("v").cast("double")).alias("value"))


def json_faults(record: Column, required: Mapping[str, str]) -> Column:
    """Array of what is wrong with a JSON text by a schema of required fields (string, number, integer): missing, or of another type; null is a wrong type, true and false pass as numbers."""
    v = F.try_parse_json(record)
    faults = []
    for name, kind in required.items():
        got = F.try_variant_get(v, f"$.{name}", "variant")
        shape = F.schema_of_variant(got)
        fits = {"string": shape == "STRING", "number": shape.rlike("^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)"), "integer": shape.rlike("^(BIGINT|BOOLEAN)")}[kind]
        faults.append(F.when(got.isNull(), F.lit(f"{name}: missing")).when(~fits, F.lit(f"{name}: not a {kind}")))
    return F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(F.array_compact(F.array(*faults)))


def prompt_schema(df: DataFrame, record: str, required: Mapping[str, str], config: Config = Config()) -> DataFrame:
    """One row: records, violations, rate and status."""
    n = df.select((F.size(json_faults(F.col(record), required)) > 0).alias("bad")).agg(F.count(F.lit(1)).alias("records"), F.count_if("bad").alias("violations"))
    rate = F.coalesce(F.col("violations") / F.when(F.col("records") > 0, F.col("records")), F.lit(0.0))
    return n.select("records", "violations", F.round(rate, 6).alias("rate"), F.when(rate == 0, "PASS").when(rate < config.prompt_fail_rate, "WARN").otherwise("FAIL").alias("status"))


def split(df: DataFrame, record: str, required: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with schema_errors)."""
    judged = df.withColumn("schema_errors", json_faults(F.col(record), required))
    return judged.filter(F.size("schema_errors") == 0).drop("schema_errors"), judged.filter(F.size("schema_errors") > 0)


def error_histogram(quarantined: DataFrame, samples: str, most: int = 3) -> DataFrame:
    """(error, records, samples): errors by number, with the smallest few values of a column."""
    rows = quarantined.select(F.explode("schema_errors").alias("error"), F.col(samples).cast("string").alias("s"))
    w = Window.partitionBy("error").orderBy("s")
    few = rows.distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).groupBy("error").agg(F.array_join(F.array_sort(F.collect_list("s")), ",").alias("samples"))
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("records")).join(few, "error").select("error", "records", "samples")


def requeue(quarantined: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows whose errors are all allowed."""
    return quarantined.filter(F.size(F.array_except("schema_errors", F.array(*map(F.lit, allowed)).cast("array<string>"))) == 0)


PARTS = ("decision", "confidence", "reasoning")


def verdict_faults(record: Column) -> Column:
    """Kinds of violation of a model's answer (a variant) by its field ``verdict``.

    None, or null: missing_verdict. An object: missing_<the first of its parts that it lacks>; confidence_out_of_range, or
    confidence_type_mismatch where it is there and no number (true and false pass as numbers). A text: unparseable_json, or
    invalid_json_structure where it is JSON and no object; an object in a text is fine as it is. Anything else: unexpected_type.
    """
    v = F.try_variant_get(record, "$.verdict", "variant")
    shape = F.schema_of_variant(v)
    part = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    lacking = F.coalesce(*[F.when(part(k).isNull(), F.lit(f"missing_{k}")) for k in PARTS])
    confidence = part("confidence")
    there = confidence.isNotNull() & ~F.is_variant_null(confidence)
    numeric = F.schema_of_variant(confidence).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    number = F.coalesce(F.try_variant_get(confidence, "$", "double"), F.try_variant_get(confidence, "$", "boolean").cast("double"))
    odd = F.when(there & numeric & ~F.coalesce(number.between(0.0, 1.0), F.lit(False)), "confidence_out_of_range").when(there & ~numeric, "confidence_type_mismatch")
    parsed = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    text = F.when(parsed.isNull(), F.array(F.lit("unparseable_json"))).when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.array(F.lit("invalid_json_structure"))).otherwise(F.array().cast("array<string>"))
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.array(F.lit("missing_verdict")))
        .when(F.startswith(shape, F.lit("OBJECT")), F.array_compact(F.array(lacking, odd)))
        .when(shape == "STRING", text)
        .otherwise(F.array(F.lit("unexpected_type")))
    )


def violation_breakdown(faults: DataFrame, column: str) -> DataFrame:
    """(violation, records): how many records have each kind."""
    return faults.select(F.explode(column).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("records"))


def violation_trend(df: DataFrame, bad: str, order: Sequence[str], config: Config = Config()) -> DataFrame:
    """One row: rate of bad rows, its status, and whether the later half (by ``order``) has more of them; no rows are an ERROR.

    Rows are numbered by a count per range of the order and a sum over ranges, not by one window over all. They are judged once, before the ranges are
    sampled.
    """
    rank = numbered(cut(df.select(*order, F.col(bad).cast("int").alias("bad"))), order, "n")
    total = rank.count()
    half = total // 2
    got = rank.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("bad"), F.lit(0)).alias("violations"), F.avg(F.when(F.col("n") <= half, F.col("bad"))).alias("a"), F.avg(F.when(F.col("n") > half, F.col("bad"))).alias("b"))
    rate = F.coalesce(F.col("violations") / F.when(F.col("records") > 0, F.col("records")), F.lit(0.0))
    move = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    trend = F.when(move > config.llm_trend_delta, "increasing").when(move < -config.llm_trend_delta, "decreasing").otherwise("stable")
    status = F.when(F.col("records") == 0, "ERROR").when(rate == 0, "PASS").when(rate < config.llm_violation_rate, "WARN").otherwise("FAIL")
    return got.select("records", "violations", F.round(rate, 6).alias("rate"), status.alias("status"), trend.alias("trend"), (rate > config.llm_violation_rate).alias("logged"))


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in ranges by ``order``, with the range's number as _part. Ranges are written, so that all who read them see the same; a key that has many rows lies in several."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order)).withColumn("_part", F.spark_partition_id())


def numbered(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Number all rows, or those of each key, from 1 by ``order``, in ranges that are sorted apart: no task gets all rows, nor all of a key."""
    ranged = in_ranges(df, [*by, *order])
    placed = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    counts = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range and key
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if not by:
        return placed.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate(by)]
    before = before.select(*keys, F.col("_part").alias("_range"), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(by)] + [F.col("_part") == F.col("_range")]
    return placed.join(before, same).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)
