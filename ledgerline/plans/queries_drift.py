"""Queries: drift and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import drift, profile
from ledgerline.plans.registry import query, read

SPLIT = "2024-01-16"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statistics of the month's first half, and of its second with stretched values, some of them lost."""
    e = read(spark, sf_dir, "events").select("ts", "user_id", "value")
    old = e.filter(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    new = e.filter(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")).withColumn("value", F.when(F.col("user_id") % 10 != 0, F.col("value") * 3 + 1))
    return profile.column_stats(old, ["value", "user_id"]), profile.column_stats(new, ["value", "user_id"])


def _stats_sql(source: str) -> str:
    one = lambda c: f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean_value, stddev_samp({c}) AS std_value, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, 1 - count({c}) / count(*) AS null_fraction, count(DISTINCT {c}) AS cardinality FROM {source}"
    return f"{one('value')} UNION ALL {one('user_id')}"


_OLD = f"(SELECT user_id, value FROM events WHERE ts < TIMESTAMP '{SPLIT}')"
_NEW = f"(SELECT user_id, CASE WHEN user_id % 10 <> 0 THEN value * 3 + 1 END AS value FROM events WHERE ts >= TIMESTAMP '{SPLIT}')"


def _drift_sql(z_warn: str, z_fail: str, n_warn: str, n_fail: str, severity: str) -> str:
    level = f"CASE WHEN {severity} IS NOT NULL THEN {severity} WHEN s = 'FAIL' THEN 'HIGH' WHEN s = 'WARN' THEN 'MEDIUM' ELSE 'LOW' END"
    return f"""
WITH c AS ({_stats_sql(_NEW)}), b AS ({_stats_sql(_OLD)}), j AS (
  SELECT c.column_name, abs(c.mean_value - b.mean_value) / b.std_value AS z, c.std_value / b.std_value AS r, (c.min_value < b.min_value)::INTEGER + (c.max_value > b.max_value)::INTEGER AS o,
    c.null_fraction - b.null_fraction AS d, b.null_fraction = 0 AND c.null_fraction > 0 AS fresh, c.cardinality / b.cardinality AS k
  FROM c JOIN b USING (column_name)), r AS (
  SELECT column_name, 'drift_mean' AS check_type, CASE WHEN z > {z_fail} THEN 'FAIL' WHEN z > {z_warn} THEN 'WARN' ELSE 'PASS' END AS s, round(z, 4) AS measure FROM j UNION ALL
  SELECT column_name, 'drift_variance', CASE WHEN r > 4 THEN 'FAIL' WHEN r > 2 OR r < 0.25 THEN 'WARN' ELSE 'PASS' END, round(r, 4) FROM j UNION ALL
  SELECT column_name, 'drift_outliers', CASE o WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END, o::DOUBLE FROM j UNION ALL
  SELECT column_name, 'drift_null_fraction', CASE WHEN d > {n_fail} THEN 'FAIL' WHEN fresh OR d > {n_warn} THEN 'WARN' ELSE 'PASS' END, round(d, 4) FROM j UNION ALL
  SELECT column_name, 'drift_cardinality', CASE WHEN k > 5 THEN 'FAIL' WHEN k > 2 OR k < 0.5 THEN 'WARN' ELSE 'PASS' END, round(k, 4) FROM j)
SELECT column_name, check_type, s AS status, {level} AS severity, measure FROM r"""


@query(_drift_sql("2", "3", "0.05", "0.2", "NULL"))
def drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five drift checks of two columns."""
    old, new = _halves(spark, sf_dir)
    return drift.drift(new, old)


@query(_drift_sql("CASE WHEN column_name = 'value' THEN 0.5 ELSE 2 END", "CASE WHEN column_name = 'value' THEN 1.0 ELSE 3 END", "CASE WHEN column_name = 'value' THEN 0.01 ELSE 0.05 END", "CASE WHEN column_name = 'value' THEN 0.02 ELSE 0.2 END", "CASE WHEN column_name = 'value' THEN 'CRITICAL' END"))
def drift_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under a field's own limits and severity."""
    old, new = _halves(spark, sf_dir)
    rules = spark.createDataFrame([("value", 0.5, 1.0, 0.01, 0.02, "CRITICAL")], "column_name string, drift_z_warn double, drift_z_fail double, null_warn double, null_fail double, severity string")
    return drift.drift(new, old, rules=rules)


@query(f"SELECT column_name, n::BIGINT AS n, round(mean_value, 4) AS mean_value, round(std_value, 4) AS std_value, min_value, max_value, round(null_fraction, 4) AS null_fraction, cardinality::BIGINT AS cardinality FROM ({_stats_sql(_NEW)})")
def baseline_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that a baseline keeps."""
    s = _halves(spark, sf_dir)[1]
    return s.select("column_name", "n", *(F.round(c, 4).alias(c) for c in ("mean_value", "std_value")), "min_value", "max_value", F.round("null_fraction", 4).alias("null_fraction"), "cardinality")


@query("SELECT event_type AS column_name, round(avg(value), 2) AS mean_value, round(stddev_samp(value), 2) AS std_value, round(1 - count(DISTINCT user_id) / count(*), 2) AS null_fraction, count(DISTINCT user_id)::DOUBLE AS cardinality FROM events GROUP BY 1")
def baseline_promote_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics read back from the texts of a report."""
    s = read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("m"), F.round(F.stddev_samp("value"), 2).alias("s"), F.round(1 - F.count_distinct("user_id") / F.count(F.lit(1)), 2).alias("f"), F.count_distinct("user_id").alias("k"))
    row = lambda check, actual, want: F.struct(F.lit(check).alias("check_type"), actual.alias("actual_value"), want.alias("expected"))
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("$") else F.col(x[1:]).cast("string") for x in p])
    rows = F.array(row("drift_mean", text("mean=", "$m", " (z=0.1)"), text("baseline mean=1.0 ± ", "$s")), row("drift_null_fraction", text("null_fraction=", "$f"), F.lit("")), row("drift_cardinality", text("cardinality=", "$k", " (ratio=1)"), F.lit("")))
    return drift.promoted(s.select(F.col("event_type").alias("column_name"), F.explode(rows).alias("r")).select("column_name", "r.*"))


@query("SELECT o_orderstatus AS key, count(*)::BIGINT AS n, 'old' AS version FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT 'P', 0::BIGINT, 'new' UNION ALL SELECT 'Q', 0::BIGINT, 'new'")
def baseline_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows with two of them replaced or added."""
    old = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit("old"))
    fresh = spark.createDataFrame([("P", 0, "new"), ("Q", 0, "new")], "key string, n bigint, version string")
    return drift.upsert(old, fresh, ["key"])


@query("SELECT key, n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'stock/orders' ELSE 'trade/' || o_orderstatus END AS key, count(*)::BIGINT AS n FROM orders GROUP BY 1) WHERE NOT starts_with(key, 'trade/')")
def baseline_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines without those of one contract."""
    key = F.when(F.col("o_orderstatus") == "P", "stock/orders").otherwise(F.concat(F.lit("trade/"), F.col("o_orderstatus")))
    return drift.cleared(read(spark, sf_dir, "orders").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")), "trade")
