"""Drift: current statistics against a baseline's, five checks a column, in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.contract import Config


def _row(check: str, status: Column, severity: Column, value: Column) -> Column:
    return F.struct(F.lit(check).alias("check_type"), status.alias("status"), severity.alias("severity"), F.round(value, 4).alias("measure"))


def drift(current: DataFrame, baseline: DataFrame, config: Config = Config(), rules: DataFrame | None = None) -> DataFrame:
    """column_name, check_type, status, severity, measure; both sides as profile.column_stats makes them.

    ``rules``: column_name, drift_z_warn, drift_z_fail, null_warn, null_fail and severity, each null where the default holds.
    """
    both = current.alias("c").join(baseline.alias("b"), "column_name")
    if rules is not None:
        both = both.join(rules.alias("r"), "column_name", "left")
    own = lambda name, default: F.coalesce(F.col(f"r.{name}"), F.lit(default)) if rules is not None else F.lit(default)
    c, b = (lambda n: F.col(f"c.{n}")), (lambda n: F.col(f"b.{n}"))
    z_warn, z_fail = own("drift_z_warn", config.drift_z_warn), own("drift_z_fail", config.drift_z_fail)
    n_warn, n_fail = own("null_warn", config.drift_null_warn), own("null_fail", config.drift_null_fail)
    flat = F.coalesce(b("std_value"), F.lit(0.0)) == 0
    z = F.abs(c("mean_value") - b("mean_value")) / b("std_value")
    moved = c("mean_value") != b("mean_value")
    mean = _row(
        "drift_mean",
        F.when(b("std_value").isNull(), "PASS").when(flat, F.when(moved, "WARN").otherwise("PASS")).when(z > z_fail, "FAIL").when(z > z_warn, "WARN").otherwise("PASS"),
        F.when(b("std_value").isNull(), "LOW").when(flat, F.when(moved, "MEDIUM").otherwise("LOW")).when(z > z_fail, "HIGH").when(z > z_warn, "MEDIUM").otherwise("LOW"),
        F.when(~flat, z),
    )
    ratio = c("std_value") / F.when(~flat, b("std_value"))
    grown = flat & (c("std_value") > 0)
    wide = (ratio > config.drift_var_warn_high) | (ratio < config.drift_var_warn_low)
    variance = _row(
        "drift_variance",
        F.when(ratio > config.drift_var_fail_high, "FAIL").when(wide | grown, "WARN").otherwise("PASS"),
        F.when(ratio > config.drift_var_fail_high, "HIGH").when(wide | grown, "MEDIUM").otherwise("LOW"),
        ratio,
    )
    below, above = c("min_value") < b("min_value"), c("max_value") > b("max_value")
    outliers = _row("drift_outliers", F.when(below & above, "FAIL").when(below | above, "WARN").otherwise("PASS"), F.when(below & above, "HIGH").when(below | above, "MEDIUM").otherwise("LOW"), below.cast("double") + above.cast("double"))
    more = c("null_fraction") - b("null_fraction")
    new = (b("null_fraction") == 0) & (c("null_fraction") > 0)
    nulls = _row(
        "drift_null_fraction",
        F.when(more > n_fail, "FAIL").when(new | (more > n_warn), "WARN").otherwise("PASS"),
        F.when(more > n_fail, "HIGH").when(new | (more > n_warn), "MEDIUM").otherwise("LOW"),
        more,
    )
    times = c("cardinality") / F.when(b("cardinality") > 0, b("cardinality"))
    from_none = (b("cardinality") == 0) & (c("cardinality") > 0)
    odd = (times > config.drift_card_warn_high) | (times < config.drift_card_warn_low) | from_none
    cardinality = _row("drift_cardinality", F.when(times > config.drift_card_fail_high, "FAIL").when(odd, "WARN").otherwise("PASS"), F.when(times > config.drift_card_fail_high, "HIGH").when(odd, "MEDIUM").otherwise("LOW"), times)
    out = both.select("column_name", *([F.col("r.severity").alias("override")] if rules is not None else [F.lit(None).cast("string").alias("override")]), F.explode(F.array(mean, variance, outliers, nulls, cardinality)).alias("d"))
    return out.select("column_name", "d.check_type", "d.status", F.coalesce("override", "d.severity").alias("severity"), "d.measure")


def promoted(results: DataFrame) -> DataFrame:
    """Statistics read back from result texts: mean and its baseline's deviation, null fraction, cardinality; a row a column."""
    pick = lambda check, column, pattern: F.max(F.when(F.col("check_type") == check, F.regexp_extract(column, pattern, 1))).try_cast("double")
    return results.groupBy("column_name").agg(
        pick("drift_mean", "actual_value", r"mean=([^ ]+) \(").alias("mean_value"),
        pick("drift_mean", "expected", "± ([^ ]+)").alias("std_value"),
        pick("drift_null_fraction", "actual_value", r"null_fraction=([^ ]+)").alias("null_fraction"),
        pick("drift_cardinality", "actual_value", r"cardinality=([^ ]+)").alias("cardinality"),
    )


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows, those with a fresh one replaced."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def cleared(stored: DataFrame, contract_id: str | None = None) -> DataFrame:
    """Without the baselines of a contract, or of all."""
    return stored.filter(F.lit(False)) if contract_id is None else stored.filter(~F.startswith(F.col("key"), F.lit(f"{contract_id}/")))
