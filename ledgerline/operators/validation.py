"""A validation run: checks, drift against baselines, freshness, samples, and what a report says of it.

The order for a table is schema, fields, drift; then references; then freshness. What goes wrong while a table's checks are
planned is an ERROR row, not an exception. Nothing runs until results are asked for, and samples only for checks that failed.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import checks, drift, evolve, profile
from ledgerline.plans.contract import Config, Contract, Enforcement, Table

COLUMNS = ("check_id", "table_name", "column_name", "check_type", "status", "severity", "records_failing", "actual_value", "expected", "message")
STATS = "key string, column_name string, n bigint, mean_value double, std_value double, min_value double, max_value double, null_fraction double, cardinality bigint"
#: Types whose columns have statistics; booleans count as 0 and 1.
MEASURED = (*profile.NUMBERS, "boolean")


@dataclass(frozen=True)
class Freshness:
    """Which column tells a table's age, and when is now."""

    table: str
    column: str
    now: str


@dataclass(frozen=True)
class Run:
    """Results, the statistics that a baseline would keep, and the mode that holds."""

    results: DataFrame
    stats: DataFrame
    mode: str


def _whole(df: DataFrame, **more: object) -> DataFrame:
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, more.get(c, F.lit(None).cast("bigint" if c == "records_failing" else "string")))
    return df.select(*COLUMNS)


def _error(spark: SparkSession, table: str, what: str) -> DataFrame:
    return _whole(spark.createDataFrame([(f"{table}.checks", table, "", "table_checks", "ERROR", "HIGH", 0, "", what.split("\n")[0][:240])], "check_id string, table_name string, column_name string, check_type string, status string, severity string, records_failing bigint, expected string, message string"))


def table_stats(df: DataFrame, table: Table, contract_id: str) -> DataFrame | None:
    """Statistics of a table's declared columns of numbers; None where it has none."""
    declared = {f.name for f in table.fields}
    numbers = [c for c, k in df.dtypes if c in declared and k.split("(")[0] in MEASURED]
    if not numbers:
        return None
    # booleans as numbers; their cast to double is 0 or 1
    own = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numbers])
    return profile.column_stats(own, numbers).select(F.lit(f"{contract_id}/{table.name}").alias("key"), "column_name", "n", "mean_value", "std_value", "min_value", "max_value", "null_fraction", "cardinality")


def _drift(spark: SparkSession, stats: DataFrame, baselines: DataFrame, table: Table, contract_id: str, enforcement: Enforcement, config: Config) -> DataFrame:
    """Drift rows of a table; rules of its fields replace thresholds and severities, or skip a check."""
    rules = [(f.name, r.drift_z_warn, r.drift_z_fail, r.null_warn, r.null_fail, r.severity) for f in table.fields if (r := enforcement.rule(table.name, f.name))]
    own = spark.createDataFrame(rules, "column_name string, drift_z_warn double, drift_z_fail double, null_warn double, null_fail double, severity string") if rules else None
    base = baselines.filter(F.col("key") == f"{contract_id}/{table.name}").drop("key")
    found = drift.drift(stats.drop("key"), base, config, own)
    skipped = [(f.name, c) for f in table.fields for c in ("drift_mean", "drift_variance", "drift_outliers", "drift_null_fraction", "drift_cardinality") if enforcement.skips(table.name, f.name, c)]
    for column, check in skipped:
        found = found.filter(~((F.col("column_name") == column) & (F.col("check_type") == check)))
    table_name = F.lit(table.name)
    return found.select(
        F.concat_ws(".", table_name, "column_name", "check_type").alias("check_id"), table_name.alias("table_name"), "column_name", "check_type", "status", "severity", F.lit(0).cast("bigint").alias("records_failing"),
        F.concat(F.lit("measure="), F.coalesce(F.col("measure").cast("string"), F.lit("none"))).alias("actual_value"), F.lit("as the baseline").alias("expected"),
        F.concat(F.col("check_type"), F.lit(" of "), F.col("column_name"), F.when(F.col("status") == "PASS", " is as before").otherwise(" moved")).alias("message"),
    )


def validate(tables: Mapping[str, DataFrame], contract: Contract, enforcement: Enforcement = Enforcement(""), baselines: DataFrame | None = None, freshness: Freshness | None = None, config: Config = Config(), mode: str | None = None) -> Run:
    """All of a contract's checks. The mode is the enforcement's, else the caller's, else the contract's."""
    spark = next(iter(tables.values())).sparkSession
    parts: list[DataFrame] = []
    stats: list[DataFrame] = []
    for table in contract.tables:
        df = tables.get(table.name)
        try:
            parts.append(_plain(checks.schema_checks(spark, table, df.columns if df is not None else [])))
            if df is None:
                continue
            found = _plain(checks.table_checks(df, table, enforcement))
            found.schema  # noqa: B018 (plans it)
            parts.append(found)
            own = table_stats(df, table, contract.id)
            if own is not None:
                stats.append(own)
                if baselines is not None:
                    parts.append(_whole(_drift(spark, own, baselines, table, contract.id, enforcement, config)))
        except PySparkException as e:
            parts.append(_error(spark, table.name, str(e)))
    for key in contract.references:
        there = key.child in tables and key.parent in tables and key.column in tables[key.child].columns and key.key in tables[key.parent].columns
        if there:
            parts.append(_plain(checks.reference_check(tables[key.child], tables[key.parent], key)))
        else:
            parts.append(_plain(spark.createDataFrame([(f"{key.child}.{key.column}.references.{key.parent}.{key.key}", key.child, key.column, "referential_integrity", "ERROR", "CRITICAL", 0, f"{key.parent}.{key.key}")], checks.RESULT)))
    if freshness is not None and freshness.table in tables and freshness.column in tables[freshness.table].columns:
        aged = checks.freshness(tables[freshness.table], freshness.table, freshness.column, freshness.now, config)
        parts.append(_whole(aged.select("check_id", "status", "severity", F.lit(freshness.table).alias("table_name"), F.lit(freshness.column).alias("column_name"), F.lit("freshness").alias("check_type"), F.lit(0).cast("bigint").alias("records_failing"), F.concat(F.lit("age_hours="), F.coalesce(F.col("age_hours").cast("string"), F.lit("none"))).alias("actual_value"), F.lit(f"{config.fresh_fail_hours:g} hours at most").alias("expected"), F.lit("age of the newest time stamp").alias("message"))))
    out = parts[0] if parts else spark.createDataFrame([], checks.RESULT)
    for p in parts[1:]:
        out = out.unionByName(p)
    kept = stats[0] if stats else spark.createDataFrame([], STATS)
    for s in stats[1:]:
        kept = kept.unionByName(s)
    return Run(out, kept, (enforcement.mode or mode or contract.mode or "AUDIT").upper())


def _plain(results: DataFrame) -> DataFrame:
    """Check rows with what was found, as text, and a message."""
    failing = F.col("records_failing")
    actual = F.when(F.col("check_type") == "schema_missing", "missing").when(F.col("check_type") == "schema_new_column", "present").otherwise(F.concat(F.lit("failing="), failing.cast("string")))
    said = F.concat(F.col("check_type"), F.lit(" of "), F.col("column_name"), F.when(F.col("status") == "PASS", " holds").when(F.col("status") == "ERROR", " can't be judged").otherwise(F.concat(F.lit(" fails in "), failing.cast("string"), F.lit(" rows"))))
    return results.withColumn("actual_value", actual).withColumn("message", said).select(*COLUMNS)


def samples(tables: Mapping[str, DataFrame], contract: Contract, results: DataFrame, limit: int = 5, enums: int = 10) -> DataFrame:
    """(check_id, place, value): of each field check that failed, the first few failing values by value, of enums distinct ones (a sample report); a job a table."""
    failed = {r["check_id"] for r in results.filter("status = 'FAIL'").select("check_id").collect()}  # as many as the contract has checks
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for table in contract.tables:
        df = tables.get(table.name)
        if df is None:
            continue
        kinds = dict(df.dtypes)
        specs = [(f"{table.name}.{f.name}.{check}", bad, f.name, check) for f in table.fields if f.name in kinds for check, bad, _ in checks._failing(f, kinds[f.name]) if f"{table.name}.{f.name}.{check}" in failed and check != "type"]
        if specs:
            cells = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(i).alias("check_id"), F.lit(check == "enum").alias("distinct"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")).alias("value"))) for i, bad, c, check in specs]))
            own = df.select(F.explode(cells).alias("s")).select("s.*")
            rows = own.filter("not distinct").unionByName(own.filter("distinct").distinct())
            w = Window.partitionBy("check_id").orderBy("value")
            parts.append(rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.when(F.col("distinct"), enums).otherwise(limit)).select("check_id", "place", "value"))
    out = parts[0] if parts else spark.createDataFrame([], "check_id string, place int, value string")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_summary(results: DataFrame) -> DataFrame:
    """One row: missing_columns and new_columns, each an array of (table, column)."""
    of = lambda kind: F.array_sort(F.coalesce(F.collect_list(F.when(F.col("check_type") == kind, F.struct(F.col("table_name").alias("table"), F.col("column_name").alias("column")))), F.array()))
    return results.filter("check_type in ('schema_missing', 'schema_new_column')").agg(of("schema_missing").alias("missing_columns"), of("schema_new_column").alias("new_columns"))  # as many as the contract has columns


def report(run: Run, contract: Contract, report_id: str, at: str, drawn: DataFrame | None = None, previous: DataFrame | None = None, current: DataFrame | None = None) -> dict:
    """A run as a document: tallies, schema summary, all results with samples, and, where columns came or went and a former version is known, the difference."""
    rows = [r.asDict() for r in run.results.orderBy("check_id").collect()]  # as many as the contract has checks
    by: dict[str, list[str]] = {}
    for r in drawn.orderBy("check_id", "place").collect() if drawn is not None else []:
        by.setdefault(r["check_id"], []).append(r["value"])
    of = lambda kind: [{"table": r["table_name"], "column": r["column_name"]} for r in rows if r["check_type"] == kind]
    count = lambda s: sum(r["status"] == s for r in rows)
    out = {
        "report_id": report_id, "contract_id": contract.id, "run_timestamp": at, "total_checks": len(rows), "passed": count("PASS"), "failed": count("FAIL"), "warned": count("WARN"), "errored": count("ERROR"), "mode": run.mode,
        "schema_summary": {"missing_columns": of("schema_missing"), "new_columns": of("schema_new_column")}, "results": [r | ({"sample": by[r["check_id"]]} if r["check_id"] in by else {}) for r in rows],
    }
    if previous is not None and current is not None and (of("schema_missing") or of("schema_new_column")):
        out["schema_diff"] = [r.asDict() for r in evolve.diff(previous, current).orderBy("table_name", "field", "change").collect()]
    return out


def exit_code(results: list[dict] | DataFrame, mode: str) -> int:
    """AUDIT: 0. WARN: 1 where something CRITICAL fails. ENFORCE: 1 where something HIGH or CRITICAL fails or can't be judged."""
    if isinstance(results, DataFrame):
        return int(checks.tally(results).first()[f"exit_{mode.lower()}"])
    fails = [r["severity"] for r in results if r["status"] == "FAIL"]
    if mode == "WARN":
        return int("CRITICAL" in fails)
    return int(mode == "ENFORCE" and (bool({"CRITICAL", "HIGH"} & {*fails}) or any(r["status"] == "ERROR" for r in results)))
