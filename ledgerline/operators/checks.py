"""Checks: a table's checks are one aggregation, whose single row becomes a row a check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.plans.contract import Config, Contract, Enforcement, Field, ForeignKey, Table

RESULT = "check_id string, table_name string, column_name string, check_type string, status string, severity string, records_failing bigint, expected string"
TYPES = {
    "string": {"string", "variant", "char", "varchar"},
    "integer": {"tinyint", "smallint", "int", "bigint", "double"},
    "number": {"float", "double", "bigint", "int", "decimal"},
    "boolean": {"boolean"},
}
SEVERITY = {"required": "CRITICAL", "type": "CRITICAL", "enum": "HIGH", "format_uuid": "CRITICAL", "format_datetime": "CRITICAL", "range": "HIGH"}


def type_fits(logical: str, actual: str) -> bool:
    """Whether a Spark type serves a logical one; an unknown logical type wants strings."""
    return actual.split("(")[0] in TYPES.get(logical, {"string"})


def _failing(field: Field, actual: str) -> list[tuple[str, Column | None, str]]:
    """(check, condition of a failing row, what is expected); no condition: the type decides for all rows."""
    c = F.col(f"`{field.name}`")
    out: list[tuple[str, Column | None, str]] = []
    if field.required:
        out.append(("required", X.missing(c, actual), "no missing value"))
    if not type_fits(field.type, actual):
        out.append(("type", F.lit(True), field.type))
    else:
        out.append(("type", F.lit(False), field.type))
    if field.enum:
        out.append(("enum", c.isNotNull() & ~c.cast("string").isin(*field.enum), ",".join(field.enum)))
    if field.format == "uuid":
        out.append(("format_uuid", X.bad_uuid(c), "uuid"))
    if field.format == "date-time":
        out.append(("format_datetime", X.bad_datetime(c), "date-time"))
    if field.minimum is not None or field.maximum is not None:
        v, bad = X.number(c), F.lit(False)
        if field.minimum is not None:
            bad = bad | (v < field.minimum)
        if field.maximum is not None:
            bad = bad | (v > field.maximum)
        out.append(("range", F.coalesce(bad, F.lit(False)), f"[{'' if field.minimum is None else f'{field.minimum:g}'},{'' if field.maximum is None else f'{field.maximum:g}'}]"))
    return out


def schema_checks(spark: SparkSession, table: Table, observed: Sequence[str]) -> DataFrame:
    """Declared columns that are missing (FAIL) and columns nobody declared (WARN)."""
    declared = {f.name for f in table.fields}
    rows = [(f"{table.name}.{c}.schema_missing", table.name, c, "schema_missing", "FAIL", "CRITICAL", 1, "declared") for c in sorted(declared - set(observed))]
    rows += [(f"{table.name}.{c}.schema_new_column", table.name, c, "schema_new_column", "WARN", "MEDIUM", 1, "undeclared") for c in sorted(set(observed) - declared)]
    return spark.createDataFrame(rows, RESULT)


def table_checks(df: DataFrame, table: Table, enforcement: Enforcement = Enforcement()) -> DataFrame:
    """All field checks of a table in one aggregation over one scan of the columns that have checks."""
    kinds = dict(df.dtypes)
    specs = [(f.name, check, bad, want) for f in table.fields if f.name in kinds for check, bad, want in _failing(f, kinds[f.name]) if not enforcement.skips(table.name, f.name, check)]
    if not specs:
        return df.sparkSession.createDataFrame([], RESULT)
    counts = [F.count_if(bad).alias(f"k{i}") for i, (_, _, bad, _) in enumerate(specs)]
    numbers = [F.count(X.number(F.col(f"`{column}`"))).alias(f"n{i}") for i, (column, check, _, _) in enumerate(specs) if check == "range"]
    one = df.agg(*counts, *numbers)
    rows = []
    for i, (column, check, _, want) in enumerate(specs):
        k = F.col(f"k{i}")
        status = F.when(k > 0, "FAIL").otherwise("PASS")
        if check == "range":
            status = F.when(F.col(f"n{i}") == 0, "ERROR").otherwise(status)
        rows.append(F.struct(F.lit(f"{table.name}.{column}.{check}").alias("check_id"), F.lit(table.name).alias("table_name"), F.lit(column).alias("column_name"), F.lit(check).alias("check_type"), status.alias("status"), F.lit(enforcement.severity(table.name, column, SEVERITY[check])).alias("severity"), k.alias("records_failing"), F.lit(want).alias("expected")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def reference_check(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """Rows of the child whose non-null value no row of the parent has, as strings; an anti join on distinct parent keys."""
    known = parent.select(F.col(f"`{key.key}`").cast("string").alias("k")).filter("k is not null").distinct()
    orphans = child.select(F.col(f"`{key.column}`").cast("string").alias("k")).filter("k is not null").join(known, "k", "left_anti")
    n = orphans.agg(F.count(F.lit(1)).alias("n"))
    check = f"{key.child}.{key.column}.references.{key.parent}.{key.key}"
    return n.select(F.lit(check).alias("check_id"), F.lit(key.child).alias("table_name"), F.lit(key.column).alias("column_name"), F.lit("referential_integrity").alias("check_type"), F.when(F.col("n") > 0, "FAIL").otherwise("PASS").alias("status"), F.lit("CRITICAL").alias("severity"), F.col("n").alias("records_failing"), F.lit(f"{key.parent}.{key.key}").alias("expected"))


def orphan_sample(child: DataFrame, parent: DataFrame, key: ForeignKey, limit: int = 5) -> DataFrame:
    """The first orphans by value: made only when asked for."""
    known = parent.select(F.col(f"`{key.key}`").cast("string").alias("k")).distinct()
    return child.select(F.col(f"`{key.column}`").cast("string").alias("k")).filter("k is not null").join(known, "k", "left_anti").orderBy("k").limit(limit)


def bad_values(df: DataFrame, field: Field, limit: int = 10) -> DataFrame:
    """The distinct values outside an enum, sorted."""
    c = F.col(f"`{field.name}`").cast("string")
    return df.select(c.alias("value")).filter(F.col("value").isNotNull() & ~F.col("value").isin(*field.enum)).distinct().orderBy("value").limit(limit)


def freshness(df: DataFrame, table: str, column: str, now: str, config: Config = Config()) -> DataFrame:
    """Age in hours of the newest time stamp against the limits; none that can be read is an error."""
    newest = df.agg(F.max(F.col(f"`{column}`").try_cast("timestamp")).alias("newest"))
    hours = (F.lit(now).cast("timestamp").cast("double") - F.col("newest").cast("double")) / 3600
    status = F.when(hours.isNull(), "ERROR").when(hours > config.fresh_fail_hours, "FAIL").when(hours > config.fresh_warn_hours, "WARN").otherwise("PASS")
    severity = F.when(hours.isNull() | (hours > config.fresh_fail_hours), "HIGH").when(hours > config.fresh_warn_hours, "MEDIUM").otherwise("LOW")
    return newest.select(F.lit(f"{table}.{column}.freshness").alias("check_id"), status.alias("status"), severity.alias("severity"), F.round(hours, 4).alias("age_hours"))


def validate(tables: Mapping[str, DataFrame], contract: Contract, enforcement: Enforcement = Enforcement()) -> DataFrame:
    """All checks of a contract: schema, fields, references. A table that isn't there misses all its columns."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for table in contract.tables:
        df = tables.get(table.name)
        parts.append(schema_checks(spark, table, df.columns if df is not None else []))
        if df is not None:
            parts.append(table_checks(df, table, enforcement))
    for key in contract.references:
        if key.child in tables and key.parent in tables:
            parts.append(reference_check(tables[key.child], tables[key.parent], key))
        else:
            parts.append(spark.createDataFrame([(f"{key.child}.{key.column}.references.{key.parent}.{key.key}", key.child, key.column, "referential_integrity", "ERROR", "CRITICAL", 0, f"{key.parent}.{key.key}")], RESULT))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tally(results: DataFrame) -> DataFrame:
    """Counts by status, and the exit code of each mode."""
    n = lambda s: F.count_if(F.col("status") == s)
    fails = F.count_if((F.col("status") == "FAIL") & (F.col("severity") == "CRITICAL"))
    high = F.count_if((F.col("status") == "FAIL") & F.col("severity").isin("CRITICAL", "HIGH"))
    return results.agg(F.count(F.lit(1)).alias("total"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("WARN").alias("warned"), n("ERROR").alias("errored"), F.lit(0).alias("exit_audit"), (fails > 0).cast("int").alias("exit_warn"), ((high > 0) | (n("ERROR") > 0)).cast("int").alias("exit_enforce"))


def quality_rules(df: DataFrame, rules: Mapping[str, Column], unique: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(rule, violations): every rule's failing rows in one aggregation, and rows beyond the distinct keys, each from counts by key, so that no row is copied a key and no task holds all keys."""
    parts = []
    if rules:
        one = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())])
        parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)])).alias("r")).select("r.*"))
    for name, keys in (unique or {}).items():
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(counts.agg((F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("violations")).select(F.lit(name).alias("rule"), "violations"))
    out = parts[0] if parts else df.sparkSession.createDataFrame([], "rule string, violations bigint")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
