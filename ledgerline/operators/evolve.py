"""Contract versions: differences, their class, the gate, and what they do to consumers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a contract's clauses as a table.
CLAUSES = "table_name string, field string, type string, required boolean, enum array<string>, minimum double, maximum double"


def type_change(old: Column, new: Column, old_max: Column, new_max: Column) -> Column:
    """struct(severity, reason) of a change of type; null where there is none."""
    kind = lambda s, r: F.struct(F.lit(s).alias("severity"), F.lit(r).alias("reason"))
    scaled = (old == "number") & (old_max <= 1) & (new_max >= 100)
    return (
        F.when(scaled, kind("CRITICAL", "scale change"))
        .when(old.eqNullSafe(new), None)
        .when((old == "number") & (new == "integer"), kind("CRITICAL", "fraction lost"))
        .when((old == "string") & new.isin("integer", "number", "boolean"), kind("CRITICAL", "narrowed"))
        .when((old == "integer") & (new == "string"), kind("CRITICAL", "number to text"))
        .otherwise(kind("HIGH", "type changed"))
    )


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_name, field, change, severity, breaking) of two versions' clauses, in one full outer join by table and field.

    Tables that come or go are rows without a field; the fields of a table that comes are reported as well. Changes that
    consumers can bear have severity COMPAT.
    """
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    both = o.join(n, (F.col("o_table_name") == F.col("n_table_name")) & (F.col("o_field") == F.col("n_field")), "full_outer")
    c = F.col
    gone, came = c("n_field").isNull(), c("o_field").isNull()
    item = lambda change, severity: F.struct(F.lit(change).alias("change"), F.lit(severity).alias("severity"))
    keep = ~gone & ~came
    old_enum, new_enum = F.coalesce("o_enum", F.array().cast("array<string>")), F.coalesce("n_enum", F.array().cast("array<string>"))
    tight = c("n_minimum").isNotNull() & (c("o_minimum").isNull() | (c("n_minimum") > c("o_minimum"))) | c("n_maximum").isNotNull() & (c("o_maximum").isNull() | (c("n_maximum") < c("o_maximum")))
    loose = c("o_minimum").isNotNull() & (c("n_minimum").isNull() | (c("n_minimum") < c("o_minimum"))) | c("o_maximum").isNotNull() & (c("n_maximum").isNull() | (c("n_maximum") > c("o_maximum")))
    kind = type_change(c("o_type"), c("n_type"), c("o_maximum"), c("n_maximum"))
    items = F.array_compact(F.array(
        F.when(gone, F.when(c("o_required"), item("field removed", "CRITICAL")).otherwise(item("field removed", "HIGH"))),
        F.when(came, F.when(c("n_required"), item("required field added", "CRITICAL")).otherwise(item("optional field added", "COMPAT"))),
        F.when(keep & kind.isNotNull(), F.struct(F.concat(F.lit("type: "), kind["reason"]).alias("change"), kind["severity"].alias("severity"))),
        F.when(keep & (F.size(F.array_except(old_enum, new_enum)) > 0) & (F.size(new_enum) > 0), item("enum values removed", "CRITICAL")),
        F.when(keep & (F.size(F.array_except(new_enum, old_enum)) > 0), item("enum values added", "COMPAT")),
        F.when(keep & F.coalesce(tight, F.lit(False)), item("range tightened", "CRITICAL")),
        F.when(keep & F.coalesce(loose, F.lit(False)), item("range widened", "COMPAT")),
    ))
    fields = both.select(F.coalesce("o_table_name", "n_table_name").alias("table_name"), F.coalesce("o_field", "n_field").alias("field"), F.explode(items).alias("i")).select("table_name", "field", "i.*")
    ot, nt = old.select("table_name").distinct(), new.select("table_name").distinct()
    removed = ot.join(nt, "table_name", "left_anti").select("table_name", F.lit(None).cast("string").alias("field"), F.lit("table removed").alias("change"), F.lit("CRITICAL").alias("severity"))
    added = nt.join(ot, "table_name", "left_anti").select("table_name", F.lit(None).cast("string").alias("field"), F.lit("table added").alias("change"), F.lit("COMPAT").alias("severity"))
    return fields.unionByName(removed).unionByName(added).withColumn("breaking", F.col("severity") != "COMPAT")


def rollback(changes: DataFrame) -> DataFrame:
    """What undoes each breaking change."""
    where = F.concat_ws(".", "table_name", "field")
    plan = F.when(F.startswith("change", F.lit("type")), F.concat(F.lit("restore the type of "), where)).when(F.contains("change", F.lit("removed")), F.concat(F.lit("restore "), where)).when(F.contains("change", F.lit("added")), F.concat(F.lit("make optional "), where)).otherwise(F.concat(F.lit("restore the range of "), where))
    return changes.filter("breaking").select("table_name", "field", "change", plan.alias("plan"))


def breaking_fields(subscriptions: DataFrame) -> DataFrame:
    """(contract_id, subscriber_id, field, reason): a row a breaking field; columns contract_id, subscriber_id, breaking_fields."""
    return subscriptions.select("contract_id", "subscriber_id", F.explode("breaking_fields").alias("b")).select("contract_id", "subscriber_id", "b.field", "b.reason").filter("field is not null")


def gate(old: DataFrame, new: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row: decision BLOCK where a removed field (by name or table.name) breaks a subscriber, and how many it breaks."""
    removed = old.select("table_name", "field").join(new.select("table_name", "field"), ["table_name", "field"], "left_anti")
    names = removed.select(F.explode(F.array("field", F.concat_ws(".", "table_name", "field"))).alias("field")).distinct()
    hit = breaking_fields(subscriptions).join(names, "field", "left_semi")
    return hit.agg(F.count_distinct("subscriber_id").alias("broken_subscribers"), F.count(F.lit(1)).alias("broken_fields")).withColumn("decision", F.when(F.col("broken_fields") > 0, "BLOCK").otherwise("PASS"))


def consumer_failures(changes: DataFrame, subscriptions: DataFrame, contract_id: str | None = None) -> DataFrame:
    """Each breaking change with the subscribers whose breaking field it is: its whole path, or a longer path that ends in the field; none: an unregistered risk.

    With a contract, only those who subscribe to it (source or source_contract holds its id). Ends of paths are keys, so that this is an equi-join.
    """
    if contract_id is not None:
        subscriptions = subscriptions.filter(F.contains(F.coalesce("source_contract", "source", F.lit("")), F.lit(contract_id)) | F.contains(F.coalesce("source", F.lit("")), F.lit(contract_id)))
    c = changes.filter("breaking and field is not null").withColumn("key", F.explode(F.array(F.concat(F.lit("="), F.concat_ws(".", "table_name", "field")), F.concat(F.lit("."), F.col("field")))))
    parts = F.split("field", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    keys = F.concat(F.array(F.concat(F.lit("="), F.col("field"))), F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<string>")))
    b = breaking_fields(subscriptions).select("subscriber_id", F.explode(keys).alias("key"))
    found = c.join(b, "key", "left").groupBy("table_name", "field", "change").agg(F.count_distinct("subscriber_id").alias("subscribers"), F.min("subscriber_id").alias("first_subscriber"))
    mode = F.when(F.contains("change", F.lit("removed")), "missing column").when(F.startswith("change", F.lit("type")), "cast error").otherwise("rejected values")
    return found.select("table_name", "field", "change", "subscribers", "first_subscriber", (F.col("subscribers") == 0).alias("unregistered_risk"), mode.alias("failure_mode"))
