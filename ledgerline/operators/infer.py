"""Contract inference: clauses from a profile, quality rules from clauses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.rules import NO_UUID, QualityRule
from ledgerline.plans.contract import Config, Field, Table


def logical_type(kind: str) -> str:
    """integer, number, boolean, or string."""
    base = kind.split("(")[0]
    return {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "number", "double": "number", "decimal": "number", "boolean": "boolean"}.get(base, "string")


def clauses(profile: DataFrame, kinds: Mapping[str, str], config: Config = Config()) -> DataFrame:
    """column_name, logical_type, required, format, is_enum, minimum, maximum, note from profile rows."""
    types = F.create_map(*[F.lit(x) for c, k in kinds.items() for x in (c, logical_type(k))])
    name, kind = F.col("column_name"), types[F.col("column_name")]
    named_id = F.endswith(name, F.lit("_id")) & ~name.isin(*sorted(NO_UUID))
    id_like, at_like, ref_like = F.endswith(name, F.lit("_id")), F.endswith(name, F.lit("_at")), F.endswith(name, F.lit("_ref"))
    confident = (kind == "number") & F.contains(name, F.lit("confidence"))
    return profile.select(
        name,
        kind.alias("logical_type"),
        (F.col("null_fraction") == 0).alias("required"),
        F.when(named_id & (kind == "string"), "uuid").when(at_like, "date-time").alias("format"),
        ((F.col("cardinality") <= config.enum_limit) & (kind == "string") & ~id_like & ~F.endswith(name, F.lit("_json"))).alias("is_enum"),
        F.when(confident, 0.0).when(ref_like, 1.0).when(F.col("min_value") >= 0, 0.0).alias("minimum"),
        F.when(confident, 1.0).alias("maximum"),
        F.when(confident & ((F.col("mean_value") > 0.99) | (F.col("mean_value") < 0.01)), "suspicious mean").alias("note"),
    )


def table_contract(name: str, inferred: DataFrame, enums: Mapping[str, tuple[str, ...]]) -> Table:
    """The contract of a table, from its clauses (a row a column)."""
    rows = inferred.orderBy("column_name").collect()
    return Table(name, tuple(Field(r["column_name"], r["logical_type"], r["required"], r["format"], tuple(enums.get(r["column_name"], ())) if r["is_enum"] else (), r["minimum"], r["maximum"]) for r in rows))


def rule_sql(table: Table) -> list[tuple[str, str]]:
    """(rule, SQL that counts its violations) of a table's clauses."""
    out = []
    for f in table.fields:
        if f.required:
            out.append((f"{f.name}_not_null", f"SELECT COUNT(*) AS violations FROM {table.name} WHERE {f.name} IS NULL"))
        bounds = [f"{f.name} < {f.minimum:g}"] if f.minimum is not None else []
        bounds += [f"{f.name} > {f.maximum:g}"] if f.maximum is not None else []
        if bounds:
            out.append((f"{f.name}_range", f"SELECT COUNT(*) AS violations FROM {table.name} WHERE {' OR '.join(bounds)}"))
        if f.enum:
            listed = ", ".join("'" + v.replace("'", "''") + "'" for v in f.enum)
            out.append((f"{f.name}_allowed", f"SELECT COUNT(*) AS violations FROM {table.name} WHERE {f.name} NOT IN ({listed})"))
    return out


def dbt_schema(table: Table) -> dict:
    """The table as a dbt model: not_null where required, unique for ids, accepted_values for enums."""
    columns = []
    for f in table.fields:
        tests: list = ["not_null"] if f.required else []
        tests += ["unique"] if f.name.endswith("_id") else []
        tests += [{"accepted_values": {"values": list(f.enum)}}] if f.enum else []
        columns.append({"name": f.name, "tests": tests})
    return {"version": 2, "models": [{"name": table.name, "columns": columns}]}


def source_description(contract_id: str, known: Mapping[str, str] = {}) -> str:
    """What a contract's source is: the text of the first part that its id holds, in any case."""
    return next((text for part, text in known.items() if part.lower() in contract_id.lower()), "profiled records")


def consumers(spark: SparkSession, edges: DataFrame, subscriptions: DataFrame, contract_id: str, label: str = "") -> DataFrame:
    """(id, relationship, confidence) of who reads a contract's data: targets of lineage edges, each once, then subscribers that aren't among them."""
    from_edges = edges.filter("target is not null and target <> ''").groupBy("target").agg(F.min_by(F.struct("relationship", "confidence"), F.col("relationship")).alias("e")).select(F.col("target").alias("id"), F.coalesce("e.relationship", F.lit("downstream")).alias("relationship"), F.col("e.confidence").alias("confidence"))
    own = (F.col("source_contract") == contract_id) | (F.contains(F.lit(label), F.col("source")) if label else F.lit(False))
    subscribed = subscriptions.filter(own & F.col("target").isNotNull() & (F.col("target") != "")).select(F.col("target").alias("id")).distinct().join(from_edges.select("id"), "id", "left_anti")
    return from_edges.unionByName(subscribed.select("id", F.lit("registered_subscriber").alias("relationship"), F.lit(None).cast("double").alias("confidence")))


def assemble(contract: dict, rules: Sequence[QualityRule], readers: Sequence[Mapping], source: str, records: int, at: str, known: Mapping[str, str] = {}, lineage: Sequence[Mapping] = (), most_ports: int = 3) -> dict:
    """A contract's document with its quality rules, where its data come from and go to, and who reads them."""
    ports = [{"uri": source, "description": source_description(contract["id"], known), "records": records, "captured_at": at}]
    ports += [{"uri": r.get("codebase_root") or r.get("snapshot_id") or "unknown", "description": "lineage", "captured_at": r.get("captured_at") or at} for r in list(lineage)[:most_ports]]
    quality = [{"name": r.name, "dimension": r.dimension, "severity": r.severity, "query": r.sql, "must_be": 0} for r in rules]
    return contract | {"version": "1.0.0", "generated_at": at, "quality": quality, "lineage": {"inputs": ports, "outputs": [{"uri": f"{contract['id']}.yaml"}, {"uri": f"{contract['id']}_dbt.yml"}]}, "consumers": [dict(r) for r in readers]}


def ambiguous(profile: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Text columns with many values whose names say nothing, with a stated fallback description."""
    strings = [c for c, k in kinds.items() if logical_type(k) == "string"]
    return profile.filter(F.col("column_name").isin(strings) & (F.col("cardinality") > 10) & ~F.col("column_name").rlike("(id|name|type|date|path|url|text|email|status)")).select("column_name", F.concat(F.lit("text column "), F.col("column_name")).alias("description"))
