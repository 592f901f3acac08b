"""Quality rules: made from profiles, or fixed for graph and event tables; executed a table at once.

A rule counts rows of one table: those that a predicate takes, those beyond the distinct values of a column, or those whose
value another table lacks. Each has its SQL; running them takes one aggregation for all predicates of a table, and one for
each uniqueness or reference.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that end in _id and hold no UUID.
NO_UUID = frozenset({"node_id", "user_id", "original_stream_id"})
NODE_TYPES = ("TABLE", "FILE", "SERVICE", "MODEL", "PIPELINE", "EXTERNAL")
LANGUAGES = ("sql", "yaml", "unknown")
RELATIONSHIPS = ("READS", "WRITES", "IMPORTS", "CALLS", "PRODUCES", "CONSUMES")
TEXT_WORDS = ("text", "excerpt", "name", "path")
FEW_VALUES = 10
LOW_CONFIDENCE = 0.5
LOW_EDGE_CONFIDENCE = 0.7
SLOW_MS = 600_000


@dataclass(frozen=True)
class QualityRule:
    """``bad``: a predicate in SQL. ``unique``: a column. ``parent``: (table, key) that must know the column. One of the three."""

    table: str
    column: str
    kind: str
    dimension: str
    severity: str
    bad: str | None = None
    unique: bool = False
    parent: tuple[str, str] | None = None

    @property
    def name(self) -> str:
        if self.parent:
            return f"{self.table}.{self.column}.references.{self.parent[0]}.{self.parent[1]}"
        return f"{self.table}.{self.column}.{self.kind}"

    @property
    def sql(self) -> str:
        """The number of violations."""
        if self.parent:
            return f"SELECT COUNT(*) FROM {self.table} a LEFT JOIN (SELECT DISTINCT {self.parent[1]} AS k FROM {self.parent[0]}) b ON a.{self.column} = b.k WHERE b.k IS NULL"
        if self.unique:
            return f"SELECT COUNT(*) - COUNT(DISTINCT {self.column}) FROM {self.table}"
        return f"SELECT COUNT(*) FROM {self.table} WHERE {self.bad}"


def _listed(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _one(table: str, column: str, kind: str) -> QualityRule:
    """The rules that need no more than a column."""
    whole = f"{column} IS NULL"
    made = {
        "not_null": ("completeness", "error", whole, False),
        "unique": ("uniqueness", "error", None, True),
        "range_check": ("validity", "error", f"{column} < 0.0 OR {column} > 1.0", False),
        "non_empty": ("validity", "warning", f"TRIM({column}) = ''", False),
        "positive": ("validity", "error", f"{column} < 1", False),
        "non_negative": ("validity", "error", f"{column} < 0", False),
        "floor_check": ("validity", "warning", f"{column} < {LOW_CONFIDENCE}", False),
        "extraction_success": ("validity", "error", f"{column} < 1", False),
        "timeout_risk": ("validity", "warning", f"{column} > {SLOW_MS}", False),
    }[kind]
    return QualityRule(table, column, kind, *made)


def allowed(table: str, column: str, values: Sequence[str]) -> QualityRule:
    """Only these values, or none."""
    return QualityRule(table, column, "allowed_values", "validity", "warning", f"{column} NOT IN ({_listed(values)}) AND {column} IS NOT NULL")


def rules_of(table: str, profile: Sequence[Mapping], kinds: Mapping[str, str], values: Mapping[str, Sequence[str]] = {}, rows: int = 0) -> list[QualityRule]:
    """The rules that a table's profile suggests; profile: column_name, null_fraction, cardinality; values: those seen in columns of few values."""
    out: list[QualityRule] = []
    for p in profile:
        c, kind = p["column_name"], kinds[p["column_name"]].split("(")[0]
        text, real, full = kind == "string", kind in ("float", "double", "decimal"), p["null_fraction"] == 0
        out += [_one(table, c, "not_null")] * full
        out += [_one(table, c, "range_check")] * ("confidence" in c and real)
        seen = [v for v in values.get(c, ()) if v]
        if text and p["cardinality"] <= FEW_VALUES and seen and not c.endswith(("_id", "_json")):
            out.append(allowed(table, c, seen))
        out += [_one(table, c, "unique")] * (c.endswith("_id") and 0 < rows <= p["cardinality"])
        out += [_one(table, c, "non_empty")] * (text and full and any(w in c for w in TEXT_WORDS))
        out += [_one(table, c, "positive")] * (c == "page_ref")
        out += [_one(table, c, "floor_check")] * ("confidence" in c and real)
    names = {p["column_name"] for p in profile}
    if table == "documents":
        out += [_one(table, c, "non_negative") for c in ("fact_count", "entity_count") if c in names]
        out += [_one(table, "fact_count", "extraction_success")] * ("fact_count" in names)
        out += [_one(table, "processing_time_ms", "timeout_risk")] * ("processing_time_ms" in names)
    if table == "extracted_facts" and "doc_id" in names:
        out.append(QualityRule(table, "doc_id", "references", "integrity", "error", parent=("documents", "doc_id")))
    return out


def graph_rules(types: Sequence[str] = NODE_TYPES, languages: Sequence[str] = LANGUAGES, relationships: Sequence[str] = RELATIONSHIPS) -> list[QualityRule]:
    """The rules of lineage_nodes and lineage_edges."""
    n, e = "lineage_nodes", "lineage_edges"
    floor = QualityRule(e, "confidence", "floor_check", "validity", "warning", f"confidence < {LOW_EDGE_CONFIDENCE}")
    return [
        *(_one(n, c, "not_null") for c in ("node_id", "type", "label")), _one(n, "node_id", "unique"), allowed(n, "type", types), allowed(n, "language", languages), _one(n, "label", "non_empty"),
        *(_one(e, c, "not_null") for c in ("source", "target", "relationship", "confidence")), _one(e, "confidence", "range_check"), floor, allowed(e, "relationship", relationships),
    ]


def event_rules(types: Sequence[str], services: Sequence[str], versions: Sequence[str] = ("1.0", "2.0")) -> list[QualityRule]:
    """The rules of events and event_metadata; the known event types and services are the caller's."""
    e, m = "events", "event_metadata"
    return [
        *(_one(e, c, "not_null") for c in ("event_id", "event_type", "aggregate_id", "aggregate_type", "sequence_number", "occurred_at", "recorded_at")), _one(e, "event_id", "unique"), allowed(e, "event_type", types), _one(e, "sequence_number", "non_negative"), allowed(e, "schema_version", versions),
        _one(m, "correlation_id", "not_null"), _one(m, "event_id", "unique"), allowed(m, "source_service", services), _one(m, "global_position", "positive"),
    ]


def execute(tables: Mapping[str, DataFrame], rules: Sequence[QualityRule]) -> DataFrame:
    """(rule, dimension, severity, violations, status) of each rule; a table or column that isn't there is an ERROR without a number."""
    spark = next(iter(tables.values())).sparkSession
    head = lambda r: [F.lit(r.name).alias("rule"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity")]
    parts: list[DataFrame] = []
    lost = [r for r in rules if r.table not in tables or r.column not in tables[r.table].columns or (r.parent and (r.parent[0] not in tables or r.parent[1] not in tables[r.parent[0]].columns))]
    if lost:
        parts.append(spark.createDataFrame([(r.name, r.dimension, r.severity, None) for r in lost], "rule string, dimension string, severity string, violations bigint"))
    there = [r for r in rules if r not in lost]
    for name in dict.fromkeys(r.table for r in there):
        plain = [r for r in there if r.table == name and r.bad]
        if plain:
            one = tables[name].agg(*[F.count_if(F.expr(r.bad)).alias(f"r{i}") for i, r in enumerate(plain)])
            parts.append(one.select(F.explode(F.array(*[F.struct(*head(r), F.col(f"r{i}").alias("violations")) for i, r in enumerate(plain)])).alias("r")).select("r.*"))
    for r in there:
        c = F.col(f"`{r.column}`")
        if r.unique:
            # rows less distinct values, from counts by value: no task holds all values
            counts = tables[r.table].groupBy(c.alias("k")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(counts.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count("k")).alias("violations")).select(*head(r), "violations"))
        if r.parent:
            known = tables[r.parent[0]].select(F.col(f"`{r.parent[1]}`").alias("k")).filter("k is not null").distinct()
            parts.append(tables[r.table].select(c.alias("k")).join(known, "k", "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(*head(r), "violations"))
    out = parts[0] if parts else spark.createDataFrame([], "rule string, dimension string, severity string, violations bigint")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("violations").isNull(), "ERROR").when(F.col("violations") > 0, "FAIL").otherwise("PASS"))
