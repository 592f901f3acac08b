"""Nested records to relational tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = "fact_id string, text string, entity_refs array<string>, confidence double, page_ref bigint, source_excerpt string"
ENTITY = "entity_id string, name string, type string, canonical_value string"
EXTRACTION = f"doc_id string, source_path string, source_hash string, extracted_facts array<struct<{FACT.replace(' ', ':').replace(',:', ',')}>>, entities array<struct<{ENTITY.replace(' ', ':').replace(',:', ',')}>>, extraction_model string, processing_time_ms bigint, token_count struct<input:bigint,output:bigint>, extracted_at string"
EVENT = "event_id string, event_type string, aggregate_id string, aggregate_type string, sequence_number bigint, payload string, metadata struct<causation_id:string,correlation_id:string,user_id:string,source_service:string,original_stream_id:string,global_position:bigint>, schema_version string, occurred_at string, recorded_at string"
LINEAGE = "snapshot_id string, codebase_root string, git_commit string, nodes array<struct<node_id:string,type:string,label:string,metadata:struct<path:string,language:string,purpose:string,last_modified:string>>>, edges array<struct<source:string,target:string,relationship:string,confidence:double>>, captured_at string"


def _size(c: str) -> Column:
    return F.coalesce(F.array_size(c), F.lit(0)).cast("bigint")


def exploded(df: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    """A row an element of an array, which is computed once: of a plain explode Spark infers a filter by the array's size, which it moves to where the array is made from, and makes it there again."""
    return df.select(*keep, F.posexplode_outer(column).alias("_place", name)).filter("_place is not null").drop("_place")


def documents(df: DataFrame) -> DataFrame:
    """A row a record, with the numbers of its facts and entities; none is 0."""
    return df.select("doc_id", "source_path", "source_hash", "extraction_model", "processing_time_ms", F.col("token_count.input").alias("token_count_input"), F.col("token_count.output").alias("token_count_output"), "extracted_at", _size("extracted_facts").alias("fact_count"), _size("entities").alias("entity_count"))


def facts(df: DataFrame) -> DataFrame:
    """A row a fact; records without any vanish."""
    return exploded(df, "extracted_facts", "f", "doc_id").select("doc_id", "f.fact_id", "f.text", "f.confidence", "f.page_ref", "f.source_excerpt")


def entities(df: DataFrame) -> DataFrame:
    """A row an entity."""
    return exploded(df, "entities", "e", "doc_id").select("doc_id", "e.entity_id", "e.name", "e.type", "e.canonical_value")


def events(df: DataFrame) -> DataFrame:
    """A row an event."""
    return df.select("event_id", "event_type", "aggregate_id", "aggregate_type", "sequence_number", "schema_version", "occurred_at", "recorded_at")


def event_metadata(df: DataFrame) -> DataFrame:
    """A row an event's metadata."""
    return df.select("event_id", "metadata.*")


def lineage_nodes(df: DataFrame) -> DataFrame:
    """A row a node."""
    return df.select(F.explode("nodes").alias("n")).select("n.node_id", "n.type", "n.label", "n.metadata.path", "n.metadata.language", "n.metadata.last_modified")


def lineage_edges(df: DataFrame) -> DataFrame:
    """A row an edge."""
    return df.select(F.explode("edges").alias("e")).select("e.*")


def trace_nodes(df: DataFrame) -> DataFrame:
    """A row a trace node; an empty parent is none, inputs, outputs and tags (variants) are JSON with sorted keys."""
    text = lambda c: F.to_json(c).alias(f"{c}_json")
    return df.select(F.col("id").alias("run_id"), F.nullif("parent_run_id", F.lit("")).alias("parent_run_id"), "depth", "name", "run_type", "start_time", "end_time", text("inputs"), text("outputs"), "error", text("tags"), "app_path", F.col("trace_project").alias("trace_project_id"))


#: Tables by name, for contracts and plug-ins.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "documents": documents, "extracted_facts": facts, "entities": entities, "events": events, "event_metadata": event_metadata, "lineage_nodes": lineage_nodes, "lineage_edges": lineage_edges, "trace_nodes": trace_nodes,
}


def flatten_all(df: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """The named tables of one nested source, lazily."""
    return {n: TABLES[n](df) for n in names if n in TABLES}
