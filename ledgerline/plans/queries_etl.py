"""Queries: flattening and the transforms to canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.operators import etl, flatten
from ledgerline.plans.queries_checks import duck_uuid5
from ledgerline.plans.registry import query, read, spread


def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extraction records: lines are facts, return flags are entities; orders of some customers have none."""
    fact = F.struct(F.col("l_linenumber").cast("string").alias("fact_id"), F.col("l_shipdate").cast("string").alias("text"), F.array(F.col("l_returnflag")).alias("entity_refs"), F.col("l_discount").alias("confidence"), F.col("l_partkey").alias("page_ref"), F.col("l_linestatus").alias("source_excerpt"))
    entity = F.struct(F.col("l_returnflag").alias("entity_id"), F.col("l_returnflag").alias("name"), F.lit("FLAG").alias("type"), F.lower("l_returnflag").alias("canonical_value"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(fact).alias("facts"), F.collect_set(entity).alias("entities"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    keep = F.col("o_custkey") % 10 != 0
    return o.select(
        F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("source_path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("source_hash"), F.when(keep, F.col("facts")).alias("extracted_facts"), F.when(keep, F.col("entities")).alias("entities"),
        F.col("o_orderstatus").alias("extraction_model"), F.col("o_custkey").alias("processing_time_ms"), F.struct(F.col("o_custkey").alias("input"), F.col("o_orderkey").alias("output")).alias("token_count"), F.col("o_orderdate").cast("string").alias("extracted_at"),
    )


_KEPT = "FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_custkey % 10 <> 0"


@query("SELECT o_orderkey::VARCHAR AS doc_id, o_orderstatus AS extraction_model, o_custkey AS token_count_input, o_orderkey AS token_count_output, CASE WHEN o_custkey % 10 <> 0 THEN count(l_orderkey) ELSE 0 END::BIGINT AS fact_count, CASE WHEN o_custkey % 10 <> 0 THEN count(DISTINCT l_returnflag) ELSE 0 END::BIGINT AS entity_count, sha256(o_orderkey::VARCHAR) AS source_hash FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus, o_custkey")
def flatten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a record, with counts."""
    return flatten.documents(_nested_orders(spark, sf_dir)).select("doc_id", "extraction_model", "token_count_input", "token_count_output", "fact_count", "entity_count", "source_hash")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, l_linenumber::VARCHAR AS fact_id, l_discount + 0.0 AS confidence, l_partkey AS page_ref, l_linestatus AS source_excerpt {_KEPT}")
def flatten_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a fact."""
    return flatten.facts(_nested_orders(spark, sf_dir)).select("doc_id", "fact_id", (F.col("confidence") + 0.0).alias("confidence"), "page_ref", "source_excerpt")


@query(f"SELECT DISTINCT o_orderkey::VARCHAR AS doc_id, l_returnflag AS entity_id, l_returnflag AS name, 'FLAG' AS type, lower(l_returnflag) AS canonical_value {_KEPT}")
def flatten_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an entity."""
    return flatten.entities(_nested_orders(spark, sf_dir))


def _nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    text = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("user_id").cast("string").alias("aggregate_id"), F.lit("User").alias("aggregate_type"), (F.col("event_id") % 9).alias("sequence_number"), F.col("props").alias("payload"),
        F.struct(F.lit(None).cast("string").alias("causation_id"), F.concat(F.lit("c"), F.col("user_id")).alias("correlation_id"), F.col("user_id").cast("string").alias("user_id"), F.lit("web").alias("source_service"), F.lit("s").alias("original_stream_id"), F.col("event_id").alias("global_position")).alias("metadata"),
        F.lit("1.0").alias("schema_version"),
    ))
    return e.select(F.from_json(text, flatten.EVENT).alias("r")).select("r.*")


@query("SELECT event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR AS aggregate_id, 'User' AS aggregate_type, (event_id % 9)::BIGINT AS sequence_number, '1.0' AS schema_version, NULL::VARCHAR AS occurred_at, NULL::VARCHAR AS recorded_at FROM events")
def flatten_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an event, from JSON."""
    return flatten.events(_nested_events(spark, sf_dir))


@query("SELECT event_id::VARCHAR AS event_id, NULL::VARCHAR AS causation_id, 'c' || user_id AS correlation_id, user_id::VARCHAR AS user_id, 'web' AS source_service, 's' AS original_stream_id, event_id AS global_position FROM events")
def flatten_event_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an event's metadata."""
    return flatten.event_metadata(_nested_events(spark, sf_dir))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("node_id"), F.lit("NATION").alias("type"), F.col("n_name").alias("label"), F.struct(F.lower("n_name").alias("path"), F.lit("sql").alias("language"), F.lit("p").alias("purpose"), F.lit("m").alias("last_modified")).alias("metadata"))).alias("nodes"),
        F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("source"), F.col("n_regionkey").cast("string").alias("target"), F.lit("IN").alias("relationship"), F.lit(0.5).alias("confidence"))).alias("edges"),
    )
    return n.select(F.col("n_regionkey").cast("string").alias("snapshot_id"), "nodes", "edges")


@query("SELECT n_nationkey::VARCHAR AS node_id, 'NATION' AS type, n_name AS label, lower(n_name) AS path, 'sql' AS language, 'm' AS last_modified FROM nation")
def flatten_lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a node."""
    return flatten.lineage_nodes(_snapshots(spark, sf_dir))


@query("SELECT n_nationkey::VARCHAR AS source, n_regionkey::VARCHAR AS target, 'IN' AS relationship, 0.5::DOUBLE AS confidence FROM nation")
def flatten_lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an edge."""
    return flatten.lineage_edges(_snapshots(spark, sf_dir))


@query("SELECT conv_id || '-' || turn AS run_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_run_id, turn AS depth, role AS run_type, '{\"a\":' || turn || ',\"b\":1}' AS inputs_json FROM conversations")
def flatten_trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a trace node, inputs as JSON with sorted keys."""
    c = read(spark, sf_dir, "conversations")
    v = F.parse_json(F.concat(F.lit('{"b": 1, "a": '), F.col("turn"), F.lit("}")))
    none = F.lit(None).cast("string")
    t = c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).otherwise("").alias("parent_run_id"), F.col("turn").alias("depth"), F.lit("n").alias("name"), F.col("role").alias("run_type"),
        none.alias("start_time"), none.alias("end_time"), v.alias("inputs"), v.alias("outputs"), none.alias("error"), v.alias("tags"), none.alias("app_path"), none.alias("trace_project"),
    )
    return flatten.trace_nodes(t).select("run_id", "parent_run_id", "depth", "run_type", "inputs_json")


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS sequence_number FROM events")
def etl_event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, numbered."""
    return etl.sequenced(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "sequence_number")


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id))::BIGINT AS global_position FROM events")
def etl_global_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, numbered."""
    return etl.positioned(read(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "global_position")


_STREAM = "CASE WHEN user_id % 5 = 0 THEN 'audit' ELSE 'loan_file-' || user_id END"
_SEQ = f"(SELECT *, {_STREAM} AS stream, row_number() OVER (PARTITION BY {_STREAM} ORDER BY event_id) - 1 AS seq FROM events)"


@query(f"SELECT {duck_uuid5(chr(39).join(['stream || ', ':', ' || seq || ', ':', ' || event_type']))} AS event_id, event_type, {duck_uuid5('CASE WHEN stream = ' + chr(39) + 'audit' + chr(39) + ' THEN ' + chr(39) + 'aggregate:audit:audit' + chr(39) + ' ELSE ' + chr(39) + 'aggregate:loan_file:' + chr(39) + ' || user_id END')} AS aggregate_id, CASE WHEN stream = 'audit' THEN 'AuditLedger' ELSE 'Loan_File' END AS aggregate_type, CASE WHEN stream = 'audit' THEN 'audit-service' ELSE 'unknown' END AS source_service, stream AS original_stream_id, seq::INTEGER AS sequence_number, {duck_uuid5(chr(39) + 'correlation:' + chr(39) + ' || stream')} AS correlation_id, 'system' AS user_id, '1.0' AS schema_version FROM {_SEQ}")
def etl_event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events from seed events."""
    e = read(spark, sf_dir, "events")
    seed = e.select("event_id", F.expr(_STREAM).alias("stream_id"), "event_type", F.lit("1").alias("event_version"), F.col("props").alias("payload"), F.col("ts").cast("string").alias("recorded_at"))
    return etl.event_records(seed, ["event_id"]).drop("recorded_at")


@query(f"SELECT count(*)::BIGINT AS events, count(DISTINCT event_type)::BIGINT AS event_types, count(DISTINCT stream)::BIGINT AS aggregates, 'AuditLedger,Loan_File' AS aggregate_types, count(DISTINCT stream)::BIGINT AS streams, (max(seq) + 1)::BIGINT AS longest_stream FROM {_SEQ}")
def etl_event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events, types, aggregates and streams the canonical events have."""
    return etl.event_summary(etl_event_records(spark, sf_dir))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _entities_sql(text: str, table: str, key: str) -> str:
    """Candidates by kind, the first of each in any case: by pattern, then by place."""
    patterns = [*(("DATE", p) for p in etl.DATE_PATTERNS), ("AMOUNT", etl.AMOUNT_PATTERN), ("ORG", etl.ACRONYM_PATTERN), ("ORG", etl.PHRASE_PATTERN)]
    words = "[" + ", ".join(map(_literal, sorted({*etl.STOP, *etl.HEADINGS}))) + "]"
    hinted = f"[x FOR x IN m IF regexp_matches(lower(x), {_literal('|'.join(etl.ORGANISATION))}) AND NOT list_has_any(string_split(lower(x), ' '), {words})]"
    parts = " UNION ALL ".join(f"SELECT {key}, '{kind}' AS kind, {i} AS p, {hinted if pattern == etl.PHRASE_PATTERN else 'm'} AS l FROM (SELECT {key}, regexp_extract_all(t, {_literal(pattern)}) AS m FROM c)" for i, (kind, pattern) in enumerate(patterns))
    return f"WITH c AS (SELECT {key}, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS t FROM {table}), f AS ({parts}), u AS (SELECT {key}, kind, p, unnest(l) AS value, generate_subscripts(l, 1) AS n FROM f) SELECT {key}, kind, arg_min(value, p * 10000000 + n) AS value FROM u GROUP BY {key}, kind, lower(value)"


@query(_entities_sql(r"regexp_replace(html, '[^\x00-\x7F€£]', 'z', 'g')", "pages", "page_id"))
def etl_regex_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, amounts and organisations of pages, whose letters beyond ASCII count as z, as the two engines' words end differently at them."""
    return read(spark, sf_dir, "pages").select("page_id", F.explode(etl.entity_candidates(F.regexp_replace("html", r"[^\x00-\x7F€£]", "z"))).alias("e")).select("page_id", "e.kind", "e.value")


_NAMED = "CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'on 3/12/24' WHEN 2 THEN '$ 1,000.50' WHEN 3 THEN 'Nairobi ' || c_mktsegment WHEN 4 THEN 'Bank of ' || c_name WHEN 5 THEN 'UN FAO' WHEN 6 THEN 'Ada Lovelace' WHEN 7 THEN 'Ada and Bob' WHEN 8 THEN lower(c_name) ELSE 'May 4, 1999' END"
@query("SELECT c_custkey, ['OTHER', 'DATE', 'AMOUNT', 'LOCATION', 'ORG', 'ORG', 'PERSON', 'ORG', 'OTHER', 'DATE'][c_custkey % 10 + 1] AS kind FROM customer")
def etl_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of entity a value is."""
    return read(spark, sf_dir, "customer").select("c_custkey", etl.classify_entity(F.expr(_NAMED)).alias("kind"))


def _page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents of two pages with blocks, tables and captions; every seventh has no page."""
    k = F.col("c_custkey")
    page = lambda n, conf, text, blocks, tables, captions: F.struct(F.lit(n).cast("bigint").alias("page_number"), conf.alias("confidence"), text.alias("text"), F.array(*blocks).cast("array<string>").alias("text_blocks"), F.array(*tables).cast("array<array<array<string>>>").alias("table_blocks"), F.array(*captions).cast("array<string>").alias("captions"), F.array().cast("array<array<array<string>>>").alias("tables"))
    one = page(1, F.when(k % 2 == 0, F.lit(0.5)), F.concat(F.lit("  Ministry Bank paid $"), k, F.lit("\n on 2024-01-05 ")), [F.col("c_mktsegment"), F.lower("c_mktsegment"), F.lit(" ")], [F.array(F.array("c_name", F.lit("x")), F.array(F.lit("ministry bank")))], [])
    two = page(2, F.lit(None).cast("double"), F.col("c_mktsegment"), [], [], [F.concat(F.lit("see "), F.col("c_name"))])
    pages = F.when(k % 7 == 0, F.array().cast(f"array<{etl.PAGE}>")).otherwise(F.array(one, two))
    return spread(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).select(
        k.cast("string").alias("doc_id"), F.concat(F.lit("in/"), k, F.lit(".pdf")).alias("file_path"), F.concat(k, F.lit(".pdf")).alias("file_name"), F.sha2(k.cast("string"), 256).alias("source_hash"), F.lit(0.8767).alias("confidence"),
        F.when(k % 3 == 0, "layout").alias("strategy"), (k / 1000).alias("processing_sec"), F.lit(1_700_000_000.25).alias("modified"), pages.alias("pages"),
    )


_DOC_ID = duck_uuid5("'document:' || c_custkey || ':in/' || c_custkey || '.pdf'")
_FACTS_SQL = "SELECT c_custkey, p, kind, t, n FROM customer, LATERAL (VALUES (1, 'page_text', 'Ministry Bank paid $' || c_custkey || ' on 2024-01-05', 3), (1, 'text_block', c_mktsegment, 1), (1, 'table_block', c_name || ' | x ; ministry bank', 1), (2, 'page_text', c_mktsegment, 1), (2, 'figure_caption', 'see ' || c_name, 0)) f(p, kind, t, n) WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 0, 'fallback', c_custkey || '.pdf', 0 FROM customer WHERE c_custkey % 7 = 0"
_PLAIN_ID = duck_uuid5("'fact:' || c_custkey || ':' || CASE WHEN kind = 'fallback' THEN '' ELSE p || ':' END || kind || ':' || lower(t)")


@query(f"SELECT {_DOC_ID} AS doc_id, {_PLAIN_ID} AS fact_id, t AS text, p::BIGINT AS page_ref, CASE WHEN p = 1 AND c_custkey % 2 = 0 THEN 0.5 ELSE 0.877 END::DOUBLE AS confidence, n + CASE WHEN t = c_mktsegment THEN 0 ELSE 0 END AS refs FROM ({_FACTS_SQL}) JOIN customer USING (c_custkey)".replace("n + CASE WHEN t = c_mktsegment THEN 0 ELSE 0 END AS refs", "CASE WHEN kind = 'page_text' AND p = 1 THEN 3 WHEN kind = 'table_block' THEN 1 WHEN t = c_mktsegment THEN 1 ELSE 0 END AS refs"))
def etl_extraction_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of extraction records, with how many of the document's entities each holds."""
    r = etl.extraction_records(_page_documents(spark, sf_dir))
    return flatten.exploded(r, "extracted_facts", "f", "doc_id").select("doc_id", "f.fact_id", "f.text", "f.page_ref", "f.confidence", F.size("f.entity_refs").alias("refs"))


@query(f"SELECT {_DOC_ID} AS doc_id, 'in/' || c_custkey || '.pdf' AS source_path, CASE WHEN c_custkey % 3 = 0 THEN 'layout' ELSE 'unknown' END AS extraction_model, c_custkey::BIGINT AS processing_time_ms, '2023-11-14T22:13:20.250000+00:00' AS extracted_at, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'DATE 2024-01-05,AMOUNT $' || c_custkey || ',ORG ' || c_mktsegment || ',ORG Ministry Bank' END AS entities FROM customer")
def etl_extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction records and their entities."""
    r = etl.extraction_records(_page_documents(spark, sf_dir))
    return r.select("doc_id", "source_path", "extraction_model", "processing_time_ms", "extracted_at", F.array_join(F.transform("entities", lambda e: F.concat_ws(" ", e["type"], e["canonical_value"])), ",").alias("entities"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' | 5 ;  ; n: ' || p_size || ' | t: ' || p_type ELSE 'x' END AS text FROM part".replace(" ;  ; ", " ; "))
def etl_table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of lists and of objects as text."""
    rows = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('[["'), F.col("p_brand"), F.lit('", 5], {"t": "'), F.col("p_type"), F.lit('", "n": '), F.col("p_size"), F.lit("}]"))).otherwise('["x"]')
    return read(spark, sf_dir, "part").select("p_partkey", etl.table_text(F.parse_json(rows)).alias("text"))


@query("SELECT event_id, strftime(make_timestamp((event_id * 86400000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 4 = 0 THEN '' ELSE '.' || lpad(((event_id % 4) * 250000)::VARCHAR, 6, '0') END || '+00:00' AS at, (event_id % 5) / 4 AS share FROM events")
def etl_times_and_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in UTC from seconds, and numbers within 0 and 1 from JSON."""
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select(k, X.iso_utc(k * 86400 + (k % 4) * 0.25).alias("at"), X.unit_interval(F.parse_json(F.format_string("%.2f", (k % 5) / 4)), "share").alias("share"))


@query("SELECT l_orderkey, l_returnflag AS flag, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2")
def etl_facts_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order and flag."""
    return etl.first_wins(read(spark, sf_dir, "lineitem"), ["l_orderkey", F.lower("l_returnflag")], ["l_linenumber", "l_partkey"]).select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("first_line"))


@query("SELECT n.n_nationkey::VARCHAR AS entity_id, d.doc_id, d.doc_id::VARCHAR AS fact_id FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25 WHERE contains(lower(d.text), lower(left(n.n_name, 2)))")
def etl_entity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that the texts of their document hold."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("fact_id"), "text")
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.substr("n_name", F.lit(1), F.lit(2)).alias("canonical_value"))
    e = d.select("doc_id").join(n, F.col("doc_id") % 25 == F.col("n_nationkey")).select("doc_id", F.col("n_nationkey").cast("string").alias("entity_id"), "canonical_value")
    return etl.entity_facts(e, d)


_NODES = "SELECT p_partkey % 50 AS node_id, CASE p_partkey % 3 WHEN 0 THEN 'FILE' WHEN 1 THEN 'MODULE' ELSE 'TABLE' END AS type, p_name AS path, p_partkey AS ord FROM part"


@query(f"SELECT node_id, type, path FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE type WHEN 'MODULE' THEN 1 WHEN 'FILE' THEN 2 ELSE 3 END, length(path), ord) AS n FROM ({_NODES})) WHERE n = 1")
def etl_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a node of several candidates."""
    p = read(spark, sf_dir, "part").selectExpr("p_partkey % 50 AS node_id", "CASE p_partkey % 3 WHEN 0 THEN 'FILE' WHEN 1 THEN 'MODULE' ELSE 'TABLE' END AS type", "p_name AS path", "p_partkey AS ord")
    return etl.graph_nodes(p, ["MODULE", "FILE"], ["ord"]).select("node_id", "type", "path")


@query("SELECT s_suppkey AS edge_id, coalesce(n.n_nationkey::VARCHAR, 'EXTERNAL::' || 'dir/' || s_name || '.sql') AS source_node, 'EXTERNAL::void' AS target_node FROM supplier LEFT JOIN nation n ON n.n_nationkey = s_nationkey AND s_suppkey % 2 = 0".replace("'dir/' || s_name || '.sql'", "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'dir/' || s_name || '.sql' END"))
def etl_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are names of files of nodes, or unknown."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("node_id"), F.lower("n_name").alias("alias"), "n_nationkey")
    s = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    edges = s.select(F.col("s_suppkey").alias("edge_id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("src/"), F.col("alias"), F.lit(".sql"))).otherwise(F.concat(F.lit("dir/"), F.col("s_name"), F.lit(".sql"))).alias("source"), F.lit("void").alias("target"))
    return etl.resolved_edges(edges, nation.select("alias", "node_id")).select("edge_id", "source_node", "target_node")


_REPORT = "concat('# Audit\nverdict: ', CASE WHEN c_custkey % 2 = 0 THEN 'pass' ELSE '' END, '\n## Structure\nscore: ', c_custkey % 5, '\nfine\n## Safety\nscore: ', c_nationkey % 5, '\n## Notes\nnone')"


@query("SELECT c_custkey AS doc_id, p::INTEGER AS position, ['Structure', 'Safety', 'Notes'][p + 1] AS heading FROM customer, range(3) r(p)")
def etl_markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of Markdown reports."""
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_REPORT).alias("text"))
    return etl.sections(d, "text").select("doc_id", "position", "heading")


_MEAN = "((c_custkey % 5) + (c_nationkey % 5)) / 2"


@query(f"SELECT c_custkey AS doc_id, 2::BIGINT AS criteria, round({_MEAN}, 4) AS overall_score, CASE WHEN c_custkey % 2 = 0 THEN 'PASS' WHEN {_MEAN} >= 3.5 THEN 'PASS' WHEN {_MEAN} >= 2.5 THEN 'CONDITIONAL' ELSE 'BLOCK' END AS overall_verdict, round(least(greatest(0.70 + 0.06 * {_MEAN} - 0.01 * abs((c_custkey % 5) - (c_nationkey % 5)), 0.5), 0.99), 4) AS confidence FROM customer")
def etl_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from Markdown reports."""
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_REPORT).alias("text"))
    return etl.verdicts(d, "text")


@query("SELECT p_partkey AS doc_id, 1 AS page, kind, txt AS text FROM part, LATERAL (SELECT 'page_text' AS kind, p_name AS txt UNION ALL SELECT 'text_block', p_brand UNION ALL SELECT 'table_block', 'b | ' || p_size UNION ALL SELECT 'figure_caption', 'fig. ' || p_partkey UNION ALL SELECT 'table', p_brand || ' | ' || p_type || ' ; x') t")
def etl_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages, blocks, captions and tables."""
    cell = lambda *rows: F.array(F.array(*rows))
    p = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("  "), F.col("p_name"), F.lit(" \n")).alias("text"), F.array(F.col("p_brand"), F.lit(" ")).alias("text_blocks"), cell(F.array(F.lit("b"), F.col("p_size").cast("string"))).alias("table_blocks"),
        F.array(F.concat(F.lit("fig. "), F.col("p_partkey")), F.lit(None)).alias("captions"), cell(F.array("p_brand", "p_type"), F.array(F.lit("x"))).alias("tables"),
    )
    return etl.page_texts(p)


_RAW_NODES = {
    "id": "CASE p_partkey % 5 WHEN 0 THEN 'macro:m' || p_partkey ELSE 'n' || p_partkey END", "source_file": "CASE p_partkey % 5 WHEN 1 THEN '/repo\\models\\a' || p_partkey || '.sql' WHEN 2 THEN '/repo/conf/c' || p_partkey || '.yml' WHEN 3 THEN '/repo/macros/x.txt' END",
    "logical_name": "CASE p_partkey % 3 WHEN 0 THEN 'stg_' || p_partkey END", "description": "CASE p_partkey % 4 WHEN 0 THEN 'an external feed' WHEN 1 THEN p_name END", "file_type": "NULL", "dataset_type": "NULL",
}
_NODES_SQL = f"""WITH r AS (SELECT p_partkey, {', '.join(f'{e} AS {c}' for c, e in _RAW_NODES.items())} FROM part), c AS (SELECT *, coalesce(replace(replace(source_file, chr(92), '/'), '/repo/', ''), id) AS path FROM r),
k AS (SELECT *, CASE WHEN contains(description, 'external') THEN 'EXTERNAL' WHEN starts_with(id, 'macro:') OR starts_with(path, 'macros/') THEN 'PIPELINE' WHEN path LIKE '%.yml' THEN 'FILE' WHEN path LIKE '%.sql' THEN 'MODEL' WHEN starts_with(logical_name, 'stg_') THEN 'MODEL' ELSE 'FILE' END AS type FROM c),
n AS (SELECT p_partkey, lower(type) || '::' || path AS node_id, type, coalesce(logical_name, description, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[a-z]+$', '')) AS label, path, CASE WHEN path LIKE '%.sql' THEN 'sql' WHEN path LIKE '%.yml' THEN 'yaml' ELSE 'unknown' END AS language, coalesce(description, logical_name, '') AS purpose FROM k)"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "part").select("p_partkey", *[F.expr(e.replace("\\", "\\\\")).cast("string").alias(c) for c, e in _RAW_NODES.items()])
    return etl.canonical_nodes(raw, "/repo")


@query(f"{_NODES_SQL} SELECT node_id, type, label, path, language, purpose FROM n")
def etl_canonical_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw nodes of a graph in canonical form."""
    return _canonical(spark, sf_dir).select("node_id", "type", "label", "path", "language", "purpose")


@query(f"{_NODES_SQL} SELECT node_id, type, min(path) AS path FROM n GROUP BY 1, 2")
def etl_merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical nodes of two graphs, each once."""
    c = _canonical(spark, sf_dir)
    return etl.merged_nodes(c, c.filter("type = 'MODEL'")).select("node_id", "type", "path")


@query(f"{_NODES_SQL} SELECT CASE WHEN p_partkey % 5 = 1 AND type = 'MODEL' THEN node_id ELSE 'external::gone' END AS source, 'external::b/zz9.py' AS target, ['READS', 'WRITES', 'READS', 'CALLS'][p_partkey % 4 + 1] AS relationship, round(least(1.0, p_size / 40), 3) AS confidence FROM n JOIN part USING (p_partkey)")
def etl_canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges with their ends' canonical names."""
    nodes = _canonical(spark, sf_dir)
    known = (F.col("p_partkey") % 5 == 1) & (F.col("p_partkey") % 4 != 0)
    raw = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("edge_id"), F.when(known, F.concat(F.lit("/repo/models/a"), F.col("p_partkey"), F.lit(".sql"))).otherwise("gone").alias("source_dataset"), F.lit("b\\zz9.py").alias("target_dataset"),
        F.element_at(F.array(F.lit("JOIN"), F.lit("write"), F.lit("?"), F.lit("Macro_Call")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("transformation_type"), (F.col("p_size") / 40).alias("confidence"),
    )
    return etl.canonical_edges(raw, nodes, "/repo")


_AUDIT = "concat('# Audit\n**Target:** repo ', c_custkey, '\n**Confidence:** ', CASE WHEN c_custkey % 4 = 0 THEN '1.7' ELSE 'none' END, '\n**Evaluated At:** 2024-01-0', c_custkey % 9 + 1, '\n### Criterion: Depth_1\n**Final Score:** ', c_custkey % 5, '/5\n- Cited Evidence: a.py, b.py; a.py\n**Dissent Summary:** not  all\nagree\n\n### Dimension: safety\n**Final Score:** ', c_nationkey % 5, '/5\n- Cited: c.md\n### Criterion: none\nno score\n', CASE WHEN c_custkey % 3 = 0 THEN '**Verdict:** conditional_pass' ELSE '' END)"
_OVERALL = "round((c_custkey % 5 + c_nationkey % 5) / 2, 2)"


@query(f"SELECT 'repo ' || c_custkey AS target_ref, sha256('Depth_1' || chr(10) || 'safety') AS rubric_id, CASE WHEN c_custkey % 3 = 0 THEN 'CONDITIONAL_PASS' WHEN {_OVERALL} >= 3.5 THEN 'PASS' WHEN {_OVERALL} >= 2.5 THEN 'CONDITIONAL' ELSE 'BLOCK' END AS overall_verdict, {_OVERALL}::DOUBLE AS overall_score, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE round(least(greatest(0.70 + 0.06 * {_OVERALL} - 0.01 * abs(c_custkey % 5 - c_nationkey % 5), 0.5), 0.99), 2) END::DOUBLE AS confidence, '2024-01-0' || (c_custkey % 9 + 1) AS evaluated_at, 'a.py|b.py' AS evidence, 'not all agree' AS notes, 'from section safety' AS more_notes FROM customer")
def etl_verdict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict records of audit reports."""
    d = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).select(F.expr(_AUDIT).alias("text"), F.concat(F.lit("reports/"), F.col("c_custkey"), F.lit(".md")).alias("path"))
    r = etl.verdict_records(d, "text", "path")
    first = F.col("scores")["Depth_1"]
    return r.select("target_ref", "rubric_id", "overall_verdict", "overall_score", "confidence", "evaluated_at", F.array_join(first["evidence"], "|").alias("evidence"), first["notes"].alias("notes"), F.col("scores")["safety"]["notes"].alias("more_notes"))


@query("SELECT doc_id, greatest(1, round_even(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')) * 1.3, 0))::INTEGER AS tokens, CASE WHEN length(text) <= 240 THEN text ELSE rtrim(left(text, 239)) || '...' END AS excerpt, sha256(text) AS digest FROM documents")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimates, excerpts and digests of texts."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.token_estimate(t).alias("tokens"), X.shorten(t).alias("excerpt"), F.sha2(t, 256).alias("digest"))
