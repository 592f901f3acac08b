"""Queries: contract versions, graphs, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.operators import evolve, graph
from ledgerline.plans.queries_checks import VALIDATE_SQL, duck_uuid5, validate_contract
from ledgerline.plans.registry import query, read, spread

OLD = [
    ("facts", "confidence", "number", True, None, 0.0, 1.0), ("facts", "fact_id", "string", True, None, None, None), ("facts", "kind", "string", True, ["a", "b"], None, None),
    ("facts", "page", "integer", False, None, 1.0, None), ("facts", "note", "string", False, None, None, None), ("logs", "line", "string", True, None, None, None),
    ("facts", "count", "integer", False, None, None, 10.0),
]
NEW = [
    ("facts", "confidence", "integer", True, None, 0.0, 100.0), ("facts", "kind", "string", True, ["b", "c"], None, None), ("facts", "page", "string", False, None, 1.0, None),
    ("facts", "note", "string", False, None, None, None), ("facts", "extra", "string", False, None, None, None), ("facts", "owner", "string", True, None, None, None),
    ("facts", "count", "integer", False, None, None, 5.0), ("audit", "who", "string", True, None, None, None),
]
SUBSCRIPTIONS = [
    ("intake", "planner", [("deep.facts.confidence", "scale"), ("facts.fact_id", "key")]), ("intake", "auditor", [("kind", "enum"), (None, "nothing")]), ("intake", "viewer", []),
]


def _frames(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    subs = spark.createDataFrame([(c, s, [{"field": f, "reason": r} for f, r in b]) for c, s, b in SUBSCRIPTIONS], "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>")
    return spark.createDataFrame(OLD, evolve.CLAUSES), spark.createDataFrame(NEW, evolve.CLAUSES), subs


def _values(rows: list[tuple]) -> str:
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, (str, float)) else "[" + ", ".join(map(repr, x)) + "]"
    return "(SELECT t, f, ty, rq, en::VARCHAR[] AS en, mn::DOUBLE AS mn, mx::DOUBLE AS mx FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ") v(t, f, ty, rq, en, mn, mx))"


_DIFF_SQL = f"""
WITH o AS {_values(OLD)}, n AS {_values(NEW)}, j AS (SELECT coalesce(o.t, n.t) AS table_name, coalesce(o.f, n.f) AS field, o.f IS NULL AS came, n.f IS NULL AS gone, o.ty AS oty, n.ty AS nty, o.rq AS orq, n.rq AS nrq, coalesce(o.en, []::VARCHAR[]) AS oen, coalesce(n.en, []::VARCHAR[]) AS nen, o.mn AS omn, n.mn AS nmn, o.mx AS omx, n.mx AS nmx FROM o FULL JOIN n ON o.t = n.t AND o.f = n.f),
k AS (SELECT *, CASE WHEN oty = 'number' AND omx <= 1 AND nmx >= 100 THEN 'CRITICAL|scale change' WHEN oty = nty THEN NULL WHEN oty = 'number' AND nty = 'integer' THEN 'CRITICAL|fraction lost' WHEN oty = 'string' AND nty IN ('integer', 'number', 'boolean') THEN 'CRITICAL|narrowed' WHEN oty = 'integer' AND nty = 'string' THEN 'CRITICAL|number to text' ELSE 'HIGH|type changed' END AS ch FROM j),
d AS (
 SELECT table_name, field, 'field removed' AS change, CASE WHEN orq THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM k WHERE gone UNION ALL
 SELECT table_name, field, CASE WHEN nrq THEN 'required field added' ELSE 'optional field added' END, CASE WHEN nrq THEN 'CRITICAL' ELSE 'COMPAT' END FROM k WHERE came UNION ALL
 SELECT table_name, field, 'type: ' || split_part(ch, '|', 2), split_part(ch, '|', 1) FROM k WHERE NOT gone AND NOT came AND ch IS NOT NULL UNION ALL
 SELECT table_name, field, 'enum values removed', 'CRITICAL' FROM k WHERE NOT gone AND NOT came AND len(list_filter(oen, lambda x: NOT list_contains(nen, x))) > 0 AND len(nen) > 0 UNION ALL
 SELECT table_name, field, 'enum values added', 'COMPAT' FROM k WHERE NOT gone AND NOT came AND len(list_filter(nen, lambda x: NOT list_contains(oen, x))) > 0 UNION ALL
 SELECT table_name, field, 'range tightened', 'CRITICAL' FROM k WHERE NOT gone AND NOT came AND ((nmn IS NOT NULL AND (omn IS NULL OR nmn > omn)) OR (nmx IS NOT NULL AND (omx IS NULL OR nmx < omx))) UNION ALL
 SELECT table_name, field, 'range widened', 'COMPAT' FROM k WHERE NOT gone AND NOT came AND ((omn IS NOT NULL AND (nmn IS NULL OR nmn < omn)) OR (omx IS NOT NULL AND (nmx IS NULL OR nmx > omx))) UNION ALL
 SELECT DISTINCT t, NULL, 'table removed', 'CRITICAL' FROM o WHERE t NOT IN (SELECT t FROM n) UNION ALL
 SELECT DISTINCT t, NULL, 'table added', 'COMPAT' FROM n WHERE t NOT IN (SELECT t FROM o))
SELECT *, severity <> 'COMPAT' AS breaking FROM d"""


@query(_DIFF_SQL)
def diff_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two versions of a contract."""
    old, new, _ = _frames(spark)
    return evolve.diff(old, new)


@query(f"SELECT table_name, field, change, CASE WHEN starts_with(change, 'type') THEN 'restore the type of ' WHEN contains(change, 'removed') THEN 'restore ' WHEN contains(change, 'added') THEN 'make optional ' ELSE 'restore the range of ' END || concat_ws('.', table_name, field) AS plan FROM ({_DIFF_SQL}) WHERE breaking")
def rollback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What undoes them."""
    return evolve.rollback(diff_contracts(spark, sf_dir))


_SUBS_SQL = "(VALUES ('planner', 'deep.facts.confidence'), ('planner', 'facts.fact_id'), ('auditor', 'kind')) s(subscriber_id, field)"


@query(f"WITH gone AS (SELECT t, f FROM {_values(OLD)} EXCEPT SELECT t, f FROM {_values(NEW)}), hit AS (SELECT * FROM {_SUBS_SQL} WHERE field IN (SELECT f FROM gone UNION ALL SELECT t || '.' || f FROM gone)) SELECT count(DISTINCT subscriber_id)::BIGINT AS broken_subscribers, count(*)::BIGINT AS broken_fields, CASE WHEN count(*) > 0 THEN 'BLOCK' ELSE 'PASS' END AS decision FROM hit")
def gate_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the new version may be deployed."""
    return evolve.gate(*_frames(spark))


@query(f"SELECT table_name, d.field, change, count(DISTINCT subscriber_id)::BIGINT AS subscribers, min(subscriber_id) AS first_subscriber, count(DISTINCT subscriber_id) = 0 AS unregistered_risk, CASE WHEN contains(change, 'removed') THEN 'missing column' WHEN starts_with(change, 'type') THEN 'cast error' ELSE 'rejected values' END AS failure_mode FROM ({_DIFF_SQL}) d LEFT JOIN {_SUBS_SQL} ON s.field = d.table_name || '.' || d.field OR ends_with(s.field, '.' || d.field) WHERE breaking AND d.field IS NOT NULL GROUP BY 1, 2, 3")
def consumer_failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaking changes and whom they break."""
    return evolve.consumer_failures(diff_contracts(spark, sf_dir), _frames(spark)[2])


@query("WITH e AS (SELECT DISTINCT c_custkey % 40 AS source, (c_custkey * 7 + c_nationkey) % 40 AS target FROM customer), w AS (WITH RECURSIVE r(node, depth) AS (SELECT target, 1 FROM e WHERE source = 3 UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.node WHERE r.depth < 40) SELECT * FROM r) SELECT node::BIGINT AS node, min(depth)::INTEGER AS depth FROM w GROUP BY 1")
def reach_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes that a change of node 3 reaches, with the fewest steps; the graph has cycles, and of its 40 nodes none is more than 40 steps away."""
    c = read(spark, sf_dir, "customer")
    edges = c.select((F.col("c_custkey") % 40).alias("source"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 40).alias("target"))
    return graph.reachable(edges, spark.createDataFrame([(3,)], "node bigint"))


@query("SELECT c_custkey::BIGINT AS subscriber FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name = 'BUILDING'")
def direct_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions by source or contract."""
    s = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subscriber"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("source_contract"))
    return graph.direct(s, "BUILDING").select("subscriber")


@query("SELECT DISTINCT p_partkey::VARCHAR AS node_id, p_name AS label, p_brand AS path FROM part, (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT 'brand#1') n WHERE name <> '' AND (contains(lower(p_name), lower(name)) OR contains(lower(p_brand), lower(name)))")
def lineage_match_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes, whose name or brand holds a first word of any part, or a brand."""
    p = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"))
    nodes = p.select(F.col("p_partkey").cast("string").alias("node_id"), F.col("p_name").alias("label"), F.col("p_brand").alias("path"))
    names = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).unionByName(spark.createDataFrame([("brand#1",)], "name string"))
    return graph.lineage_matches(nodes, names)


_COMMITS = "SELECT o_orderkey::VARCHAR AS hash, round(greatest(0, least(1, 1 - 0.1 * ((epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) / 86400 / 400) - 0.2 * 1)), 4) AS score FROM orders ORDER BY score DESC, hash LIMIT 5"


@query(_COMMITS)
def blame_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five orders with the highest scores, as commits whose days pass 400 times as slowly (a top-k report)."""
    day = (F.lit("2000-01-01").cast("timestamp").cast("double") - F.col("o_orderdate").cast("timestamp").cast("double")) / 400
    commits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("hash"), F.timestamp_micros(((F.lit("2000-01-01").cast("timestamp").cast("double") - day) * 1000000).cast("long")).cast("string").alias("ts"))
    return graph.blame(commits, "2000-01-01 00:00:00", hops=1).select("hash", "score")


@query(f"SELECT {duck_uuid5(chr(39) + 'trade:snap:' + chr(39) + ' || o_orderkey')} AS violation_id, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def violation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of violations."""
    return read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(X.uuid5(F.concat(F.lit("trade:snap:"), F.col("o_orderkey"))).alias("violation_id"), "o_orderkey")


@query(f"SELECT {duck_uuid5(chr(39) + 'trade:snap:' + chr(39) + ' || check_id')} AS violation_id, check_id, status, severity, 2::BIGINT AS reached, 2 AS depth, 'b' AS commit FROM ({VALIDATE_SQL}) WHERE status <> 'PASS'")
def attribute_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing checks with their reach and likely commit."""
    reach = spark.createDataFrame([("planner", 1), ("viewer", 2)], "node string, depth int")
    culprits = spark.createDataFrame([("a", 0.4), ("b", 0.9)], "hash string, score double")
    return graph.attribute(validate_contract(spark, sf_dir), "trade", "snap", reach, culprits)
