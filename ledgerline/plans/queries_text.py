"""Queries: texts, vectors, JSON, quarantine, model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.operators import ai
from ledgerline.operators import textchecks as T
from ledgerline.plans.registry import query, read, spread

_BAG = "SELECT {by} token, sum(1.0 / n) / any_value(texts) AS weight FROM (SELECT {by} unnest(w) AS token, len(w) AS n, texts FROM (SELECT *, count(*) OVER ({over}) AS texts FROM (SELECT *, list_filter(string_split_regex(lower({column}), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) > 0)) GROUP BY ALL"


@query(f"SELECT source, token, round(weight, 6) AS weight FROM ({_BAG.format(by='source,', over='PARTITION BY source', column='text', table='documents')})")
def bow_centroid_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's mean bag of words."""
    return T.bag(read(spark, sf_dir, "documents"), "text", ["source"]).withColumn("weight", F.round("weight", 6))


_COSINE = "SELECT 1 - sum(coalesce(a.weight, 0) * coalesce(b.weight, 0)) / (sqrt(sum(coalesce(a.weight, 0) ** 2)) * sqrt(sum(coalesce(b.weight, 0) ** 2))) AS d FROM a FULL JOIN b USING (token)"


@query(f"WITH a AS ({_BAG.format(by='', over='', column='text', table='benchmark')}), b AS ({_BAG.format(by='', over='', column='text', table='documents')}), c AS ({_COSINE}) SELECT round(d, 4) AS distance, CASE WHEN d >= 0.3 THEN 'FAIL' WHEN d >= 0.1 THEN 'WARN' ELSE 'PASS' END AS status FROM c")
def bow_cosine_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the documents' words are from the benchmark's."""
    a, b = T.bag(read(spark, sf_dir, "benchmark"), "text"), T.bag(read(spark, sf_dir, "documents"), "text")
    return T.cosine_distance(a, b).select(F.round("distance", 4).alias("distance"), T.drift_status(F.col("distance")).alias("status"))


@query("SELECT label, (place - 1)::INTEGER AS place, round(avg(v::DOUBLE), 5) AS value FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL")
def emb_centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's mean vector."""
    return T.centroids(read(spark, sf_dir, "embeddings"), "embedding", "label").withColumn("value", F.round("value", 5))


@query("WITH c AS (SELECT label, place, avg(v::DOUBLE) AS weight FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL), a AS (SELECT place AS token, weight FROM c WHERE label = 0), b AS (SELECT place AS token, weight FROM c WHERE label = 1) SELECT round(d, 4) AS distance FROM (" + _COSINE + ")")
def emb_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine distance of two labels' mean vectors."""
    c = T.centroids(read(spark, sf_dir, "embeddings"), "embedding", "label").withColumnRenamed("value", "weight")
    return T.cosine_distance(c.filter("label = 0"), c.filter("label = 1"), "place").select(F.round("distance", 4).alias("distance"))


_EVENT_JSON = "CASE event_id % 7 WHEN 0 THEN '{\"k\": 1}' WHEN 1 THEN '{\"k\": \"x\", \"t\": \"e\"}' WHEN 2 THEN '{\"k\": null, \"t\": \"e\"}' WHEN 3 THEN 'oops' WHEN 4 THEN '{\"k\": true, \"t\": 5}' ELSE '{\"k\": ' || event_id || ', \"t\": \"' || event_type || '\"}' END"
_SCHEMA = {"k": "integer", "t": "string"}
_FAULTS = f"""(SELECT event_id, j, CASE WHEN NOT json_valid(j) THEN ['not JSON'] ELSE list_filter([
 CASE WHEN json_type(j, '$.k') IS NULL THEN 'k: missing' WHEN json_type(j, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN') THEN 'k: not a integer' END,
 CASE WHEN json_type(j, '$.t') IS NULL THEN 't: missing' WHEN json_type(j, '$.t') <> 'VARCHAR' THEN 't: not a string' END], lambda x: x IS NOT NULL) END AS e
 FROM (SELECT event_id, {_EVENT_JSON} AS j FROM events))"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON text an event, of every kind of fault and none: events' own properties have no faults."""
    return read(spark, sf_dir, "events").select("event_id", F.expr(_EVENT_JSON).alias("record"))


@query(f"SELECT count(*)::BIGINT AS records, count(*) FILTER (WHERE len(e) > 0)::BIGINT AS violations, round(count(*) FILTER (WHERE len(e) > 0) / count(*), 6) AS rate, 'FAIL' AS status FROM {_FAULTS}")
def prompt_schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that don't fit a JSON schema."""
    return T.prompt_schema(_records(spark, sf_dir), "record", _SCHEMA)


@query("SELECT count(*)::BIGINT AS records, count(*) FILTER (WHERE json_type(props, '$.k') IS NULL OR json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT'))::BIGINT AS violations, round(count(*) FILTER (WHERE json_type(props, '$.k') IS NULL OR json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT')) / count(*), 6) AS rate, CASE WHEN count(*) FILTER (WHERE json_type(props, '$.k') IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM events")
def props_schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the properties of events, as they are, fit a JSON schema."""
    return T.prompt_schema(read(spark, sf_dir, "events"), "props", {"k": "integer"})


@query(f"SELECT event_id, array_to_string(e, '; ') AS errors FROM {_FAULTS} WHERE len(e) > 0")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantined ones, with why."""
    return T.split(_records(spark, sf_dir), "record", _SCHEMA)[1].select("event_id", F.array_join("schema_errors", "; ").alias("errors"))


@query(f"SELECT error, count(*)::BIGINT AS records, array_to_string(list_slice(list_sort(list(DISTINCT event_id::VARCHAR)), 1, 3), ',') AS samples FROM (SELECT event_id, unnest(e) AS error FROM {_FAULTS}) GROUP BY 1")
def quarantine_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by number, three samples each (a report)."""
    return T.error_histogram(T.split(_records(spark, sf_dir), "record", _SCHEMA)[1], "event_id")


@query(f"SELECT event_id FROM {_FAULTS} WHERE len(e) > 0 AND len(list_filter(e, lambda x: x NOT IN ('t: missing', 't: not a string'))) = 0")
def quarantine_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined rows with allowed errors only."""
    return T.requeue(T.split(_records(spark, sf_dir), "record", _SCHEMA)[1], ["t: missing", "t: not a string"]).select("event_id")


@query("WITH r AS (SELECT (event_type = 'error')::INTEGER AS bad, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () AS c FROM events), t AS (SELECT count(*)::BIGINT AS records, sum(bad)::BIGINT AS violations, avg(bad) AS rate, avg(bad) FILTER (WHERE n > c // 2) - avg(bad) FILTER (WHERE n <= c // 2) AS move FROM r) SELECT records, violations, round(rate, 6) AS rate, CASE WHEN rate = 0 THEN 'PASS' WHEN rate < 0.05 THEN 'WARN' ELSE 'FAIL' END AS status, CASE WHEN move > 0.05 THEN 'increasing' WHEN move < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend, rate > 0.05 AS logged FROM t")
def llm_rate_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of errors among events and its trend."""
    e = read(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "error")
    return T.violation_trend(e, "bad", ["ts", "event_id"])


_ANSWER = """CASE event_id % 11 WHEN 0 THEN '{}' WHEN 1 THEN '{"verdict": null}' WHEN 2 THEN '{"verdict": {"confidence": 0.5, "reasoning": "r"}}' WHEN 3 THEN '{"verdict": {"decision": "d", "reasoning": "r"}}'
 WHEN 4 THEN '{"verdict": {"decision": "d", "confidence": 1.5}}' WHEN 5 THEN '{"verdict": {"decision": "d", "confidence": "high", "reasoning": "r"}}' WHEN 6 THEN '{"verdict": "oops {"}' WHEN 7 THEN '{"verdict": "[1, 2]"}' WHEN 8 THEN '{"verdict": 7}'
 WHEN 9 THEN concat('{"verdict": {"decision": "d", "confidence": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END, ', "reasoning": "r"}}') ELSE concat('{"verdict": {"decision": "', event_type, '", "confidence": ', CAST(floor(value) AS INTEGER) / 50, ', "reasoning": "r"}}') END"""
_KINDS = f"""(SELECT event_id, CASE WHEN t IS NULL OR t = 'NULL' THEN ['missing_verdict']
 WHEN t = 'OBJECT' THEN list_filter([CASE WHEN json_type(v, '$.decision') IS NULL THEN 'missing_decision' WHEN c IS NULL THEN 'missing_confidence' WHEN json_type(v, '$.reasoning') IS NULL THEN 'missing_reasoning' END,
  CASE WHEN c IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN CASE WHEN CASE v ->> '$.confidence' WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE (v ->> '$.confidence')::DOUBLE END NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range' END WHEN c <> 'NULL' THEN 'confidence_type_mismatch' END], lambda x: x IS NOT NULL)
 WHEN t = 'VARCHAR' THEN CASE WHEN NOT json_valid(j ->> '$.verdict') THEN ['unparseable_json'] WHEN json_type((j ->> '$.verdict')::JSON) <> 'OBJECT' THEN ['invalid_json_structure'] ELSE [] END ELSE ['unexpected_type'] END AS kinds
 FROM (SELECT event_id, j, json_type(j, '$.verdict') AS t, j -> '$.verdict' AS v, json_type(j -> '$.verdict', '$.confidence') AS c FROM (SELECT event_id, ({_ANSWER})::JSON AS j FROM events)))"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer an event, of all kinds of violation and none."""
    return spread(read(spark, sf_dir, "events").select("event_id", "event_type", "value")).select("event_id", F.try_parse_json(F.expr(_ANSWER)).alias("answer"))


@query(f"SELECT violation, count(*)::BIGINT AS records FROM (SELECT unnest(kinds) AS violation FROM {_KINDS}) GROUP BY 1")
def llm_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of answers by kind."""
    return T.violation_breakdown(_answers(spark, sf_dir).select(T.verdict_faults(F.col("answer")).alias("kinds")), "kinds")


@query(f"WITH k AS (SELECT (len(kinds) > 0)::INTEGER AS bad, row_number() OVER (ORDER BY event_id) AS n, count(*) OVER () AS c FROM {_KINDS}), t AS (SELECT count(*)::BIGINT AS records, sum(bad)::BIGINT AS violations, avg(bad) AS rate, avg(bad) FILTER (WHERE n > c // 2) - avg(bad) FILTER (WHERE n <= c // 2) AS move FROM k) SELECT 'llm_output_violation_rate' AS check_type, CASE WHEN rate = 0 THEN 'PASS' WHEN rate < 0.05 THEN 'WARN' ELSE 'FAIL' END AS status, 'HIGH' AS severity, records, round(rate, 6) AS measure, violations || ' of ' || records || ' answers, ' || CASE WHEN move > 0.05 THEN 'increasing' WHEN move < -0.05 THEN 'decreasing' ELSE 'stable' END AS message FROM t")
def llm_output_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of answers with a violation, as a check."""
    return ai.output_violations(_answers(spark, sf_dir), "answer", ["event_id"])


_CHECKS = "(SELECT 'c' || (event_id % 9) AS check_type, CASE WHEN event_id % 4 = 0 AND user_id % 2 = 0 THEN 'WARN' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, event_type FROM events)"


@query(f"SELECT event_type, count(*)::BIGINT AS total_checks, count(*) FILTER (WHERE status = 'PASS')::BIGINT AS passed, count(*) FILTER (WHERE status = 'WARN')::BIGINT AS warned, count(*) FILTER (WHERE status = 'FAIL')::BIGINT AS failed, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'HIGH' WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM {_CHECKS} GROUP BY 1")
def ai_risk_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk of model checks, by type of event."""
    c = read(spark, sf_dir, "events").selectExpr("concat('c', event_id % 9) AS check_type", "CASE WHEN event_id % 4 = 0 AND user_id % 2 = 0 THEN 'WARN' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status", "event_type")
    types = [r[0] for r in c.select("event_type").distinct().orderBy("event_type").collect()]
    out = None
    for t in types:
        one = ai.summary(c.filter(F.col("event_type") == t)).select(F.lit(t).alias("event_type"), "total_checks", "passed", "warned", "failed", "risk_level")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT conv_id, turn, k AS key, CASE WHEN k IN ('api_key', 'user_password') THEN '<redacted>' WHEN k = 'role' THEN role ELSE turn::VARCHAR END AS value FROM conversations, (VALUES ('api_key'), ('user_password'), ('role'), ('turn')) t(k)")
def scrub_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the values of sensitive keys hidden."""
    m = F.create_map(F.lit("api_key"), F.lit("k1"), F.lit("user_password"), F.lit("p"), F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(X.scrub(m)).alias("key", "value"))
