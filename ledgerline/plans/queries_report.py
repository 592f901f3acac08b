"""Queries: reports over results and logs, and the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import ai, evolve, report
from ledgerline.plans.contract import Field, Table
from ledgerline.plans.queries_checks import VALIDATE_SQL, validate_contract
from ledgerline.plans.queries_evolve import _DIFF_SQL, _SUBS_SQL, diff_contracts
from ledgerline.plans.queries_text import _answers
from ledgerline.plans.registry import query, read
from ledgerline.streaming import enforce

_R = f"({VALIDATE_SQL})"


@query(f"SELECT total, passed, failed, criticals, round(100.0 * passed / total, 1) AS pass_rate, greatest(0, least(100, round_even(100.0 * passed / total - 20 * criticals, 0)))::INTEGER AS score, CASE WHEN failed > 0 THEN 'ISSUES_DETECTED' ELSE 'ATTENTION_REQUIRED' END AS verdict FROM (SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE status = 'PASS')::BIGINT AS passed, count(*) FILTER (WHERE status = 'FAIL')::BIGINT AS failed, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL')::BIGINT AS criticals FROM {_R})")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of a validation."""
    return report.health(validate_contract(spark, sf_dir))


@query(f"SELECT severity, status, count(*)::BIGINT AS checks FROM {_R} GROUP BY ROLLUP (severity, status)")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by severity and status with subtotals."""
    return report.rollup(validate_contract(spark, sf_dir))


_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'COMPAT' THEN 4 ELSE 5 END"


@query(f"SELECT check_id, status, severity, records_failing, {_RANK} AS rank FROM {_R} WHERE status <> 'PASS'")
def issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that aren't PASS, ranked."""
    return report.issues(validate_contract(spark, sf_dir)).select("check_id", "status", "severity", "records_failing", "rank")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 2 = 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'PASS' ELSE 'ATTENTION_REQUIRED' END ELSE 'ISSUES_DETECTED' END AS verdict FROM customer")
def health_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three verdicts, of customers as runs."""
    evolution = F.when(F.col("c_mktsegment") == "BUILDING", "compatible").when(F.col("c_mktsegment") == "MACHINERY", "breaking").otherwise("unknown")
    return read(spark, sf_dir, "customer").select("c_custkey", report.verdict(F.col("c_custkey") % 3, F.col("c_nationkey") % 2, evolution).alias("verdict"))


_FIELD_SQL = "CASE WHEN contains(check_id, '.') THEN split_part(check_id, '.', 1) || '.' || column_name ELSE column_name END"
_ACTIONS_SQL = f"""WITH a AS (SELECT CASE WHEN status = 'FAIL' AND severity = 'CRITICAL' THEN 0 WHEN status = 'FAIL' THEN 1 ELSE 2 END AS priority, 'contracts/unknown.yaml' AS file, {_FIELD_SQL} AS field, check_id AS clause, severity, NULL::VARCHAR AS consumer FROM {_R} WHERE status <> 'PASS'
 UNION ALL SELECT CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 1 ELSE 3 END, 'contracts/trade.yaml', concat_ws('.', d.table_name, d.field), change, severity, (SELECT min(subscriber_id) FROM {_SUBS_SQL} WHERE breaking AND (s.field = d.table_name || '.' || d.field OR ends_with(s.field, '.' || d.field))) FROM ({_DIFF_SQL}) d
 UNION ALL SELECT 2, 'reports/models.json', 'unknown', 'llm_output_violation_rate', 'HIGH', NULL
 UNION ALL SELECT DISTINCT CASE sev WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 3 ELSE 4 END, 'reports/violations', event_type, 'c.' || event_type, sev, NULL FROM (SELECT event_type, CASE user_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS sev FROM events WHERE user_id = (SELECT max(user_id) FROM events)))"""
_ACTION_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'COMPAT' THEN 4 ELSE 5 END"


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of one contract, a run a user."""
    severity = "CASE user_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity"
    return read(spark, sf_dir, "events").selectExpr("cast(event_id as string) AS violation_id", "'trade' AS contract_id", "concat('r', lpad(user_id, 12, '0')) AS run_id", "lpad(user_id, 12, '0') AS run_timestamp", "event_type AS column_name", "concat('c.', event_type) AS check_id", "'c' AS check_type", severity)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.plans.queries_evolve import _frames

    results, changes = validate_contract(spark, sf_dir), diff_contracts(spark, sf_dir)
    return report.action_candidates(report.result_actions(results), report.change_actions(changes, evolve.consumer_failures(changes, _frames(spark)[2]), "trade"), report.model_actions(ai.output_violations(_answers(spark, sf_dir), "answer", ["event_id"])), report.log_actions(_violations(spark, sf_dir)))


@query(f"{_ACTIONS_SQL} SELECT * FROM a")
def action_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is to do, from results, contract changes, model checks and the log."""
    return _candidates(spark, sf_dir).drop("rationale")


@query(f"{_ACTIONS_SQL} SELECT * FROM a ORDER BY priority, {_ACTION_RANK}, file, field, clause LIMIT 3")
def prioritized_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most pressing actions (a top-k report)."""
    return report.actions(_candidates(spark, sf_dir)).drop("rationale")


@query("SELECT violations, sev AS severity, n FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS sev, count(*)::BIGINT AS n, (sum(count(*)) OVER ())::BIGINT AS violations FROM events WHERE user_id = (SELECT max(user_id) FROM events) GROUP BY 1)")
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run's violations by severity."""
    return report.violation_summary(_violations(spark, sf_dir)).select("violations", F.explode("by_severity").alias("severity", "n"))


@query(f"SELECT 1::BIGINT AS contracts, count(*)::BIGINT AS total_checks, count(*) FILTER (WHERE status = 'PASS')::BIGINT AS total_passed, count(*) FILTER (WHERE status = 'FAIL')::BIGINT AS total_failed, count(*) FILTER (WHERE status = 'WARN')::BIGINT AS total_warned, round(100.0 * count(*) FILTER (WHERE status = 'PASS') / count(*), 1) AS pass_rate_pct, count(*) FILTER (WHERE status <> 'PASS' AND severity = 'HIGH')::BIGINT AS high FROM {_R}")
def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the results of contracts."""
    got = report.validation_summary(validate_contract(spark, sf_dir).withColumn("contract_id", F.lit("trade")))
    return got.select("contracts", "total_checks", "total_passed", "total_failed", "total_warned", "pass_rate_pct", F.coalesce(F.col("severity_counts")["HIGH"], F.lit(0)).alias("high"))


@query(f"SELECT check_id, CASE WHEN check_type = 'enum' THEN 'list the values of ' || column_name WHEN starts_with(check_type, 'schema_') THEN 'agree on ' || column_name ELSE 'look at ' || {_FIELD_SQL} || ': ' || check_type END AS step FROM {_R} WHERE status <> 'PASS'")
def remediation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about each failing check."""
    t = spark.createDataFrame([("enum", "list the values of {column}"), ("schema_*", "agree on {column}"), ("*", "look at {label}: {check_type}")], "pattern string, template string")
    return report.remediation(validate_contract(spark, sf_dir), t)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: every fiftieth is a run's header."""
    e = read(spark, sf_dir, "events")
    head = F.col("event_id") % 50 == 0
    return e.select((F.col("user_id") % 4).cast("string").alias("contract_id"), F.when(head, "run_header").otherwise("violation").alias("record_type"), F.when(head, F.concat(F.lit("r"), F.col("event_id"))).alias("run_id"), "event_id")


@query("SELECT event_id, contract_id, run FROM (SELECT event_id, (user_id % 4)::VARCHAR AS contract_id, event_id % 50 = 0 AS head, last_value(CASE WHEN event_id % 50 = 0 THEN 'r' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id % 4 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM events) WHERE NOT head")
def log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with the run that they belong to."""
    return report.runs(_log(spark, sf_dir), "event_id").select("event_id", "contract_id", "run")


@query("WITH l AS (SELECT event_id, (user_id % 4)::VARCHAR AS contract_id, strftime(ts, '%Y-%m-%d') AS run_timestamp, 'r' || (event_id % 13) AS run_id FROM events), m AS (SELECT contract_id, max(run_timestamp || run_id) AS k FROM l GROUP BY 1) SELECT event_id, l.contract_id, run_id FROM l JOIN m ON l.contract_id = m.contract_id AND run_timestamp || run_id = k")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each contract's last run."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).cast("string").alias("contract_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_timestamp"), F.concat(F.lit("r"), F.col("event_id") % 13).alias("run_id"))
    return report.latest_run(e).select("event_id", "contract_id", "run_id")


@query(f"""WITH r AS (SELECT *, CASE WHEN status = 'FAIL' AND severity = 'CRITICAL' THEN 0 WHEN status = 'FAIL' AND severity = 'HIGH' THEN 1 WHEN status = 'WARN' THEN 3 END AS g FROM {_R}), b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY check_id) AS n FROM r WHERE g IS NOT NULL)
SELECT (g * 100 + n)::INTEGER AS place, CASE g WHEN 0 THEN 'CRITICAL: mend ' WHEN 1 THEN 'HIGH: mend ' ELSE 'WARN: look at ' END || check_id AS line FROM b WHERE n <= CASE WHEN g = 3 THEN 1 ELSE 2 END
UNION ALL SELECT 200, x || ' more checks fail' FROM (SELECT count(*) FILTER (WHERE status = 'FAIL') - least(2, count(*) FILTER (WHERE g = 0)) - least(2, count(*) FILTER (WHERE g = 1)) AS x FROM r) WHERE x > 0
UNION ALL SELECT 390, x || ' more checks warn' FROM (SELECT count(*) FILTER (WHERE status = 'WARN') - 1 AS x FROM r) WHERE x > 0
UNION ALL SELECT 500, x || ' breaking changes: plan the migration before they are deployed' FROM (SELECT count(*) AS x FROM ({_DIFF_SQL}) WHERE breaking) WHERE x > 0
UNION ALL SELECT 600, x || ' violations are logged: tell their owners' FROM (SELECT count(*) AS x FROM events WHERE user_id = (SELECT max(user_id) FROM events)) WHERE x > 0""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do, in lines (a top-k report)."""
    return report.recommendations(validate_contract(spark, sf_dir), changes=diff_contracts(spark, sf_dir), violations=report.violation_summary(_violations(spark, sf_dir)), each=2, warned=1)


@query("SELECT snapshot, rank FROM (SELECT 's' || strftime(o_orderdate, '%Y%m%d') AS snapshot, (row_number() OVER (ORDER BY strftime(o_orderdate, '%Y%m%d') DESC))::INTEGER AS rank FROM (SELECT DISTINCT o_orderdate FROM orders)) WHERE rank <= 2")
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest of dated snapshots (a top-k report)."""
    d = read(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.date_format("o_orderdate", "yyyyMMdd")).alias("snapshot")).distinct()
    top = d.orderBy(F.col("snapshot").desc()).limit(2)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("snapshot").desc())))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*)::BIGINT AS \"rows\", count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup') OR value < 0 OR value > 100)::BIGINT AS violations FROM events GROUP BY 1")
def stream_violation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by day, as the streaming extension counts them, over the table."""
    table = Table("events", (Field("event_type", enum=("view", "click", "purchase", "signup")), Field("value", "number", minimum=0, maximum=100)))
    return enforce.violation_windows(read(spark, sf_dir, "events"), table, "ts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "rows", "violations")
