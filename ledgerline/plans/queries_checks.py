"""Queries: checks, quality rules, profiles, inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.operators import checks, infer, profile, validation
from ledgerline.operators import rules as rulebook
from ledgerline.plans.contract import Contract, Enforcement, Field, ForeignKey, Rule, Table
from ledgerline.plans.registry import query, read

LINEITEM = Table("lineitem", (
    Field("l_orderkey", "integer", True), Field("l_partkey", "integer", True), Field("l_suppkey", "integer", True), Field("l_linenumber", "integer", True, minimum=1, maximum=7),
    Field("l_quantity", "number", True, minimum=1, maximum=50), Field("l_extendedprice", "number", True, minimum=0), Field("l_discount", "number", True, minimum=0, maximum=0.08),
    Field("l_tax", "number", True, minimum=0, maximum=0.08), Field("l_returnflag", "string", True, enum=("A", "N")), Field("l_linestatus", "string", True, enum=("F", "O")), Field("l_shipdate", "string", True),
))
ORDERS = Table("orders", (
    Field("o_orderkey", "integer", True), Field("o_custkey", "integer", True), Field("o_orderstatus", "string", True, enum=("O", "F")), Field("o_totalprice", "number", True, minimum=1000), Field("o_note", "string"),
))
CONTRACT = Contract("trade", (LINEITEM, ORDERS), (ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), ForeignKey("orders", "o_orderkey", "lineitem", "l_orderkey")))
RULES = Enforcement("ENFORCE", frozenset(), (Rule("l_discount", "lineitem", severity="LOW"), Rule("l_tax", "lineitem", skip=frozenset({"range"}))))


def _sql(table: Table, rules: Enforcement = Enforcement()) -> str:
    """The same checks of a test table as SQL of counts, written from its clauses alone."""
    out = []

    def add(column: str, check: str, bad: str, want: str) -> None:
        if rules.skips(table.name, column, check):
            return
        severity = rules.severity(table.name, column, checks.SEVERITY[check])
        out.append(f"SELECT '{table.name}.{column}.{check}' AS check_id, '{table.name}' AS table_name, '{column}' AS column_name, '{check}' AS check_type, CASE WHEN count(*) FILTER (WHERE {bad}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, '{severity}' AS severity, count(*) FILTER (WHERE {bad})::BIGINT AS records_failing, '{want}' AS expected FROM {table.name}")

    for f in table.fields:
        if f.name == "o_note":
            out.append(f"SELECT '{table.name}.o_note.schema_missing', '{table.name}', 'o_note', 'schema_missing', 'FAIL', 'CRITICAL', 1::BIGINT, 'declared'")
            continue
        if f.required:
            add(f.name, "required", f"{f.name} IS NULL", "no missing value")
        add(f.name, "type", "true" if f.name == "l_shipdate" else "false", f.type)
        if f.enum:
            add(f.name, "enum", f"{f.name} NOT IN ({', '.join(repr(v) for v in f.enum)})", ",".join(f.enum))
        if f.minimum is not None or f.maximum is not None:
            bad = " OR ".join([f"{f.name} < {f.minimum}"] * (f.minimum is not None) + [f"{f.name} > {f.maximum}"] * (f.maximum is not None))
            add(f.name, "range", bad, f"[{'' if f.minimum is None else f'{f.minimum:g}'},{'' if f.maximum is None else f'{f.maximum:g}'}]")
    if table is ORDERS:
        for c in ("o_orderdate", "o_orderpriority"):
            out.append(f"SELECT 'orders.{c}.schema_new_column', 'orders', '{c}', 'schema_new_column', 'WARN', 'MEDIUM', 1::BIGINT, 'undeclared'")
    return " UNION ALL ".join(out)


def _reference_sql(child: str, column: str, parent: str, key: str) -> str:
    return f"SELECT '{child}.{column}.references.{parent}.{key}' AS check_id, '{child}' AS table_name, '{column}' AS column_name, 'referential_integrity' AS check_type, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, 'CRITICAL' AS severity, count(*)::BIGINT AS records_failing, '{parent}.{key}' AS expected FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)"


VALIDATE_SQL = " UNION ALL ".join([_sql(LINEITEM), _sql(ORDERS), _reference_sql("lineitem", "l_orderkey", "orders", "o_orderkey"), _reference_sql("orders", "o_orderkey", "lineitem", "l_orderkey")])


@query(VALIDATE_SQL)
def validate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the trade contract."""
    return checks.validate({t: read(spark, sf_dir, t) for t in ("lineitem", "orders")}, CONTRACT)


@query(_sql(LINEITEM, RULES))
def validate_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of lineitem under an enforcement that skips one and lowers another."""
    return checks.table_checks(read(spark, sf_dir, "lineitem"), LINEITEM, RULES)


@query(f"SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE status = 'PASS')::BIGINT AS passed, count(*) FILTER (WHERE status = 'FAIL')::BIGINT AS failed, count(*) FILTER (WHERE status = 'WARN')::BIGINT AS warned, count(*) FILTER (WHERE status = 'ERROR')::BIGINT AS errored, 0 AS exit_audit, (count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL') > 0)::INTEGER AS exit_warn, (count(*) FILTER (WHERE (status = 'FAIL' AND severity IN ('CRITICAL', 'HIGH')) OR status = 'ERROR') > 0)::INTEGER AS exit_enforce FROM ({VALIDATE_SQL})")
def tally_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and exit codes by mode."""
    return checks.tally(validate_contract(spark, sf_dir))


@query("SELECT count(*)::BIGINT AS total_rows, count(*) FILTER (WHERE nullif(o_orderpriority, '5-LOW') IS NULL)::BIGINT AS records_failing FROM orders")
def chk_required_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing priorities, where the lowest counts as missing."""
    df = read(spark, sf_dir, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(X.missing(F.col("p"), "string")).alias("records_failing"))


@query("SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('O', 'F') ORDER BY 1 LIMIT 10")
def chk_enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses outside the enum (a sample report of ten at most)."""
    return checks.bad_values(read(spark, sf_dir, "orders"), Field("o_orderstatus", enum=("O", "F")))


@query("SELECT count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.08)::BIGINT AS records_failing, count(l_discount)::BIGINT AS numbers, round(min(l_discount) + 0.0, 4) AS low, round(max(l_discount) + 0.0, 4) AS high FROM lineitem")
def chk_range_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts outside their range."""
    v = X.number(F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").agg(F.count_if((v < 0) | (v > 0.08)).alias("records_failing"), F.count(v).alias("numbers"), F.round(F.min(v) + 0.0, 4).alias("low"), F.round(F.max(v) + 0.0, 4).alias("high"))


_NS = "from_hex('6ba7b8119dad11d180b400c04fd430c8')"


def duck_uuid5(name: str) -> str:
    """uuid5 of a SQL expression, for DuckDB."""
    s = f"sha1({_NS} || encode({name}))"
    return f"concat_ws('-', substr({s}, 1, 8), substr({s}, 9, 4), '5' || substr({s}, 14, 3), substr('89ab', ((strpos('0123456789abcdef', substr({s}, 17, 1)) - 1) % 4)::INTEGER + 1, 1) || substr({s}, 18, 3), substr({s}, 21, 12))"


@query(f"SELECT count(*) FILTER (WHERE NOT regexp_full_match(u, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}'))::BIGINT AS records_failing, count(DISTINCT u)::BIGINT AS distinct_ids FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'x' || event_id WHEN event_id % 10 = 1 THEN upper({duck_uuid5('event_id::VARCHAR')}) ELSE {duck_uuid5('event_id::VARCHAR')} END AS u FROM events)")
def chk_uuid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that are no UUIDs: every tenth is spoilt, every tenth is in capitals, which is fine."""
    own = X.uuid5(F.col("event_id").cast("string"))
    u = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), F.col("event_id"))).when(F.col("event_id") % 10 == 1, F.upper(own)).otherwise(own)
    return read(spark, sf_dir, "events").select(u.alias("u")).agg(F.count_if(X.bad_uuid(F.col("u"))).alias("records_failing"), F.count_distinct("u").alias("distinct_ids"))


@query("SELECT count(*) FILTER (WHERE NOT regexp_full_match(d, '[0-9]{4}(-[0-9]{2}){2}[T ]([0-9]{2}:){2}[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?'))::BIGINT AS records_failing FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS d FROM orders)")
def chk_datetime_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-only strings are no dates and times."""
    d = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read(spark, sf_dir, "orders").select(d.alias("d")).agg(F.count_if(X.bad_datetime(F.col("d"))).alias("records_failing"))


@query("SELECT * FROM (VALUES ('l_orderkey', 'integer', true), ('l_quantity', 'integer', true), ('l_quantity', 'string', false), ('l_returnflag', 'string', true), ('l_returnflag', 'number', false), ('l_shipdate', 'string', false), ('l_linenumber', 'boolean', false)) t(column_name, logical_type, fits)")
def chk_type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which Spark types serve which logical types."""
    kinds = dict(read(spark, sf_dir, "lineitem").dtypes)
    asked = [("l_orderkey", "integer"), ("l_quantity", "integer"), ("l_quantity", "string"), ("l_returnflag", "string"), ("l_returnflag", "number"), ("l_shipdate", "string"), ("l_linenumber", "boolean")]
    return spark.createDataFrame([(c, t, checks.type_fits(t, kinds[c])) for c, t in asked], "column_name string, logical_type string, fits boolean")


@query("SELECT d.c AS column_name, 'schema_missing' AS check_type, 'FAIL' AS status FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_note')) d(c) WHERE d.c NOT IN (SELECT column_name FROM (DESCRIBE orders)) UNION ALL SELECT column_name, 'schema_new_column', 'WARN' FROM (DESCRIBE orders) WHERE column_name NOT IN ('o_orderkey', 'o_custkey', 'o_note')")
def chk_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against observed columns."""
    declared = Table("orders", (Field("o_orderkey"), Field("o_custkey"), Field("o_note")))
    return checks.schema_checks(spark, declared, read(spark, sf_dir, "orders").columns).select("column_name", "check_type", "status")


@query(_reference_sql("orders", "o_orderkey", "lineitem", "l_orderkey"))
def chk_fk_orders_without_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line."""
    return checks.reference_check(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), ForeignKey("orders", "o_orderkey", "lineitem", "l_orderkey"))


@query("SELECT o_orderkey::VARCHAR AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 5")
def chk_fk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of them (a sample report)."""
    return checks.orphan_sample(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), ForeignKey("orders", "o_orderkey", "lineitem", "l_orderkey"))


@query("SELECT count(*)::BIGINT AS violations FROM (SELECT CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) o LEFT JOIN customer c ON o.k = c.c_custkey WHERE c.c_custkey IS NULL")
def chk_fk_null_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule by outer join counts null keys as well."""
    o = read(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("k"))
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return o.join(c, o["k"] == c["c_custkey"], "left").filter("c_custkey is null").agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS violations, 'lineitem_pk' AS rule FROM lineitem")
def chk_unique_lineitem_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond the distinct keys."""
    return checks.quality_rules(read(spark, sf_dir, "lineitem"), {}, {"lineitem_pk": ("l_orderkey", "l_linenumber")})


@query("SELECT 'events.ts.freshness' AS check_id, CASE WHEN h > 72 THEN 'FAIL' WHEN h > 24 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN h > 72 THEN 'HIGH' WHEN h > 24 THEN 'MEDIUM' ELSE 'LOW' END AS severity, round(h, 4) AS age_hours FROM (SELECT (epoch(TIMESTAMP '2024-02-01 12:00:00') - epoch(max(ts))) / 3600 AS h FROM events)")
def chk_freshness_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age of the newest event at a given time."""
    return checks.freshness(read(spark, sf_dir, "events"), "events", "ts", "2024-02-01 12:00:00")


@query("SELECT 'price_not_null' AS rule, count(*) FILTER (WHERE o_totalprice IS NULL)::BIGINT AS violations FROM orders UNION ALL SELECT 'price_range', count(*) FILTER (WHERE o_totalprice < 5000 OR o_totalprice > 400000)::BIGINT FROM orders UNION ALL SELECT 'status_allowed', count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F'))::BIGINT FROM orders UNION ALL SELECT 'priority_non_empty', count(*) FILTER (WHERE trim(o_orderpriority) = '')::BIGINT FROM orders UNION ALL SELECT 'orderkey_unique', (count(*) - count(DISTINCT o_orderkey))::BIGINT FROM orders")
def quality_rules_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's quality rules, executed in one aggregation."""
    p = F.col("o_totalprice")
    rules = {"price_not_null": p.isNull(), "price_range": (p < 5000) | (p > 400000), "status_allowed": ~F.col("o_orderstatus").isin("O", "F"), "priority_non_empty": F.trim("o_orderpriority") == ""}
    return checks.quality_rules(read(spark, sf_dir, "orders"), rules, {"orderkey_unique": ("o_orderkey",)})


def _rule_table() -> Table:
    return Table("orders", (Field("o_orderkey", "integer", True), Field("o_totalprice", "number", True, minimum=1000, maximum=400000), Field("o_orderstatus", "string", True, enum=("O", "F"))))


@query(" UNION ALL ".join(f"SELECT '{r}' AS rule, violations::BIGINT AS violations FROM ({sql})" for r, sql in infer.rule_sql(_rule_table())))
def generated_rules_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL that a contract generates, run as it is."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    out = None
    for rule, sql in infer.rule_sql(_rule_table()):
        one = spark.sql(sql).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _profile_sql(table: str, numeric: tuple[str, ...], text: tuple[str, ...], group: str = "") -> str:
    head, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    rows = []
    for c in numeric:
        rows.append(f"SELECT {head}'{c}' AS column_name, count(*)::BIGINT AS \"rows\", round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS null_fraction, count(DISTINCT {c})::BIGINT AS cardinality, round(min({c})::DOUBLE + 0.0, 4) AS min_value, round(max({c})::DOUBLE + 0.0, 4) AS max_value, round(avg({c}), 4) AS mean_value, round(stddev_samp({c}), 4) AS std_value, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75 FROM {table}{by}")
    for c in text:
        rows.append(f"SELECT {head}'{c}', count(*)::BIGINT, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 4), count(DISTINCT {c})::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM {table}{by}")
    return " UNION ALL ".join(rows)


@query(_profile_sql("lineitem", _NUMERIC, ("l_returnflag", "l_linestatus")))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of lineitem."""
    return profile.profile(read(spark, sf_dir, "lineitem"), (*_NUMERIC, "l_returnflag", "l_linestatus"))


@query(_profile_sql("events", ("value", "user_id"), (), "event_type"))
def profile_events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of events by type."""
    return profile.profile(read(spark, sf_dir, "events"), ("value", "user_id"), ("event_type",))


_CUSTOMER_SQL = _profile_sql("customer", ("c_acctbal", "c_nationkey", "c_custkey"), ("c_mktsegment", "c_name"))


@query(f"SELECT column_name, CASE WHEN column_name = 'c_acctbal' THEN 'number' WHEN column_name IN ('c_nationkey', 'c_custkey') THEN 'integer' ELSE 'string' END AS logical_type, null_fraction = 0 AS required, NULL::VARCHAR AS format, column_name = 'c_mktsegment' AND cardinality <= 10 AS is_enum, CASE WHEN min_value >= 0 THEN 0.0::DOUBLE END AS minimum, NULL::DOUBLE AS maximum, NULL::VARCHAR AS note FROM ({_CUSTOMER_SQL})")
def infer_clauses_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses inferred for customer."""
    df = read(spark, sf_dir, "customer")
    return infer.clauses(profile.profile(df), dict(df.dtypes))


@query("SELECT DISTINCT c_mktsegment AS value FROM customer ORDER BY 1 LIMIT 10")
def sample_values_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample values of a column (a report of ten at most)."""
    return profile.sample_values(read(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT column_name, (row_number() OVER (PARTITION BY column_name ORDER BY ord))::INTEGER AS place, value FROM (SELECT column_name, value, min(ord) AS ord FROM (SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, row_number() OVER () AS ord FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, row_number() OVER () FROM customer) GROUP BY 1, 2) QUALIFY place <= 5")
def first_values_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column's first five distinct values as they come (a sample report)."""
    return profile.first_values(read(spark, sf_dir, "customer"), ("c_mktsegment", "c_nationkey"))


def _rule_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as documents and their lines as facts; a few of either break rules."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    documents = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("source_path"), F.col("o_orderstatus").alias("extraction_model"), (F.col("o_custkey") % 50 - 1).alias("fact_count"), F.col("o_custkey").alias("entity_count"), (F.col("o_totalprice") * 3).cast("bigint").alias("processing_time_ms"))
    facts = line.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("fact_id"), F.when(F.col("l_partkey") % 40 == 0, "none").otherwise(F.col("l_orderkey").cast("string")).alias("doc_id"), F.when(F.col("l_suppkey") % 9 == 0, " ").otherwise(F.col("l_returnflag")).alias("text"), (F.col("l_linenumber") - 1).alias("page_ref"), (F.col("l_quantity") / 40).alias("confidence"))
    return {"documents": documents, "extracted_facts": facts}


_RULE_SQL = """WITH d AS (SELECT o_orderkey::VARCHAR AS doc_id, o_orderpriority AS source_path, o_orderstatus AS extraction_model, o_custkey % 50 - 1 AS fact_count, o_custkey AS entity_count, (o_totalprice * 3) AS ms FROM orders),
f AS (SELECT l_orderkey || '-' || l_linenumber AS fact_id, CASE WHEN l_partkey % 40 = 0 THEN 'none' ELSE l_orderkey::VARCHAR END AS doc_id, CASE WHEN l_suppkey % 9 = 0 THEN ' ' ELSE l_returnflag END AS text, l_linenumber - 1 AS page_ref, l_quantity / 40 AS confidence FROM lineitem),
r AS (SELECT 'documents.' || c || '.not_null' AS rule, 'completeness' AS dimension, 'error' AS severity, 0 AS violations FROM (VALUES ('doc_id'), ('source_path'), ('extraction_model'), ('fact_count'), ('entity_count'), ('processing_time_ms')) t(c)
 UNION ALL SELECT 'documents.doc_id.unique', 'uniqueness', 'error', count(*) - count(DISTINCT doc_id) FROM d
 UNION ALL SELECT 'documents.source_path.allowed_values', 'validity', 'warning', 0 UNION ALL SELECT 'documents.extraction_model.allowed_values', 'validity', 'warning', 0
 UNION ALL SELECT 'documents.source_path.non_empty', 'validity', 'warning', count(*) FILTER (WHERE trim(source_path) = '') FROM d
 UNION ALL SELECT 'documents.fact_count.non_negative', 'validity', 'error', count(*) FILTER (WHERE fact_count < 0) FROM d UNION ALL SELECT 'documents.entity_count.non_negative', 'validity', 'error', 0
 UNION ALL SELECT 'documents.fact_count.extraction_success', 'validity', 'error', count(*) FILTER (WHERE fact_count < 1) FROM d
 UNION ALL SELECT 'documents.processing_time_ms.timeout_risk', 'validity', 'warning', count(*) FILTER (WHERE trunc(ms) > 600000) FROM d
 UNION ALL SELECT 'extracted_facts.' || c || '.not_null', 'completeness', 'error', 0 FROM (VALUES ('fact_id'), ('doc_id'), ('text'), ('page_ref'), ('confidence')) t(c)
 UNION ALL SELECT 'extracted_facts.confidence.range_check', 'validity', 'error', count(*) FILTER (WHERE confidence < 0 OR confidence > 1) FROM f
 UNION ALL SELECT 'extracted_facts.confidence.floor_check', 'validity', 'warning', count(*) FILTER (WHERE confidence < 0.5) FROM f
 UNION ALL SELECT 'extracted_facts.page_ref.positive', 'validity', 'error', count(*) FILTER (WHERE page_ref < 1) FROM f
 UNION ALL SELECT 'extracted_facts.text.non_empty', 'validity', 'warning', count(*) FILTER (WHERE trim(text) = '') FROM f
 UNION ALL SELECT 'extracted_facts.text.allowed_values', 'validity', 'warning', 0
 UNION ALL SELECT 'extracted_facts.fact_id.unique', 'uniqueness', 'error', count(*) - count(DISTINCT fact_id) FROM f
 UNION ALL SELECT 'extracted_facts.doc_id.references.documents.doc_id', 'integrity', 'error', count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM d))"""


def _suggested(name: str, df: DataFrame) -> list[rulebook.QualityRule]:
    """The rules that a table's profile suggests."""
    rows = [r.asDict() for r in profile.profile(df).orderBy("column_name").collect()]  # a row a column
    kinds = dict(df.dtypes)
    values = {r["column_name"]: [v["value"] for v in profile.sample_values(df, r["column_name"]).collect()] for r in rows if kinds[r["column_name"]] == "string" and r["cardinality"] <= rulebook.FEW_VALUES}
    return rulebook.rules_of(name, rows, kinds, values, max((r["rows"] for r in rows), default=0))


@query(f"{_RULE_SQL} SELECT rule, dimension, severity, violations::BIGINT AS violations, CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM r WHERE rule <> 'extracted_facts.fact_id.unique' OR (SELECT count(DISTINCT fact_id) = count(*) FROM f)")
def suggested_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of rules that profiles of documents and facts suggest, executed."""
    tables = _rule_tables(spark, sf_dir)
    return rulebook.execute(tables, [r for n, df in tables.items() for r in _suggested(n, df)])


_GRAPH = {"lineage_nodes": "SELECT n_nationkey::VARCHAR AS node_id, CASE WHEN n_nationkey % 6 = 0 THEN 'COUNTRY' ELSE 'TABLE' END AS type, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE n_name END AS label, CASE WHEN n_nationkey % 4 = 0 THEN 'cobol' WHEN n_nationkey % 4 = 1 THEN NULL ELSE 'sql' END AS language FROM nation", "lineage_edges": "SELECT n_nationkey::VARCHAR AS source, CASE WHEN n_nationkey % 7 <> 0 THEN n_regionkey::VARCHAR END AS target, CASE WHEN n_nationkey % 3 = 0 THEN 'EATS' ELSE 'READS' END AS relationship, n_nationkey / 20 AS confidence FROM nation"}
_GRAPH_WANT = {
    "lineage_nodes": {"node_id.not_null": "node_id IS NULL", "type.not_null": "type IS NULL", "label.not_null": "label IS NULL", "node_id.unique": None, "type.allowed_values": "type = 'COUNTRY'", "language.allowed_values": "language = 'cobol'", "label.non_empty": "label = ' '"},
    "lineage_edges": {"source.not_null": "source IS NULL", "target.not_null": "target IS NULL", "relationship.not_null": "relationship IS NULL", "confidence.not_null": "confidence IS NULL", "confidence.range_check": "confidence > 1", "confidence.floor_check": "confidence < 0.7", "relationship.allowed_values": "relationship = 'EATS'"},
}
_EVENTS = {"events": "SELECT event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR AS aggregate_id, CASE WHEN user_id % 9 <> 0 THEN 'User' END AS aggregate_type, event_id % 5 - 1 AS sequence_number, ts::VARCHAR AS occurred_at, ts::VARCHAR AS recorded_at, (event_id % 3 + 1) || '.0' AS schema_version FROM events", "event_metadata": "SELECT (event_id // 2)::VARCHAR AS event_id, CASE WHEN user_id % 4 <> 0 THEN 'c' END AS correlation_id, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'app' END AS source_service, event_id % 6 AS global_position FROM events"}
_EVENTS_WANT = {
    "events": {**{f"{c}.not_null": f"{c} IS NULL" for c in ("event_id", "event_type", "aggregate_id", "aggregate_type", "sequence_number", "occurred_at", "recorded_at")}, "event_id.unique": None, "event_type.allowed_values": "event_type NOT IN ('view', 'click')", "sequence_number.non_negative": "sequence_number < 0", "schema_version.allowed_values": "schema_version = '3.0'"},
    "event_metadata": {"correlation_id.not_null": "correlation_id IS NULL", "event_id.unique": None, "source_service.allowed_values": "source_service = 'app'", "global_position.positive": "global_position < 1"},
}


def _counts_sql(tables: dict[str, str], want: dict[str, dict[str, str | None]]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}.{r}' AS rule, {'count(*) - count(DISTINCT event_id)' if bad is None and t != 'lineage_nodes' else 'count(*) - count(DISTINCT node_id)' if bad is None else f'count(*) FILTER (WHERE {bad})'}::BIGINT AS violations FROM ({tables[t]})" for t, rules in want.items() for r, bad in rules.items())


@query(_counts_sql(_GRAPH, _GRAPH_WANT))
def graph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of graph tables, executed over nations as nodes."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    nodes = n.select(k.cast("string").alias("node_id"), F.when(k % 6 == 0, "COUNTRY").otherwise("TABLE").alias("type"), F.when(k % 5 == 0, " ").otherwise(F.col("n_name")).alias("label"), F.when(k % 4 == 0, "cobol").when(k % 4 > 1, "sql").alias("language"))
    edges = n.select(k.cast("string").alias("source"), F.when(k % 7 != 0, F.col("n_regionkey").cast("string")).alias("target"), F.when(k % 3 == 0, "EATS").otherwise("READS").alias("relationship"), (k / 20).alias("confidence"))
    return rulebook.execute({"lineage_nodes": nodes, "lineage_edges": edges}, rulebook.graph_rules()).select("rule", "violations")


@query(_counts_sql(_EVENTS, _EVENTS_WANT))
def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of event tables, executed over events."""
    e, k, u = read(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    events = e.select(k.cast("string").alias("event_id"), "event_type", u.cast("string").alias("aggregate_id"), F.when(u % 9 != 0, "User").alias("aggregate_type"), (k % 5 - 1).alias("sequence_number"), F.col("ts").cast("string").alias("occurred_at"), F.col("ts").cast("string").alias("recorded_at"), F.concat(k % 3 + 1, F.lit(".0")).alias("schema_version"))
    meta = e.select(F.floor(k / 2).cast("string").alias("event_id"), F.when(u % 4 != 0, "c").alias("correlation_id"), F.when(k % 2 == 0, "web").otherwise("app").alias("source_service"), (k % 6).alias("global_position"))
    return rulebook.execute({"events": events, "event_metadata": meta}, rulebook.event_rules(("view", "click"), ("web",))).select("rule", "violations")


_EVENT_TABLE = Table("events", (Field("event_id", "integer", True), Field("event_type", enum=("view", "click", "purchase")), Field("user_id", "integer", True, minimum=0), Field("value", "number", minimum=0, maximum=400), Field("gone", "string"), Field("ts", "string")))
_STAT = "SELECT '{c}' AS c, avg({c}) AS m, stddev_samp({c}) AS s, min({c}) AS a, max({c}) AS b, count(DISTINCT {c}) AS d FROM {t}"
_BOTH = " UNION ALL ".join(f"SELECT n.c, n.m AS nm, o.m AS om, n.s AS ns, o.s AS os, n.a < o.a AS low, n.b > o.b AS high, n.d / o.d AS times FROM ({_STAT.format(c=c, t='events')}) n, ({_STAT.format(c=c, t='older')}) o" for c in ("event_id", "user_id", "value"))
_RUN_SQL = f"""WITH older AS (SELECT event_id, user_id, value FROM events WHERE ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)), b AS ({_BOTH}),
c(column_name, check_type, severity, n) AS (SELECT 'event_id', 'required', 'CRITICAL', 0 UNION ALL SELECT 'event_id', 'type', 'CRITICAL', 0 UNION ALL SELECT 'event_type', 'type', 'CRITICAL', 0 UNION ALL SELECT 'event_type', 'enum', 'HIGH', count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')) FROM events
 UNION ALL SELECT 'user_id', 'required', 'CRITICAL', 0 UNION ALL SELECT 'user_id', 'type', 'CRITICAL', 0 UNION ALL SELECT 'user_id', 'range', 'HIGH', 0 UNION ALL SELECT 'value', 'type', 'CRITICAL', 0 UNION ALL SELECT 'value', 'range', 'HIGH', count(*) FILTER (WHERE value < 0 OR value > 400) FROM events
 UNION ALL SELECT 'gone', 'schema_missing', 'CRITICAL', 1 UNION ALL SELECT 'ts', 'type', 'CRITICAL', count(*) FROM events),
d AS (SELECT c, 'drift_mean' AS t, CASE WHEN abs(nm - om) / os > 3 THEN 'FAIL' WHEN abs(nm - om) / os > 2 THEN 'WARN' ELSE 'PASS' END AS s FROM b UNION ALL SELECT c, 'drift_variance', CASE WHEN ns / os > 4 THEN 'FAIL' WHEN ns / os > 2 OR ns / os < 0.25 THEN 'WARN' ELSE 'PASS' END FROM b
 UNION ALL SELECT c, 'drift_outliers', CASE WHEN low AND high THEN 'FAIL' WHEN low OR high THEN 'WARN' ELSE 'PASS' END FROM b UNION ALL SELECT c, 'drift_null_fraction', 'PASS' FROM b UNION ALL SELECT c, 'drift_cardinality', CASE WHEN times > 5 THEN 'FAIL' WHEN times > 2 OR times < 0.5 THEN 'WARN' ELSE 'PASS' END FROM b)
SELECT 'events.' || column_name || '.' || check_type AS check_id, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, severity, n::BIGINT AS records_failing FROM c
UNION ALL SELECT 'events.props.schema_new_column', 'WARN', 'MEDIUM', 1
UNION ALL SELECT 'events.' || c || '.' || t, s, CASE s WHEN 'FAIL' THEN 'HIGH' WHEN 'WARN' THEN 'MEDIUM' ELSE 'LOW' END, 0 FROM d
UNION ALL SELECT 'events.ts.freshness', CASE WHEN h > 72 THEN 'FAIL' WHEN h > 24 THEN 'WARN' ELSE 'PASS' END, CASE WHEN h > 72 THEN 'HIGH' WHEN h > 24 THEN 'MEDIUM' ELSE 'LOW' END, 0 FROM (SELECT (epoch(TIMESTAMP '2024-02-01 12:00:00') - epoch(max(ts))) / 3600 AS h FROM events)
UNION ALL SELECT 'events.user_id.references.users.id', 'ERROR', 'CRITICAL', 0"""


def _event_run(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], Contract, validation.Run]:
    """A run over events, whose baseline is their older half."""
    e = read(spark, sf_dir, "events")
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select((F.col("a") + (F.col("b") - F.col("a")) / 2).alias("half"))
    older = e.crossJoin(F.broadcast(ends)).filter("ts < half").drop("half")  # one row
    contract = Contract("stream", (_EVENT_TABLE,), (ForeignKey("events", "user_id", "users", "id"),))
    baseline = validation.table_stats(older, _EVENT_TABLE, "stream")
    return {"events": e}, contract, validation.validate({"events": e}, contract, Enforcement(""), baseline, validation.Freshness("events", "ts", "2024-02-01 12:00:00"))


@query(_RUN_SQL)
def validation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema, field and reference checks, drift against a baseline and freshness in one run."""
    return _event_run(spark, sf_dir)[2].results.select("check_id", "status", "severity", "records_failing")


@query("SELECT 'events.event_type.enum' AS check_id, (row_number() OVER (ORDER BY v))::INTEGER AS place, v AS value FROM (SELECT DISTINCT event_type AS v FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')) QUALIFY place <= 10 UNION ALL SELECT 'events.value.range', (row_number() OVER (ORDER BY v))::INTEGER AS place, v FROM (SELECT value::VARCHAR AS v FROM events WHERE value < 0 OR value > 400) QUALIFY place <= 5")
def validation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing values of the checks that fail (a sample report)."""
    tables, contract, run = _event_run(spark, sf_dir)
    return validation.samples(tables, contract, run.results)


@query("SELECT 'gone' AS missing, 'props' AS added")
def validation_schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns went and which came."""
    got = validation.schema_summary(_event_run(spark, sf_dir)[2].results)
    return got.select(F.array_join(F.transform("missing_columns", lambda x: x["column"]), ",").alias("missing"), F.array_join(F.transform("new_columns", lambda x: x["column"]), ",").alias("added"))
