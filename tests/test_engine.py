import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.operators import checks, drift, etl, evolve, flatten, graph, infer, profile, report, rules, textchecks, validation
from ledgerline.plans import registry
from ledgerline.plans.contract import Config, Contract, Enforcement, Field, ForeignKey, Registry, Rule, Table
from ledgerline.sources import readers, sinks
from ledgerline.streaming import enforce


def test_injected_faults_are_counted(spark):
    rows = [(None if i < 3 else f"00000000-0000-4000-8000-{i:012d}", "x" if i < 2 else "a", float(i), "2026-01-01" if i < 4 else "2026-01-01T00:00:00Z") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, kind string, v double, at string")
    table = Table("t", (Field("id", "string", True, "uuid"), Field("kind", enum=("a",)), Field("v", "number", minimum=5), Field("at", format="date-time")))
    got = {r["check_id"]: (r["status"], r["records_failing"]) for r in checks.table_checks(df, table).collect()}
    assert got["t.id.required"] == ("FAIL", 3) and got["t.id.format_uuid"] == ("PASS", 0)
    assert got["t.kind.enum"] == ("FAIL", 2) and got["t.v.range"] == ("FAIL", 5) and got["t.at.format_datetime"] == ("FAIL", 4)


def test_range_without_numbers_is_an_error_and_missing_tables_miss_columns(spark):
    df = spark.createDataFrame([("x",)], "v string")
    assert checks.table_checks(df, Table("t", (Field("v", minimum=0),))).filter("check_type = 'range'").first()["status"] == "ERROR"
    c = Contract("c", (Table("t", (Field("v"),)), Table("u", (Field("w"),))), (ForeignKey("t", "v", "u", "w"),))
    got = {r["check_id"]: r["status"] for r in checks.validate({"t": df}, c).collect()}
    assert got["u.w.schema_missing"] == "FAIL" and got["t.v.references.u.w"] == "ERROR"


def test_not_a_number_is_missing_and_empty_table_passes(spark):
    t = Table("t", (Field("v", "number", True),))
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert checks.table_checks(df, t).filter("check_type = 'required'").first()["records_failing"] == 2
    assert checks.table_checks(df.limit(0), t).filter("status <> 'PASS'").count() == 0


def test_enforcement_merge():
    a = Enforcement("AUDIT", frozenset({"type"}), (Rule("v", severity="LOW"),))
    m = a.merged(Enforcement("ENFORCE", frozenset({"enum"}), (Rule("v", severity="HIGH"), Rule("w", "t", skip=frozenset({"range"})))))
    assert m.mode == "ENFORCE" and m.skip == {"type", "enum"} and m.severity("t", "v", "CRITICAL") == "HIGH"
    assert m.skips("t", "w", "range") and not m.skips("u", "w", "range")


def test_orphans_count_rows_and_skip_nulls(spark):
    child = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "k string")
    parent = spark.createDataFrame([(1,), (None,)], "k int")
    key = ForeignKey("c", "k", "p", "k")
    assert checks.reference_check(child, parent, key).first()["records_failing"] == 2
    assert [r["k"] for r in checks.orphan_sample(child, parent, key).collect()] == ["2", "2"]


@pytest.mark.parametrize("mean,status", [(120.0, "PASS"), (120.01, "WARN"), (130.0, "WARN"), (130.01, "FAIL")])
def test_mean_drift_limits_are_strict(spark, mean, status):
    schema = "column_name string, n bigint, mean_value double, std_value double, min_value double, max_value double, null_fraction double, cardinality bigint"
    base = spark.createDataFrame([("v", 50, 100.0, 10.0, 80.0, 120.0, 0.0, 40)], schema)
    now = spark.createDataFrame([("v", 50, mean, 10.0, 80.0, 120.0, 0.0, 40)], schema)
    assert drift.drift(now, base).filter("check_type = 'drift_mean'").first()["status"] == status


@pytest.mark.parametrize("column,value,check,status", [("cardinality", 15, "drift_cardinality", "WARN"), ("cardinality", 210, "drift_cardinality", "FAIL"), ("null_fraction", 0.01, "drift_null_fraction", "WARN"), ("null_fraction", 0.21, "drift_null_fraction", "FAIL"), ("std_value", 41.0, "drift_variance", "FAIL"), ("std_value", 2.4, "drift_variance", "WARN"), ("max_value", 121.0, "drift_outliers", "WARN")])
def test_drift_bands(spark, column, value, check, status):
    schema = "column_name string, n bigint, mean_value double, std_value double, min_value double, max_value double, null_fraction double, cardinality bigint"
    base = spark.createDataFrame([("v", 50, 100.0, 10.0, 80.0, 120.0, 0.0, 40)], schema)
    assert drift.drift(base.withColumn(column, F.lit(value)), base).filter(F.col("check_type") == check).first()["status"] == status


def test_constant_baseline_warns_when_it_moves(spark):
    a = profile.column_stats(spark.createDataFrame([(50.0,)] * 5, "v double"), ["v"])
    b = profile.column_stats(spark.createDataFrame([(float(i),) for i in range(5)], "v double"), ["v"])
    got = {r["check_type"]: r["status"] for r in drift.drift(b, a).collect()}
    assert got["drift_mean"] == "WARN" and got["drift_variance"] == "WARN"


def test_config_from_env():
    c = Config.from_env({"LEDGERLINE_DRIFT_Z_WARN": "1.5", "LEDGERLINE_ENUM_LIMIT": "many"})
    assert c.drift_z_warn == 1.5 and c.enum_limit == 10


def test_inferred_contract_and_dbt(spark):
    df = spark.createDataFrame([("a", 0.5, "d1"), ("b", 0.7, "d2"), (None, 0.9, "d3")], "kind string, confidence double, doc_id string")
    got = infer.clauses(profile.profile(df), dict(df.dtypes))
    table = infer.table_contract("t", got, {"kind": ("a", "b")})
    by = {f.name: f for f in table.fields}
    assert by["kind"].enum == ("a", "b") and not by["kind"].required and by["confidence"].maximum == 1.0 and by["doc_id"].format == "uuid"
    assert any("NOT IN ('a', 'b')" in sql for _, sql in infer.rule_sql(table))
    assert {"name": "doc_id", "tests": ["not_null", "unique"]} in infer.dbt_schema(table)["models"][0]["columns"]


def test_gate_passes_without_subscribers_of_removed_fields(spark):
    old = spark.createDataFrame([("t", "a", "string", True, None, None, None), ("t", "b", "string", True, None, None, None)], evolve.CLAUSES)
    subs = spark.createDataFrame([("c", "s", [("a", "r")])], "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>")
    assert evolve.gate(old, old.filter("field = 'a'"), subs).first()["decision"] == "PASS"
    assert evolve.gate(old, old.filter("field = 'b'"), subs).first()["decision"] == "BLOCK"


def test_reach_has_the_start_of_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert {(r["node"], r["depth"]) for r in graph.reachable(e, spark.createDataFrame([("a",)], "node string")).collect()} == {("b", 1), ("c", 2), ("a", 3)}


def test_reach_follows_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 5)], "source bigint, target bigint")
    got = {(r["node"], r["depth"]) for r in graph.reachable(e, spark.createDataFrame([(0,)], "node bigint")).collect()}
    assert got == {(i, i) for i in range(1, 21)}


def test_whole_tables_are_reached_and_matched(spark, tmp_path):
    from ledgerline.plans.queries_evolve import lineage_match_parts, reach_subscribers

    spark.createDataFrame([(3, 0), (21, 0), (27, 0)], "c_custkey bigint, c_nationkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(9, "plum a", "Brand#2"), (10, "a plum", "Brand#2")], "p_partkey bigint, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    assert {(r["node"], r["depth"]) for r in reach_subscribers(spark, str(tmp_path)).collect()} == {(21, 1), (27, 2), (29, 3)}
    assert {r["node_id"] for r in lineage_match_parts(spark, str(tmp_path)).collect()} == {"9", "10"}


def entities(spark, text):
    return [(e["kind"], e["value"]) for e in spark.createDataFrame([(text,)], "t string").select(etl.entity_candidates(F.col("t")).alias("e")).first()["e"]]


def test_entity_candidates(spark):
    text = "On 2020-05-01, 3/4/21, 5-6-2022 and Sept 7, 1999 (sept 7, 1999)  ACME  CORP paid €5.50 and 1,000 birr to World Bank Group; World Bank The Table of National School Board. Annual Report. Über School"
    got = entities(spark, text)
    assert got[:4] == [("DATE", "2020-05-01"), ("DATE", "3/4/21"), ("DATE", "5-6-2022"), ("DATE", "Sept 7, 1999")]
    assert got[4:6] == [("AMOUNT", "€5.50"), ("AMOUNT", "1,000 birr")]
    assert got[6:] == [("ORG", "ACME CORP"), ("ORG", "World Bank Group"), ("ORG", "National School Board"), ("ORG", "School")]
    assert entities(spark, None) == [] and entities(spark, " ") == [] and len(entities(spark, "TOOLONGACRONYMS")) == 1


def test_confidences_must_be_shares(spark):
    df = spark.createDataFrame([("0.5",), (None,)], "j string").select(X.unit_interval(F.try_parse_json("j"), "c").alias("c"))
    assert [r["c"] for r in df.collect()] == [0.5, None]
    for bad in ("true", '"x"', "1.5", "-0.1", "[1]"):
        with pytest.raises(Exception, match="within 0 and 1"):
            spark.createDataFrame([(bad,)], "j string").select(X.unit_interval(F.parse_json("j"), "c")).collect()
    with pytest.raises(Exception, match="within 0 and 1"):
        spark.createDataFrame([(2.0, None)], "a double, b double").select(etl.confidence(F.col("a"), F.col("b"))).collect()


def test_records_of_odd_documents(spark):
    page = (1, None, "Same text", ["same TEXT", None], None, None, None)
    rows = [("1", "a/b.pdf", None, "h", None, None, None, 0.0, None), ("2", "a/c.pdf", " ", "h", 0.25, "s", 1.5, 0.0, [page, (1, 0.75, "SAME text", None, None, None, [[["x", None, "y"]]])])]
    got = etl.extraction_records(spark.createDataFrame(rows, etl.SOURCE)).orderBy("source_path").collect()
    assert [f["text"] for f in got[0]["extracted_facts"]] == ["a/b.pdf"] and got[0]["extracted_facts"][0]["confidence"] == 0.0 and got[0]["extraction_model"] == "unknown"
    assert [(f["text"], f["confidence"]) for f in got[1]["extracted_facts"]] == [("Same text", 0.75), ("x | y", 0.75)] and got[1]["processing_time_ms"] == 1500
    assert etl.extraction_records(spark.createDataFrame([], etl.SOURCE)).count() == 0


def test_answers_of_every_kind(spark):
    want = {
        "{}": ["missing_verdict"], '{"verdict": null}': ["missing_verdict"], '{"verdict": []}': ["unexpected_type"], '{"verdict": 1.5}': ["unexpected_type"], '{"verdict": "x"}': ["unparseable_json"], '{"verdict": "3"}': ["invalid_json_structure"],
        '{"verdict": "{}"}': [], '{"verdict": {}}': ["missing_decision"], '{"verdict": {"decision": null, "confidence": null, "reasoning": null}}': [], '{"verdict": {"decision": 1, "confidence": true, "reasoning": 1}}': [],
        '{"verdict": {"confidence": -1}}': ["missing_decision", "confidence_out_of_range"], '{"verdict": {"decision": 1, "confidence": "0.5"}}': ["missing_reasoning", "confidence_type_mismatch"], '{"verdict": {"decision": 1, "confidence": [1], "reasoning": 1}}': ["confidence_type_mismatch"],
    }
    df = spark.createDataFrame([(k,) for k in want], "j string")
    assert {r["j"]: r["k"] for r in df.select("j", textchecks.verdict_faults(F.parse_json("j")).alias("k")).collect()} == want


def test_names_are_found_wherever_they_are(spark):
    nodes = spark.createDataFrame([("1", "Alpha beta", "x/y.sql"), ("2", None, "models/ab.sql"), ("3", "a", None), ("4", "ÄRGER", "")], "node_id string, label string, path string")
    names = ["beta", "B", "ALPHA B", "sql", "zzz", "ärg", "", "l"]
    got = graph.lineage_matches(nodes, spark.createDataFrame([(n,) for n in names], "name string"))
    lower = [(r["node_id"], (r["label"] or "").lower(), (r["path"] or "").lower()) for r in nodes.collect()]
    assert {r["node_id"] for r in got.collect()} == {i for i, a, b in lower if any(n.lower() in a or n.lower() in b for n in names if n)}
    for n in names[:-2]:
        one = graph.lineage_matches(nodes, spark.createDataFrame([(n,)], "name string")).collect()
        assert sorted(r["node_id"] for r in one) == [i for i, a, b in lower if n.lower() in a or n.lower() in b]


def test_breaking_fields_by_path_or_its_end(spark):
    changes = spark.createDataFrame([("t", "a.b", "field removed", "CRITICAL", True), ("t", "c", "field removed", "CRITICAL", True)], "table_name string, field string, change string, severity string, breaking boolean")
    subs = spark.createDataFrame([("k", s, [{"field": f, "reason": ""}], "src", "k") for s, f in (("whole", "t.a.b"), ("end", "x.y.a.b"), ("bare", "a.b"), ("part", "x.b"), ("c", "u.c"), ("bare c", "c"))], "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>, source string, source_contract string")
    got = {r["field"]: (r["subscribers"], r["unregistered_risk"]) for r in evolve.consumer_failures(changes, subs).collect()}
    assert got == {"a.b": (2, False), "c": (1, False)}
    assert all(r["unregistered_risk"] for r in evolve.consumer_failures(changes, subs, "other").collect())


def test_planning_errors_are_rows(spark):
    df = spark.createDataFrame([({"a": 1},)], "k map<string,int>")
    run = validation.validate({"t": df}, Contract("c", (Table("t", (Field("k", minimum=0.0),)),)))
    assert {(r["status"], r["check_type"]) for r in run.results.collect()} >= {("ERROR", "table_checks")}


def test_profile_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(float(v) if v % 7 else None, int(v) % 5, f"s{v % 11}" if v % 4 else None, [int(v) % 3], ["g", None][v % 2]) for v in rng.integers(0, 50, 400).tolist()]
    df = spark.createDataFrame([*rows, (float("nan"), None, "s1", None, None)], "a double, b int, c string, d array<int>, g string")
    for by in ((), ("g",)):
        for r in profile.profile(df, by=by).collect():
            own = [x for x in df.collect() if not by or x["g"] == r["g"]]
            values = [x[r["column_name"]] for x in own]
            there = [tuple(v) if isinstance(v, list) else v for v in values if v is not None and v == v]
            assert r["rows"] == len(own) and r["cardinality"] == len(set(there)) and r["null_fraction"] == round(1 - len(there) / len(own), 4)
            if r["column_name"] in ("a", "b"):
                assert [r["p25"], r["p50"], r["p75"]] == [round(float(q), 4) for q in np.percentile(there, [25, 50, 75])] and r["max_value"] == max(there) and abs(r["std_value"] - np.std(there, ddof=1)) < 1e-3
            else:
                assert r["p50"] is None and r["max_value"] is None
    assert {r["cardinality"] for r in profile.profile(df.limit(0)).collect()} == {0}


def test_rules_without_their_table_are_errors(spark):
    df = spark.createDataFrame([("a", 1.5)], "k string, confidence double")
    got = {r["rule"]: r["status"] for r in rules.execute({"t": df}, [rules.allowed("t", "k", ["it's"]), rules.allowed("u", "k", ["a"]), rules.allowed("t", "z", ["a"])]).collect()}
    assert got == {"t.k.allowed_values": "FAIL", "u.k.allowed_values": "ERROR", "t.z.allowed_values": "ERROR"}
    df.createOrReplaceTempView("t_rules")
    assert spark.sql(rules.allowed("t_rules", "k", ["it's"]).sql).first()[0] == 1


def test_scrub_and_json_faults(spark):
    df = spark.createDataFrame([('{"a": "x", "n": 1.5}',), ('{"a": null, "n": true}',), ("no",), ("{}",)], "r string")
    got = [r[0] for r in df.select(textchecks.json_faults(F.col("r"), {"a": "string", "n": "number"})).collect()]
    assert got == [[], ["a: not a string"], ["not JSON"], ["a: missing", "n: missing"]]
    m = spark.range(1).select(X.scrub(F.create_map(F.lit("Api-Key"), F.lit("1"), F.lit("name"), F.lit("2"))).alias("m")).first()["m"]
    assert m == {"Api-Key": "<redacted>", "name": "2"}


def test_trend_and_empty(spark):
    df = spark.createDataFrame([(i, i >= 5) for i in range(10)], "i int, bad boolean")
    assert textchecks.violation_trend(df, "bad", ["i"]).first()["trend"] == "increasing"
    assert textchecks.violation_trend(df.limit(0), "bad", ["i"]).first()["status"] == "ERROR"


def test_cosine_of_nothing_is_one(spark):
    a = spark.createDataFrame([("x", 1.0)], "token string, weight double")
    assert textchecks.cosine_distance(a, a.limit(0)).first()["distance"] == 1.0 and textchecks.cosine_distance(a, a).first()["distance"] == 0.0


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"doc_id": "1", "extracted_facts": [{"fact_id": "f"}]}\n\nnot json\n{"doc_id": "2"}\n')
    lenient = readers.jsonl(spark, str(p), flatten.EXTRACTION, strict=False)
    assert flatten.documents(lenient).select("fact_count").collect() == [(1,), (0,)] and flatten.facts(lenient).count() == 1
    with pytest.raises(Exception):
        readers.jsonl(spark, str(p), flatten.EXTRACTION).collect()
    assert readers.jsonl(spark, str(tmp_path / "none"), flatten.EXTRACTION, strict=False).count() == 0
    assert readers.digests(spark, str(p)).first()["sha256"] == readers.file_digest(str(p))
    for stamp, x in (("20260101_000000", 1), ("20260102_000000", 2), ("20260103_000000", 3)):
        sinks.document({"v": x}, str(tmp_path / "snaps" / f"{stamp}.yaml"))
    assert readers.two_snapshots(str(tmp_path / "snaps")) == ({"v": 2}, {"v": 3})
    assert readers.two_snapshots(str(tmp_path / "snaps"), "20260101") == ({"v": 1}, {"v": 3})
    t = str(tmp_path / "t")
    sinks.replace(spark.range(3).toDF("k"), t)
    sinks.upsert(t, spark.createDataFrame([(2,), (7,)], "k bigint"), ["k"], drift.upsert)
    assert sorted(r["k"] for r in spark.read.parquet(t).collect()) == [0, 1, 2, 7]
    with pytest.raises(ValueError):
        readers.within("/etc/passwd", str(tmp_path))
    assert Registry([{"breaking_fields": [{"field": None}, {"field": "a"}]}]).normalised().subscriptions[0]["breaking_fields"] == [{"field": "a"}]


def test_streams_split_and_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 01:00:00"), (None, "2026-01-02 00:00:00")], "kind string, at string").write.json(src)
    stream = spark.readStream.schema("kind string, at string").json(src)
    table = Table("t", (Field("kind", "string", True, enum=("a",)),))
    enforce.enforce(stream, table, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert sorted(r["schema_errors"][0] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["kind.enum", "kind.required"]
    assert [(r["rows"], r["violations"]) for r in enforce.violation_windows(spark.read.json(src), table, "at").orderBy("start").collect()] == [(2, 1), (1, 1)]


def test_small_reports(spark):
    r = spark.createDataFrame([], checks.RESULT)
    assert report.health(r).first()["score"] == 0 and report.latest_run(spark.createDataFrame([], "contract_id string, run_id string, run_timestamp string")).count() == 0
    assert "| a |" in report.markdown("T", [{"c": "a"}], ["c"])
    assert json.loads(json.dumps(infer.dbt_schema(Table("t", ()))))["models"][0]["columns"] == []


def test_partitioning_changes_nothing(spark, sf):
    from ledgerline.plans.queries_checks import LINEITEM

    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    one, many = (checks.table_checks(x, LINEITEM).orderBy("check_id").collect() for x in (df.coalesce(1), df.repartition(13)))
    assert one == many
    assert etl.positioned(df.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).agg(F.max("global_position")).first()[0] == df.count()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_are_exact_in_any_year_and_zone(spark, zone):
    want = {0.0: "1970-01-01T00:00:00+00:00", -0.25: "1969-12-31T23:59:59.750000+00:00", 1710037800.5: "2024-03-10T02:30:00.500000+00:00", 253402300800.25: "10000-01-01T00:00:00.250000+00:00", 518399913600.75: "18397-06-10T00:00:00.750000+00:00", -60001084800.0: "0068-08-22T00:00:00+00:00", 1.9999999: "1970-01-01T00:00:02+00:00"}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {r["s"]: r["at"] for r in spark.createDataFrame([(s,) for s in want], "s double").select("s", X.iso_utc(F.col("s")).alias("at")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_facts_are_made_once(spark):
    page = (1, 0.5, "Bank of Kenya paid $5 on 2024-01-05", ["Bank of Kenya"], [], [], [])
    df = spark.createDataFrame([("a", "a.pdf", "a.pdf", "h", 0.9, None, 1.0, 0.0, [page]), ("b", "b.pdf", "b.pdf", "h", 0.9, None, 1.0, 0.0, None)], etl.SOURCE)
    got = flatten.facts(etl.extraction_records(df))
    assert sorted(r["text"] for r in got.collect()) == ["Bank of Kenya", "Bank of Kenya paid $5 on 2024-01-05", "b.pdf"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.replace("Filter isnotnull(_place", "")  # one by the array's size would make all facts again
    odd = spark.createDataFrame([("c", []), ("d", None), ("e", [None, ("1", "t", [], 0.5, 1, "t")])], f"doc_id string, extracted_facts array<struct<{flatten.FACT.replace(' ', ':').replace(',:', ',')}>>")
    assert sorted((r["doc_id"], r["fact_id"] or "") for r in flatten.facts(odd).collect()) == [("e", ""), ("e", "1")]


def test_names_meet_common_strings_in_slices(spark):
    nodes = spark.createDataFrame([(str(i), f"part {i}", "brand") for i in range(60)], "node_id string, label string, path string")
    names = spark.createDataFrame([(n,) for n in ["par", "PART 1", "brand", "7", "nd", "none"]], "name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = graph.lineage_matches(nodes, names)
        assert "BroadcastHashJoin" in one._jdf.queryExecution().executedPlan().toString()  # and no string's nodes in one task
        for n in (names, names.filter("name in ('PART 1', '7', 'none')")):
            got = [graph.lineage_matches(nodes, n, *more).collect() for more in ((), (0, 7), (0, 1000))]
            want = sorted(str(i) for i in range(60) if any(x.lower() in f"part {i} brand" for (x,) in n.collect()))
            assert all(sorted(r["node_id"] for r in g) == want for g in got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_profile_cuts_texts_to_ranges(spark, monkeypatch):
    seen = []
    own = profile.cut
    monkeypatch.setattr(profile, "cut", lambda df: seen.append(own(df)) or seen[-1])
    df = spark.range(4000).select(F.concat(F.lit("text "), "id").alias("t"), F.lit(None).cast("string").alias("none"), (F.col("id") % 7).alias("k"))
    got = {r["column_name"]: r["cardinality"] for r in profile.profile(df).collect()}
    assert got == {"t": 4000, "none": 0, "k": 7}
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4007 and max(sizes) < 2000


@pytest.mark.parametrize("name", ["etl_extraction_facts", "etl_extraction_records", "etl_verdict_records"])
def test_rows_of_much_work_are_in_tasks_for_all_cores(spark, sf, name):
    registry.load()
    assert registry.QUERIES[name](spark, sf).rdd.getNumPartitions() >= 4


def test_answers_are_judged_once(spark, sf):
    registry.load()
    judged = spark.sparkContext.accumulator(0)

    def judge(rows):
        for r in rows:
            judged.add(1)
            yield (r["id"], r["id"] % 4 == 0)

    answers = spark.createDataFrame(spark.range(400).rdd.mapPartitions(judge), "id bigint, bad boolean")
    got = textchecks.violation_trend(answers, "bad", ["id"]).first()
    assert (got["records"], got["violations"], got["trend"]) == (400, 100, "stable") and judged.value == 400
    plan = registry.QUERIES["llm_breakdown"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
