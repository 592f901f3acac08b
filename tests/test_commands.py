import json
import os
import subprocess

import pytest
import yaml

from ledgerline.__main__ import main
from ledgerline.operators import etl, graph, infer, report
from ledgerline.plans import batch, documents, runlog
from ledgerline.plans.contract import Contract, Field, ForeignKey, Table
from ledgerline.sources import files, readers, sinks


def test_infer_then_validate_then_diff(spark, sf, tmp_path, capsys):
    old = str(tmp_path / "old.yaml")
    assert main(["infer", "trade", old, f"orders={sf}/orders.parquet"], spark) == 0
    assert main(["validate", old, f"orders={sf}/orders.parquet", "--mode", "ENFORCE", "--log", str(tmp_path / "log"), "--now", "t1"], spark) in (0, 1)
    c = documents.from_document(__import__("yaml").safe_load(open(old)))
    fewer = Contract(c.id, (Table("orders", tuple(f for f in c.tables[0].fields if f.name != "o_custkey")),))
    new = str(tmp_path / "new.yaml")
    sinks.document(documents.to_document(fewer), new)
    assert main(["diff", old, new], spark) == 1 and main(["diff", old, old], spark) == 0
    reg = str(tmp_path / "reg.yaml")
    sinks.document({"subscriptions": [{"contract_id": "trade", "subscriber_id": "s", "breaking_fields": ["orders.o_custkey"]}]}, reg)
    assert main(["gate", old, new, reg], spark) == 1 and main(["gate", old, old, reg], spark) == 0
    assert main(["gate", old, str(tmp_path / "none" / "x.yaml"), reg], spark) == 1
    capsys.readouterr()


def test_validate_modes_and_log(spark, tmp_path, capsys):
    t = str(tmp_path / "t.jsonl")
    open(t, "w").write('{"k": "a"}\n{"k": "z"}\n')
    c = str(tmp_path / "c.yaml")
    sinks.document(documents.to_document(Contract("c", (Table("t", (Field("k", enum=("a",)),)),), (ForeignKey("t", "k", "u", "k"),))), c)
    codes = [main(["validate", c, f"t={t}", "--mode", m, "--log", str(tmp_path / "log"), "--now", m], spark) for m in ("AUDIT", "WARN", "ENFORCE")]
    assert codes == [0, 0, 1]
    assert main(["log", str(tmp_path / "log")], spark) == 0
    assert "t.k.enum" in capsys.readouterr().out


def test_quarantine_command(spark, tmp_path, capsys):
    q = str(tmp_path / "q.json")
    open(q, "w").write('{"id": 1, "schema_errors": ["a"], "quarantined_at": "x"}\n{"id": 2, "schema_errors": ["a", "b"], "quarantined_at": "x"}\n')
    assert main(["quarantine", q, "id", "--allow", "a", "--out", str(tmp_path / "out"), "--archive"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0]) == {"error": "a", "records": 2, "samples": "1,2"}
    assert [r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()] == [1]


def test_batch(spark):
    jobs = [batch.Job("good", lambda s: int(s.range(3).count() != 3)), batch.Job("bad", lambda s: 1 // 0), batch.Job("late", lambda s: 0)]
    got = batch.run_batch(spark, jobs, workers=1, fail_fast=True)
    assert [o.code for o in got] == [0, 2, None] and got[1].error.startswith("ZeroDivisionError")
    assert batch.summary(got) | {"seconds": 0} == {"jobs": 3, "passed": 1, "failed": 1, "skipped": 1, "seconds": 0}


def lines(path, *rows):
    open(path, "w").write("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_validation_with_baselines_report_and_precedence(spark, tmp_path, capsys):
    data = lines(tmp_path / "t.jsonl", *({"k": "a", "v": i, "at": "2024-01-01T00:00:00Z"} for i in range(20)))
    doc = documents.to_document(Contract("c", (Table("t", (Field("k", enum=("a",)), Field("v", "integer", True), Field("at", format="date-time"), Field("lost"))),)))
    c, base, rep = str(tmp_path / "c.yaml"), str(tmp_path / "base"), str(tmp_path / "r.json")
    sinks.document(doc | {"sla": {"freshness": {"table": "t", "column": "at"}}}, c)
    run = ["validate", c, f"t={data}", "--baselines", base, "--now", "2024-01-02T01:00:00Z"]
    assert main([*run, "--dry-run", "--report", rep, "--log", str(tmp_path / "log")], spark) == 0
    assert not files.exists(spark, base) and not os.path.exists(rep) and not os.path.exists(tmp_path / "log")
    assert main([*run, "--report", rep, "--mode", "WARN", "--log", str(tmp_path / "log")], spark) == 1  # a declared column is missing
    first = json.load(open(rep))
    assert first["schema_summary"]["missing_columns"] == [{"table": "t", "column": "lost"}] and first["mode"] == "WARN"
    assert {r["status"] for r in first["results"] if r["check_type"] == "freshness"} == {"WARN"} and not [r for r in first["results"] if r["check_type"].startswith("drift")]
    lines(tmp_path / "t.jsonl", *({"k": "b", "v": 1000 * i, "at": "2024-01-01T00:00:00Z"} for i in range(20)))
    assert main([*run, "--report", rep], spark) == 0
    second = json.load(open(rep))
    assert {r["status"] for r in second["results"] if r["check_type"] == "drift_mean"} == {"FAIL"}
    assert next(r for r in second["results"] if r["check_id"] == "t.k.enum")["sample"] == ["b"]
    before = spark.read.parquet(base).collect()
    assert main([*run, "--promote"], spark) == 0 and spark.read.parquet(base).collect() != before
    assert main([*run, "--report", rep], spark) == 0 and {r["status"] for r in json.load(open(rep))["results"] if r["check_type"] == "drift_mean"} == {"PASS"}
    sinks.document(doc | {"enforcement": {"mode": "AUDIT"}}, c)  # the document's mode goes before the command's
    assert main(["validate", c, f"t={data}", "--mode", "ENFORCE"], spark) == 0
    capsys.readouterr()
    assert main(["baselines", base], spark) == 0 and json.loads(capsys.readouterr().out.splitlines()[0])["key"] == "c/t"
    assert main(["baselines", base, "--clear", "c"], spark) == 0 and spark.read.parquet(base).count() == 0


def test_remedies_and_reports(spark, tmp_path, capsys):
    data = lines(tmp_path / "t.jsonl", {"k": "z", "v": 1})
    c, rep, log = str(tmp_path / "c.yaml"), str(tmp_path / "r.json"), str(tmp_path / "log")
    sinks.document(documents.to_document(Contract("c", (Table("t", (Field("k", enum=("a",)), Field("w", required=True))),))), c)
    main(["validate", c, f"t={data}", "--report", rep, "--log", log, "--now", "n1"], spark)
    md, js = str(tmp_path / "plan.md"), str(tmp_path / "plan.json")
    assert main(["remedy", rep, md], spark) == 0 and main(["remedy", rep, js], spark) == 0
    plan = {x["check_id"]: x["step"] for x in json.load(open(js))["items"]}
    assert plan["t.k.enum"] == "bring the values of t.k into line, or allow the new ones" and "t.v" in plan["t.v.schema_new_column"] and "`t.k.enum`" in open(md).read()
    rules = str(tmp_path / "rules.yaml")
    sinks.document({"exact": {"enum": "list {label}"}, "prefix": {"schema_": "agree on {column}"}, "default": "look"}, rules)
    assert main(["remedy", rep, js, "--rules", rules], spark) == 0
    assert {x["step"] for x in json.load(open(js))["items"]} == {"list t.k", "agree on v", "agree on w"}
    models = str(tmp_path / "models.json")
    sinks.document({"checks": [{"check_type": "llm_output_violation_rate", "status": "FAIL", "severity": "HIGH", "records": 3, "measure": 0.5, "message": "m"}]}, models)
    old, new = str(tmp_path / "old.yaml"), str(tmp_path / "new.yaml")
    sinks.document(documents.to_document(Contract("c", (Table("t", (Field("k", required=True), Field("x"))),))), old)
    sinks.document(documents.to_document(Contract("c", (Table("t", (Field("x"),)),))), new)
    out, out1, outmd = (str(tmp_path / n) for n in ("rep.json", "rep1.json", "rep.md"))
    more = ["--models", models, "--old", old, "--new", new, "--log", log]
    assert main(["report", out, rep, *more], spark) == 0 and main(["report", out1, rep, *more, "--version", "1.0"], spark) == 0 and main(["report", outmd, rep], spark) == 0
    two, one = json.load(open(out)), json.load(open(out1))
    assert two["verdict"] == one["verdict"] == "ISSUES_DETECTED" and two["schema_evolution"]["verdict"] == "breaking" and two["ai_checks"]["risk_level"] == "HIGH"
    assert len(two["prioritized_actions"]) == 3 and two["prioritized_actions"][0]["priority"] == 0 and two["violations"]["total_count"] == 3 and "prioritized_actions" not in one
    assert two["generation_evidence"]["violation_log_run_timestamp"] == "n1" and "What to do first" in open(outmd).read()
    capsys.readouterr()


def test_batch_manifest(spark, tmp_path, capsys):
    data = lines(tmp_path / "t.jsonl", {"k": "a"})
    c, m = str(tmp_path / "c.yaml"), str(tmp_path / "m.yaml")
    sinks.document(documents.to_document(Contract("c", (Table("t", (Field("k", enum=("b",)),)),))), c)
    sinks.document({"defaults": {"contract": c, "data": f"t={data}"}, "jobs": [{"output": str(tmp_path / "1.json")}, {"output": str(tmp_path / "2.json"), "mode": "enforce"}]}, m)
    assert main(["batch", m, "--out", str(tmp_path / "sum.json")], spark) == 1
    got = json.load(open(tmp_path / "sum.json"))
    assert sorted(r["exit_code"] for r in got["results"]) == [0, 1] and json.load(open(tmp_path / "1.json"))["failed"] == 1
    for bad in ({}, {"jobs": []}, {"jobs": [3]}, {"jobs": [{"contract": c}]}, {"jobs": [{"contract": c, "data": "d", "output": "o", "mode": "loud"}]}):
        sinks.document(bad, m)
        with pytest.raises(ValueError):
            readers.manifest(m)
    capsys.readouterr()


def test_gate_at_a_revision(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    c, reg = str(repo / "c.yaml"), str(tmp_path / "reg.yaml")
    sinks.document(documents.to_document(Contract("c", (Table("t", (Field("k"), Field("x"))),))), c)
    git("add", "."), git("commit", "-qm", "one")
    sinks.document(documents.to_document(Contract("c", (Table("t", (Field("x"),)),))), c)
    sinks.document({"subscriptions": [{"contract_id": "c", "subscriber_id": "s", "breaking_fields": ["t.k"]}]}, reg)
    assert main(["gate", c, c, reg, "--ref", "HEAD"], spark) == 1
    git("checkout", "-q", "c.yaml")
    assert main(["gate", c, c, reg, "--ref", "HEAD"], spark) == 0
    other = str(repo / "new.yaml")
    sinks.document({}, other)
    assert main(["gate", other, other, reg, "--ref", "HEAD"], spark) == 0
    commits = readers.git_log(spark, str(repo), "c.yaml").collect()
    assert [r["message"] for r in commits] == ["one"] and readers.git_log(spark, str(repo), "nothing").count() == 0
    capsys.readouterr()


def test_history_of_snapshots(spark, tmp_path, capsys):
    out, snaps = str(tmp_path / "c.yaml"), str(tmp_path / "snaps")
    data = lines(tmp_path / "t.jsonl", *({"k": "a", "v_id": f"{i}", "name": "n", "confidence": 0.5} for i in range(3)))
    assert main(["infer", "c", out, f"t={data}", "--snapshots", snaps], spark) == 0
    assert main(["history", f"{snaps}/c"], spark) == 2
    doc = yaml.safe_load(open(out))
    assert {r["name"] for r in doc["quality"]} >= {"t.k.allowed_values", "t.v_id.unique", "t.name.non_empty", "t.confidence.range_check", "t.confidence.floor_check", "t.k.not_null"}
    lines(tmp_path / "t.jsonl", *({"k": "a"} for _ in range(3)))
    assert main(["infer", "c", out, f"t={data}", "--snapshots", snaps], spark) == 0
    assert main(["history", f"{snaps}/c"], spark) == 1 and readers.previous_snapshot(f"{snaps}/c")["id"] == "c"
    capsys.readouterr()


def test_model_checks(spark, tmp_path, capsys):
    fact = lambda t: {"fact_id": "f", "text": t, "entity_refs": [], "confidence": 0.5, "page_ref": 1, "source_excerpt": ""}
    ex = lines(tmp_path / "e.jsonl", *({"doc_id": f"d{i}", "source_path": "p", "extraction_model": "m", "extracted_facts": [fact("one two three")]} for i in range(3)))
    good = {"decision": "d", "confidence": 0.5, "reasoning": "r"}
    an = lines(tmp_path / "a.jsonl", *({"verdict": good} for _ in range(5)))
    base, out = str(tmp_path / "base"), str(tmp_path / "out.json")
    assert main(["models", ex, an, base, "--out", out], spark) == 0
    assert [c["status"] for c in json.load(open(out))["checks"]] == ["PASS"] * 3
    lines(tmp_path / "e.jsonl", {"doc_id": "d", "source_path": "p", "extracted_facts": [fact("entirely other words")]})
    lines(tmp_path / "a.jsonl", {"verdict": good}, {"verdict": 5}, {"verdict": "oops"})
    assert main(["models", ex, an, base, "--out", out], spark) == 1
    got = {c["check_type"]: c for c in json.load(open(out))["checks"]}
    assert got["embedding_drift"]["measure"] == 1.0 and all(c["status"] == "FAIL" for c in got.values())
    assert main(["models", ex, an, base], spark) == 1  # the baseline is what the run before saw; inputs and answers still fail
    capsys.readouterr()


def test_logs_are_json(capsys):
    handler = runlog.configure("r1")
    import logging

    logging.getLogger("ledgerline.x").info("hello %s", "you", extra={"rows": 3})
    runlog.configure("r2")
    line = json.loads(capsys.readouterr().err.splitlines()[-1])
    assert line["message"] == "hello you" and line["rows"] == 3 and line["run_id"] == "r1" and handler is not None


def test_span_names_jobs(spark):
    with runlog.span(spark, "counting", n=1):
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "counting"
    assert spark.sparkContext.getLocalProperty("spark.job.description") != "counting"


def test_violations_are_attributed_in_the_log(spark, tmp_path, capsys):
    data = lines(tmp_path / "t.jsonl", {"k": "z"})
    c, reg, log = str(tmp_path / "c.yaml"), str(tmp_path / "reg.yaml"), str(tmp_path / "log")
    sinks.document(documents.to_document(Contract("c", (Table("t", (Field("k", enum=("a",)),)),))), c)
    sinks.document({"subscriptions": [{"contract_id": "c", "source_contract": "c", "target": "d", "subscriber_id": "d"}, {"contract_id": "d", "source_contract": "d", "target": "e", "subscriber_id": "e"}]}, reg)
    assert main(["validate", c, f"t={data}", "--registry", reg, "--log", log, "--now", "2024-01-01T00:00:00"], spark) == 0
    rows = spark.read.parquet(log).collect()
    assert [(r["check_id"], r["reached"], r["depth"], r["commit"]) for r in rows] == [("t.k.enum", 2, 2, None)] and len(rows[0]["violation_id"]) == 36
    assert main(["--root", str(tmp_path / "elsewhere"), "validate", c, f"t={data}"], spark) == 2
    capsys.readouterr()


def test_nested_tables_and_fixed_rules(spark, tmp_path, capsys):
    fact = {"fact_id": "f", "text": "t", "entity_refs": [], "confidence": 0.5, "page_ref": 1, "source_excerpt": ""}
    ex = lines(tmp_path / "e.jsonl", {"doc_id": "d", "extracted_facts": [fact, fact]}, {"doc_id": "e"})
    out = str(tmp_path / "c.yaml")
    assert main(["infer", "c", out, f"nested:extractions={ex}"], spark) == 0
    doc = yaml.safe_load(open(out))
    assert set(doc["tables"]) == {"documents", "extracted_facts", "entities"} and "extracted_facts.doc_id.references.documents.doc_id" in {r["name"] for r in doc["quality"]}
    assert main(["infer", "c", out, f"nested:extractions={ex}", "--rules", "events", "--event-types", "view", "--services", "web"], spark) == 0
    assert "event_metadata.global_position.positive" in {r["name"] for r in yaml.safe_load(open(out))["quality"]}
    capsys.readouterr()


def test_quarantine_gives_rows_back(spark, tmp_path, capsys):
    q = tmp_path / "q"
    q.mkdir()
    (q / "a.json").write_text('{"id": 1, "schema_errors": ["a"], "quarantined_at": "x"}\nnot json\n{"id": 2, "schema_errors": ["b"], "quarantined_at": "x"}\n')
    assert main(["quarantine", str(q), "id", "--allow", "a", "--out", str(tmp_path / "out"), "--remove"], spark) == 0
    assert [r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()] == [1] and [r["id"] for r in spark.read.json(str(q)).collect()] == [2]
    capsys.readouterr()


def test_audits_extractions_and_hook(spark, tmp_path, capsys):
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "one.md").write_text("# A\n### Criterion: c1\n**Final Score:** 4/5\n")
    (folder / "two.md").write_text("nothing\n")
    out = str(tmp_path / "v")
    assert main(["audits", str(folder), out, "--now", "t"], spark) == 0
    got = {r["target_ref"]: (r["overall_score"], r["overall_verdict"], r["confidence"], r["evaluated_at"]) for r in spark.read.json(out).collect()}
    assert got == {"one": (4.0, "PASS", 0.94, "t"), "two": (0.0, "BLOCK", 0.5, "t")}
    assert readers.reports_in(spark, str(folder).replace("reports", "rep_orts"), alias=("rep_orts", "reports")) == readers.reports_in(spark, None, [str(tmp_path / "no"), str(folder)])
    with pytest.raises(FileNotFoundError):
        readers.reports_in(spark, str(tmp_path / "no"))
    files_ = [str(tmp_path / n) for n in ("a.pdf", "b.pdf", "c.pdf")]
    for f in files_:
        open(f, "w").write(os.path.basename(f))
    done = lines(tmp_path / "done.jsonl", {"doc_id": "1", "source_path": "other/b.pdf"})
    capsys.readouterr()
    assert main(["extract", "grep -q a", *files_, "--done", done, "--workers", "2"], spark) == 1
    assert {os.path.basename(x["file"]): x["status"] for x in map(json.loads, capsys.readouterr().out.splitlines())} == {"a.pdf": "OK", "b.pdf": "SKIP", "c.pdf": "ERROR"}
    assert main(["extract", "tail -f", files_[0], "--timeout", "0.3"], spark) == 1
    repo = tmp_path / "r"
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    for _ in range(2):
        assert main(["hook", str(repo), "contracts", "registry.yaml"], spark) == 0
    assert os.access(repo / ".git/hooks/pre-push", os.X_OK) and os.path.exists(repo / ".git/hooks/pre-push.before")
    subprocess.run(["sh", "-n", str(repo / ".git/hooks/pre-push")], check=True)
    capsys.readouterr()


def test_changes_told_by_documents(spark):
    of = lambda d: [(r["table_name"], r["field"], r["change"], r["breaking"]) for r in report.evolution_of(spark, d).collect()]
    assert report.evolution_of(spark, None) is None
    assert of({"breaking_changes": [{"table": "t", "field": "f", "type": "removed", "severity": "critical"}, 3]}) == [("t", "f", "removed", True)]
    results = [{"table_name": "t", "column_name": "f", "check_type": "enum", "severity": "HIGH", "status": "FAIL"}, {"status": "PASS"}]
    assert of({"results": results}) == [("t", "f", "enum", True)]
    assert of({"results": [], "schema_summary": {"missing_columns": [{"table": "t", "column": "a"}], "new_columns": [{"table": "t", "column": "b"}]}}) == [("t", "a", "schema_missing", True), ("t", "b", "schema_new_column", False)]


def test_other_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id": "1"}'), (tmp_path / "b.routing.json").write_text('{"doc_id": "2"}')
    assert [r["doc_id"] for r in readers.documents_in(spark, str(tmp_path / "*.json"), "doc_id string").collect()] == ["1"]
    (tmp_path / "x.md").write_text("a\nb")
    assert readers.texts_in(spark, str(tmp_path / "x.md")).first()["text"] == "a\nb"
    seed = tmp_path / "s.jsonl"
    seed.write_text('{"stream_id": "s-1", "event_type": "e", "event_version": 2, "payload": {"user_id": "u"}, "recorded_at": "r"}\n\n{"stream_id": "s-2", "event_type": "f"}\n')
    rows = readers.seed_events(spark, str(seed)).orderBy("ord").collect()
    assert [r["event_type"] for r in rows] == ["e", "f"] and json.loads(rows[0]["payload"]) == {"user_id": "u"} and rows[0]["event_version"] == "2"
    assert readers.optional_json(None) is None and readers.optional_json(str(tmp_path / "none.json")) is None
    catalog = spark.createDataFrame([("c", "active", "d/"), ("x", None, None)], "id string, status string, data_path string")
    assert [graph.catalog_status(catalog, i) for i in "cxz"] == [("active", "d/"), ("unknown", None), ("unknown", None)]
    assert etl.common_root(["/a/b/c.sql", "\\a\\b\\d\\e.yml", "rel", ""]) == "/a/b" and etl.common_root(["x"]) is None
    assert infer.source_description("Event-Log", {"event": "the log"}) == "the log"
    work = spark.createDataFrame([("a/1", "1"), ("a/2", "2")], "source_path string, name string")
    assert [r["name"] for r in readers.pending(work, spark.createDataFrame([("z", "1"), (None, None)], "source_path string, name string"), ["source_path", "name"]).collect()] == ["2"]
