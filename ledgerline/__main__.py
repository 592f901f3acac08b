"""python -m ledgerline COMMAND: validate, infer, diff, gate, log, quarantine, baselines, remedy, report, models, batch, history, audits, extract, hook."""

from __future__ import annotations

import argparse
import datetime
import json
import logging
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.functions.lineage import cut
from ledgerline.operators import ai, checks, drift, etl, evolve, flatten, graph, infer, profile, report, textchecks, validation
from ledgerline.operators import rules as rulebook
from ledgerline.plans import batch, documents, external, runlog
from ledgerline.plans.contract import Config, Contract, Registry
from ledgerline.sources import files, readers, sinks


NESTED = {"extractions": (flatten.EXTRACTION, ["documents", "extracted_facts", "entities"]), "events": (flatten.EVENT, ["events", "event_metadata"]), "lineage": (flatten.LINEAGE, ["lineage_nodes", "lineage_edges"])}


def _tables(spark: SparkSession, pairs: list[str]) -> dict[str, DataFrame]:
    """name=path: Parquet folders, or JSON lines by their ending; nested:KIND=path: all tables of nested records (extractions, events or lineage)."""
    out = {}
    for pair in pairs:
        name, _, path = pair.partition("=")
        if name.startswith("nested:"):
            schema, tables = NESTED[name.removeprefix("nested:")]
            out |= flatten.flatten_all(readers.jsonl(spark, path, schema), tables)
        else:
            out[name] = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return out


def _now(a: argparse.Namespace) -> str:
    return a.now or datetime.datetime.now(datetime.UTC).isoformat()


def _attributed(spark: SparkSession, a: argparse.Namespace, contract_id: str, run_id: str, results: DataFrame) -> DataFrame:
    """Results with stable ids, how many nodes and levels a registry's subscriptions reach from the contract, and the likeliest commit of --producer."""
    config = Config.from_env()
    subs = readers.subscriptions(spark, readers.registry(a.registry) if a.registry else Registry())
    edges = subs.select(F.coalesce("source_contract", "source", "contract_id").alias("source"), F.coalesce("target", "subscriber_id").alias("target")).filter("source is not null and target is not null")
    reach = graph.reachable(edges, spark.createDataFrame([(contract_id,)], "node string"))
    commits = readers.git_log(spark, os.path.dirname(os.path.abspath(a.producer)), os.path.basename(a.producer), config.git_log_limit) if a.producer else spark.createDataFrame([], "hash string, author string, ts string, message string")
    culprits = graph.blame(commits, _now(a), most=config.blame_candidates, per_day=config.blame_per_day, per_hop=config.blame_per_hop)
    found = graph.attribute(results, contract_id, run_id, reach, culprits)
    return results.join(found.select("check_id", "violation_id", "reached", "depth", "commit"), "check_id")


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Check tables against a contract, with drift against baselines and freshness where given; the exit code is the mode's. The enforcement's mode goes before the command line's."""
    doc = readers.settings(a.contract)
    if not doc:
        raise ValueError(f"{a.contract} has no contract")
    contract, rules = documents.from_document(doc), documents.enforcement_of(doc, readers.settings(a.registry) if a.registry else {})
    fresh = (doc.get("sla") or {}).get("freshness") or {}
    aged = validation.Freshness(fresh["table"], fresh["column"], _now(a)) if fresh else None
    baselines = spark.read.parquet(a.baselines) if a.baselines and files.exists(spark, a.baselines) else None
    tables = _tables(spark, a.tables)
    run_id = str(uuid.uuid4())
    with runlog.span(spark, f"validate {contract.id}", run_id=run_id):
        run = validation.validate(tables, contract, rules, baselines, aged, Config.from_env(), a.mode)
        results = cut(run.results)  # now, as a baseline that it reads may be replaced
        if a.log and not a.dry_run:
            violations = _attributed(spark, a, contract.id, run_id, results)
            sinks.append_log(violations, a.log, contract.id, run_id, _now(a))
        if a.report and not a.dry_run:
            previous = readers.previous_snapshot(a.snapshots) if a.snapshots else None
            versions = [documents.clauses(spark, documents.from_document(d)) if d else None for d in (previous, doc)]
            sinks.document(validation.report(validation.Run(results, run.stats, run.mode), contract, run_id, _now(a), validation.samples(tables, contract, results, enums=Config.from_env().sample_limit), *versions), a.report)
        if a.baselines and not a.dry_run:
            sinks.baselines(run.stats, a.baselines, a.promote)
        t = checks.tally(results).first().asDict()
        print(json.dumps(t | {"mode": run.mode} | report.health(results).first().asDict()))
    return validation.exit_code(results, run.mode)


def infer_contract(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write the contract that tables suggest, with quality rules and who reads it, a dbt schema a table, and a snapshot."""
    found, rules = [], []
    for name, df in _tables(spark, a.tables).items():
        profiled = profile.profile(df).cache()
        kinds = dict(df.dtypes)
        clauses = infer.clauses(profiled, kinds)
        few = [r["column_name"] for r in profiled.filter(F.col("cardinality") <= rulebook.FEW_VALUES).collect() if kinds[r["column_name"]] == "string"]
        values = {c: tuple(v["value"] for v in profile.sample_values(df, c).collect()) for c in few}
        enums = {r["column_name"]: values.get(r["column_name"], ()) for r in clauses.filter("is_enum").collect()}
        found.append(infer.table_contract(name, clauses, enums))
        rows = profiled.orderBy("column_name").collect()  # a row a column
        for r in infer.ambiguous(profiled, kinds).collect():  # a row a column; not part of the contract
            logging.getLogger("ledgerline.infer").info("%s.%s may need a description: %s", name, r["column_name"], r["description"])
        rules += rulebook.rules_of(name, [r.asDict() for r in rows], kinds, values, max((r["rows"] for r in rows), default=0))
    rules = {"graph": rulebook.graph_rules(), "events": rulebook.event_rules(a.event_types, a.services)}.get(a.rules, rules)
    nodes = readers.lineage(spark, a.lineage)[1] if a.lineage else spark.createDataFrame([], "source string, target string, relationship string, confidence double")
    subs = readers.subscriptions(spark, readers.registry(a.registry) if a.registry else Registry())
    consumers = [r.asDict() for r in infer.consumers(spark, nodes, subs, a.id).orderBy("id").collect()]
    lineage = readers.lineage_sample(spark, a.lineage) if a.lineage else []
    doc = infer.assemble(documents.to_document(Contract(a.id, tuple(found))), rules, consumers, " ".join(a.tables), len(found), _now(a), lineage=lineage)
    sinks.document(doc, a.out)
    for t in found:
        sinks.document(infer.dbt_schema(t), f"{a.out}.{t.name}_dbt.yml")
    if a.snapshots:
        stamp = datetime.datetime.now(datetime.UTC).strftime("%Y%m%d_%H%M%S_%f")
        sinks.document(doc, os.path.join(a.snapshots, a.id, f"{stamp}.yaml"))
    return 0


def _pair(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return tuple(documents.clauses(spark, documents.from_document(readers.settings(p))) for p in (a.old, a.new))


def diff(spark: SparkSession, a: argparse.Namespace) -> int:
    """Print the changes between two versions, and how to undo the breaking ones; 1 if any breaks."""
    changes = evolve.diff(*_pair(spark, a)).cache()
    for r in changes.orderBy("table_name", "field", "change").collect():  # as many as a contract has clauses
        print(json.dumps(r.asDict()))
    for r in evolve.rollback(changes).collect():
        print(json.dumps(r.asDict()))
    return int(not changes.filter("breaking").isEmpty())


def gate(spark: SparkSession, a: argparse.Namespace) -> int:
    """1 where the new version breaks a subscriber. Versions are files, or, with --ref, one file now and as it was at a revision; one that wasn't there breaks nobody."""
    if a.ref:
        before = readers.git_show(os.path.dirname(os.path.abspath(a.old)), a.ref, f"./{os.path.basename(a.old)}")
        if before is None:
            print(json.dumps({"decision": "PASS", "reason": f"not at {a.ref}"}))
            return 0
        docs = [readers.parsed(before), readers.settings(a.old)]
    else:
        docs = [readers.settings(p) for p in (a.old, a.new)]
    old, new = (documents.clauses(spark, documents.from_document(d)) for d in docs)
    got = evolve.gate(old, new, readers.subscriptions(spark, readers.registry(a.registry))).first()
    print(json.dumps(got.asDict()))
    return int(got["decision"] == "BLOCK")


def log(spark: SparkSession, a: argparse.Namespace) -> int:
    """Print the last run of each contract in a log, as Markdown."""
    rows = report.latest_run(spark.read.parquet(a.path)).withColumn("rank", report.severity_rank(F.col("severity"))).orderBy("rank", "check_id").limit(a.most)
    print(report.markdown("Last violations", [r.asDict() for r in rows.collect()], ["contract_id", "check_id", "status", "severity", "records_failing"]))
    return 0


def baselines(spark: SparkSession, a: argparse.Namespace) -> int:
    """List the baselines; clear a contract's or all; or promote what a report measured."""
    rows = spark.read.parquet(a.path)
    if a.clear is not None:
        sinks.replace(drift.cleared(rows, None if a.clear == "all" else a.clear), a.path)
        return 0
    for r in rows.orderBy("key", "column_name").collect():  # a row a column of a contract
        print(json.dumps(r.asDict()))
    return 0


def _results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The results of report files, each with its contract."""
    rows = [(doc["contract_id"], *(r.get(c) for c in validation.COLUMNS)) for doc in map(readers.settings, paths) for r in doc.get("results") or []]
    kinds = ", ".join(f"{c} {'bigint' if c == 'records_failing' else 'string'}" for c in validation.COLUMNS)
    return spark.createDataFrame(rows, f"contract_id string, {kinds}")


def remedy(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write what to do about the results of a report that aren't PASS: Markdown, YAML or JSON, by the output's ending."""
    doc = readers.settings(a.report)
    plan = report.remediation_plan(_results(spark, [a.report]), report.steps(spark, readers.settings(a.rules) if a.rules else None), doc.get("contract_id", "unknown"))
    if a.out.endswith((".json", ".yml", ".yaml")):
        sinks.document(plan, a.out)
    else:
        sinks.text(report.render_plan(plan), a.out)
    return 0


def make_report(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write a report of validations, model checks, the difference of two versions and a log: a document, or Markdown."""
    model = readers.optional_json(a.models)
    known = {f.split(" ")[0] for f in ai.ROW.split(", ")}
    checks_ = spark.createDataFrame([tuple(c.get(k.split(" ")[0]) for k in ai.ROW.split(", ")) for c in model["checks"]], ai.ROW) if model and known else None
    changes = evolve.diff(*_pair(spark, a)) if a.old and a.new else report.evolution_of(spark, readers.optional_json(a.evolution))
    log_ = spark.read.parquet(a.log) if a.log and files.exists(spark, a.log) else None
    failures = evolve.consumer_failures(changes, readers.subscriptions(spark, readers.registry(a.registry))) if changes is not None and a.registry else None
    sources = report.manifest({"validation_reports": a.reports, "models": a.models, "versions": [a.old, a.new], "violation_log": a.log}, log_)
    doc = report.document(_results(spark, a.reports), _now(a), a.version, checks_, changes, failures, log_, Config.from_env().critical_penalty, sources)
    if a.out.endswith((".json", ".yml", ".yaml")):
        sinks.document(doc, a.out)
    else:
        sinks.text(report.render(doc), a.out)
    return 0


def models(spark: SparkSession, a: argparse.Namespace) -> int:
    """Check what models read and write: facts' texts against the stored baseline, inputs against their schema, answers' violations; 1 where a check fails."""
    records = spark.read.text(a.extractions).filter("trim(value) <> ''").withColumnRenamed("value", "record")
    facts = flatten.facts(readers.jsonl(spark, a.extractions, flatten.EXTRACTION))
    answers = readers.variants(spark, a.answers).withColumn("ord", F.monotonically_increasing_id())
    required = readers.settings(a.schema) if a.schema else {"doc_id": "string", "source_path": "string", "extraction_model": "string"}
    found = ai.run_all(ai.Inputs(facts, "text", records, "record", required, answers, "v", ["ord"], a.baseline), Config.from_env())
    if a.quarantine:
        sinks.quarantine(textchecks.split(records, "record", required)[1], a.quarantine, _now(a))
    doc = ai.document(found, _now(a))
    if a.out:
        sinks.document(doc, a.out)
    print(json.dumps(doc["summary"]))
    return ai.exit_code(doc)


def run_manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    """Run the validations of a manifest; 1 where one doesn't end with 0."""
    entries, workers = readers.manifest(a.manifest)

    def one(session: SparkSession, e: dict) -> int:
        pairs = e["data"] if isinstance(e["data"], list) else [e["data"]]
        argv = ["validate", e["contract"], *pairs, "--mode", e["mode"], "--report", e["output"], *(["--baselines", a.baselines] if a.baselines else []), *(["--promote"] if e["promote_baselines"] else [])]
        return validate(session, parser().parse_args(argv))

    outcomes = batch.run_batch(spark, batch.jobs_of(entries, one), a.workers or workers, a.fail_fast)
    doc = batch.document(outcomes)
    if a.out:
        sinks.document(doc, a.out)
    print(json.dumps(doc))
    return int(any(o.code for o in outcomes))


def history(spark: SparkSession, a: argparse.Namespace) -> int:
    """Compare the last two snapshots of a folder, or the first since a time and the last; 1 if anything breaks, 2 where there aren't two."""
    pair = readers.two_snapshots(a.folder, a.since)
    if pair is None:
        print("there aren't two snapshots", file=sys.stderr)
        return 2
    changes = evolve.diff(*(documents.clauses(spark, documents.from_document(d)) for d in pair)).cache()
    for r in changes.orderBy("table_name", "field", "change").collect():
        print(json.dumps(r.asDict()))
    return int(not changes.filter("breaking").isEmpty())


def quarantine(spark: SparkSession, a: argparse.Namespace) -> int:
    """Print the errors of a quarantine; write what only has allowed ones, and with --remove take it out of the quarantine; or archive it. Lines that aren't JSON are left out."""
    rows = spark.read.json(a.path)
    if "_corrupt_record" in rows.columns:
        rows = cut(rows).filter("_corrupt_record is null").drop("_corrupt_record")
    for r in textchecks.error_histogram(rows, a.key).orderBy(F.col("records").desc(), "error").limit(a.most).collect():
        print(json.dumps(r.asDict()))
    if a.out:
        sinks.jsonl(textchecks.requeue(rows, a.allow).drop("schema_errors", "quarantined_at"), a.out)
    if a.out and a.remove:
        stay = cut(rows.join(textchecks.requeue(rows, a.allow).select(a.key), a.key, "left_anti"))
        sinks.rewrite(stay, a.path)
    if a.archive:
        print(sinks.archive(spark, a.path))
    return 0


def audits(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write the verdict records of Markdown audit reports as JSON lines; 2 where there are none."""
    paths = readers.reports_in(spark, a.reports)
    if not paths:
        print("there are no reports", file=sys.stderr)
        return 2
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    sinks.jsonl(etl.verdict_records(texts, "text", "path", now=_now(a)), a.out)
    return 0


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    """Run a program on each file that --done doesn't have yet, each for --timeout seconds at most; 1 where one fails."""
    done = flatten.documents(readers.jsonl(spark, a.done, flatten.EXTRACTION, strict=False)).select("source_path", F.substring_index("source_path", "/", -1).alias("name")) if a.done else None
    found = external.extract(spark, a.program.split(), a.files, done, a.timeout, a.workers)
    for f in found:
        print(json.dumps(vars(f)))
    return int(any(f.status in ("ERROR", "TIMEOUT") for f in found))


def hook(spark: SparkSession, a: argparse.Namespace) -> int:
    """Install the hook that runs the gate before a push."""
    print(external.install_hook(a.repository, a.contracts, a.registry))
    return 0


def parser() -> argparse.ArgumentParser:
    """All commands."""
    p = argparse.ArgumentParser(prog="ledgerline", description=__doc__)
    p.add_argument("--root", help="a folder that contracts and outputs must lie in")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, *arguments):
        s = sub.add_parser(name, help=f.__doc__)
        s.set_defaults(run=f)
        for flags, options in arguments:
            s.add_argument(*flags, **options)

    tables = (("tables",), {"nargs": "+", "metavar": "NAME=PATH"})
    flag = lambda name, **o: ((name,), o)
    yes = {"action": "store_true"}
    now, registry_ = flag("--now", default=""), flag("--registry")
    add("validate", validate, flag("contract"), tables, registry_, flag("--log"), flag("--mode", choices=list(readers.MODES)), now, flag("--baselines"), flag("--promote", **yes), flag("--dry-run", **yes), flag("--report"), flag("--snapshots"), flag("--producer"))
    add("infer", infer_contract, flag("id"), flag("out"), tables, registry_, flag("--lineage"), flag("--snapshots"), now, flag("--rules", choices=["graph", "events"]), flag("--event-types", nargs="*", default=[]), flag("--services", nargs="*", default=[]))
    add("diff", diff, flag("old"), flag("new"))
    add("gate", gate, flag("old"), flag("new"), flag("registry"), flag("--ref"))
    add("log", log, flag("path"), flag("--most", type=int, default=5))
    add("quarantine", quarantine, flag("path"), flag("key"), flag("--allow", nargs="*", default=[]), flag("--out"), flag("--archive", **yes), flag("--remove", **yes), flag("--most", type=int, default=20))
    add("baselines", baselines, flag("path"), flag("--clear"))
    add("remedy", remedy, flag("report"), flag("out"), flag("--rules"))
    add("report", make_report, flag("out"), flag("reports", nargs="+"), flag("--models"), flag("--old"), flag("--new"), flag("--evolution"), registry_, flag("--log"), flag("--version", choices=["1.0", "2.0"], default="2.0"), now)
    add("models", models, flag("extractions"), flag("answers"), flag("baseline"), flag("--schema"), flag("--quarantine"), flag("--out"), now)
    add("batch", run_manifest, flag("manifest"), flag("--baselines"), flag("--workers", type=int), flag("--fail-fast", **yes), flag("--out"))
    add("history", history, flag("folder"), flag("--since"))
    add("audits", audits, flag("reports"), flag("out"), now)
    add("extract", extract, flag("program"), flag("files", nargs="+"), flag("--done"), flag("--timeout", type=float, default=120.0), flag("--workers", type=int, default=1))
    add("hook", hook, flag("repository"), flag("contracts"), flag("registry"))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; 2 on an error."""
    a = parser().parse_args(argv)
    runlog.configure(str(uuid.uuid4()))
    spark = spark or SparkSession.builder.appName("ledgerline").getOrCreate()
    try:
        for name in ("contract", "report", "out", "log", "baselines", "snapshots") if a.root else ():
            if isinstance(getattr(a, name, None), str):
                readers.within(getattr(a, name), a.root)
        return a.run(spark, a)
    except (OSError, ValueError, KeyError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
