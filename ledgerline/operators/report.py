"""Reports over check results, model checks, contract changes and violation logs.

Results of checks have as many rows as contracts have clauses, so that a report's parts are put together on the driver; logs
are summed in Spark first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.textchecks import in_ranges

RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "COMPAT": 4}


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL to 4 for COMPAT, else 5."""
    out = F.lit(5)
    for name, n in reversed(RANK.items()):
        out = F.when(F.upper(severity) == name, n).otherwise(out)
    return out


def verdict(failed: Column, ai_failed: Column, evolution: Column) -> Column:
    """PASS where nothing fails and versions are compatible, ATTENTION_REQUIRED where nothing fails, else ISSUES_DETECTED."""
    calm = (failed == 0) & (ai_failed == 0)
    return F.when(calm & (evolution == "compatible"), "PASS").when(calm, "ATTENTION_REQUIRED").otherwise("ISSUES_DETECTED")


def evolution_verdict(changes: DataFrame) -> DataFrame:
    """One row: breaking and compatible changes, and breaking or compatible."""
    n = changes.agg(F.count_if("breaking").alias("breaking_changes"), F.count_if(~F.col("breaking")).alias("compatible_changes"))
    return n.withColumn("verdict", F.when(F.col("breaking_changes") > 0, "breaking").otherwise("compatible"))


def evolution_of(spark: SparkSession, doc: dict | None) -> DataFrame | None:
    """The changes (table_name, field, change, severity, breaking) that a document tells: its list of breaking changes, else its results that aren't PASS, else the columns that its summary says went or came; None without a document."""
    if not doc:
        return None
    told = doc.get("breaking_changes", doc.get("schema_diff"))
    if isinstance(told, list):
        rows = [(c.get("table") or c.get("table_name"), c.get("field"), c.get("type") or c.get("change") or "changed", str(c.get("severity") or "UNKNOWN").upper()) for c in told if isinstance(c, dict)]
    else:
        rows = [(r.get("table_name"), r.get("column_name"), r.get("check_type") or "changed", str(r.get("severity") or "UNKNOWN").upper()) for r in doc.get("results") or [] if r.get("status") != "PASS"]
    if not rows:
        both = doc.get("schema_summary") or {}
        rows = [(c.get("table"), c.get("column"), kind, severity) for part, kind, severity in (("missing_columns", "schema_missing", "CRITICAL"), ("new_columns", "schema_new_column", "MEDIUM")) for c in both.get(part) or []]
    return spark.createDataFrame(rows, "table_name string, field string, change string, severity string").withColumn("breaking", F.col("severity").isin("CRITICAL", "HIGH"))


def health(results: DataFrame, penalty: float = 20, checks: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Totals, pass rate, critical failures, score (pass rate less a penalty for each, within 0 and 100) and verdict.

    ``checks``: of models; none are no failure. ``changes``: of a contract; without any known the verdict is no PASS.
    """
    n = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if((F.col("status") == "FAIL") & (F.upper("severity") == "CRITICAL")).alias("criticals"))
    ai = checks.agg(F.count_if(F.col("status") == "FAIL").alias("ai")) if checks is not None else None
    n = n.crossJoin(F.broadcast(ai)) if ai is not None else n.withColumn("ai", F.lit(0))  # one row each
    n = n.crossJoin(F.broadcast(evolution_verdict(changes).select(F.col("verdict").alias("evolution")))) if changes is not None else n.withColumn("evolution", F.lit("unknown"))
    score = F.when(F.col("total") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100.0 * F.col("passed") / F.greatest(F.col("total"), F.lit(1)) - penalty * F.col("criticals")).cast("int"))))
    return n.select("total", "passed", "failed", "criticals", F.round(100.0 * F.col("passed") / F.greatest(F.col("total"), F.lit(1)), 1).alias("pass_rate"), score.alias("score"), verdict(F.col("failed"), F.col("ai"), F.col("evolution")).alias("verdict"))


def validation_summary(results: DataFrame) -> DataFrame:
    """One row over contracts (contract_id): how many there are, totals by status, pass rate, and how many results that aren't PASS have each severity."""
    n = lambda s: F.count_if(F.col("status") == s)
    bad = results.filter("status <> 'PASS'").groupBy(F.upper("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_counts"))
    got = results.agg(F.count_distinct("contract_id").alias("contracts"), F.count(F.lit(1)).alias("total_checks"), n("PASS").alias("total_passed"), n("FAIL").alias("total_failed"), n("WARN").alias("total_warned"), n("ERROR").alias("total_errored"))
    return got.withColumn("pass_rate_pct", F.round(100.0 * F.col("total_passed") / F.greatest(F.col("total_checks"), F.lit(1)), 1)).crossJoin(F.broadcast(bad))  # one row each


def field_label(check_id: Column, column: Column) -> Column:
    """``table.column``: the table is a check's first part, where it has several; else the column, or the check."""
    named = F.nullif(F.coalesce(column, F.lit("")), F.lit(""))
    parts = F.split(check_id, r"\.")
    return F.when(F.instr(check_id, ".") > 0, F.coalesce(F.concat_ws(".", parts[0], named), F.array_join(F.slice(parts, 1, 2), "."))).otherwise(F.coalesce(named, F.nullif(check_id, F.lit("")), F.lit("unknown")))


def clause(check_id: Column, check_type: Column) -> Column:
    """A check's id, else its type."""
    return F.coalesce(F.nullif(check_id, F.lit("")), F.nullif(check_type, F.lit("")), F.lit("unknown"))


def contract_path(contract_id: Column) -> Column:
    """Where a contract's document is."""
    return F.concat(F.lit("contracts/"), F.coalesce(contract_id, F.lit("unknown")), F.lit(".yaml"))


def violation_summary(log: DataFrame, most: int = 10) -> DataFrame:
    """One row over the log's latest runs: violations, how many of each severity, and a few ids (a sample report)."""
    last = latest_run(log)
    by = last.groupBy(F.upper(F.coalesce("severity", F.lit("UNKNOWN"))).alias("severity")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("by_severity"))
    few = last.select("violation_id").orderBy("violation_id").limit(most).agg(F.array_sort(F.collect_list("violation_id")).alias("sample_ids"))
    return by.crossJoin(F.broadcast(few))  # one row each


def rollup(results: DataFrame) -> DataFrame:
    """Counts by severity and status, with subtotals and the total (null)."""
    return results.rollup("severity", "status").agg(F.count(F.lit(1)).alias("checks"))


def issues(results: DataFrame) -> DataFrame:
    """Results that aren't PASS, the most severe first."""
    return results.filter("status <> 'PASS'").withColumn("rank", severity_rank(F.col("severity"))).orderBy("rank", "check_id")


ACTION = ("priority", "file", "field", "clause", "severity", "rationale", "consumer")


def result_actions(results: DataFrame) -> DataFrame:
    """Results that aren't PASS: FAIL and CRITICAL first (0), then FAIL (1), then the rest (2)."""
    known = {"contract_id", "message"} & {*results.columns}
    r = results.withColumns({c: F.lit(None).cast("string") for c in ("contract_id", "message") if c not in known}).filter("status <> 'PASS'")
    priority = F.when((F.col("status") == "FAIL") & (F.upper("severity") == "CRITICAL"), 0).when(F.col("status") == "FAIL", 1).otherwise(2)
    return r.select(priority.alias("priority"), contract_path(F.col("contract_id")).alias("file"), field_label(F.col("check_id"), F.col("column_name")).alias("field"), clause(F.col("check_id"), F.col("check_type")).alias("clause"), F.upper("severity").alias("severity"), F.coalesce("message", F.lit("")).alias("rationale"), F.lit(None).cast("string").alias("consumer"))


def change_actions(changes: DataFrame, failures: DataFrame | None = None, contract_id: str | None = None) -> DataFrame:
    """Contract changes: CRITICAL and HIGH 1, others 3; with the first consumer that each breaks (failures: evolve.consumer_failures)."""
    c = changes.withColumn("consumer", F.lit(None).cast("string")) if failures is None else changes.join(failures.select("table_name", "field", "change", F.col("first_subscriber").alias("consumer")), ["table_name", "field", "change"], "left")
    priority = F.when(F.col("severity").isin("CRITICAL", "HIGH"), 1).otherwise(3)
    return c.select(priority.alias("priority"), contract_path(F.lit(contract_id)).alias("file"), F.concat_ws(".", "table_name", "field").alias("field"), F.col("change").alias("clause"), "severity", F.col("change").alias("rationale"), "consumer")


def model_actions(checks: DataFrame) -> DataFrame:
    """Model checks that aren't PASS: CRITICAL and HIGH 2, others 4."""
    s = F.upper(F.coalesce("severity", F.lit("UNKNOWN")))
    return checks.filter("status <> 'PASS'").select(F.when(s.isin("CRITICAL", "HIGH"), 2).otherwise(4).alias("priority"), F.lit("reports/models.json").alias("file"), F.lit("unknown").alias("field"), F.col("check_type").alias("clause"), s.alias("severity"), F.coalesce("message", F.lit("")).alias("rationale"), F.lit(None).cast("string").alias("consumer"))


def log_actions(log: DataFrame) -> DataFrame:
    """Violations of the log's latest runs: CRITICAL 1, HIGH 3, others 4."""
    last = latest_run(log)
    s = F.upper(F.coalesce("severity", F.lit("UNKNOWN")))
    return last.select(F.when(s == "CRITICAL", 1).when(s == "HIGH", 3).otherwise(4).alias("priority"), F.lit("reports/violations").alias("file"), F.coalesce("column_name", F.lit("unknown")).alias("field"), clause(F.col("check_id"), F.col("check_type")).alias("clause"), s.alias("severity"), F.lit("logged").alias("rationale"), F.lit(None).cast("string").alias("consumer"))


def action_candidates(*sources: DataFrame) -> DataFrame:
    """All actions, one a file, field and clause: the most pressing one."""
    out = sources[0].select(*ACTION)
    for s in sources[1:]:
        out = out.unionByName(s.select(*ACTION))
    w = Window.partitionBy("file", "field", "clause").orderBy("priority", severity_rank(F.col("severity")), "rationale")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def actions(candidates: DataFrame, most: int = 3) -> DataFrame:
    """The most pressing actions (a top-k report)."""
    return candidates.orderBy("priority", severity_rank(F.col("severity")), "file", "field", "clause").limit(most)


def action_text() -> Column:
    """An action as a line."""
    line = F.concat(F.concat_ws(" | ", "file", "field", "clause"), F.lit(" | "), F.col("severity"), F.lit(": "), F.col("rationale"))
    return F.concat(line, F.coalesce(F.concat(F.lit(" | consumer: "), F.col("consumer")), F.lit("")))


def remediation(results: DataFrame, templates: DataFrame) -> DataFrame:
    """check_id and step of each result that isn't PASS, by the template of its check type, else of the longest prefix, else the default; templates pattern, template, with {column}, {label} (table.column) and {check_type}."""
    bad = results.filter("status <> 'PASS'").select("check_id", "check_type", "column_name")
    fit = bad.join(templates, (F.col("pattern") == F.col("check_type")) | (F.endswith("pattern", F.lit("*")) & F.startswith("check_type", F.rtrim("pattern", F.lit("*")))))
    best = fit.groupBy("check_id", "column_name", "check_type").agg(F.max_by("template", F.when(F.col("pattern") == F.col("check_type"), 1000).otherwise(F.length("pattern"))).alias("template"))
    step = F.col("template")
    for mark, value in (("{column}", F.col("column_name")), ("{label}", field_label(F.col("check_id"), F.col("column_name"))), ("{check_type}", F.col("check_type"))):
        step = F.replace(step, F.lit(mark), value)
    return best.select("check_id", step.alias("step"))


#: Steps by kind of check, where no file has others.
STEPS = {
    "schema_missing": "bring {label} back, or take it out of the contract on purpose", "schema_new_column": "add {label} to the contract, or stop producing it", "required": "find where {label} loses its values, and reject rows without",
    "type": "cast {label} at the producer to what the contract has, or change the contract", "enum": "bring the values of {label} into line, or allow the new ones", "drift_*": "ask whether {label} was meant to change; if so, promote the baseline", "*": "look at what produces {label}: {check_type} fails",
}


def steps(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    """(pattern, template) of a rules document (exact, prefix, default), or STEPS where it is empty."""
    rows = {**(rules.get("exact") or {}), **{f"{k}*": v for k, v in (rules.get("prefix") or {}).items()}, **({"*": rules["default"]} if rules.get("default") else {})} if rules else {}
    return spark.createDataFrame([*{**({} if rows else STEPS), **rows, **({} if "*" in rows or not rows else {"*": STEPS["*"]})}.items()], "pattern string, template string")


def runs(log: DataFrame, order: str) -> DataFrame:
    """Log rows with the run of the header before them: ``record_type`` run_header begins a run. Rows before any header have none. A contract's log is filled range by range, from the last header of the ranges before."""
    head = F.col("record_type") == "run_header"
    ranged = in_ranges(log, ["contract_id", order])
    own = Window.partitionBy("contract_id", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.withColumn("_own", F.last(F.when(head, F.col("run_id")), True).over(own))
    last = ranged.groupBy("contract_id", "_part").agg(F.max_by(F.when(head, F.col("run_id")), F.when(head, F.col(order))).alias("_last"))  # a row a range and contract
    earlier = last.withColumn("_before", F.last("_last", True).over(Window.partitionBy("contract_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("contract_id").alias("_contract"), F.col("_part").alias("_range"), "_before")
    out = filled.join(earlier, F.col("contract_id").eqNullSafe(F.col("_contract")) & (F.col("_part") == F.col("_range")))
    return out.withColumn("run", F.coalesce("_own", "_before")).filter("record_type <> 'run_header'").select(*log.columns, "run")


def latest_run(log: DataFrame) -> DataFrame:
    """Per contract the rows of the run with the largest time, then id."""
    last = log.groupBy("contract_id").agg(F.max(F.struct("run_timestamp", "run_id")).alias("m"))
    last = last.select("contract_id", F.col("m.run_id").alias("run_id"), F.col("m.run_timestamp").alias("run_timestamp"))
    return log.join(F.broadcast(last), ["contract_id", "run_id", "run_timestamp"], "left_semi")  # a row a contract


def recommendations(results: DataFrame, checks: DataFrame | None = None, changes: DataFrame | None = None, violations: DataFrame | None = None, each: int = 3, warned: int = 2) -> DataFrame:
    """(place, line): a few CRITICAL and a few HIGH failures, how many more fail, a few warnings and how many more, then model checks, breaking changes and logged violations; or that all is well (a top-k report).

    violations: as violation_summary has them.
    """
    w = Window.partitionBy("group").orderBy("check_id")
    group = F.when((F.col("status") == "FAIL") & (F.col("severity") == "CRITICAL"), 0).when((F.col("status") == "FAIL") & (F.col("severity") == "HIGH"), 1).when(F.col("status") == "WARN", 3)
    ranked = results.withColumn("group", group).filter("group is not null").withColumn("n", F.row_number().over(w))
    shown = F.when(F.col("group") == 3, warned).otherwise(each)
    head = ranked.filter(F.col("n") <= shown).select((F.col("group") * 100 + F.col("n")).cast("int").alias("place"), F.concat(F.element_at(F.array(F.lit("CRITICAL: mend "), F.lit("HIGH: mend "), F.lit(""), F.lit("WARN: look at ")), F.col("group") + 1), F.col("check_id")).alias("line"))
    few = lambda g: F.least(F.lit(each), F.count_if((F.col("status") == "FAIL") & (F.col("severity") == g)))
    rest = results.agg((F.count_if(F.col("status") == "FAIL") - few("CRITICAL") - few("HIGH")).alias("fails"), (F.count_if(F.col("status") == "WARN") - warned).alias("warns"))
    more = lambda place, n, text: F.when(F.col(n) > 0, F.struct(F.lit(place).alias("place"), F.concat(F.col(n).cast("string"), F.lit(text)).alias("line")))
    parts = [head, rest.select(F.explode(F.array_compact(F.array(more(200, "fails", " more checks fail"), more(390, "warns", " more checks warn")))).alias("m")).select("m.*")]
    for place, df, n, text in ((400, checks, F.count_if(F.col("status") == "FAIL") if checks is not None else None, " model checks fail"), (500, changes, F.count_if("breaking") if changes is not None else None, " breaking changes: plan the migration before they are deployed"), (600, violations, F.coalesce(F.max("violations"), F.lit(0)) if violations is not None else None, " violations are logged: tell their owners")):
        if df is not None:
            parts.append(df.agg(n.alias("n")).filter("n > 0").select(F.lit(place).alias("place"), F.concat(F.col("n").cast("string"), F.lit(text)).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    some = out.agg(F.count(F.lit(1)).alias("c")).filter("c = 0").select(F.lit(0).alias("place"), F.lit("all is well: refresh the baselines when the data are meant to change").alias("line"))
    return out.unionByName(some)


def manifest(sources: dict[str, object], violations: DataFrame | None = None) -> dict:
    """What a report was made from: the paths of its parts, and the latest run of its log."""
    head = violations.agg(F.max(F.struct("run_timestamp", "run_id")).alias("m")).first()["m"] if violations is not None else None
    return {**sources, "violation_log_run_id": head["run_id"] if head else None, "violation_log_run_timestamp": head["run_timestamp"] if head else None}


def document(results: DataFrame, at: str, version: str = "2.0", checks: DataFrame | None = None, changes: DataFrame | None = None, failures: DataFrame | None = None, log: DataFrame | None = None, penalty: float = 20, sources: dict[str, object] | None = None) -> dict:
    """A report as a document; 1.0 has scores, sums and recommendations, 2.0 also how the score came about, the issues, changes, violations in depth and the actions to take first."""
    by_contract = results if "contract_id" in results.columns else results.withColumn("contract_id", F.lit(None).cast("string"))
    h = health(results, penalty, checks, changes).first().asDict()
    summary = validation_summary(by_contract).first().asDict()
    evolution = evolution_verdict(changes).first().asDict() if changes is not None else {"breaking_changes": 0, "compatible_changes": 0, "verdict": "unknown"}
    logged = violation_summary(log) if log is not None else None
    found = logged.first().asDict() if logged is not None else {"violations": 0, "by_severity": {}, "sample_ids": []}
    models = _models(checks)
    out = {
        "timestamp": at, "report_format_version": version, "data_health_score": h["score"], "verdict": h["verdict"],
        "health_score_explanation": f"{summary['total_checks']} checks ({summary['pass_rate_pct']}% pass), {models['total_checks']} model checks, versions {evolution['verdict']}, {found['violations']} logged violations",
        "validation": summary, "ai_checks": models, "schema_evolution": evolution, "violations": {"total_count": found["violations"], "sample_ids": found["sample_ids"]},
        "recommendations": [r["line"] for r in recommendations(results, checks, changes, logged).orderBy("place").collect()],
    }
    if version == "1.0":
        return out
    candidates = action_candidates(*[s for s in (result_actions(results), change_actions(changes, failures) if changes is not None else None, model_actions(checks) if checks is not None else None, log_actions(log) if log is not None else None) if s is not None])
    top = actions(candidates).withColumn("text", action_text()).collect()
    return out | {
        "generation_evidence": sources or {}, "health_score_breakdown": {"checks_passed": h["passed"], "total_checks": h["total"], "base_score": h["pass_rate"], "critical_violations": h["criticals"], "critical_penalty": penalty * h["criticals"]},
        "issues": [r.asDict() for r in issues(results).collect()], "schema_changes": [r.asDict() for r in changes.orderBy("table_name", "field", "change").collect()] if changes is not None else [],
        "violations": out["violations"] | {"by_severity": found["by_severity"]}, "violation_deep_dive": [r.asDict() for r in latest_run(log).orderBy("violation_id").limit(5).collect()] if log is not None else [],
        "prioritized_actions": [r.asDict() for r in top], "recommendations": [r["text"] for r in top] or out["recommendations"],
    }


def _models(checks: DataFrame | None) -> dict:
    from ledgerline.operators import ai

    return ai.summary(checks).first().asDict() if checks is not None else {"total_checks": 0, "passed": 0, "warned": 0, "failed": 0, "errored": 0, "check_types": [], "risk_level": "LOW"}


def listed(lines: Sequence[str], none: str) -> str:
    """Markdown points, or one that says there are none."""
    return "\n".join(f"- {x}" for x in lines or [none])


def render(report_: dict) -> str:
    """A report document as Markdown."""
    v, e, x = report_["validation"], report_["schema_evolution"], report_["violations"]
    severities = [f"{k}: {n}" for k, n in sorted((v["severity_counts"] or {}).items())]
    parts = [
        f"# Data health {report_['data_health_score']} of 100: {report_['verdict']}", report_["health_score_explanation"], "## Checks", f"{v['total_passed']} of {v['total_checks']} pass, {v['total_failed']} fail, {v['total_warned']} warn, {v['total_errored']} can't be judged.",
        listed(severities, "nothing to mend"), "## Models", f"risk {report_['ai_checks']['risk_level']}, {report_['ai_checks']['failed']} of {report_['ai_checks']['total_checks']} fail", "## Versions", f"{e['verdict']}: {e['breaking_changes']} breaking, {e['compatible_changes']} compatible",
        "## Violations", f"{x['total_count']} in the latest runs", listed(x["sample_ids"], "none"), "## What to do first", listed(report_["recommendations"], "nothing"),
    ]
    if report_.get("issues"):
        parts += ["## Issues", markdown("", report_["issues"], ["check_id", "status", "severity", "records_failing"]).split("\n\n", 1)[1]]
    return "\n\n".join(parts) + "\n"


def remediation_plan(results: DataFrame, templates: DataFrame, contract_id: str, title: str | None = None) -> dict:
    """The steps for all results that aren't PASS, as a document."""
    items = [r.asDict() for r in remediation(results, templates).join(results.select("check_id", "check_type", "status", "severity"), "check_id").orderBy("check_id").collect()]
    return {"contract_id": contract_id, "contract_title": title, "remediation_count": len(items), "items": items}


def render_plan(plan: dict) -> str:
    """Such a document as Markdown."""
    head = [f"# What to mend in {plan['contract_title'] or plan['contract_id']}", "", f"{plan['remediation_count']} steps.", ""]
    return "\n".join([*head, *(f"{i}. `{x['check_id']}` ({x['status']}, {x['severity']}): {x['step']}" for i, x in enumerate(plan["items"], 1)), *([] if plan["items"] else ["All checks pass."])]) + "\n"


def markdown(title: str, rows: Sequence[dict], columns: Sequence[str]) -> str:
    """A Markdown table under a title."""
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows)]) + "\n"
