"""Readers: JSON lines, settings, snapshots, registries, lineage, logs, git."""

from __future__ import annotations

import glob
import hashlib
import os
import re
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import flatten
from ledgerline.plans.contract import Registry
from ledgerline.sources import files

MODES = ("AUDIT", "WARN", "ENFORCE")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records of a JSON-lines file. Strict: a bad line is an error. Lenient: bad lines are left out, and no file is no rows."""
    if not strict and not any(c in path for c in "*?[{") and not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def variants(spark: SparkSession, path: str) -> DataFrame:
    """Each line as a variant ``v``, for checks that need the types as written."""
    return spark.read.option("singleVariantColumn", "v").json(path)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, ord): non-blank lines with an order that follows files and lines."""
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).filter(F.trim("value") != "").withColumnRenamed("value", "line")


SEED = "stream_id string, event_type string, event_version string, payload string, recorded_at string"


def seed_events(spark: SparkSession, path: str, schema: str = SEED) -> DataFrame:
    """Seed events of JSON lines, with ``ord``, their place in the file. A field that is an object in the file is its JSON text."""
    return ordered_lines(spark, path).select("ord", F.from_json("line", schema).alias("e")).select("ord", "e.*")


def documents_in(spark: SparkSession, pattern: str, schema: str, skip: str = r"\.routing\.json$") -> DataFrame:
    """One record a JSON file, with its ``file``; files whose name matches ``skip`` left out."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.input_file_name()).filter(~F.col("file").rlike(skip))


def texts_in(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, text) of whole text files."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def reports_in(spark: SparkSession, path: str | None, folders: Sequence[str] = (), alias: tuple[str, str] = ("", "")) -> list[str]:
    """Markdown reports: a file, those of a folder, or, where the path has another spelling (``alias``), of that one; without a path those of the first of ``folders`` that has any. A path that is nowhere is an error."""
    of = lambda p: [p] if p.endswith(".md") else [f for f in files.names(spark, p) if f.endswith(".md")]
    if path is None:
        return next((found for f in folders if (found := of(f))), [])
    for p in dict.fromkeys((path, path.replace(*alias) if alias[0] else path)):
        if files.exists(spark, p):
            return of(p)
    raise FileNotFoundError(path)


def digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, sha256) of files; files over 2 GB need file_digest."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def file_digest(path: str) -> str:
    """The SHA-256 of a file of any size."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def settings(path: str) -> dict:
    """A YAML or JSON file; a missing or empty one is {}."""
    import yaml

    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def parsed(text: str) -> dict:
    """A YAML or JSON text; an empty one is {}."""
    import yaml

    return yaml.safe_load(text) or {}


def snapshot_time(path: str) -> str:
    """The time in a snapshot's name, YYYYMMDD_HHMMSS or with a T, else the file's own time, as YYYYMMDDHHMMSS."""
    m = re.search(r"(\d{8})[T_-]?(\d{6})", os.path.basename(path))
    if m:
        return m[1] + m[2]
    import datetime

    return datetime.datetime.fromtimestamp(os.path.getmtime(path), datetime.UTC).strftime("%Y%m%d%H%M%S")


def previous_snapshot(folder: str) -> dict | None:
    """The snapshot before the last one, by name; None where there are fewer than two."""
    files_ = sorted(glob.glob(os.path.join(folder, "*.y*ml")))
    return settings(files_[-2]) if len(files_) > 1 else None


def lineage_sample(spark: SparkSession, path: str, most: int = 5) -> list[dict]:
    """The first few records of a lineage file, for a contract's ports; none where there is no file."""
    return [r.asDict(True) for r in jsonl(spark, path, flatten.LINEAGE, strict=False).limit(most).collect()]


def manifest(path: str) -> tuple[list[dict], int]:
    """(jobs, workers) of a batch file: ``jobs``, each with contract, data and output of its own or from ``defaults``, and a mode; ``max_workers``, else one a job, eight at most."""
    doc = settings(path)
    jobs, defaults = doc.get("jobs") if isinstance(doc, dict) else None, (doc.get("defaults") or {}) if isinstance(doc, dict) else {}
    if not isinstance(jobs, list) or not jobs:
        raise ValueError(f"{path} needs a list of jobs")
    out = []
    for i, job in enumerate(jobs, 1):
        if not isinstance(job, dict):
            raise ValueError(f"job {i} isn't a mapping")
        one = {"mode": "AUDIT", "promote_baselines": False} | defaults | job
        lost = [k for k in ("contract", "data", "output") if not one.get(k)]
        if lost:
            raise ValueError(f"job {i} has no {lost[0]}")
        one["mode"] = str(one["mode"]).upper()
        if one["mode"] not in MODES:
            raise ValueError(f"job {i} has the mode {one['mode']}; there are {', '.join(MODES)}")
        out.append({k: one[k] for k in ("contract", "data", "output", "mode", "promote_baselines")})
    return out, int(doc.get("max_workers") or min(len(out), 8))


def optional_json(path: str | None) -> dict | None:
    """A JSON document that may be missing."""
    return settings(path) or None if path else None


def two_snapshots(folder: str, since: str | None = None) -> tuple[dict, dict] | None:
    """The last but one and the last snapshot, or the first since a time and the last; None where there aren't two."""
    files = sorted(glob.glob(os.path.join(folder, "*.y*ml")), key=lambda p: (snapshot_time(p), p))
    if since is not None:
        files = [p for p in files if snapshot_time(p) >= since]
    if len(files) < 2:
        return None
    return settings(files[0] if since is not None else files[-2]), settings(files[-1])


def registry(path: str) -> Registry:
    """Subscriptions of a registry file; breaking fields may be names or have reasons."""
    subs = settings(path).get("subscriptions") or []
    for s in subs:
        s["breaking_fields"] = [b if isinstance(b, dict) else {"field": b, "reason": ""} for b in s.get("breaking_fields") or []]
    return Registry(subs).normalised()


def subscriptions(spark: SparkSession, reg: Registry) -> DataFrame:
    """A registry as rows."""
    rows = [(s.get("contract_id"), s.get("subscriber_id"), s.get("source"), s.get("source_contract"), s.get("target"), [{"field": b.get("field"), "reason": b.get("reason")} for b in s["breaking_fields"]]) for s in reg.subscriptions]
    return spark.createDataFrame(rows, "contract_id string, subscriber_id string, source string, source_contract string, target string, breaking_fields array<struct<field:string,reason:string>>")


def lineage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all snapshots of a lineage file, leniently."""
    df = jsonl(spark, path, flatten.LINEAGE, strict=False)
    return flatten.lineage_nodes(df), flatten.lineage_edges(df)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that isn't done, by any of the keys (a path or a name)."""
    out = work
    for k in keys:
        out = out.join(done.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return out


def git_log(spark: SparkSession, repository: str, path: str, most: int = 20) -> DataFrame:
    """(hash, author, ts, message) of a file's last commits; none where git or the file isn't there."""
    run = subprocess.run(["git", "-C", repository, "log", f"-n{int(most)}", "--format=%H%x1f%an%x1f%cI%x1f%s", "--", path], capture_output=True, text=True, timeout=60)
    rows = [tuple(line.split("\x1f")) for line in run.stdout.splitlines() if line.count("\x1f") == 3]
    return spark.createDataFrame([(h, re.sub(r"[^\w .@-]", "", a), t, m) for h, a, t, m in rows], "hash string, author string, ts string, message string")


def git_show(repository: str, ref: str, path: str) -> str | None:
    """A file as it was at a revision; None where it wasn't."""
    run = subprocess.run(["git", "-C", repository, "show", f"{ref}:{path}"], capture_output=True, text=True, timeout=60)
    return run.stdout if run.returncode == 0 else None


def within(path: str, root: str) -> str:
    """The path, if it lies under the root."""
    full = os.path.realpath(path)
    if os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"{path} lies outside {root}")
    return full


def language_of(path: Column) -> Column:
    """A file's language by its ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = {"py": "python", "sql": "sql", "yml": "yaml", "yaml": "yaml", "md": "markdown", "js": "javascript", "ts": "typescript", "sh": "shell", "json": "json"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[ending], F.lit("unknown"))
