"""Writers: logs that grow, tables that are replaced whole, small documents."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources import files


def append_log(results: DataFrame, path: str, contract_id: str, run_id: str, run_timestamp: str) -> None:
    """Add a run's failing rows to a log; the run is in columns, not in header rows."""
    rows = results.filter("status <> 'PASS'").withColumns({"contract_id": F.lit(contract_id), "run_id": F.lit(run_id), "run_timestamp": F.lit(run_timestamp)})
    rows.write.mode("append").partitionBy("contract_id").parquet(path)


def quarantine(rows: DataFrame, path: str, at: str) -> None:
    """Add rows with their errors to the quarantine."""
    rows.withColumn("quarantined_at", F.lit(at)).write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    """Replace a table that may be read by what is written: a new version, then a swap of names, on any file system."""
    spark = df.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(fresh)
    there = files.exists(spark, path)
    if there:
        files.move(spark, path, old)
    files.move(spark, fresh, path)
    if there:
        files.delete(spark, old)


def upsert(path: str, fresh: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> None:
    """Merge rows into a table by key."""
    replace(merge(stored(fresh, path), fresh, keys), path)


def stored(fresh: DataFrame, path: str) -> DataFrame:
    """The table at a path; one without rows, and the columns of ``fresh``, where there is none yet."""
    return fresh.sparkSession.read.parquet(path) if files.exists(fresh.sparkSession, path) else fresh.limit(0)


def baselines(fresh: DataFrame, path: str, promote: bool) -> bool:
    """Keep statistics as the baseline: always where there is none yet, later only if promoted. Says whether they were written."""
    if files.exists(fresh.sparkSession, path) and not promote:
        return False
    upsert(path, fresh, ["key", "column_name"], lambda old, new, keys: old.join(new.select("key").distinct(), "key", "left_anti").unionByName(new))
    return True


def jsonl(df: DataFrame, path: str) -> None:
    """Records as JSON lines."""
    df.write.mode("overwrite").json(path)


def document(content: dict, path: str) -> None:
    """A small document as YAML or JSON, by the path's ending."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        if path.endswith((".yml", ".yaml")):
            import yaml

            yaml.safe_dump(content, f, sort_keys=False, allow_unicode=True)
        else:
            json.dump(content, f, indent=1, ensure_ascii=False)


def text(content: str, path: str) -> None:
    """A Markdown or text report."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


def archive(spark: SparkSession, path: str) -> str | None:
    """Move a quarantine away, under a new name."""
    if not files.exists(spark, path):
        return None
    to = f"{path}.archived-{uuid.uuid4().hex[:8]}"
    files.move(spark, path, to)
    return to


def rewrite(df: DataFrame, path: str) -> None:
    """Replace a quarantine of JSON lines by those of its rows that stay."""
    spark = df.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}.old"
    df.write.json(fresh)
    files.move(spark, path, old)
    files.move(spark, fresh, path)
    files.delete(spark, old)
