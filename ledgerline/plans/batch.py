"""Several validations in one session."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import SparkSession

log = logging.getLogger("ledgerline.batch")


@dataclass(frozen=True)
class Job:
    """A name and what to run; it returns an exit code."""

    name: str
    run: Callable[[SparkSession], int]


@dataclass(frozen=True)
class Outcome:
    """How a job ended: its exit code, or an error; ``skipped`` where an earlier one stopped the batch."""

    name: str
    code: int | None
    seconds: float
    error: str = ""
    skipped: bool = False


def run_batch(spark: SparkSession, jobs: list[Job], workers: int = 4, fail_fast: bool = False) -> list[Outcome]:
    """Run jobs at once, each in a scheduler pool of its own; with ``fail_fast`` the first that doesn't end with 0 keeps the rest from starting."""
    stop: list[str] = []

    def one(job: Job) -> Outcome:
        if stop:
            return Outcome(job.name, None, 0.0, skipped=True)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", job.name)
        spark.sparkContext.setJobDescription(job.name)
        began = time.monotonic()
        try:
            out = Outcome(job.name, job.run(spark), time.monotonic() - began)
        except Exception as e:  # a job's failure is its outcome
            out = Outcome(job.name, 2, time.monotonic() - began, f"{type(e).__name__}: {e}")
        if fail_fast and out.code:
            stop.append(job.name)
        log.info("%s ended with %s in %.1f s", out.name, out.code, out.seconds)
        return out

    with ThreadPoolExecutor(max(1, min(workers, len(jobs) or 1))) as pool:
        futures = [pool.submit(one, j) for j in jobs]
        wait(futures, return_when=FIRST_EXCEPTION)
        return [f.result() for f in futures]


def jobs_of(entries: list[dict], run: Callable[[SparkSession, dict], int]) -> list[Job]:
    """Jobs of a manifest's entries (readers.manifest), named by their contracts."""
    return [Job(e["contract"], lambda spark, e=e: run(spark, e)) for e in entries]


def document(outcomes: list[Outcome]) -> dict:
    """A batch as a document: its summary and how each job ended."""
    return summary(outcomes) | {"results": [{"name": o.name, "exit_code": o.code, "elapsed_s": round(o.seconds, 3), "error": o.error, "skipped": o.skipped} for o in outcomes]}


def summary(outcomes: list[Outcome]) -> dict:
    """Counts and times of a batch."""
    ran = [o for o in outcomes if not o.skipped]
    return {"jobs": len(outcomes), "passed": sum(o.code == 0 for o in ran), "failed": sum(o.code not in (0, None) for o in ran), "skipped": len(outcomes) - len(ran), "seconds": round(sum(o.seconds for o in ran), 3)}
