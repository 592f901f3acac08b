"""Structured logs, and spans that name what Spark is doing."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class JsonLines(logging.Formatter):
    """A line of JSON a record: time, level, logger, message, the run's id, and what ``extra`` adds."""

    KNOWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}

    def __init__(self, run_id: str | None = None):
        super().__init__()
        self.run_id = run_id

    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if self.run_id:
            out["run_id"] = self.run_id
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out | {k: v for k, v in vars(record).items() if k not in self.KNOWN}, default=str, ensure_ascii=False)


def configure(run_id: str | None = None, level: str = "INFO", as_json: bool = True) -> logging.Handler:
    """Let the library's loggers write to standard error, as JSON or plain; a second call replaces the first."""
    root = logging.getLogger("ledgerline")
    for h in [h for h in root.handlers if getattr(h, "_ledgerline", False)]:
        root.removeHandler(h)
    handler = logging.StreamHandler()
    handler._ledgerline = True
    handler.setFormatter(JsonLines(run_id) if as_json else logging.Formatter("%(levelname)s %(name)s: %(message)s"))
    root.addHandler(handler)
    root.setLevel(level)
    return handler


@contextmanager
def span(spark: SparkSession, name: str, **attributes: object) -> Iterator[dict]:
    """A named piece of work: Spark's jobs inside bear its name, and its end is logged with its seconds and attributes."""
    sc = spark.sparkContext
    before, began = sc.getLocalProperty("spark.job.description"), time.monotonic()
    sc.setJobDescription(name)
    try:
        yield attributes
    finally:
        sc.setLocalProperty("spark.job.description", before)
        logging.getLogger("ledgerline.span").info(name, extra={"seconds": round(time.monotonic() - began, 3), "attributes": attributes})
