"""Extension: contracts on streams. Each micro-batch is split to good and quarantined rows; windows count violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.checks import _failing
from ledgerline.plans.contract import Table


def faults(df: DataFrame, table: Table) -> Column:
    """array<string> of the checks that a row fails."""
    kinds = dict(df.dtypes)
    found = [F.when(bad, F.lit(f"{f.name}.{check}")) for f in table.fields if f.name in kinds for check, bad, _ in _failing(f, kinds[f.name])]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def enforce(stream: DataFrame, table: Table, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Write good rows to one folder and the others, with their faults, to another; restarts repeat no batch twice in the folders' batch column."""

    def write(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("schema_errors", faults(batch, table)).withColumn("batch", F.lit(number))
        judged.filter(F.size("schema_errors") == 0).drop("schema_errors").write.mode("overwrite").parquet(f"{good}/batch={number}")
        judged.filter(F.size("schema_errors") > 0).write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def violation_windows(stream: DataFrame, table: Table, time: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, rows, violations) per window of event time, for a stream with late rows or a table."""
    own = stream.withColumn("_at", F.col(time).cast("timestamp")).withColumn("_bad", (F.size(faults(stream, table)) > 0).cast("int"))
    if own.isStreaming:
        own = own.withWatermark("_at", late)
    return own.groupBy(F.window("_at", width).alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_bad").alias("violations")).select(F.col("w.start").alias("start"), "rows", "violations")
