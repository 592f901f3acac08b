"""Checks of what models read and write, as one run: drift of texts, inputs against a schema, outputs' violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import textchecks as T
from ledgerline.plans.contract import Config
from ledgerline.sources import files, sinks

ROW = "check_type string, status string, severity string, records bigint, measure double, message string"


def embedding_drift(texts: DataFrame, column: str, baseline: str, config: Config = Config()) -> DataFrame:
    """One row: how far the texts' mean bag of words is from the stored one. The first run passes; every run stores its own as the next baseline."""
    spark = texts.sparkSession
    texts = texts.filter(F.col(column).isNotNull() & (F.trim(F.col(column)) != ""))
    n = texts.count()
    if not n:
        return spark.createDataFrame([("embedding_drift", "ERROR", "HIGH", 0, None, "no text to compare")], ROW)
    now = T.bag(texts, column)
    if not files.exists(spark, baseline):
        sinks.replace(now, baseline)
        return spark.createDataFrame([("embedding_drift", "PASS", "HIGH", n, 0.0, "first run: the baseline is made")], ROW)
    distance = T.cosine_distance(spark.read.parquet(baseline), now).first()["distance"]
    sinks.replace(now, baseline)
    status = "FAIL" if distance >= config.embedding_fail else "WARN" if distance >= config.embedding_warn else "PASS"
    return spark.createDataFrame([("embedding_drift", status, "HIGH", n, float(distance), f"distance {distance:.4f}")], ROW)


def prompt_inputs(records: DataFrame, record: str, required: Mapping[str, str], config: Config = Config()) -> DataFrame:
    """One row: how many inputs don't fit their schema."""
    got = T.prompt_schema(records, record, required, config)
    return got.select(F.lit("prompt_input_schema").alias("check_type"), "status", F.lit("HIGH").alias("severity"), "records", F.col("rate").alias("measure"), F.concat(F.col("violations").cast("string"), F.lit(" of "), F.col("records").cast("string"), F.lit(" records don't fit")).alias("message"))


def output_violations(answers: DataFrame, record: str, order: Sequence[str], config: Config = Config()) -> DataFrame:
    """One row: the rate of answers (variants) with a violation, and its trend."""
    got = T.violation_trend(answers.select(*order, (F.size(T.verdict_faults(F.col(record))) > 0).alias("bad")), "bad", order, config)
    return got.select(F.lit("llm_output_violation_rate").alias("check_type"), "status", F.lit("HIGH").alias("severity"), "records", F.col("rate").alias("measure"), F.concat(F.col("violations").cast("string"), F.lit(" of "), F.col("records").cast("string"), F.lit(" answers, "), F.col("trend")).alias("message"))


@dataclass(frozen=True)
class Inputs:
    """What a run looks at: texts of facts, input records and their schema, answers and their order, and where the baseline is."""

    facts: DataFrame
    text: str
    records: DataFrame
    record: str
    required: Mapping[str, str]
    answers: DataFrame
    answer: str
    order: Sequence[str]
    baseline: str


def run_all(inputs: Inputs, config: Config = Config()) -> DataFrame:
    """A row a check."""
    return embedding_drift(inputs.facts, inputs.text, inputs.baseline, config).unionByName(prompt_inputs(inputs.records, inputs.record, inputs.required, config)).unionByName(output_violations(inputs.answers, inputs.answer, inputs.order, config))


def summary(checks: DataFrame) -> DataFrame:
    """One row: how many checks there are of each status, and the risk: HIGH if any fails, MEDIUM if any warns, else LOW."""
    n = lambda s: F.count_if(F.col("status") == s)
    got = checks.agg(F.count(F.lit(1)).alias("total_checks"), n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"), n("ERROR").alias("errored"), F.array_sort(F.collect_set("check_type")).alias("check_types"))
    return got.withColumn("risk_level", F.when(F.col("failed") > 0, "HIGH").when(F.col("warned") > 0, "MEDIUM").otherwise("LOW"))


def document(checks: DataFrame, at: str) -> dict:
    """A run as a document."""
    return {"timestamp": at, "checks": [r.asDict() for r in checks.collect()], "summary": summary(checks).first().asDict()}


def exit_code(document_: dict) -> int:
    """1 where a check failed."""
    return int(document_["summary"]["failed"] > 0)


def empty(spark: SparkSession) -> DataFrame:
    """No checks."""
    return spark.createDataFrame([], ROW)
