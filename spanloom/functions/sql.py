"""Spans for SQL users, planned with their queries and run in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanloom.plans.pipeline import Config, detect, exploded


def create_span_view(spark: SparkSession, source: str, key: str, name: str, text: str = "text", config: Config = Config()) -> None:
    """A temporary view of one row for each resolved span of a table or view: key, type, value, start, end, source, confidence, confirmed, seq."""
    exploded(detect(spark.table(source), config, text), [key]).createOrReplaceTempView(name)
