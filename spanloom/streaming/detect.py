"""Detection on streams. It is stateless and row by row, so the batch expression serves; the audit is a streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import merge as M
from spanloom.plans.pipeline import Config, detect, retained


def masked_stream(stream: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:
    found = detect(stream, config, text).withColumn("spans", retained(F.col("spans"), config))
    return found.withColumn("masked", M.mask(F.col(text), F.col("spans"), config.referential))


def audit_stream(stream: DataFrame, config: Config = Config(), text: str = "text", time: str | None = None, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Occurrences of each type and value so far, or by window of an event time."""
    rows = stream if time is None else stream.withWatermark(time, late)
    spans = masked_stream(rows, config, text).select(*([time] if time else []), F.explode("spans").alias("s"))
    keys = [F.window(time, window).alias("window")] if time else []
    return spans.groupBy(*keys, F.col("s.type").alias("type"), F.col("s.value").alias("value")).agg(F.count("*").alias("occurrences"))
