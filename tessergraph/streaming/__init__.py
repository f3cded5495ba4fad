"""Beyond the batch operators: change histories as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_counts(changes: DataFrame, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Changes of each file in windows of their date, late ones up to the watermark: start, path, changes, committers.

    `changes` is a stream of (path, committer, date); write it in append mode.
    """
    counted = changes.withWatermark("date", late).groupBy(F.window("date", window).alias("w"), "path").agg(F.count("*").alias("changes"), F.approx_count_distinct("committer").alias("committers"))
    return counted.select(F.col("w.start").alias("start"), "path", "changes", "committers")
