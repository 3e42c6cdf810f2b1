"""Structured Streaming over the decision log and over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.graph import component_mismatches, match_components


def read_decisions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Decisions as Parquet files appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def decision_rates(decisions: DataFrame, window: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Decisions and matches a window; rows later than `late` no longer count."""
    w = F.window(ts, window)
    return decisions.withWatermark(ts, late).groupBy(w).agg(F.count("*").alias("decisions"), F.count_if("is_match").alias("matches")).select(F.col("window.start").alias("start"), "decisions", "matches")


def first_decisions(decisions: DataFrame, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Each pair's repeated decision once, within the watermark."""
    pair = decisions.withColumns({"a": F.least("left", "right"), "b": F.greatest("left", "right")})
    return pair.withWatermark(ts, late).dropDuplicatesWithinWatermark(["a", "b", "is_match"]).drop("a", "b")


def keep_views(spark: SparkSession, log: str, out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append the batch to the log, then write the views it implies to a folder of the batch's own.

    A batch that is run again writes the same folders, so a restart neither loses nor doubles a decision.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        decisions = spark.read.parquet(log)
        components = match_components(decisions)
        components.write.mode("overwrite").parquet(f"{out}/components/{number}")
        component_mismatches(decisions, components).write.mode("overwrite").parquet(f"{out}/mismatches/{number}")

    return run
