"""Endpoint latency statistics over all samples, with percentiles of the newest N."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 1000


def latency_stats(samples: DataFrame, order: list[str], window: int = WINDOW) -> DataFrame:
    """samples: endpoint, elapsed_ms. Percentiles take element floor(n q) of the sorted newest
    samples; every task keeps at most ``window`` rows per endpoint before the shuffle."""
    totals = samples.groupBy("endpoint").agg(
        F.count("*").alias("count"), F.avg("elapsed_ms").alias("avg_ms"), F.min("elapsed_ms").alias("min_ms"), F.max("elapsed_ms").alias("max_ms"))
    w = Window.partitionBy("endpoint").orderBy(*[F.desc(c) for c in order])
    recent = samples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= window)
    ordered = recent.groupBy("endpoint").agg(F.sort_array(F.collect_list("elapsed_ms")).alias("s"))  # at most ``window`` values
    n = F.size("s")
    at = lambda q: F.element_at("s", F.least(F.floor(n * F.lit(q)), n - 1).cast("int") + 1)
    return totals.join(
        ordered.select("endpoint", F.element_at("s", (F.floor(n / 2) + 1).cast("int")).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms")),
        "endpoint")
