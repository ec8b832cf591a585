"""Ranks, running minima and exact percentiles inside large groups.

A window over a whole group would run in one task. Values are reduced to distinct values with
counts, spread over order-preserving blocks, ordered inside their block only, and carried
across blocks by the (at most ``BLOCKS`` per group) block totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.session import materialize

BLOCKS = 1024
BORDERS = 255
STEP = 16


def with_blocks(df: DataFrame, by: list[str], value: str, scale: Column | None = None) -> DataFrame:
    """Adds ``_block``; ``scale`` maps a value to [0, 1], by default linear between the group's
    extremes."""
    if scale is not None:
        return df.withColumn("_block", F.floor(scale * (BLOCKS - 1)).cast("int"))
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    share = F.when(width > 0, (F.col(value) - F.col("_lo")) / width).otherwise(F.lit(0.0))
    joined = df.join(ends, by) if by else df.join(F.broadcast(ends))
    return joined.withColumn("_block", F.floor(share * (BLOCKS - 1)).cast("int")).drop("_lo", "_hi")


def with_even_blocks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``_block`` with about equally many rows each, whatever the spread of the values. Approximate
    percentiles serve as borders only; they are staged, as every use has to see the same ones."""
    shares = [(i + 1) / (BORDERS + 1) for i in range(BORDERS)]
    found = df.groupBy(*by).agg(F.percentile_approx(value, F.lit(shares), F.lit(10 * BORDERS)).alias("_borders"))
    borders = materialize(found.withColumn("_steps", F.filter("_borders", lambda b, i: i % STEP == STEP - 1)))
    joined = df.join(borders, by) if by else df.join(F.broadcast(borders))  # one row
    # borders ascend: every sixteenth of them first, then the sixteen in question
    below = lambda of: F.size(F.filter(of, lambda b: b < F.col(value)))
    step = joined.withColumn("_step", STEP * below(F.col("_steps")))
    return step.withColumn("_block", F.col("_step") + below(F.slice("_borders", F.col("_step") + 1, STEP))).drop("_borders", "_steps", "_step")


def cumulative_count(blocked: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: rows of the group at or below the value (``_n`` counts each value)."""
    sums = blocked.groupBy(*by, "_block").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_in", F.sum("_n").over(inside)).join(offsets, by + ["_block"])
        .withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")
    )


def running_min_from_right(blocked: DataFrame, by: list[str], value: str, measure: str, out: str) -> DataFrame:
    """Adds ``out``: least ``measure`` among rows of the group at or above the value."""
    mins = blocked.groupBy(*by, "_block").agg(F.min(measure).alias("_bm"))
    after = Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = mins.withColumn("_after", F.min("_bm").over(after)).drop("_bm")
    inside = Window.partitionBy(*by, "_block").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_in", F.min(measure).over(inside)).join(carried, by + ["_block"])
        .withColumn(out, F.least("_in", "_after")).drop("_in", "_after")
    )


def exact_percentiles(samples: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Per group and quantile: nearest rank (element ceil(n q)) and linear interpolation."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("_n"))
    ranked = cumulative_count(with_even_blocks(counts, by, "v"), by, "v", "hi").withColumn("lo", F.col("hi") - F.col("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("total")).withColumn("q", F.explode(F.lit([float(q) for q in quantiles])))
    wanted = totals.select(
        *by, "q", "total",
        F.greatest(F.ceil(F.col("total") * F.col("q")) - 1, F.lit(0)).alias("near"),
        F.floor((F.col("total") - 1) * F.col("q")).alias("below"),
    )
    at = lambda i: F.max(F.when((F.col("lo") <= i) & (i < F.col("hi")), F.col("v")))
    above = F.least(F.col("below") + 1, F.col("total") - 1)
    joined = ranked.join(F.broadcast(wanted) if not by else wanted, by or None)
    picked = joined.groupBy(*by, "q").agg(
        at(F.col("near")).alias("nearest"), at(F.col("below")).alias("_a"), at(above).alias("_b"),
        F.first("total").alias("n"), F.first("below").alias("_k"),
    )
    fraction = (F.col("n") - 1) * F.col("q") - F.col("_k")
    return picked.select(*by, "q", "n", "nearest", (F.col("_a") + (F.col("_b") - F.col("_a")) * fraction).alias("linear"))
