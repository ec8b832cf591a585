"""Input order that does not depend on how Spark cuts and packs files: (file, place in the file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.session import broadcast_if_small, materialize


def positioned(scan: DataFrame, name: str, within_file: bool = False, file: str | None = None) -> DataFrame:
    """The rows of a file scan with their number from 0: over all files in path order, or within each file. ``file`` keeps the path.

    Each split of a file is read in order by one task, so a row's place in its split is known there; the splits' row counts
    (one row per split) give the number of rows before it.
    """
    columns = [c for c in scan.columns]
    tagged = scan.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_row"))
    splits = materialize(tagged.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")))
    order = (Window.partitionBy("_file").orderBy("_block") if within_file else Window.orderBy("_file", "_block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before")))
    placed = tagged.join(broadcast_if_small(starts), ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_row") - F.col("_first"))
    return placed.select(*([F.col("_file").alias(file)] if file else []), *columns, name)


def table_region(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """Lines after the first ``begin`` line of a dataset and before its first ``end`` line; nothing without a begin line.

    Each task sums up its lines as the smallest number of either marker, and the summaries combine by their minimum, so
    that files may be cut anywhere.
    """
    marks = lines.where(F.col("line").isin(begin, end)).groupBy("dataset").agg(
        F.min(F.when(F.col("line") == begin, F.col("line_no"))).alias("_begin"), F.min(F.when(F.col("line") == end, F.col("line_no"))).alias("_end"))
    inside = (F.col("line_no") > F.col("_begin")) & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    rows = lines.join(broadcast_if_small(materialize(marks)), "dataset").where(inside & (F.col("line") != begin) & (F.trim("line") != ""))
    return rows.drop("_begin", "_end")
