"""A keyed table in hash buckets with versions: a batch rewrites the buckets it touches, readers follow a manifest.

    <table>/data/version=<v>/bucket=<b>/...     rows of the bucket as of version v
    <table>/manifest/version=<v>/...            (bucket, at): the version that holds each bucket, complete for every version

A version exists once its manifest is committed. Data written before a crash is not seen by readers and is overwritten by the replay; a
replay of a committed version finds its manifest and writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.session import materialize
from evidra.sources.literature import upsert_items

BUCKETS = 256


def bucket_of(key: str, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n_buckets)).cast("int")


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Committed versions, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _manifest(spark: SparkSession, table: str, version: int) -> dict[int, int]:
    """bucket -> version, as many rows as there are buckets at most."""
    rows = spark.read.schema("bucket int, at long").parquet(f"{table}/manifest/version={version}").collect()
    return {r["bucket"]: r["at"] for r in rows}


def _commit(spark: SparkSession, table: str, version: int, manifest: dict[int, int]) -> None:
    spark.createDataFrame(sorted(manifest.items()), "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/version={version}")


def _paths(table: str, manifest: dict[int, int], wanted: set[int] | None = None) -> list[str]:
    return [f"{table}/data/version={at}/bucket={b}" for b, at in sorted(manifest.items()) if wanted is None or b in wanted]


def _read(spark: SparkSession, schema, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(rows: DataFrame, table: str, version: int, key: str, n_buckets: int) -> None:
    # a bucket is one task's file; a bucket's size follows from their number
    rows.withColumn("bucket", bucket_of(key, n_buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/version={version}")


def create(rows: DataFrame, table: str, key: str = "id", n_buckets: int = BUCKETS) -> None:
    """Version 0 of a new table."""
    spark = rows.sparkSession
    if 0 in _versions(spark, table):
        return
    _write(rows, table, 0, key, n_buckets)
    held = rows.select(bucket_of(key, n_buckets).alias("bucket")).distinct().collect()
    _commit(spark, table, 0, {r["bucket"]: 0 for r in held})


def read(spark: SparkSession, table: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a committed version, the latest by default."""
    versions = _versions(spark, table)
    if not versions or (version is not None and version not in versions):
        raise FileNotFoundError(f"{table} has no version {version if version is not None else ''}")
    return _read(spark, schema, _paths(table, _manifest(spark, table, versions[-1] if version is None else version)))


def merge(incoming: DataFrame, table: str, schema, version: int, key: str = "id", n_buckets: int = BUCKETS) -> list[int]:
    """Writes ``version`` from the latest one before it and ``incoming`` (one row per key); the buckets written, none for a replay.

    ``n_buckets`` is that of ``create``. Only the touched buckets are read and written, so the bytes follow the batch.
    """
    spark = incoming.sparkSession
    versions = _versions(spark, table)
    if version in versions:
        return []
    before = [v for v in versions if v < version]
    if not before:
        raise FileNotFoundError(f"{table} has no version before {version}")
    manifest = _manifest(spark, table, before[-1])
    staged = materialize(incoming)
    touched = {r["bucket"] for r in staged.select(bucket_of(key, n_buckets).alias("bucket")).distinct().collect()}  # n_buckets rows at most
    if touched:
        old = _read(spark, schema, _paths(table, manifest, touched))
        _write(upsert_items(old, staged, key).drop("sync_state"), table, version, key, n_buckets)
    _commit(spark, table, version, manifest | dict.fromkeys(touched, version))
    return sorted(touched)
