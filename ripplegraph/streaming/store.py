"""Parquet folders per micro-batch for streaming sinks.

A micro-batch writes ``version=<batch id + 1>``; a folder counts once Spark's commit marker is in
it, so a replayed batch overwrites its own unfinished version and a finished one is skipped.

State is dealt to buckets by a hash of its key.  A batch rewrites the buckets that its keys fall in
and no other; a reader takes each bucket from the newest version that has it.  Append sinks
(``read_all``) hold every version's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, ascending."""
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


BUCKET = "bucket"


def _buckets(spark: SparkSession, root: str, version: int) -> list[int]:
    fs, p, _ = _fs(spark, f"{root}/version={version}")
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return [int(n.split("=", 1)[1]) for n in names if n.startswith(f"{BUCKET}=")]


def _newest(spark: SparkSession, root: str, below: int) -> dict[int, int]:
    """bucket -> newest committed version below ``below`` that holds it."""
    out: dict[int, int] = {}
    for v in versions(spark, root):
        if v < below:
            out |= dict.fromkeys(_buckets(spark, root, v), v)
    return out


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_before(spark: SparkSession, root: str, version: int, schema: str, only: list[int] | None = None) -> DataFrame:
    """State before ``version``: every bucket (or those of ``only``) in its newest committed form."""
    paths = [f"{root}/version={v}/{BUCKET}={b}" for b, v in sorted(_newest(spark, root, version).items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_latest(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return read_before(spark, root, 1 << 62, schema)


def read_all(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of every committed batch of an append sink."""
    paths = [f"{root}/version={v}" for v in versions(spark, root)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_until(spark: SparkSession, root: str, version: int, schema: str) -> DataFrame:
    """Rows of the committed batches before ``version`` of an append sink."""
    paths = [f"{root}/version={v}" for v in versions(spark, root) if v < version]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_newest(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of the newest committed batch of a sink whose batches replace each other."""
    last = versions(spark, root)[-1:]
    return spark.read.schema(schema).parquet(f"{root}/version={last[0]}") if last else spark.createDataFrame([], schema)


def write_version(df: DataFrame, root: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/version={version}")


def write_state(df: DataFrame, root: str, version: int, keys: list[str], buckets: int) -> None:
    """Write touched buckets as a version and remove bucket folders that two newer versions have replaced."""
    spark = df.sparkSession
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/version={version}")
    seen: dict[int, int] = {}
    for v in reversed(versions(spark, root)):
        for b in _buckets(spark, root, v):
            seen[b] = seen.get(b, 0) + 1
            if seen[b] > 2:
                fs, p, _ = _fs(spark, f"{root}/version={v}/{BUCKET}={b}")
                fs.delete(p, True)


def done(spark: SparkSession, root: str, version: int) -> bool:
    return version in versions(spark, root)
