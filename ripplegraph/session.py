"""Session construction and lineage cutting.

Iterative operators write their frontier as Parquet into the folder named by
``spark.checkpoint.dir`` and read it back, so a lost executor replays one level
and the next join sees real file sizes (which AQE uses to pick its strategy).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "ripplegraph", cpus: int | None = None, shuffle: int | None = None) -> SparkSession:
    """A session: local by default; with $RIPPLE_MASTER (or under spark-submit) master, memory and partitions come from outside."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    if os.environ.get("RIPPLE_MASTER") or "SPARK_SUBMIT_MODE" in os.environ:
        outside = SparkSession.builder.appName(app)
        return (outside.master(os.environ["RIPPLE_MASTER"]) if os.environ.get("RIPPLE_MASTER") else outside).getOrCreate()
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RIPPLE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the session's setting, else a local one in local mode only."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_ROOTS[app]


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a finished table at ``path``?"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _app_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/ripplegraph/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table of this application."""
    return f"{_app_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when no result is read any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a table that one task of a shuffle should hold.
TASK_ROWS = 1_000_000
SHUFFLES = "spark.sql.shuffle.partitions"


@contextmanager
def shuffles_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside shuffle into at least a task per ``TASK_ROWS`` of ``rows``, so a task's memory does not grow with them."""
    before = spark.conf.get(SHUFFLES)
    spark.conf.set(SHUFFLES, str(max(int(before), -(-rows // TASK_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, before)


#: What a task reads of files or shuffled data, where the caller sets nothing else; narrow rows take some 30 times this in a sort or hash table.
TASK_BYTES = 16 << 20
SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def size_tasks(spark: SparkSession, rows: int) -> None:
    """From here on the session's jobs deal a table of ``rows`` to tasks of about ``TASK_ROWS`` rows and ``TASK_BYTES``.

    More rows then make more tasks, not larger ones.  Shuffles are never made smaller, and split sizes that
    the caller has set stay.
    """
    for name in SPLITS:
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(TASK_BYTES))
    wanted = -(-rows // TASK_ROWS)
    if wanted > int(spark.conf.get(SHUFFLES)):
        spark.conf.set(SHUFFLES, str(wanted))


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Codec of intermediate tables, which are written once and lie on disk until the results are read.
CODEC = "zstd"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes made inside delete their shuffle files when they end, so that disk holds those of one write at a time.

    Without this they lie there until the driver's garbage collector finds them.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def write_scratch(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write an intermediate table; nothing but its files stays on disk."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode(mode).option("compression", CODEC).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the checkpoint folder and return a reader over the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    write_scratch(df, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``materialize`` for as long as the block runs; then the table is deleted."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    write_scratch(df, path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows from which a step is made in passes over a hash of its key, and the most passes of a step that is linear in its rows.
PASS_ROWS, PASSES = 4_000_000, 4


def passes_for(rows: int) -> int:
    """Passes for a step whose shuffles hold about ``rows``."""
    return max(1, min(PASSES, rows // PASS_ROWS))


def in_pass(key: str, i: int, n: int) -> Column:
    """Is a row's ``key`` dealt with in pass ``i`` of ``n``?"""
    return F.lit(True) if n == 1 else F.pmod(F.xxhash64(key), F.lit(n)) == F.lit(i)


def materialize_passes(make: Callable[[int], DataFrame], n: int, label: str) -> DataFrame:
    """As ``materialize``, the rows made pass by pass: disk holds the shuffles of one pass.  Column ``pass`` tells a row's pass."""
    path = None
    for i in range(n):
        df = make(i)
        path = path or scratch_path(df.sparkSession, label)
        write_scratch(df, f"{path}/pass={i}")
    return df.sparkSession.read.schema(df.withColumn("pass", F.lit(0)).schema).parquet(path)
