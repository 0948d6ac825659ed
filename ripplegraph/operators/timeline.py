"""Ordered per-key computations that never sort a whole key in one task.

A plain window over a key that holds a third of the rows is one task's work.  These helpers cut
each key's timeline into time buckets: the heavy rows are ordered inside (key, bucket) only, and
a second window runs over one pre-aggregated row per bucket to carry state across buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _bucket(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(float(size))).cast("long")


def lagged(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], position: Column, size: int
) -> DataFrame:
    """Add ``prev_<col>`` for every col: its value on the previous row of the key in ``order``.

    ``position`` is a number that grows with the first order column; ``size`` is the bucket width.
    """
    x = df.withColumn("_b", _bucket(position, size))
    kb = [*keys, "_b"]
    cell = F.struct(*[F.col(c).alias(c) for c in cols])
    inner = x.withColumn("_p", F.lag(cell).over(Window.partitionBy(*kb).orderBy(*order)))
    last = x.groupBy(*kb).agg(F.max_by(cell, F.struct(*order)).alias("_last"))
    carry = last.withColumn("_c", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_last")
    out = inner.join(carry, kb).withColumn("_p", F.coalesce("_p", "_c"))
    return out.select(*df.columns, *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in cols])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, position: Column, size: int
) -> DataFrame:
    """Add ``run_before`` and ``run_total``: running sum of ``value`` per key before and after each row."""
    x = df.withColumn("_b", _bucket(position, size))
    kb = [*keys, "_b"]
    w = Window.partitionBy(*kb).orderBy(*order)
    inner = x.withColumn("_i", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    totals = x.groupBy(*kb).agg(F.sum(value).alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.withColumn("_o", F.coalesce(before, F.lit(0))).drop("_t")
    out = inner.join(carry, kb)
    return out.select(
        *df.columns, (F.col("_o") + F.col("_i") - F.col(value)).alias("run_before"), (F.col("_o") + F.col("_i")).alias("run_total")
    )


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, position: Column, size: int) -> DataFrame:
    """Rows of maximal runs where ``hit`` holds, with ``run_id``; a run not closed by a later row is dropped.

    The run id is the number of breaks seen before the row, so the gaps-and-islands step is a
    bucketed running sum, and each run stays as rows instead of one collected list.
    """
    marked = df.withColumn("_hit", hit).withColumn("_break", F.when(hit, 0).otherwise(1).cast("long"))
    x = running_sum(marked, keys, order, "_break", position, size)
    breaks = marked.groupBy(*keys).agg(F.sum("_break").alias("_n"))
    rows = x.filter("_hit").join(breaks, list(keys)).filter(F.col("run_before") < F.col("_n"))
    return rows.select(*df.columns, F.col("run_before").alias("run_id"))


def decayed_prefix(df: DataFrame, keys: Sequence[str], ms: str, mass: str, beta: float) -> DataFrame:
    """Exponentially decayed sum of earlier mass at every distinct time: (keys, ms, prefix).

    prefix(t) = sum over rows with time < t of mass * exp(-beta * (t - time)), time in hours,
    ``ms`` in epoch milliseconds.  Three levels keep every window small and every exponent
    below 300: milliseconds inside an hour, hours inside a block of 300 / beta hours, and the
    previous block's decayed total (older blocks are below 1e-130 of their mass).
    """
    if beta > 300:
        raise ValueError("beta above 300 per hour needs a time unit shorter than an hour")
    block_hours = max(1, int(300 / beta))
    hour_ms = 3_600_000
    b = F.lit(float(beta))
    ticks = df.groupBy(*keys, ms).agg(F.sum(mass).alias("_a")).withColumn("_h", _bucket(F.col(ms), hour_ms))
    rel = (F.col(ms) - F.col("_h") * hour_ms) / F.lit(float(hour_ms))
    grown = F.col("_a") * F.exp(b * rel)
    w = Window.partitionBy(*keys, "_h").orderBy(ms).rowsBetween(Window.unboundedPreceding, -1)
    in_hour = ticks.withColumn("_inner", F.coalesce(F.sum(grown).over(w) * F.exp(-b * rel), F.lit(0.0))).withColumn("_rel", rel)
    # mass of each hour decayed to the end of that hour
    hours = ticks.groupBy(*keys, "_h").agg(F.sum(F.col("_a") * F.exp(b * (rel - 1.0))).alias("_m"))
    hours = hours.withColumn("_k", _bucket(F.col("_h"), block_hours))
    off = (F.col("_h") - F.col("_k") * block_hours).cast("double")
    wh = Window.partitionBy(*keys, "_k").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    # decayed to the start of hour h: exp(-beta * (h - h' - 1))
    hours = hours.withColumn(
        "_hp", F.coalesce(F.sum(F.col("_m") * F.exp(b * (off + 1.0))).over(wh) * F.exp(-b * off), F.lit(0.0))
    ).withColumn("_off", off)
    blocks = hours.groupBy(*keys, "_k").agg(
        F.sum(F.col("_m") * F.exp(b * (F.col("_off") + 1.0 - block_hours))).alias("_bt")
    )
    prev = blocks.select(*keys, (F.col("_k") + 1).alias("_k"), F.col("_bt").alias("_carry"))
    hours = hours.join(prev, [*keys, "_k"], "left").withColumn(
        "_start", F.col("_hp") + F.coalesce("_carry", F.lit(0.0)) * F.exp(-b * F.col("_off"))
    )
    return in_hour.join(hours.select(*keys, "_h", "_start"), [*keys, "_h"]).select(
        *keys, ms, (F.col("_inner") + F.col("_start") * F.exp(-b * F.col("_rel"))).alias("prefix")
    )


def asof_join(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, bucket_hours: int = 24
) -> DataFrame:
    """Each left row with the last right ``value`` of its key at or before ``left_ts``.

    Both sides share one timeline per key; inside a time bucket a running last value is taken,
    across buckets one carried value per bucket.  ``left`` must not hold a column named ``value``'s name.
    """
    size = bucket_hours * HOUR * 1_000_000
    names = left.columns
    a = left.select(F.col(key).alias("_k"), micros(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_v"), F.struct(*names).alias("_row"))
    b = right.filter(F.col(value).isNotNull()).select(
        F.col(key).alias("_k"), micros(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).alias("_row")
    )
    x = a.unionByName(b).withColumn("_b", _bucket(F.col("_t"), size))
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    inner = x.withColumn("_i", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    last = x.groupBy("_k", "_b").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_l"))
    wb = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("_k", "_b", F.last("_l", ignorenulls=True).over(wb)["_v"].alias("_c"))
    return inner.join(carry, ["_k", "_b"]).select("_row.*", F.coalesce("_i", "_c").alias(value))
