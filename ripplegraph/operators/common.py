"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.session import materialize


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """Best ``k`` rows per key.

    ``row_number() <= k`` makes Spark put a group limit in front of the shuffle, so every
    map task sends at most ``k`` rows per key and a hot key never lands whole in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


#: Rows of a written table that each task may hold as the broadcast side of a join.
BROADCAST_ROWS = 200_000


def unless_small(written: DataFrame) -> DataFrame:
    """``written`` for a join, by sort and merge if it has more than ``BROADCAST_ROWS`` rows.

    The planner goes by the size of the files; repetitive rows take a hundred times that in memory.
    """
    return written.hint("merge") if written.count() > BROADCAST_ROWS else written


def round_js(x: Column, digits: int) -> Column:
    """Half-up rounding toward +infinity, as ``Math.round`` does (C20).

    Digits far below the result are rounded away first, so a value on a half does not flip with
    the order in which a distributed sum was added up.
    """
    m = float(10**digits)
    return F.floor(F.round(x * F.lit(m), 6) + F.lit(0.5)) / F.lit(m)


def scalar(df: DataFrame) -> Column:
    """One-row, one-column frame as a scalar subquery (no join, no driver round trip)."""
    return df.scalar()


class HotJoin:
    """Inner join of ``rows`` with smaller tables on ``key``, of which few values may hold most rows.

    Values with more than a ``share``-th of all rows, fewer than ``share`` of them, are dealt over
    ``salts`` tasks; only their rows of the other table are copied.
    """

    def __init__(self, rows: DataFrame, key: str, share: int = 1000, salts: int = 32, least: int = 10_000) -> None:
        total = rows.count()
        often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") * share > total) & (F.col("_n") > least))
        self.hot = materialize(often.select(key, F.lit(salts).alias("_salts")), "hot-values")
        self.key, self.none = key, self.hot.isEmpty()
        self.rows = rows if self.none else self._salted(rows, F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.col("_salts")))

    def _salted(self, df: DataFrame, salt: Column) -> DataFrame:
        marked = df.join(F.broadcast(self.hot), self.key, "left")
        return marked.withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(salt).cast("int")).drop("_salts")

    def join(self, other: DataFrame) -> DataFrame:
        if self.none:
            return self.rows.join(other, self.key)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt")
        copied = other.join(F.broadcast(self.hot), self.key, "left").select(*other.columns, copies)
        return self.rows.join(copied, [self.key, "_salt"]).drop("_salt")
