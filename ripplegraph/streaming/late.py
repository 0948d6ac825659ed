"""Late rows of windowed streams (T2, T10): kept aside and repaired, window by window.

A windowed aggregate leaves out rows whose window the watermark has closed.  ``keep_late`` runs beside it
over the same source: every row goes to a history, and each (row, window) that the aggregate left out,
by the same rule, to a side table.  ``repair`` counts those windows anew from the history and no other;
``repaired`` puts them in the place of what the stream wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ripplegraph.streaming import store
from ripplegraph.streaming.jobs import each_version

NEWEST = "ms bigint"


def _window(ts: str, length: str, slide: str | None) -> Column:
    return F.window(ts, length, slide) if slide else F.window(ts, length)


def keep_late(events: DataFrame, root: str, checkpoint: str, key: str, ts: str = "ts", length: str = "1 hour", slide: str | None = None, delay_ms: int = 3_600_000) -> DataStreamWriter:
    """Append tables below ``root``: ``rows`` (history), ``late`` (window, key), ``newest`` (latest event time of each batch)."""

    def step(df: DataFrame, version: int) -> dict[str, DataFrame]:
        # the watermark of a batch comes from the batches before it
        seen = store.read_until(df.sparkSession, f"{root}/newest", version, NEWEST).agg(F.max("ms")).first()[0]
        placed = df.select(_window(ts, length, slide).alias("window"), key)
        late = placed.filter(F.unix_millis("window.end") <= F.lit(seen - delay_ms)) if seen is not None else placed.limit(0)
        return {"rows": df, "late": late.distinct(), "newest": df.agg(F.unix_millis(F.max(ts)).alias("ms"))}

    return events.writeStream.foreachBatch(each_version(root, step)).option("checkpointLocation", checkpoint)


def repair(spark: SparkSession, root: str, rows_schema: str, key: str, ts: str = "ts", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window, key, n, total) of the windows that late rows fall in, over the whole history."""
    history = store.read_all(spark, f"{root}/rows", rows_schema)
    kind = dict(history.dtypes)[key]
    late = store.read_all(spark, f"{root}/late", f"window struct<start:timestamp,end:timestamp>, {key} {kind}").distinct()
    placed = history.select(_window(ts, length, slide).alias("window"), key, "value")
    return placed.join(late, ["window", key], "left_semi").groupBy("window", key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def repaired(written: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """What the stream wrote, with the repaired windows in place of theirs."""
    return written.join(corrections.select("window", key), ["window", key], "left_anti").select("window", key, "n", "total").unionByName(corrections)
