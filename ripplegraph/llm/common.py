"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "_row_key"
#: A-Z to a-z and every ASCII character that is neither a letter nor a digit to a blank.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A-Z to a-z only.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*cols: str) -> Column:
    """Key of a row by its content, never null; rows alike in ``cols`` share it, so it is the same whenever it is computed."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *(F.coalesce(F.md5(F.col(c).cast("binary") if c == "text" else F.col(c).cast("string").cast("binary")), F.lit("null")) for c in cols))))


SPAN = "array<struct<start:int,stop:int,hit:string>>"
#: Pieces of a text that one fold appends to one array.
BLOCK = 256


def with_places(df: DataFrame, name: str, pieces: str) -> DataFrame:
    """Replace ``pieces`` (structs of ``gap``, the length before, and ``hit``) by ``name``: start, stop and hit of each.

    Places are running sums of lengths.  An array that a fold appends to is copied each time, so pieces are
    folded in blocks of fixed size, each from the sum of the blocks before it.  Write the result before
    filtering or exploding it: a filter on ``name`` would be pushed down with all of this in it.
    """
    none = F.expr(f"cast(array() as {SPAN})")
    blocks, sums = f"_b_{name}", f"_s_{name}"
    numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
    cut = F.when(F.size(pieces) > 0, F.transform(numbers, lambda k: F.slice(pieces, k * BLOCK + 1, BLOCK)))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["hit"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("hit")))).alias("out"))

    df = df.withColumn(blocks, cut)
    df = df.withColumn(sums, F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["hit"]))))
    before = F.transform(sums, lambda _, k: F.aggregate(F.slice(sums, 1, k), F.lit(0), lambda a, x: a + x))
    placed = F.zip_with(blocks, before, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step)["out"])
    return df.withColumn(name, F.coalesce(F.flatten(placed), none)).drop(blocks, sums, pieces)


def pieces_of(matches: Column, between: Column) -> Column:
    """Matches and the texts between them (one more) as structs of ``gap`` and ``hit``."""
    return F.slice(F.zip_with(matches, between, lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("hit"))), F.lit(1), F.size(matches))


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add, for each name, the leftmost non-overlapping matches of a pattern: start, stop (code points, stop exclusive) and hit.

    Spark's functions give the matches and the pieces between them; the places follow from the
    lengths of both.  A pattern must not match the empty string.
    """
    for name, pattern in patterns.items():
        df = df.withColumn(f"_m_{name}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    for name, pattern in patterns.items():
        m = F.col(f"_m_{name}")
        df = df.withColumn(f"_p_{name}", F.when(F.size(m) > 0, pieces_of(m, F.split(text, pattern, -1))))
    for name in patterns:
        df = with_places(df.drop(f"_m_{name}"), name, f"_p_{name}")
    return df


def joined_spans(spans: Column) -> Column:
    """kind:start:stop of each struct, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
