"""Picks from ordered rows: evenly spaced ones, every nth, named references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their place ``nth`` from 0 and the group's size ``of``."""
    group = Window.partitionBy(*by)
    return rows.withColumns({"nth": F.row_number().over(group.orderBy(*order)) - 1, "of": F.count(F.lit(1)).over(group)})


def evenly_spaced(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """About ``n`` rows of each group from the first to the last, at places rounded half to even; all if there are no more.

    With ``n`` of 1 that is the first row.
    """
    r = ranked(rows, by, order)
    places = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: F.bround(i * (F.col("of") - 1) / F.lit(float(max(n - 1, 1)))).cast("long"))
    return r.filter((F.col("of") <= n) | F.array_contains(places, F.col("nth").cast("long"))).drop("nth", "of")


def at_fractions(rows: DataFrame, by: list[str], order: list[str], fractions: list[float]) -> DataFrame:
    """The rows at shares of the way through their group, each once."""
    r = ranked(rows, by, order)
    places = F.transform(F.array(*map(F.lit, fractions)), lambda f: F.greatest(F.lit(0), F.least(F.col("of") - 1, F.bround(f * (F.col("of") - 1)).cast("long"))))
    return r.filter(F.array_contains(places, F.col("nth").cast("long"))).drop("nth", "of")


def every_nth(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return ranked(rows, by, order).filter(F.pmod("nth", F.lit(max(n, 1))) == 0).drop("nth", "of")


def reference_frames(spec: str, frames: DataFrame) -> DataFrame:
    """(place, frame_index) for words like "first,mid,last,12" in their order, without repeats or what can't be read."""
    n = frames.count()
    words = frames.sparkSession.range(1).select(F.posexplode(F.split(F.lit(spec), ",")).alias("place", "word"))
    w = F.lower(F.trim("word"))
    index = F.when(w == "first", 0).when(w.isin("mid", "middle"), n // 2).when(w == "last", n - 1).otherwise(w.try_cast("int"))
    read = words.select("place", index.alias("frame_index")).filter((F.col("frame_index") >= 0) & (F.col("frame_index") < n))
    return read.groupBy("frame_index").agg(F.min("place").alias("place")).select("place", "frame_index")


def seeded(rows: DataFrame, by: list[str], order: list[str], n: int = 150, seed: int = 1234) -> DataFrame:
    """``n`` rows of each group, or all, without repeats: those with the least hashes of ``order`` and the seed.

    Spark keeps only the first ``n`` of each task's rows of a group before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *order), *order)
    return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")
