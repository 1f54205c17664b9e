"""Views over the driver's tables that stand in for the inputs of the operators, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumitrack.functions.geo import wrap_degrees
from lumitrack.functions.names import source_key

SPACING = 185.0
ACROSS = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts) -> F.Column:
    return F.date_diff(ts, F.lit("2024-01-01"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-point observations from events: a track per user, a frame per day; errors have no position."""
    e = table(spark, sf_dir, "events")
    frame, user = day(F.col("ts")), F.col("user_id")
    good = F.col("event_type") != "error"
    x = wrap_degrees(F.lit(170.0) + F.lit(0.8) * frame + F.lit(0.01) * (user % 100) + F.lit(0.01) * F.col("value"))
    y = F.lit(-20.0) + F.lit(1.2) * frame - F.lit(0.01) * frame * frame + F.lit(0.02) * (user % 100) + F.lit(0.005) * F.col("value")
    sx, sy = F.lit(SPACING) * (user % ACROSS), F.lit(-SPACING) * F.floor(user / F.lit(float(ACROSS)))
    return e.select(
        source_key(sx, sy).alias("track_key"), frame.alias("frame_index"), F.col("event_id").alias("row_index"), F.when(good, x).alias("mapX"), F.when(good, y).alias("mapY"),
        sx.alias("sourceX"), sy.alias("sourceY"), "user_id", "value", "event_type",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(day(F.col("ts")).alias("frame_index")).distinct()


OBS = """obs as (
  select printf('%.3f|%.3f', 185e0 * (user_id % 15), -185e0 * floor(user_id / 15e0)) track_key, frame_index, event_id row_index,
         case when event_type <> 'error' then x + 180e0 - 360e0 * floor((x + 180e0) / 360e0) - 180e0 end mapX,
         case when event_type <> 'error' then -20e0 + 1.2e0 * frame_index - 0.01e0 * frame_index * frame_index + 0.02e0 * (user_id % 100) + 0.005e0 * value end mapY,
         185e0 * (user_id % 15) sourceX, -185e0 * floor(user_id / 15e0) sourceY, user_id, value, event_type
  from (select *, 170e0 + 0.8e0 * frame_index + 0.01e0 * (user_id % 100) + 0.01e0 * value x
        from (select *, cast(date_diff('day', timestamp '2024-01-01', ts) as int) frame_index from events))),
frames as (select distinct cast(date_diff('day', timestamp '2024-01-01', ts) as int) frame_index from events)"""

IMAGES = 8


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight images from embeddings: a row per vector, a column per dimension."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
    return e.select((F.col("vec_id") % IMAGES).cast("int").alias("image"), F.floor(F.col("vec_id") / F.lit(float(IMAGES))).cast("int").alias("row"), "col", (F.col("v").cast("double") * 50.0 + 100.0).alias("value"))


IMG = """img as (
  select cast(vec_id % 8 as int) image, cast(floor(vec_id / 8e0) as int) "row", cast(i - 1 as int) col, cast(embedding[i] as double) * 50e0 + 100e0 as value
  from embeddings, range(1, 65) r(i))"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from events; one in eleven has no id."""
    e = table(spark, sf_dir, "events")
    base = F.concat(F.lit("ISS067-E-"), F.lit(300000) + F.col("event_id"))
    name = F.when(F.col("event_id") % 11 == 0, F.lit("notes.txt")).when(F.col("event_id") % 2 == 0, F.concat(base, F.lit("_real.points"))).otherwise(F.concat(base, F.lit(".JPG")))
    return e.select("event_id", "event_type", "user_id", "ts", F.concat(F.lit("/data/run1/"), name).alias("path"), name.alias("file_name"))


NAMES = """names as (
  select event_id, event_type, user_id, ts, '/data/run1/' || file_name as path, file_name from (
    select *, case when event_id % 11 = 0 then 'notes.txt' when event_id % 2 = 0 then 'ISS067-E-' || (300000 + event_id) || '_real.points' else 'ISS067-E-' || (300000 + event_id) || '.JPG' end file_name from events))"""
