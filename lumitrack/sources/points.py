"""Readers: control points, matches, mappings, orbit elements, images and settings, all as DataFrames of many files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumitrack.functions.names import base_name, id_by_mission, is_image, settings
from lumitrack.functions.numbers import finite, lenient_double

#: The columns of a control-point file (a fixed format).
POINT_COLUMNS = ("mapX", "mapY", "sourceX", "sourceY", "enable", "dX", "dY", "residual")
STATUS_COLUMNS = ("temporal_status", "temporal_residual_km", "temporal_threshold_km")
REQUIRED = ("mapX", "mapY", "sourceX", "sourceY")
MATCHES = "sim_x DOUBLE, sim_y DOUBLE, real_x DOUBLE, real_y DOUBLE"
MAPPING = "sourceX DOUBLE, sourceY DOUBLE, mapX DOUBLE, mapY DOUBLE, geoX INT, geoY INT"


def lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file_name, nth, line) of every line of the files; what follows an "M" is a comment, and empty lines drop out."""
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select(base_name(F.col("_metadata.file_path")).alias("file_name"), "value")
    each = whole.select("file_name", F.posexplode(F.split("value", "\r?\n")).alias("nth", "line"))
    return each.withColumn("line", F.trim(F.split("line", "M")[0])).filter("line <> ''")


def read_points(spark: SparkSession, path: str, glob: str = "*.points") -> DataFrame:
    """Control points of all files: file_name, frame_id, row_index, the known columns as doubles, and others in ``extra``.

    A file's own header names its columns; files that lack a required one are left out (see ``rejected_files``). Values that
    aren't numbers are null.
    """
    marked = _with_header(lines(spark, path, glob)).filter("_complete and row_index >= 0")
    known = {c: lenient_double(F.col("_values")[c]) for c in POINT_COLUMNS}
    extra = F.map_filter("_values", lambda k, _: ~k.isin(*POINT_COLUMNS))
    return marked.select("file_name", id_by_mission(F.col("file_name")).alias("frame_id"), "row_index", *(v.alias(k) for k, v in known.items()), extra.alias("extra"))


def rejected_files(spark: SparkSession, path: str, glob: str = "*.points") -> DataFrame:
    return _with_header(lines(spark, path, glob)).filter("not _complete").select("file_name").distinct()


def _with_header(rows: DataFrame) -> DataFrame:
    file = Window.partitionBy("file_name").orderBy("nth")
    parts = rows.withColumn("_parts", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    marked = parts.withColumns({"_header": F.first("_parts").over(file), "row_index": F.row_number().over(file) - 2})
    complete = F.size(F.array_intersect("_header", F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED)
    n = F.least(F.size("_header"), F.size("_parts"))
    pairs = F.map_from_arrays(F.slice("_header", F.lit(1), n), F.slice("_parts", F.lit(1), n))
    return marked.withColumns({"_complete": complete, "_values": pairs})


def observations(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Points as observations of tracks: track_key, frame_index, row_index and positions; a row without a source place has no key."""
    return tracked(points.join(frames.select("file_name", "frame_index"), "file_name"))


def tracked(placed: DataFrame) -> DataFrame:
    """Points of frames with the track that they belong to."""
    from lumitrack.functions.names import source_key

    return placed.withColumn("track_key", F.when(finite(F.col("sourceX"), F.col("sourceY")), source_key(F.col("sourceX"), F.col("sourceY"))))


def output_columns(first: list[str], status: bool = False) -> list[str]:
    """The columns that a filtered file has: the first input's in its order, then known ones that it lacks, then the status's."""
    own = [c for c in first if not c.startswith("__")] if set(REQUIRED) <= set(first) else list(POINT_COLUMNS)
    return list(dict.fromkeys((*own, *POINT_COLUMNS, *(STATUS_COLUMNS if status else ()))))


def enabled(points: DataFrame) -> DataFrame:
    """The points that are switched on; only displays look at this, georeferencing takes all."""
    return points.filter(F.col("enable").cast("int") == 1)


def nonempty(files: DataFrame) -> DataFrame:
    """The files (path, length, ...) that hold anything."""
    return files.filter("length > 0")


def matched_places(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``pairs`` of two arrays of [x, y] as ``matched``: an array of struct(left, right) as far as both go, as floats, without
    pairs that aren't finite; null if none is left or a side is missing."""
    n = F.least(F.size(left), F.size(right))
    as_float = lambda a: F.transform(a, lambda p: F.transform(p, lambda v: v.cast("float")))
    zipped = F.zip_with(F.slice(as_float(F.col(left)), F.lit(1), n), F.slice(as_float(F.col(right)), F.lit(1), n), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    good = F.filter(zipped, lambda p: finite(p["left"][0], p["left"][1], p["right"][0], p["right"][1]))
    return pairs.withColumn("matched", F.when(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.size(good) > 0), good))


def ids_in_range(points: DataFrame, first: int, last: int) -> DataFrame:
    """The distinct frame ids from ``first`` to ``last`` of files that have points, in order."""
    return points.filter(F.col("frame_id").between(first, last)).select("frame_id").distinct().orderBy("frame_id")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Match pairs with their file; a malformed row is an error."""
    read = spark.read.option("header", True).option("mode", "FAILFAST").schema(MATCHES).csv(path)
    return read.withColumn("file_name", base_name(F.col("_metadata.file_path")))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("header", True).schema(MAPPING).csv(path)
    return read.withColumn("file_name", base_name(F.col("_metadata.file_path")))


def read_elements(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Two-line orbit elements: name, line1, line2, epoch, file_order (by file and line)."""
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return elements(whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("nth", "line")))


def elements(rows: DataFrame) -> DataFrame:
    """Pairs of a line that begins with 1 and a next that begins with 2, from (path, nth, line)."""
    file = Window.partitionBy("path").orderBy("nth")
    kept = rows.withColumn("line", F.trim("line")).filter("line <> ''")
    pairs = kept.withColumn("line2", F.lead("line").over(file)).filter("line like '1%' and line2 like '2%'")
    year, day = F.substring("line", 19, 2).try_cast("int"), F.substring("line", 21, 12).try_cast("double")
    full = F.when(year < 57, year + 2000).otherwise(year + 1900)
    start = F.unix_micros(F.make_date(full, F.lit(1), F.lit(1)).cast("timestamp"))
    epoch = F.timestamp_micros(start + F.floor((day - 1.0) * 86400e6 + 0.5).cast("long"))
    named = pairs.select(F.split("line", r"\s+")[1].alias("name"), F.col("line").alias("line1"), "line2", epoch.alias("epoch"), F.struct("path", "nth").alias("file_order"))
    return named.filter("epoch is not null")


def list_images(spark: SparkSession, path: str, endings: str = "jpe?g") -> DataFrame:
    """(path, file_name, length) of images, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.withColumn("file_name", base_name(F.col("path"))).filter(is_image(F.col("file_name"), endings))


def first_existing(wanted: DataFrame, files: DataFrame, endings: list[str]) -> DataFrame:
    """Each base name with the file whose ending comes first in ``endings``; null if there is none."""
    ranks = F.create_map(*(F.lit(x) for i, e in enumerate(endings) for x in (e, i)))
    ranked = files.select(F.regexp_replace("file_name", r"\.[^.]+$", "").alias("base"), "file_name", ranks[F.regexp_extract("file_name", r"(\.[^.]+)$", 1)].alias("_rank")).filter("_rank is not null")
    return wanted.join(ranked.groupBy("base").agg(F.min_by("file_name", "_rank").alias("file_name")), "base", "left")


def photo_tags(tags: DataFrame) -> DataFrame:
    """Time, focal length and size from tags read as text columns (taken, changed, focal, width, height, file_width, file_height)."""
    when = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy:MM:dd HH:mm:ss"))
    parts = F.split("focal", "/")
    focal = F.when(F.col("focal").contains("/"), F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))).otherwise(F.col("focal").try_cast("double"))
    size = lambda c: F.coalesce(F.col(c).try_cast("int"), F.col(f"file_{c}").try_cast("int"))
    rest = [c for c in tags.columns if c not in ("taken", "changed", "focal", "width", "height", "file_width", "file_height")]
    return tags.select(*rest, F.coalesce(when("taken"), when("changed")).alias("time"), focal.alias("focal"), size("width").alias("width"), size("height").alias("height"))


def read_json_text(texts: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """``texts`` with ``parsed``; null where the text isn't valid."""
    return texts.withColumn("parsed", F.from_json(text, schema))


def read_settings(texts: DataFrame, text: str = "value") -> DataFrame:
    """(file_name, key, value) of every "key = value" line."""
    each = texts.select("file_name", F.posexplode(F.split(text, "\r?\n")).alias("nth", "line")).withColumn("s", settings(F.col("line")))
    return each.filter("s is not null").select("file_name", "nth", "s.key", "s.value")


def window_of(parsed: Column, width: Column, height: Column) -> Column:
    """The window that a parsed region file names, kept within the frame; null if an edge is missing."""
    from lumitrack.functions.numbers import clamp

    x0, y0 = clamp(parsed["x0"], 0, width - 1), clamp(parsed["y0"], 0, height - 1)
    x1, y1 = clamp(parsed["x1"], x0 + 1, width), clamp(parsed["y1"], y0 + 1, height)
    whole = parsed["x0"].isNotNull() & parsed["x1"].isNotNull() & parsed["y0"].isNotNull() & parsed["y1"].isNotNull()
    return F.when(whole, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def read_flow_arrays(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) of saved (H, W, 2) arrays as (path, row, col, dx, dy); others give one row with ``error``."""
    import io

    import numpy as np

    def load(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in them:
            for path, content in zip(x["path"], x["content"], strict=True):
                try:
                    m = np.load(io.BytesIO(content), allow_pickle=False)
                    if m.ndim != 3 or m.shape[2] != 2:
                        raise ValueError(f"shape {m.shape}")
                except (ValueError, EOFError, OSError) as e:
                    yield pd.DataFrame({"path": [path], "row": [None], "col": [None], "dx": [None], "dy": [None], "error": [str(e)[:200]]})
                    continue
                rows, cols = np.mgrid[: m.shape[0], : m.shape[1]]
                yield pd.DataFrame({"path": path, "row": rows.ravel(), "col": cols.ravel(), "dx": m[..., 0].ravel().astype(float), "dy": m[..., 1].ravel().astype(float), "error": None})

    return files.select("path", "content").mapInPandas(load, "path string, row int, col int, dx double, dy double, error string")


def with_all_columns(parts: list[DataFrame]) -> DataFrame:
    """The rows of all, with the columns of any; nulls where one lacks a column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
