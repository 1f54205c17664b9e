"""Writers: control points, mappings, tables and JSON, partitioned by frame, with a manifest for what a frame lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumitrack.sources.points import POINT_COLUMNS


def write_points(points: DataFrame, frames: DataFrame, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Points as CSV by frame, in the order of row_ordinal, and a manifest of all frames with their counts.

    A partitioned writer leaves no trace of a frame without points, so the manifest has a row with 0 for it.
    """
    columns = [c for c in (*POINT_COLUMNS, *extra) if c in points.columns]
    ordered = points.repartition("frame_index").sortWithinPartitions("frame_index", "row_ordinal")
    ordered.select("frame_index", *columns).write.mode("overwrite").partitionBy("frame_index").option("header", True).csv(f"{path}/points")
    counts = points.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"))
    manifest = frames.select("frame_index").distinct().join(counts, "frame_index", "left").fillna({"n": 0})
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return points.sparkSession.read.parquet(f"{path}/manifest")


def write_by_frame(table: DataFrame, path: str, by: str = "frame_index", kind: str = "parquet") -> None:
    writer = table.repartition(by).write.mode("overwrite").partitionBy(by)
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def write_table(table: DataFrame, path: str) -> None:
    """A small summary as CSV with a header: one row a frame or a track."""
    table.write.mode("overwrite").option("header", True).csv(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def as_json(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, json): the columns as one JSON text."""
    return rows.select(key, F.to_json(F.struct(*columns)).alias("json"))


#: Headers of a projected match file (a fixed format), with the columns that they hold.
PROJECTED = {"Sim Pixel X": "sim_x", "Sim Pixel Y": "sim_y", "Real Pixel X": "real_x", "Real Pixel Y": "real_y", "Latitude": "lat", "Longitude": "lon"}
#: What a corrected point file has beyond the known columns, in order (a fixed format).
CORRECTED = ("dX_raw", "dY_raw", "correction_mag", "flow_inside", "flow_applied", "correction_reason", "geoX_first", "geoY_first")


def projected_layout(pixels: DataFrame, *keys: str) -> DataFrame:
    """The six columns of a projected match file, after ``keys``."""
    return pixels.select(*keys, *(F.col(c).alias(h) for h, c in PROJECTED.items()))


def corrected_layout(points: DataFrame, corrected: DataFrame) -> DataFrame:
    """Corrected points with their files' columns: those of ``points`` (frame_index, row_ordinal, sourceX, sourceY, enable)
    with new places, the corrections used and raw, and the pixels before."""
    own = points.select("frame_index", "row_ordinal", "sourceX", "sourceY", F.col("enable") if "enable" in points.columns else F.lit(1).alias("enable"))
    used = lambda c: F.when(F.col("flow_applied") == 1, F.col(f"{c}_raw")).otherwise(F.lit(0.0)).alias(c)
    both = corrected.join(own, ["frame_index", "row_ordinal"]).withColumns({"geoX_first": F.col("geoX"), "geoY_first": F.col("geoY")})
    return both.select("frame_index", "row_ordinal", "mapX", "mapY", "sourceX", "sourceY", "enable", used("dX"), used("dY"), F.lit(0.0).alias("residual"), *CORRECTED)


def correction_json(stats: DataFrame, meta: DataFrame, given_sign: float | None = None, limited: bool = False) -> DataFrame:
    """(frame_index, json) of each frame's corrections. meta: frame_index, x0, y0, x1, y1, sign, flow_definition, flow_correction."""
    x = stats.join(meta, "frame_index")
    roi = F.struct("x0", "y0", "x1", "y1", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    fields = [
        F.lit("original_points_only_exact_flow_sample").alias("mode"), F.lit(True).alias("no_dense_points_added"), F.lit(not limited).alias("no_max_pixel_limit_applied"),
        F.col("sign").alias("flow_sign_used"), F.lit("flow_meta" if given_sign is None else "cli").alias("flow_sign_source"), F.lit(given_sign).cast("double").alias("flow_sign_cli_received"),
        "n_points", "inside_flow_count", "applied_count", "reason_counts", roi.alias("roi"), "flow_definition", "flow_correction",
        F.struct("p50", "p90", "p95", "max").alias("correction_mag_percentiles"),
    ]
    return x.select("frame_index", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def window_json(frames: DataFrame, margin: int | None, mode: str = "gcp") -> DataFrame:
    """(frame_index, json) of each frame's window: ten fields where it comes from control points, else three.

    frames: frame_index, ref_width, ref_height, and with mode "gcp" x0, x1, y0, y1, roi_width, roi_height.
    """
    sizes = ["ref_width", "ref_height"]
    fields = ["x0", "x1", "y0", "y1", "roi_width", "roi_height", *sizes, F.lit(margin).cast("int").alias("roi_margin_px"), F.lit(mode).alias("roi_mode")] if mode == "gcp" else [F.lit(mode).alias("roi_mode"), *sizes]
    return frames.select("frame_index", F.to_json(F.struct(*fields)).alias("json"))


#: What a flow's metadata say of it (fixed values).
FLOW_VERSION = 3
FLOW_CORRECTION = "new_pixel = old_pixel + flow[y, x]"


def flow_json(frames: DataFrame, definition: str, settings: dict[str, float], fractions: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 1.0)) -> DataFrame:
    """(frame_index, json) of each frame's flow. frames: frame_index, image_id, first, second (paths), full_width, full_height,
    x0, y0, x1, y1, input_width, input_height, roi_source."""
    crop = [F.lit(float(v)).alias(f"crop_{n}") for n, v in zip(("x_start", "x_end", "y_start", "y_end"), fractions, strict=True)]
    fields = [
        F.lit(FLOW_VERSION).alias("metadata_version"), "image_id", F.col("first").alias("iss_rect_tiff"), F.col("second").alias("viirs_tiff"), "full_width", "full_height", "x0", "y0", "x1", "y1",
        (F.col("x1") - F.col("x0")).alias("flow_width"), (F.col("y1") - F.col("y0")).alias("flow_height"), F.col("input_width").alias("viirs_input_width"), F.col("input_height").alias("viirs_input_height"),
        "roi_source", *crop, F.lit(definition).alias("flow_definition"), F.lit(FLOW_CORRECTION).alias("correction_to_apply_in_correct_points"),
        F.create_map(*(F.lit(x) for k, v in settings.items() for x in (k, float(v)))).alias("farneback_params"),
    ]
    return frames.select("frame_index", F.to_json(F.struct(*fields)).alias("json"))


def replace_frames(table: DataFrame, path: str, by: str = "frame_index") -> None:
    """Writes the frames of ``table`` in place of their earlier versions; other frames stay."""
    table.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
