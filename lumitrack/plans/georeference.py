"""Whole plans: filter a sequence's control points, correct them by a flow, and decide which stages have work to do."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumitrack.functions.numbers import finite
from lumitrack.operators import tracks
from lumitrack.operators.joins import has_neighbour
from lumitrack.plans.shared import kept
from lumitrack.sources import point_files
from lumitrack.sources import points as sources
from lumitrack.sources.sinks import write_table


@dataclass(frozen=True)
class Filtered:
    """What the filter of a sequence yields. ``tracks`` and ``written`` are kept in the shared folder; the rest is made when it's asked for."""

    observations: DataFrame
    usable: DataFrame
    frames: DataFrame
    radius_km: float | None
    tracks: DataFrame
    written: DataFrame

    @cached_property
    def points(self) -> DataFrame:
        if self.radius_km is None:
            return self.written
        return has_neighbour(self.written, self.radius_km, ["frame_index"], "track_key").filter("has_neighbour").drop("has_neighbour")

    @cached_property
    def frame_qc(self) -> DataFrame:
        return tracks.frame_qc(self.tracks, self.observations, self.written, self.points, self.frames)

    @cached_property
    def track_qc(self) -> DataFrame:
        return tracks.track_qc(self.tracks, self.usable)


def filter_sequence(observations: DataFrame, frames: DataFrame, config: tracks.FilterConfig = tracks.FilterConfig(), radius_km: float | None = 80.0) -> Filtered:
    """Temporal filter and imputation per track, then the spatial filter per frame (none with ``radius_km`` null).

    Rows without a source place are read (``input_count``) but belong to no track. Which rows have a neighbour as they are
    read is counted in either case, and decides on fits only where the configuration says so.
    """
    if radius_km is not None:
        observations = kept(has_neighbour(observations, radius_km, ["frame_index"], "track_key").withColumnRenamed("has_neighbour", "pre_spatial_ok"), "observations")
    usable = observations.filter(finite(F.col("sourceX"), F.col("sourceY")))
    filtered = kept(tracks.filtered_tracks(usable, frames, config), "tracks")
    written = kept(tracks.outputs(filtered, usable), "written")
    return Filtered(observations, usable, frames, radius_km, filtered, written)


def filter_files(
    spark: SparkSession, path: str, out: str, config: tracks.FilterConfig = tracks.FilterConfig(), radius_km: float | None = 80.0,
    first: int | None = None, last: int | None = None, mission: str = "ISS067", status: bool = True,
) -> Filtered:
    """From control-point files under ``path`` to filtered ones under ``out``: a file for each frame, frame_qc, track_qc and left_out.

    Files are frames in the order of their names, with ids from ``first`` to ``last``; one with a header alone is a frame
    whose points are imputed; one without the required columns is left out, and ``left_out`` says so. A frame's file is named by mission and id, and
    has the first file's columns in its order, the known ones that it lacks, and with ``status`` the filter's.
    """
    frames = kept(point_files.frames_of_files(spark, path, first, last, mission), "frames")
    points = kept(point_files.read_point_files(spark, path).drop("frame_id").withColumnRenamed("file_name", "input_name"), "points")
    named = points.join(frames.select("input_name", "frame_index"), "input_name").drop("input_name")
    found = filter_sequence(sources.tracked(named), frames, config, radius_km)
    head = frames.filter("frame_index = 0").select("columns").first()
    columns = sources.output_columns(head["columns"] if head else [], status)
    point_files.write_point_files(found.points, frames, f"{out}/points", columns)
    write_table(point_files.left_out_files(spark, path, first, last), f"{out}/left_out")
    write_table(frames.drop("columns").join(found.frame_qc, "frame_index"), f"{out}/frame_qc")
    write_table(found.track_qc, f"{out}/track_qc")
    return found


def stage_decisions(stages: DataFrame) -> DataFrame:
    """Per stage (stage, forced, expected, actual, upstream_changed, config_known, same_config): whether it runs, and why.

    Finished output is used again unless the run is forced; a changed configuration is only noted down.
    """
    done = F.col("actual") >= F.col("expected")
    runs = F.col("forced") | ~done
    differs = F.col("upstream_changed") | ~F.col("config_known") | ~F.col("same_config")
    reason = F.when(F.col("forced"), "forced").when(~done, "incomplete").when(differs, "complete, configuration noted").otherwise("complete")
    return stages.select("stage", runs.alias("runs"), (~runs & differs).alias("notes_config"), reason.alias("reason"))
