"""Per-frame plans with a status row for each frame: georeference images, crop a light raster to them, find the flow between.

A frame that can't be done gets a status that says why; the others go on. All frames are worked on at once, by joins on
the frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumitrack.functions.geo import geo_to_pixel
from lumitrack.functions.ground import System
from lumitrack.functions.numbers import finite
from lumitrack.operators import ground, kernels, rasters, warps
from lumitrack.plans.shared import kept

#: How many places along each side of an image are warped to see how large its warp gets.
SIDE_PLACES = 21


@dataclass(frozen=True)
class Georeferenced:
    """``status`` has a row per frame; ``grids`` (frame_index, warp_width, warp_height, gt) and ``mapping`` those that were done."""

    status: DataFrame
    grids: DataFrame
    mapping: DataFrame


def edge_places(images: DataFrame) -> DataFrame:
    """(frame_index, x, y) along the edges of images, corners included."""
    part = F.explode(F.sequence(F.lit(0), F.lit(SIDE_PLACES - 1)))
    along = images.select("frame_index", "width", "height", part.alias("k")).withColumn("t", F.col("k") / F.lit(float(SIDE_PLACES - 1)))
    w, h, t = F.col("width").cast("double"), F.col("height").cast("double"), F.col("t")
    side = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    sides = F.array(side(w * t, F.lit(0.0)), side(w * t, h), side(F.lit(0.0), h * t), side(w, h * t))
    return along.select("frame_index", F.inline(sides)).distinct()


def georeferenced(points: DataFrame, images: DataFrame, done: DataFrame | None = None, least: int = 6, most_extent: float = 60.0, most_side: int = rasters.MOST_SIDE) -> Georeferenced:
    """Which frames can be warped by a spline through their control points, onto which grid, and where their points lie on it.

    points: frame_index, row_ordinal, mapX, mapY, sourceX, sourceY (rows counted downwards as negative); images:
    frame_index, width, height; done: frames whose output is there already, which are skipped. A frame needs ``least``
    rows, points within ``most_extent`` degrees and a warp of a sensible size.
    """
    images = images.select("frame_index", "width", "height")
    skipped = (done if done is not None else images.limit(0)).select("frame_index").distinct().withColumn("_done", F.lit(True))
    rows = points.groupBy("frame_index").agg(F.count(F.lit(1)).alias("_rows"))
    extent = rasters.extent_check(points, most=most_extent).select("frame_index", "valid_extent")
    known = images.join(skipped, "frame_index", "left").join(rows, "frame_index", "left").join(extent, "frame_index", "left")
    first = F.when(F.col("_done"), "skipped").when(F.coalesce("_rows", F.lit(0)) < least, "too few points").when(~F.coalesce("valid_extent", F.lit(False)), "points too far apart")
    checked = kept(known.select("frame_index", "width", "height", first.alias("_first")), "checked_frames")
    todo = checked.filter("_first is null").select("frame_index", "width", "height")
    usable = points.join(todo.select("frame_index"), "frame_index", "left_semi").filter(finite(F.col("mapX"), F.col("mapY"), F.col("sourceX"), F.col("sourceY")))
    placed = usable.groupBy("frame_index", F.col("sourceX").alias("x"), (-F.col("sourceY")).alias("y")).agg(F.avg("mapX").alias("u"), F.avg("mapY").alias("v"))
    sizes = kept(rasters.warp_size(kernels.warped(placed, edge_places(todo), least), todo, most_side=most_side), "warp_sizes")
    status = checked.join(sizes.select("frame_index", "fits"), "frame_index", "left")
    said = F.coalesce(F.col("_first"), F.when(F.col("fits").isNull(), "too few points").when(~F.col("fits"), "warp too large").otherwise("done"))
    grids = sizes.filter("fits").select("frame_index", "warp_width", "warp_height", "gt")
    at = points.join(grids.select("frame_index", "gt"), "frame_index").withColumn("_p", geo_to_pixel(F.col("mapX"), F.col("mapY"), [F.col("gt")[i] for i in range(6)]))
    mapping = at.select("frame_index", "row_ordinal", "sourceX", "sourceY", "mapX", "mapY", F.col("_p.col").alias("geoX"), F.col("_p.row").alias("geoY"))
    return Georeferenced(status.select("frame_index", said.alias("status")), grids, mapping)


def warped_pixels(raster: DataFrame, points: DataFrame, grids: DataFrame, value: str = "value") -> DataFrame:
    """(frame_index, row, col, value) of warped images: each pixel of a grid takes the image's pixel under it, by the spline
    from the ground to the image, to an eighth of a pixel; pixels that lie off the image have no row. raster: frame_index,
    row, col, value."""
    good = points.filter(finite(F.col("mapX"), F.col("mapY"), F.col("sourceX"), F.col("sourceY")))
    ground = good.groupBy("frame_index", F.col("mapX").alias("x"), F.col("mapY").alias("y")).agg(F.avg("sourceX").alias("u"), F.avg(-F.col("sourceY")).alias("v"))
    at = warps.pixels(warps.cells(ground, grids), grids).select("frame_index", "row", "col", F.floor("v").cast("int").alias("_row"), F.floor("u").cast("int").alias("_col"))
    source = raster.select("frame_index", F.col("row").alias("_row"), F.col("col").alias("_col"), value)
    return at.join(source, ["frame_index", "_row", "_col"]).select("frame_index", "row", "col", value)


def cropped(mapping: DataFrame, images: DataFrame, light: DataFrame, light_gt: Column, margin: int = 100, method: str = "nearest", done: DataFrame | None = None, systems: tuple[System, System] | None = None) -> tuple[DataFrame, DataFrame]:
    """One light raster cut to each frame's control points, toned and put on the frame's own grid: (status with windows, pixels).

    mapping: frame_index, geoX, geoY; images: frame_index, width, height, gt; light: row, col, value on ``light_gt``, one
    raster for all frames; systems: those of the images and of the light, where they differ. Pixels are (frame_index, row, col, tone) counted from the window's corner, with 0 where there is
    no light; a frame whose window has none at all is "no overlap".
    """
    sizes = images.select("frame_index", "width", "height", "gt")
    windows = rasters.roi_from_mapping(mapping, margin, F.col("width"), F.col("height"), sizes=sizes)
    skipped = (done if done is not None else images.limit(0)).select("frame_index").distinct()
    todo = windows.join(skipped, "frame_index", "left_anti").join(sizes, "frame_index")
    extent = light.agg((F.max("col") + 1).alias("source_width"), (F.max("row") + 1).alias("source_height"))
    grids = todo.select(F.col("frame_index").alias("image"), F.col("roi_width").alias("width"), F.col("roi_height").alias("height"), rasters.window_transform(F.col("gt"), F.col("x0"), F.col("y0")).alias("gt"), light_gt.alias("source_gt"))
    # one row of two numbers goes to every grid
    grids = grids.crossJoin(F.broadcast(extent))
    toned = rasters.tone_mapped(light)
    change = ground.change_of(*systems) if systems else None
    pixels = kept(rasters.resampled_from_one(toned, grids, method, value="tone", ground=change).withColumnRenamed("image", "frame_index"), "cropped")
    overlap = (ground.overlap(grids, *systems) if systems else _overlap(grids)).withColumnRenamed("image", "frame_index")
    status = sizes.select("frame_index").join(windows, "frame_index", "left").join(overlap, "frame_index", "left").join(skipped.withColumn("_done", F.lit(True)), "frame_index", "left")
    said = F.when(F.col("_done"), "skipped").when(F.col("x0").isNull(), "no mapped pixels").when(~F.coalesce("_meets", F.lit(False)), "no overlap").otherwise("done")
    out = status.select("frame_index", said.alias("status"), "x0", "x1", "y0", "y1", "roi_width", "roi_height")
    return out, pixels.join(out.filter("status = 'done'").select("frame_index"), "frame_index", "left_semi")


def _overlap(grids: DataFrame) -> DataFrame:
    """(image, _meets): whether a north-up grid shares ground with its source."""
    g, s = F.col("gt"), F.col("source_gt")
    ends = lambda a, b: (F.least(a, b), F.greatest(a, b))
    x0, x1 = ends(g[0], g[0] + F.col("width") * g[1])
    y0, y1 = ends(g[3], g[3] + F.col("height") * g[5])
    u0, u1 = ends(s[0], s[0] + F.col("source_width") * s[1])
    v0, v1 = ends(s[3], s[3] + F.col("source_height") * s[5])
    return grids.select("image", ((x0 < u1) & (u0 < x1) & (y0 < v1) & (v0 < y1)).alias("_meets"))


def flows(first: DataFrame, second: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The flow from each frame's grey image to its light image within a window: (status, pixels with dx and dy).

    first: image, row, col, value of whole images; second: image, row, col, value on the window's grid, or on another,
    which is resized to it; windows: image, x0, y0, x1, y1. The first's levels are matched to the second's before.
    """
    boxes = windows.select("image", "x0", "y0", "x1", "y1")
    sizes = second.groupBy("image").agg((F.max("col") + 1).alias("source_width"), (F.max("row") + 1).alias("source_height"))
    wanted = sizes.join(boxes, "image").withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")}).drop("x0", "y0", "x1", "y1")
    same = (F.col("width") == F.col("source_width")) & (F.col("height") == F.col("source_height"))
    known = second.select("image", "row", "col", F.when(finite(F.col("value")), F.col("value")).otherwise(0.0).alias("value"))
    fitting = known.join(wanted.filter(same).select("image"), "image", "left_semi").unionByName(rasters.resized(known, wanted.filter(~same)))
    other = kept(rasters.to_bytes(fitting).filter("byte is not null").select("image", "row", "col", "byte"), "light_bytes")
    window = rasters.clipped(first, boxes).withColumn("byte", F.floor("value").cast("int")).select("image", "row", "col", "byte")
    matched = rasters.histogram_matched(window, other).select("image", "row", "col", F.floor(F.least(F.greatest("matched", F.lit(0.0)), F.lit(255.0))).cast("double").alias("a"))
    both = matched.join(other.select("image", "row", "col", F.col("byte").cast("double").alias("b")), ["image", "row", "col"])
    seen = lambda x, name: x.select("image").distinct().withColumn(name, F.lit(True))
    status = boxes.select("image").join(seen(first, "_first"), "image", "left").join(seen(second, "_second"), "image", "left").join(seen(other, "_bytes"), "image", "left")
    said = F.when(F.col("_first").isNull(), "missing image").when(F.col("_second").isNull(), "missing light image").when(F.col("_bytes").isNull(), "flat light image").otherwise("done")
    return status.select("image", said.alias("status")), kernels.image_flow(both)
