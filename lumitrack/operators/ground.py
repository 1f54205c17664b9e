"""Rasters and polygons from one ground system to another: extents by densified edges, resampling, crops.

A raster is described by its size and the six terms of its affine mapping; its system is the same for all rows of a call,
but for a transverse Mercator whose zone is a column. Work is joins on (image, row, col) of the taps that a target pixel
reads, as in ``rasters.resampled``; no image is gathered. Edges are a bounded number of rows an image or polygon side.

Rows: places that either system can't show count for nothing; a raster without such a place on its edge has a null grid
and is not written; target pixels without a place in the source are ``nodata``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumitrack.functions.geo import pixel_to_geo
from lumitrack.functions.ground import System, changed
from lumitrack.functions.numbers import finite
from lumitrack.operators import rasters

#: Places along each side of a raster, and pieces of a polygon's side, whose ground is looked up.
SIDE_PLACES = 21


def _terms(gt: Column) -> list[Column]:
    return [gt[i] for i in range(6)]


def middle_x(gt: Column, width: Column, height: Column) -> Column:
    """The x of a raster's middle, which longitudes are counted around."""
    return gt[0] + width / F.lit(2.0) * gt[1] + height / F.lit(2.0) * gt[2]


def edges_in(images: DataFrame, source: System, target: System) -> DataFrame:
    """(image, x, y, u, v): places along the edges of images (image, width, height, gt) and where they are in ``target``."""
    t = F.col("_k") / F.lit(float(SIDE_PLACES - 1))
    w, h, zero = F.col("width").cast("double"), F.col("height").cast("double"), F.lit(0.0)
    side = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    along = images.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SIDE_PLACES - 1))))
    each = along.withColumn("_at", F.explode(F.array(side(w * t, zero), side(w * t, h), side(zero, h * t), side(w, h * t))))
    ground = pixel_to_geo(F.col("_at.x"), F.col("_at.y"), _terms(F.col("gt")))
    # a geographic target counts longitudes around the image's middle, wherever that comes from
    mid = pixel_to_geo(w / 2.0, h / 2.0, _terms(F.col("gt")))
    around = source.inverse(mid["x"], mid["y"])[0] if target.is_geographic else None
    u, v = changed(ground["x"], ground["y"], source, target, around)
    found = each.select("image", F.col("_at.x").alias("x"), F.col("_at.y").alias("y"), u.alias("u"), v.alias("v"))
    return found.filter(finite(F.col("u"), F.col("v"))).dropDuplicates(["image", "x", "y"])


def target_grids(images: DataFrame, source: System, target: System, most_side: int = rasters.MOST_SIDE, most_pixels: int = rasters.MOST_PIXELS) -> DataFrame:
    """The north-up grid of each image in ``target`` that keeps its diagonal's number of pixels: image, warp_width,
    warp_height, gt, fits (null size and false where its corners can't be shown)."""
    sizes = images.select("image", "width", "height")
    found = rasters.warp_size(edges_in(images, source, target), sizes, "image", most_side, most_pixels)
    return sizes.select("image").join(found, "image", "left").fillna(False, ["fits"])


def reprojected(raster: DataFrame, grids: DataFrame, source: System, target: System, method: str = "nearest", nodata: float = 0.0, value: str = "value") -> DataFrame:
    """``rasters.resampled`` where the target grids are in another system than the source."""
    return rasters.resampled(raster, grids, method, nodata, value, change_of(target, source))


def change_of(target: System, source: System) -> rasters.Change:
    """From a target pixel's ground to the source's, for rows that have source_gt, source_width and source_height."""
    around = middle_x(F.col("source_gt"), F.col("source_width"), F.col("source_height")) if source.is_geographic else None
    return lambda x, y: changed(x, y, target, source, around)


def overlap(grids: DataFrame, target: System, source: System) -> DataFrame:
    """(image, _meets): whether the box of a grid's edges, in the source's system, shares ground with the north-up source."""
    s = F.col("source_gt")
    edges = edges_in(grids, target, source).groupBy("image").agg(*(f(c).alias(f"_{c}{n}") for c in "uv" for n, f in ((0, F.min), (1, F.max))))
    met = grids.select("image", "source_gt", "source_width", "source_height").join(edges, "image", "left")
    if source.is_geographic:  # longitudes as near to the source's middle as can be
        turn = F.round((middle_x(s, F.col("source_width"), F.col("source_height")) - (F.col("_u0") + F.col("_u1")) / 2.0) / 360.0) * 360.0
        met = met.withColumns({"_u0": F.col("_u0") + turn, "_u1": F.col("_u1") + turn})
    x, y = s[0] + F.col("source_width") * s[1], s[3] + F.col("source_height") * s[5]
    shares = lambda c, a, b: (F.col(f"_{c}0") < F.greatest(a, b)) & (F.least(a, b) < F.col(f"_{c}1"))
    return met.select("image", F.coalesce(shares("u", s[0], x) & shares("v", s[3], y), F.lit(False)).alias("_meets"))


def edges_across(edges: DataFrame, source: System, target: System, pieces: int = SIDE_PLACES - 1, around: Column | None = None) -> DataFrame:
    """Polygon sides (image, x1, y1, x2, y2) as shorter sides in another system, each cut into ``pieces`` before.

    A side with an end that can't be shown is left out, which opens its ring: a polygon must lie within both systems.
    """
    usable = edges.filter(finite(*map(F.col, ("x1", "y1", "x2", "y2")))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

    def at(k: Column) -> tuple[Column, Column]:
        t = k / F.lit(float(pieces))
        part = lambda a, b: F.when(k == pieces, F.col(b)).otherwise(F.col(a) + t * (F.col(b) - F.col(a)))
        return changed(part("x1", "x2"), part("y1", "y2"), source, target, around)

    (u1, v1), (u2, v2) = at(F.col("_k")), at(F.col("_k") + 1)
    out = usable.select("image", u1.alias("x1"), v1.alias("y1"), u2.alias("x2"), v2.alias("y2"))
    return out.filter(finite(*map(F.col, ("x1", "y1", "x2", "y2"))))


def edges_in_pixels(edges: DataFrame, images: DataFrame) -> DataFrame:
    """Sides on the ground as sides in pixels of their image (image, gt)."""
    g = F.col("gt")
    det = g[1] * g[5] - g[2] * g[4]
    x = lambda a, b: (g[5] * (F.col(a) - g[0]) - g[2] * (F.col(b) - g[3])) / det
    y = lambda a, b: (g[1] * (F.col(b) - g[3]) - g[4] * (F.col(a) - g[0])) / det
    met = edges.join(images.select("image", "gt"), "image")
    return met.select("image", x("x1", "y1").alias("x1"), y("x1", "y1").alias("y1"), x("x2", "y2").alias("x2"), y("x2", "y2").alias("y2"))
