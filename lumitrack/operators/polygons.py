"""Polygons over pixels: even-odd fill by row spans, clips of rasters, and outlines of valid pixels.

Edges are rows (image, x1, y1, x2, y2) in pixels; rings, holes and crossings of rings need no order among them. An edge
meets the pixel rows whose middles lie between its ends; a row's crossings, sorted and paired, are its spans; a pixel is
inside where its middle is in a span (its left end belongs to it, its right end doesn't).

Scale: an edge becomes as many rows as pixel rows that it meets; crossings of one pixel row are gathered, pixels of a
raster only join their row's spans. An outline comes from each pixel's four neighbours by a map-side sum of sides, so no
image is gathered, and straight pieces are joined by windows over one grid line.

Rows: edges and vertices with a null or non-finite number count for nothing; a ring of fewer than three vertices encloses
nothing. Repeated edges cancel each other in pairs, as the even-odd rule has it. An image without edges has no pixel inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitrack.functions.numbers import finite


def edges_of(vertices: DataFrame) -> DataFrame:
    """The closed rings' edges, from vertices (image, ring, nth, x, y)."""
    ring = Window.partitionBy("image", "ring").orderBy("nth", "x", "y")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    usable = vertices.filter(finite(F.col("x"), F.col("y")))
    return usable.select("image", F.col("x").alias("x1"), F.col("y").alias("y1"), after("x").alias("x2"), after("y").alias("y2"))


def spans(edges: DataFrame) -> DataFrame:
    """(image, row, spans): of each pixel row that has any, its spans as structs (first, end) of columns."""
    usable = edges.filter(finite(*map(F.col, ("x1", "y1", "x2", "y2"))))
    first = lambda c: F.ceil(c - F.lit(0.5))  # noqa: E731  the first pixel whose middle is not before c
    low, high = first(F.least("y1", "y2")), first(F.greatest("y1", "y2")) - 1
    met = usable.filter(high >= low).withColumn("row", F.explode(F.sequence(low, high)))
    middle = F.col("row") + F.lit(0.5)
    x = F.col("x1") + (middle - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossed = met.select("image", F.col("row").cast("int").alias("row"), x.alias("_x")).groupBy("image", "row").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    at = lambda i: first(F.col("_xs")[i]).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (F.size("_xs") / 2).cast("int") - 1), lambda i: F.struct(at(2 * i).alias("first"), at(2 * i + 1).alias("end")))
    return crossed.filter("size(_xs) > 1").select("image", "row", F.filter(pairs, lambda s: s["end"] > s["first"]).alias("spans")).filter("size(spans) > 0")


def clipped(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """The pixels (image, row, col, ...) whose middles are inside."""
    inside = F.exists("spans", lambda s: (F.col("col") >= s["first"]) & (F.col("col") < s["end"]))
    return pixels.join(spans(edges), ["image", "row"]).filter(inside).select(*pixels.columns)


def clip_status(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """(image, n_pixels, n_inside, status) of every image of either side: ok, no overlap, or no pixels."""
    inside = F.exists(F.coalesce(F.col("spans"), F.array().cast("array<struct<first:int,end:int>>")), lambda s: (F.col("col") >= s["first"]) & (F.col("col") < s["end"]))
    counts = pixels.join(spans(edges), ["image", "row"], "left").groupBy("image").agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if(inside).alias("n_inside"))
    every = edges.select("image").union(pixels.select("image")).distinct()
    out = every.join(counts, "image", "left").fillna(0, ["n_pixels", "n_inside"])
    return out.withColumn("status", F.when(F.col("n_pixels") == 0, "no pixels").when(F.col("n_inside") == 0, "no overlap").otherwise("ok"))


def outline(pixels: DataFrame) -> DataFrame:
    """The edges around the given pixels (image, row, col), holes among them; each a maximal straight piece.

    The inside is on the right of an edge that goes down or left. ``spans`` of the result are the pixels again.
    """
    each = pixels.select("image", "row", "col").distinct()
    side = lambda kind, line, at, sign: F.struct(F.lit(kind).alias("kind"), line.alias("line"), at.alias("at"), F.lit(sign).alias("sign"))
    row, col = F.col("row"), F.col("col")
    four = F.array(side("v", col, row, 1), side("v", col + 1, row, -1), side("h", row, col, 1), side("h", row + 1, col, -1))
    sides = each.select("image", F.explode(four).alias("s")).select("image", "s.*")
    bare = sides.groupBy("image", "kind", "line", "at").agg(F.sum("sign").alias("sign")).filter("sign <> 0")  # a side between two pixels is none
    along = Window.partitionBy("image", "kind", "line", "sign").orderBy("at")
    parts = bare.withColumn("_part", F.col("at") - F.row_number().over(along))
    pieces = parts.groupBy("image", "kind", "line", "sign", "_part").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"))
    start, end = F.when(F.col("sign") > 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("sign") > 0, F.col("b")).otherwise(F.col("a"))
    upright = F.col("kind") == "v"
    place = lambda x, y: F.when(upright, x).otherwise(y).cast("double")
    return pieces.select("image", place(F.col("line"), start).alias("x1"), place(start, F.col("line")).alias("y1"), place(F.col("line"), end).alias("x2"), place(end, F.col("line")).alias("y2"))
