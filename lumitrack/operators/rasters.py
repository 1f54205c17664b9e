"""Rasters in long form (one row a pixel): sampling, tone, histograms, statistics, and corrections read from them.

The key columns of a raster are (image, row, col); every operator works per image, with hash joins and sums on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumitrack.functions.geo import pixel_to_geo
from lumitrack.functions.numbers import clamp, finite

#: A place (x, y) of one ground system in another.
Change = Callable[[Column, Column], tuple[Column, Column]]


def by_image():
    return Window.partitionBy("image")


def bilinear(points: DataFrame, raster: DataFrame, values: list[str], key: list[str] | None = None) -> DataFrame:
    """``points`` (image, x, y, ...) with the raster's values between its pixels; null outside or if not finite.

    A point needs four pixels: it's exploded to its corners, joined on (image, row, col), and added up by weight. Points
    outside never meet the raster. ``key`` names columns, the image among them, that tell points apart; only these go with
    the corners (without it, all columns do).
    """
    by = key or points.columns
    size = raster.groupBy("image").agg((F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    keyed = points.withColumn("_id", F.struct(*by)).select("image", "x", "y", "_id").distinct().join(size, "image")
    usable = keyed.filter(finite(F.col("x"), F.col("y"))).filter("x >= 0 and y >= 0 and x <= _w - 1 and y <= _h - 1")
    x0, y0 = F.floor("x").cast("int"), F.floor("y").cast("int")
    fx, fy = F.col("x") - x0, F.col("y") - y0
    corner = lambda dx, dy, w: F.struct(F.least(x0 + dx, F.col("_w") - 1).alias("col"), F.least(y0 + dy, F.col("_h") - 1).alias("row"), w.alias("weight"))
    corners = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))
    each = usable.select("image", "_id", F.explode(corners).alias("c")).select("image", "_id", "c.col", "c.row", "c.weight")
    # a pixel that isn't there, or has no value, counts for nothing only where its weight is 0
    whole = lambda v: F.sum(F.when(F.col(v).isNotNull(), F.col("weight"))) > 1 - 1e-9
    sums = [F.when(whole(v), F.sum(F.col(v) * F.col("weight"))).alias(f"sampled_{v}") for v in values]
    found = each.join(raster, ["image", "row", "col"]).groupBy("_id").agg(*sums)
    return points.withColumn("_id", F.struct(*by)).join(found, "_id", "left").drop("_id")


def tone_mapped(raster: DataFrame, value: str = "value", top: float = 200.0, gamma: float = 2.5, low: float = 0.0) -> DataFrame:
    """``tone``: values cut to [low, top] and spread from there over [0, 100] with a gamma; what isn't finite counts as 0."""
    if top <= low:
        raise ValueError("top must be above low")
    v = clamp(F.when(finite(F.col(value)), F.col(value)).otherwise(F.lit(0.0)), low, top)
    spread = F.pow((v - F.lit(low)) / F.lit(top - low + 1e-9), F.lit(1.0 / gamma)) * F.lit(100.0)
    return raster.withColumn("tone", clamp(spread, 0.0, 100.0))


def to_bytes(raster: DataFrame, value: str = "value") -> DataFrame:
    """``byte``: values spread over 0 to 255 and cut to whole numbers; null for a flat image."""
    ends = raster.groupBy("image").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    spread = (F.col(value) - F.col("_low")) * F.lit(255.0) / (F.col("_high") - F.col("_low"))
    return raster.join(ends, "image").withColumn("byte", F.when(F.col("_high") > F.col("_low"), F.floor(clamp(spread, 0.0, 255.0)).cast("int"))).drop("_low", "_high")


def histogram_matched(source: DataFrame, reference: DataFrame, level: str = "byte") -> DataFrame:
    """``matched``: the reference's level at which its share of pixels is that of the source's level, interpolated.

    Histograms have at most as many rows as there are levels, so only these are windowed; pixels join by level.
    """
    def shares(raster: DataFrame) -> DataFrame:
        counts = raster.groupBy("image", F.col(level).cast("double").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        up = by_image().orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
        return counts.select("image", "level", (F.sum("n").over(up) / F.sum("n").over(by_image())).alias("share"))

    src = shares(source).withColumns({"_kind": F.lit(1)})
    ref = shares(reference).withColumns({"_kind": F.lit(0)})
    along = by_image().orderBy("share", "_kind")
    at = F.when(F.col("_kind") == 0, F.struct("share", "level"))
    both = src.union(ref).withColumns({"_back": F.last(at, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)), "_on": F.last(at, ignorenulls=True).over(by_image().orderBy(F.desc("share"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0))})
    b, o, s = F.col("_back"), F.col("_on"), F.col("share")
    between = F.when(b.isNull(), o["level"]).when(o.isNull() | (o["share"] == b["share"]) | (b["share"] == s), b["level"]).otherwise(b["level"] + (o["level"] - b["level"]) * (s - b["share"]) / (o["share"] - b["share"]))
    table = both.filter("_kind = 1").select("image", F.col("level").alias("_level"), between.alias("matched"))
    return source.withColumn("_level", F.col(level).cast("double")).join(table, ["image", "_level"]).drop("_level")


def image_statistics(raster: DataFrame, value: str = "value", dark: float = 10.0) -> DataFrame:
    """Per image: share of pixels above ``dark``, population deviation, and variance of the Laplacian (mirrored edges)."""
    neighbours = {}
    for name, line, along in (("x", "row", "col"), ("y", "col", "row")):
        w = Window.partitionBy("image", line).orderBy(along)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        neighbours |= {f"_{name}0": F.coalesce(before, after, value), f"_{name}1": F.coalesce(after, before, value)}
    laplacian = F.col("_x0") + F.col("_x1") + F.col("_y0") + F.col("_y1") - F.lit(4.0) * F.col(value)
    return raster.withColumns(neighbours).withColumn("_lap", laplacian).groupBy("image").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.avg((F.col(value) > dark).cast("double")).alias("non_dark_fraction"), F.stddev_pop(value).alias("contrast"), F.var_pop("_lap").alias("texture")
    )


#: Weights of a reference image's terms, and what is taken off below a limit (fixed values).
REFERENCE_WEIGHTS = {"coverage": 2.00, "keypoints": 1.50, "contrast": 0.50, "texture": 0.50, "non_dark": 0.35}
REFERENCE_PENALTIES = (("non_dark", 0.01, 1.0), ("keypoints", 100, 1.0), ("coverage", 0.10, 0.5))


def reference_score(keypoints: Column, coverage: Column, contrast: Column, texture: Column, non_dark: Column) -> Column:
    """How well an image serves as the reference of a search: saturating terms, less penalties."""
    raw = {"keypoints": keypoints, "coverage": coverage, "non_dark": non_dark}
    terms = {
        "coverage": coverage,
        "keypoints": F.tanh(keypoints / F.lit(1000.0)),
        "contrast": clamp(contrast / F.lit(64.0), 0.0, 1.0),
        "texture": clamp(F.log1p(texture) / F.log1p(F.lit(2000.0)), 0.0, 1.0),
        "non_dark": clamp(non_dark / F.lit(0.35), 0.0, 1.0),
    }
    total = F.lit(0.0)
    for name, weight in REFERENCE_WEIGHTS.items():
        total = total + F.lit(weight) * terms[name]
    for name, limit, off in REFERENCE_PENALTIES:
        total = total - F.when(raw[name] < limit, F.lit(off)).otherwise(F.lit(0.0))
    return total


def valid_box(raster: DataFrame, value: str = "value", nodata: float = 0.0) -> DataFrame:
    """Per image: the box of finite pixels other than ``nodata`` (ends exclusive)."""
    good = raster.filter(finite(F.col(value)) & (F.col(value) != nodata))
    return good.groupBy("image").agg(F.min("col").alias("x0"), F.min("row").alias("y0"), (F.max("col") + 1).alias("x1"), (F.max("row") + 1).alias("y1"))


def clipped(raster: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels within their image's box (x0, y0, x1, y1), counted from its corner."""
    x = raster.join(boxes, "image").filter("col >= x0 and col < x1 and row >= y0 and row < y1")
    return x.withColumns({"col": F.col("col") - F.col("x0"), "row": F.col("row") - F.col("y0")}).drop("x0", "y0", "x1", "y1")


def roi_from_mapping(mapping: DataFrame, margin: int, width: Column, height: Column, by: str = "frame_index", sizes: DataFrame | None = None) -> DataFrame:
    """Per frame: the window of mapped pixels (geoX, geoY) and a margin, within the image; no row without finite pixels.

    ``width`` and ``height`` are of all frames, or columns of ``sizes``, a row per frame.
    """
    good = mapping.filter(finite(F.col("geoX"), F.col("geoY")))
    ends = good.groupBy(by).agg(F.floor(F.min("geoX") - margin).alias("a"), F.ceil(F.max("geoX") + margin).alias("b"), F.floor(F.min("geoY") - margin).alias("c"), F.ceil(F.max("geoY") + margin).alias("d"))
    ends = ends if sizes is None else ends.join(sizes, by)
    first, last = (lambda c, n: clamp(F.col(c), 0, n - 1).cast("int")), (lambda c, low, n: clamp(F.col(c), low + 1, n).cast("int"))
    x0, y0 = first("a", width), first("c", height)
    x1, y1 = last("b", x0, width), last("d", y0, height)
    return ends.select(by, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), (x1 - x0).alias("roi_width"), (y1 - y0).alias("roi_height"))


#: How far each way of resampling reaches, as offsets from the pixel below the place.
TAPS = {"nearest": (0, 0), "bilinear": (0, 1), "cubic": (-1, 2)}


def _tap_weights(part: Column, method: str) -> list[Column]:
    """The weights of the taps along one axis, where ``part`` of a pixel lies beyond the pixel below; the cubic is Keys' with a = -1/2."""
    if method == "nearest":
        return [F.lit(1.0)]
    if method == "bilinear":
        return [F.lit(1.0) - part, part]
    near = lambda t: (F.lit(1.5) * t - F.lit(2.5)) * t * t + F.lit(1.0)
    far = lambda t: ((F.lit(-0.5) * t + F.lit(2.5)) * t - F.lit(4.0)) * t + F.lit(2.0)
    return [far(part + 1.0), near(part), near(F.lit(1.0) - part), far(F.lit(2.0) - part)]


def resampled(raster: DataFrame, grids: DataFrame, method: str = "nearest", nodata: float = 0.0, value: str = "value", ground: Change | None = None) -> DataFrame:
    """(image, row, col, value) of every pixel of the target grids, in the ground system that they share with the source,
    or in one that ``ground`` takes (x, y) of into the source's.

    raster: image, row, col and the value; grids: a row per target with image, width, height and gt of the target, and
    source_gt, source_width, source_height (six doubles each gt). A pixel's centre is looked up in the source by
    ``nearest``, ``bilinear`` or ``cubic``; source pixels that are absent, not finite or ``nodata`` count for nothing and
    the others' weights are scaled up. ``nodata`` outside the source, and where nothing is left.
    """
    return _resampled(raster, grids, method, nodata, value, ["image"], ground)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows and columns of the tiles in which a source meets the pixels that read it.
TILE = 16


def _tiles(raster: DataFrame, nodata: float, value: str, by: list[str]) -> DataFrame:
    """The source as tiles (``_ty``, ``_tx``): the sum of the values at each place of a tile (``_values``), and how many (``_counts``);
    null where there is none."""
    row, col = F.col("row").cast("int"), F.col("col").cast("int")
    tile = [*by, "_ty", "_tx"]
    good = raster.filter(finite(F.col(value)) & (F.col(value) != nodata))
    placed = good.select(*by, F.floor(row / F.lit(TILE)).cast("int").alias("_ty"), F.floor(col / F.lit(TILE)).cast("int").alias("_tx"), (F.pmod(row, F.lit(TILE)) * TILE + F.pmod(col, F.lit(TILE))).alias("_place"), F.col(value).cast("double").alias("_v"))
    each = placed.repartition(_parts(raster), *tile).groupBy(*tile, "_place").agg(F.sum("_v").alias("_v"), F.count("_v").cast("double").alias("_n"))
    held = each.groupBy(*tile).agg(F.map_from_entries(F.collect_list(F.struct("_place", F.struct("_v", "_n")))).alias("_held"))
    # the map is a lambda's argument, so that it's made once and not anew for each place
    dense = F.transform(F.array("_held"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), lambda i: F.try_element_at(m, i)))
    return held.withColumn("_all", dense[0]).select(*tile, F.col("_all._v").alias("_values"), F.col("_all._n").alias("_counts"))


def _resampled(raster: DataFrame, grids: DataFrame, method: str, nodata: float, value: str, by: list[str], ground: Change | None = None) -> DataFrame:
    low, high = TAPS[method]
    g, s = F.col("gt"), F.col("source_gt")
    # a grid is one row that becomes millions: its lines are dealt out before they become pixels, and the join below is
    # a sorted merge whatever size the plan expects, as it takes pixels for as few as the grids they come from
    lines = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    pixels = lines.repartition(_parts(grids), "image", "row").withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    i, j = F.col("col") + 0.5, F.col("row") + 0.5
    x, y = g[0] + i * g[1] + j * g[2], g[3] + i * g[4] + j * g[5]
    x, y = ground(x, y) if ground else (x, y)
    dx, dy = F.col("_gx") - s[0], F.col("_gy") - s[3]
    det = s[1] * s[5] - s[2] * s[4]
    at = pixels.withColumns({"_gx": x, "_gy": y}).select("image", "row", "col", "source_width", "source_height", ((s[5] * dx - s[2] * dy) / det).alias("_x"), ((s[1] * dy - s[4] * dx) / det).alias("_y"))
    back = 0.0 if method == "nearest" else 0.5
    inside = F.coalesce(F.expr("_x >= 0 and _x < source_width and _y >= 0 and _y < source_height"), F.lit(False))
    placed = at.select("image", "row", "col", inside.alias("_in"), *((F.col(f"_{a}") - back).alias(f"_{a}") for a in "xy")).withColumns({f"_{a}0": F.floor(f"_{a}").cast("int") for a in "xy"})
    asked = placed.select("image", "row", "col", "_in", "_x0", "_y0", *((F.col(f"_{a}") - F.col(f"_{a}0")).alias(f"_d{a}") for a in "xy"))
    # a pixel goes once to each tile that its taps touch, not once to each tap; one outside goes by its own place, as it reads none
    n = range(high - low + 1)
    for axis, own in (("x", "col"), ("y", "row")):
        touched = F.sequence(*(F.floor((F.col(f"_{axis}0") + k) / F.lit(TILE)).cast("int") for k in (low, high)))
        asked = asked.withColumn(f"_t{axis}", F.explode(F.when(F.col("_in"), touched).otherwise(F.array(F.col(own).cast("int")))))
        asked = asked.withColumn(f"_l{axis}", F.col(f"_{axis}0") + low - F.col(f"_t{axis}") * TILE)
    weights = {}
    for axis in "xy":
        for k, weight in enumerate(_tap_weights(F.col(f"_d{axis}"), method)):
            here = F.col("_in") & (F.col(f"_l{axis}") + k).between(0, TILE - 1)
            weights[f"_w{axis}{k}"] = F.when(here, weight).otherwise(F.lit(0.0))
    asked = asked.withColumns(weights | {"_place": F.col("_ly") * TILE + F.col("_lx")}).drop("_in", "_x0", "_y0", "_dx", "_dy", "_lx", "_ly")
    met = asked.hint("merge").join(_tiles(raster, nodata, value, by).hint("merge"), [*by, "_ty", "_tx"], "left")

    def added(c: str) -> Column:
        """What a tile has at a pixel's taps, by their weights; a tap outside the tile weighs nothing here."""
        total = F.lit(0.0)
        for j in n:
            line = F.lit(0.0)
            for i in n:
                line = line + F.col(f"_wx{i}") * F.coalesce(F.get(F.col(c), F.col("_place") + (j * TILE + i)), F.lit(0.0))
            total = total + F.col(f"_wy{j}") * line
        return total

    shares = met.select("image", "row", "col", added("_counts").alias("_w"), added("_values").alias("_v"))
    sums = shares.groupBy("image", "row", "col").agg(F.sum("_w").alias("_w"), F.sum("_v").alias("_v"))
    return sums.select("image", "row", "col", F.when(F.abs("_w") > 1e-6, F.col("_v") / F.col("_w")).alias(value)).fillna(nodata, [value])


def resampled_from_one(raster: DataFrame, grids: DataFrame, method: str = "nearest", nodata: float = 0.0, value: str = "value", ground: Change | None = None) -> DataFrame:
    """``resampled`` where all targets read one source (row, col and the value, no image)."""
    return _resampled(raster, grids, method, nodata, value, [], ground)


def window_transform(gt: Column, x0: Column, y0: Column) -> Column:
    """The transform of a window that begins at pixel (x0, y0) of a raster with ``gt``."""
    return F.array(gt[0] + x0 * gt[1] + y0 * gt[2], gt[1], gt[2], gt[3] + x0 * gt[4] + y0 * gt[5], gt[4], gt[5])


def resized(raster: DataFrame, sizes: DataFrame, value: str = "value") -> DataFrame:
    """Images of other sizes by linear interpolation between pixel centres, the edge's value beyond the outermost ones.

    sizes: image, width, height (wanted), source_width, source_height.
    """
    along = lambda w, h: F.array(F.lit(0.0), w, F.lit(0.0), F.lit(0.0), F.lit(0.0), h)
    grids = sizes.withColumns({"gt": along(F.col("source_width") / F.col("width"), F.col("source_height") / F.col("height")), "source_gt": along(F.lit(1.0), F.lit(1.0))})
    return resampled(raster, grids, "bilinear", float("inf"), value)


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a colour by the usual shares of its parts, rounded to a whole number."""
    return F.floor(F.lit(0.299) * red + F.lit(0.587) * green + F.lit(0.114) * blue + F.lit(0.5)).cast("int")


#: The largest image that a warp may make (fixed values).
MOST_SIDE, MOST_PIXELS = 50_000, 2_500_000_000


def warp_size(edges: DataFrame, sizes: DataFrame, by: str = "frame_index", most_side: int = MOST_SIDE, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """Per image the north-up grid that its warp would fill, and whether that is of a sensible size (``fits``).

    edges: places (x, y) along an image's edge, its corners (0, 0) and (width, height) among them, with the ground (u, v)
    that they go to; sizes: ``by``, width, height. The pixel is as long as keeps the diagonal's number of pixels.
    """
    corner = lambda c, x, y: F.max(F.when((F.col("x") == x) & (F.col("y") == y), F.col(c)))
    zero, w, h = F.lit(0.0), F.col("width"), F.col("height")
    ends = edges.join(sizes.select(by, "width", "height"), by).groupBy(by, "width", "height").agg(
        F.min("u").alias("_u0"), F.max("u").alias("_u1"), F.min("v").alias("_v0"), F.max("v").alias("_v1"),
        (corner("u", w, h) - corner("u", zero, zero)).alias("_du"), (corner("v", w, h) - corner("v", zero, zero)).alias("_dv"),
    )
    pixel = F.sqrt(F.col("_du") * F.col("_du") + F.col("_dv") * F.col("_dv")) / F.sqrt((w * w + h * h).cast("double"))
    sized = ends.withColumn("pixel", F.when(pixel > 0, pixel))
    along = lambda a, b: F.greatest(F.lit(1), F.floor((F.col(b) - F.col(a)) / F.col("pixel") + 0.5)).cast("long")
    sized = sized.withColumns({"warp_width": F.when(F.col("pixel") > 0, along("_u0", "_u1")), "warp_height": F.when(F.col("pixel") > 0, along("_v0", "_v1"))})
    fits = (F.col("warp_width") <= most_side) & (F.col("warp_height") <= most_side) & (F.col("warp_width") * F.col("warp_height") <= most_pixels)
    gt = F.array(F.col("_u0"), F.col("pixel"), zero, F.col("_v1"), zero, -F.col("pixel"))
    return sized.select(by, "warp_width", "warp_height", F.coalesce(fits, F.lit(False)).alias("fits"), gt.alias("gt"))


def extent_check(points: DataFrame, by: str = "frame_index", most: float = 60.0, least_points: int = 6) -> DataFrame:
    """Per frame: how far its points spread, and whether a warp may be tried."""
    good = finite(F.col("mapX"), F.col("mapY"))
    x, y = F.when(good, F.col("mapX")), F.when(good, F.col("mapY"))
    spread = points.groupBy(by).agg(F.count(x).alias("n_points"), (F.max(x) - F.min(x)).alias("lon_span"), (F.max(y) - F.min(y)).alias("lat_span"))
    valid = F.coalesce((F.col("lon_span") < most) & (F.col("lat_span") < most), F.lit(False))
    return spread.withColumns({"valid_extent": valid, "can_warp": valid & (F.col("n_points") >= least_points)})


def flow_sign(correction: Column, definition: Column) -> Column:
    """+1 or -1, as a flow's metadata say in words; +1 if they don't."""
    said = lambda text: F.when(F.lower(text).contains("old_pixel + flow"), 1.0).when(F.lower(text).contains("old_pixel - flow"), -1.0)
    return F.coalesce(said(correction), said(definition), F.lit(1.0))


def corrected_points(points: DataFrame, mapping: DataFrame, flow: DataFrame, frames: DataFrame, max_px: float | None = None) -> DataFrame:
    """Control points moved by the flow at their pixel.

    points: frame_index, row_ordinal, mapX, mapY; mapping: frame_index, row_ordinal, geoX, geoY (rows pair by ordinal, as
    far as both go); flow: image (a frame_index), row, col, dx, dy in a window; frames: frame_index, x0, y0 of the
    window, sign, gt (six doubles). Frames without flow or metadata drop out. Every finite pixel gets a new place, so
    that points outside the flow are put on the pixel grid too.
    """
    both = points.join(mapping.select("frame_index", "row_ordinal", "geoX", "geoY"), ["frame_index", "row_ordinal"]).join(frames, "frame_index")
    pixel = finite(F.col("geoX"), F.col("geoY"))
    asked = both.select(F.col("frame_index").alias("image"), "row_ordinal", (F.col("geoX") - F.col("x0")).alias("x"), (F.col("geoY") - F.col("y0")).alias("y"))
    sampled = bilinear(asked, flow, ["dx", "dy"], ["image", "row_ordinal"]).select(F.col("image").alias("frame_index"), "row_ordinal", "sampled_dx", "sampled_dy")
    rows = both.join(sampled, ["frame_index", "row_ordinal"])
    inside = finite(F.col("sampled_dx"), F.col("sampled_dy"))
    dx, dy = (F.when(inside, F.col("sign") * F.col(f"sampled_{d}")).otherwise(F.lit(0.0)) for d in ("dx", "dy"))
    rows = rows.withColumns({"_px": pixel, "flow_inside": (inside & pixel).cast("int"), "dX_raw": dx, "dY_raw": dy})
    size = F.sqrt(F.col("dX_raw") * F.col("dX_raw") + F.col("dY_raw") * F.col("dY_raw"))
    large = (size > max_px) if max_px is not None else F.lit(False)
    reason = F.when(~F.col("_px"), "non_finite_mapping_pixel").when(F.col("flow_inside") == 0, "outside_flow_roi").when(large, "too_large_filtered").when(size > 1e-9, "applied").otherwise("zero_flow")
    rows = rows.withColumn("correction_reason", reason).withColumn("flow_applied", (F.col("correction_reason") == "applied").cast("int"))
    used = lambda c: F.when(F.col("flow_applied") == 1, F.col(c)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_dx": used("dX_raw"), "_dy": used("dY_raw")})
    place = pixel_to_geo(F.col("geoX") + F.col("_dx"), F.col("geoY") + F.col("_dy"), [F.col("gt")[i] for i in range(6)])
    rows = rows.withColumn("_new", place)
    moved = lambda c, old: F.when(F.col("_px"), F.col(f"_new.{c}")).otherwise(F.col(old))
    return rows.select("frame_index", "row_ordinal", moved("x", "mapX").alias("mapX"), moved("y", "mapY").alias("mapY"), F.col("mapX").alias("mapX_first"), F.col("mapY").alias("mapY_first"), "geoX", "geoY", "dX_raw", "dY_raw", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).alias("correction_mag"), "flow_inside", "flow_applied", "correction_reason")


def correction_status(frames: DataFrame, points: DataFrame, mapping: DataFrame, flow: DataFrame, meta: DataFrame) -> DataFrame:
    """(frame_index, status): ``ok``, or the first thing that keeps a frame from being corrected.

    frames: frame_index, width, height of its image as it is now; meta: frame_index, x0, y0, x1, y1, full_width,
    full_height as its flow was made (null sizes are taken as right); flow: image, row, col. A flow must be of its window's
    shape.
    """
    has = lambda x, c, name: x.select(F.col(c).alias("frame_index")).distinct().withColumn(name, F.lit(True))
    shape = flow.groupBy(F.col("image").alias("frame_index")).agg((F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    x = frames.select("frame_index", "width", "height").join(has(points, "frame_index", "_points"), "frame_index", "left").join(has(mapping, "frame_index", "_mapping"), "frame_index", "left")
    x = x.join(shape, "frame_index", "left").join(meta.select("frame_index", "x0", "y0", "x1", "y1", "full_width", "full_height").withColumn("_meta", F.lit(True)), "frame_index", "left")
    sizes = (F.coalesce("full_width", "width") != F.col("width")) | (F.coalesce("full_height", "height") != F.col("height"))
    window = (F.col("_w") != F.col("x1") - F.col("x0")) | (F.col("_h") != F.col("y1") - F.col("y0"))
    status = F.when(F.col("_points").isNull(), "missing points").when(F.col("_mapping").isNull(), "missing mapping").when(F.col("_w").isNull(), "missing flow")
    status = status.when(F.col("_meta").isNull(), "missing flow metadata").when(sizes, "image size differs").when(F.coalesce(window, F.lit(True)), "flow shape differs").otherwise("ok")
    return x.select("frame_index", status.alias("status"))


def correction_stats(corrected: DataFrame) -> DataFrame:
    """Per frame: counts, counts by reason as a map, and percentiles of the corrections."""
    reasons = corrected.groupBy("frame_index", "correction_reason").agg(F.count(F.lit(1)).alias("n"))
    maps = reasons.groupBy("frame_index").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("correction_reason", "n")))).alias("reason_counts"))
    p = F.percentile("correction_mag", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    sums = corrected.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n_points"), F.sum("flow_inside").alias("inside_flow_count"), F.sum("flow_applied").alias("applied_count"), p.alias("_p"), F.max("correction_mag").alias("max"))
    return sums.join(maps, "frame_index").select("frame_index", "n_points", "inside_flow_count", "applied_count", "reason_counts", F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p90"), F.col("_p")[2].alias("p95"), "max")


def grid_mesh(sizes: DataFrame, step: int, least: int) -> DataFrame:
    """A node grid per row of ``sizes`` (with width, height): about ``step`` apart, edges included, ``least`` nodes or more.

    While there are too few nodes, the axis with the wider spacing gets one more; that takes ``least`` rounds at most.
    """
    first = lambda s: F.greatest(F.lit(2), F.bround((F.col(s) - 1) / F.lit(float(max(step, 1)))).cast("int") + 1)
    wide = lambda n: F.col("width") / n["x"] >= F.col("height") / n["y"]
    grow = lambda n, _: F.when(n["x"] * n["y"] >= least, n).when(wide(n), F.struct((n["x"] + 1).alias("x"), n["y"].alias("y"))).otherwise(F.struct(n["x"].alias("x"), (n["y"] + 1).alias("y")))
    n = F.aggregate(F.sequence(F.lit(1), F.lit(max(least, 1))), F.struct(first("width").alias("x"), first("height").alias("y")), grow)
    sized = sizes.withColumn("_n", n).withColumns({"nx": F.col("_n.x"), "ny": F.col("_n.y")}).drop("_n")
    nodes = sized.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    along = lambda i, s, n: F.col(i) * ((F.col(s) - 1) / (F.col(n) - 1).cast("double"))
    return nodes.withColumns({"x": along("ix", "width", "nx"), "y": along("iy", "height", "ny")})


def grid_points(sizes: DataFrame, step: int) -> DataFrame:
    """Another grid: multiples of ``step``, and the far edge if it isn't one."""
    along = lambda s: F.array_distinct(F.concat(F.sequence(F.lit(0), F.col(s) - 1, F.lit(step)), F.array(F.col(s) - 1)))
    return sizes.withColumn("y", F.explode(along("height"))).withColumn("x", F.explode(along("width")))
