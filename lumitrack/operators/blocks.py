"""Rasters as tables of square blocks: made from pixels, given margins by their neighbours, resampled, sampled and compared.

A row is one block: image, block_row, block_col; row0, col0, height, width (the box of its pixels, cut at the image's end);
and for each band its pixels by row (``band``, doubles) with their least and greatest finite value (``band_low``,
``band_high``). A pixel that is absent or null is NaN, and a pixel without a value in any band is absent.

Pixels are an array of doubles and not packed bytes, so that Spark reads one of them in place: sampling at points needs no
Python. A block of 512 x 512 is 2 MB a band, and no row, message or group is larger than a block with its margins in both
bands (20 MB for flow), whatever the image's size.

Scale: what a block needs from its neighbours is cut out before it is shuffled; a task holds one block's surroundings.
Settings of an image (a box, a grid) reach its blocks by joins on the block, not on the image, so that one image may hold
all rows; blocks that they don't touch drop out there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumitrack.functions.numbers import finite
from lumitrack.operators import kernels
from lumitrack.operators.rasters import TAPS

#: Rows and columns of a block.
SIDE = 512
KEY = ["image", "block_row", "block_col"]
PLACE = ["row0", "col0", "height", "width"]


def _schema(like: DataFrame, bands: Sequence[str]) -> str:
    places = ", ".join(f"{c} int" for c in [*KEY[1:], *PLACE])
    return f"image {like.schema['image'].dataType.simpleString()}, {places}, " + ", ".join(f"`{b}` array<double>, `{b}_low` double, `{b}_high` double" for b in bands)


def _row(image, block_row: int, block_col: int, row0: int, col0: int, bands: dict[str, np.ndarray]) -> dict:
    """A block as a row; the bands have one shape."""
    height, width = next(iter(bands.values())).shape
    row = {"image": image, "block_row": block_row, "block_col": block_col, "row0": row0, "col0": col0, "height": height, "width": width}
    for name, m in bands.items():
        good = m[np.isfinite(m)]
        row |= {name: m.ravel(), f"{name}_low": good.min() if good.size else None, f"{name}_high": good.max() if good.size else None}
    return row


def _grid(values, height: int, width: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(int(height), int(width))


def _block_of(at: Column, side: int) -> Column:
    return F.floor(at / F.lit(float(side))).cast("int")


def blocks_of(raster: DataFrame, bands: Sequence[str] = ("value",), side: int = SIDE) -> DataFrame:
    """Blocks of pixels (image, row, col and the bands). A pixel given twice has the greatest of its values; pixels without an
    image or a place, or with a negative one, are none."""
    known = raster.filter("image is not null and row >= 0 and col >= 0").select(
        "image", _block_of(F.col("row"), side).alias("block_row"), _block_of(F.col("col"), side).alias("block_col"),
        F.col("row").cast("int").alias("_r"), F.col("col").cast("int").alias("_c"), *(F.col(b).cast("double").alias(b) for b in bands),
    )

    def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        image, i, j = key
        rows, cols = x["_r"].to_numpy() - i * side, x["_c"].to_numpy() - j * side
        made = {}
        for b in bands:
            made[b] = np.full((rows.max() + 1, cols.max() + 1), np.nan)
            np.fmax.at(made[b], (rows, cols), x[b].to_numpy(dtype=float))
        return pd.DataFrame([_row(image, i, j, i * side, j * side, made)])

    # shuffled once, by block; repeats are one row before they meet, so that a group has no more rows than a block has pixels
    most = [F.max(F.when(~F.isnan(b), F.col(b))).alias(b) for b in bands]
    once = known.repartition(*KEY).groupBy(*KEY, "_r", "_c").agg(*most)
    return once.groupBy(KEY).applyInPandas(pack, _schema(raster, bands))


def pixels_of(blocks: DataFrame, bands: Sequence[str] = ("value",)) -> DataFrame:
    """(image, row, col and the bands) of the pixels that are there."""
    def spread(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in them:
            for b in batch.to_dict("records"):
                m = np.stack([np.asarray(b[n], dtype=float) for n in bands])
                k = np.flatnonzero(~np.isnan(m).all(axis=0))
                yield pd.DataFrame({"image": b["image"], "row": b["row0"] + k // b["width"], "col": b["col0"] + k % b["width"]} | {n: m[i, k] for i, n in enumerate(bands)})

    return blocks.select("image", *PLACE, *bands).mapInPandas(spread, f"image {blocks.schema['image'].dataType.simpleString()}, row int, col int, " + ", ".join(f"`{b}` double" for b in bands))


def sizes_of(blocks: DataFrame) -> DataFrame:
    """(image, width, height); reads no pixels."""
    return blocks.groupBy("image").agg(F.max(F.col("col0") + F.col("width")).alias("width"), F.max(F.col("row0") + F.col("height")).alias("height"))


# --- blocks on the ground, stored


def placed(blocks: DataFrame, grounds: DataFrame) -> DataFrame:
    """Blocks with their own transform ``gt`` and the box of ground that they cover (west, east, south, north).

    grounds: image, gt (six doubles); an image without one drops out.
    """
    g, x, y, w, h = F.col("_gt"), F.col("col0"), F.col("row0"), F.col("width"), F.col("height")
    corner = lambda i, j: (g[0] + i * g[1] + j * g[2], g[3] + i * g[4] + j * g[5])
    four = [corner(x, y), corner(x + w, y), corner(x, y + h), corner(x + w, y + h)]
    own = F.array(four[0][0], g[1], g[2], four[0][1], g[4], g[5])
    ends = {n: f(*(c[axis] for c in four)) for n, f, axis in (("west", F.least, 0), ("east", F.greatest, 0), ("south", F.least, 1), ("north", F.greatest, 1))}
    return blocks.join(grounds.select("image", F.col("gt").alias("_gt")), "image").withColumns({"gt": own} | ends).drop("_gt")


def in_extent(blocks: DataFrame, west: float = -math.inf, east: float = math.inf, south: float = -math.inf, north: float = math.inf) -> DataFrame:
    """Placed blocks that share ground with a box, open where no end is given (a transform may go on past 180 degrees or a
    pole); of stored ones, row groups that can't are not read."""
    return blocks.filter((F.col("west") < east) & (F.col("east") > west) & (F.col("south") < north) & (F.col("north") > south))


def write_blocks(blocks: DataFrame, path: str, group_bytes: int = 64 << 20) -> None:
    """Neighbouring blocks lie in one file, and a row group holds few, so that its ends say where it is."""
    near = blocks.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    near.write.option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 4).option("parquet.block.size.row.check.max", 16).option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- neighbours


@dataclass(frozen=True)
class Patch:
    """A block with what lies around it: ``bands`` begin at (row0, col0); its own pixels begin ``top`` rows and ``left``
    columns further on and are ``height`` x ``width``."""

    image: object
    block_row: int
    block_col: int
    row0: int
    col0: int
    top: int
    left: int
    height: int
    width: int
    bands: dict[str, np.ndarray]

    @property
    def own(self) -> tuple[slice, slice]:
        return slice(self.top, self.top + self.height), slice(self.left, self.left + self.width)


def around(blocks: DataFrame, bands: Sequence[str], before: int, after: int, work: Callable[[Patch], dict | None], schema: str, side: int = SIDE, boxed: bool = False) -> DataFrame:
    """``work`` (a row, or None for none) on each block with ``before`` rows and columns of what lies above and left of it
    and ``after`` of what lies below and right, as far as the image goes.

    Each block sends its neighbours just the strips that they see. With ``boxed``, blocks have _row0, _row1, _col0, _col1
    (ends included), and what lies outside is as if it weren't there.
    """
    ends = ["_row0", "_row1", "_col0", "_col1"] if boxed else []
    places = ", ".join(f"{c} int" for c in [*KEY[1:], *PLACE])
    sent = f"image {blocks.schema['image'].dataType.simpleString()}, {places}, own boolean, " + ", ".join(f"`{b}` array<double>" for b in bands)
    # only in these targets does a part of [start, end) lie, once margins are added
    reached = lambda start, end: range(max(0, (start - after) // side), (end - 1 + before) // side + 1)
    part = lambda t, start, end: (max(start, t * side - before), min(end, (t + 1) * side + after))

    def send(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in them:
            for b in batch.to_dict("records"):
                m = {n: _grid(b[n], b["height"], b["width"]) for n in bands}
                r0, r1, c0, c1 = b["row0"], b["row0"] + b["height"], b["col0"], b["col0"] + b["width"]
                if boxed:
                    r0, r1, c0, c1 = max(r0, b["_row0"]), min(r1, b["_row1"] + 1), max(c0, b["_col0"]), min(c1, b["_col1"] + 1)
                rows = []
                for i in reached(r0, r1) if r0 < r1 and c0 < c1 else ():
                    top, bottom = part(i, r0, r1)
                    for j in reached(c0, c1):
                        left, right = part(j, c0, c1)
                        if top < bottom and left < right:
                            cut = np.s_[top - b["row0"] : bottom - b["row0"], left - b["col0"] : right - b["col0"]]
                            rows.append({"image": b["image"], "block_row": i, "block_col": j, "row0": top, "col0": left, "height": bottom - top, "width": right - left, "own": (i, j) == (b["block_row"], b["block_col"])} | {n: m[n][cut].ravel() for n in bands})
                if rows:
                    yield pd.DataFrame(rows)

    def meet(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        own = parts[parts["own"]]
        if own.empty:
            return pd.DataFrame()
        row0, col0 = int(parts["row0"].min()), int(parts["col0"].min())
        shape = int((parts["row0"] + parts["height"]).max()) - row0, int((parts["col0"] + parts["width"]).max()) - col0
        whole = {n: np.full(shape, np.nan) for n in bands}
        for p in parts.to_dict("records"):
            for n in bands:
                whole[n][p["row0"] - row0 : p["row0"] - row0 + p["height"], p["col0"] - col0 : p["col0"] - col0 + p["width"]] = _grid(p[n], p["height"], p["width"])
        o = own.iloc[0]
        done = work(Patch(key[0], key[1], key[2], row0, col0, int(o["row0"]) - row0, int(o["col0"]) - col0, int(o["height"]), int(o["width"]), whole))
        return pd.DataFrame([done]) if done else pd.DataFrame()

    return blocks.select(*KEY, *PLACE, *ends, *bands).mapInPandas(send, sent).groupBy(KEY).applyInPandas(meet, schema)


def _keys(images: DataFrame, rows: tuple[Column, Column], cols: tuple[Column, Column], side: int) -> DataFrame:
    """A row of ``images`` for each block that its rows and columns (ends included) touch; none if an end is before its start."""
    along = lambda a, b: F.explode(F.when(a <= b, F.sequence(_block_of(a, side), _block_of(b, side))))
    return images.withColumn("block_row", along(*rows)).withColumn("block_col", along(*cols))


def flow(blocks: DataFrame, a: str = "a", b: str = "b", margin: int = kernels.MARGIN, side: int = SIDE) -> DataFrame:
    """Blocks with bands dx and dy: ``dense_flow`` from band ``a`` to band ``b`` over whole images.

    Pixels without a finite value in either count as 0 and have no displacement of their own.
    """
    if side % 4 or margin % 4:
        raise ValueError("side and margin must be multiples of 4, so that blocks are halved where the whole image is")

    def work(p: Patch) -> dict:
        there = np.isfinite(p.bands[a]) & np.isfinite(p.bands[b])
        found = kernels.dense_flow(*(np.where(there, p.bands[n], 0.0) for n in (a, b)))
        d = {n: np.where(there, found[..., i], np.nan)[p.own] for i, n in enumerate(("dx", "dy"))}
        return _row(p.image, p.block_row, p.block_col, p.row0 + p.top, p.col0 + p.left, d)

    return around(blocks, [a, b], margin, margin, work, _schema(blocks, ["dx", "dy"]), side)


def _levels(blocks: DataFrame, band: str) -> DataFrame:
    """Per image and whole part of its values, whole ones apart: how many, their ends, and the box that they lie in."""
    names = {"_n": "long", "_least": "double", "_most": "double", "_row0": "int", "_row1": "int", "_col0": "int", "_col1": "int"}

    def count(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in them:
            for b in batch.to_dict("records"):
                v = np.asarray(b[band], dtype=float)
                k = np.flatnonzero(np.isfinite(v))
                v, rows, cols = v[k], b["row0"] + k // b["width"], b["col0"] + k % b["width"]
                x = pd.DataFrame({"_v": np.floor(v).astype("int64"), "_whole": np.floor(v) == v, "a": v, "r": rows, "c": cols})
                ends = x.groupby(["_v", "_whole"]).agg(_n=("a", "size"), _least=("a", "min"), _most=("a", "max"), _row0=("r", "min"), _row1=("r", "max"), _col0=("c", "min"), _col1=("c", "max"))
                yield ends.reset_index().assign(image=b["image"])[["image", "_v", "_whole", *names]]

    each = blocks.select("image", *PLACE, band).mapInPandas(count, f"image {blocks.schema['image'].dataType.simpleString()}, _v long, _whole boolean, " + ", ".join(f"{n} {t}" for n, t in names.items()))
    least = {"_least", "_row0", "_col0"}
    return each.groupBy("image", "_v", "_whole").agg(*((F.sum if n == "_n" else F.min if n in least else F.max)(n).alias(n) for n in names))


def likeness(blocks: DataFrame, a: str = "a", b: str = "b", window: int = 7, side: int = SIDE) -> DataFrame:
    """(image, likeness): ``masked_likeness`` of whole images, bands ``a`` and ``b``.

    The box of what is lit comes from counts of levels. A window belongs to the block of its first pixel; windows with a
    pixel that isn't there count for nothing. NaN where no window is left.
    """
    levels = _levels(blocks, a)
    dark = kernels.darkest(levels.groupBy("image", "_v").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most")))
    lit = (F.col("_v") > F.col("_dark")) | ((F.col("_v") == F.col("_dark")) & ~F.col("_whole"))
    enough = F.sum(F.when(lit, F.col("_n")).otherwise(0)) >= 0.05 * F.sum("_n")
    ends = [F.when(enough, f(F.when(lit, F.col(c)))).otherwise(f(c)).alias(c) for c, f in (("_row0", F.min), ("_row1", F.max), ("_col0", F.min), ("_col1", F.max))]
    boxes = levels.join(dark, "image").groupBy("image").agg(*ends)
    touched = blocks.join(_keys(boxes, (F.col("_row0"), F.col("_row1")), (F.col("_col0"), F.col("_col1")), side), KEY)

    def work(p: Patch) -> dict:
        found = kernels.likeness_map(p.bands[a], p.bands[b], window)[: p.height, : p.width]
        found = found[np.isfinite(found)]
        return {"image": p.image, "total": float(found.sum()), "n": int(found.size)}

    schema = f"image {blocks.schema['image'].dataType.simpleString()}, total double, n long"
    scored = around(touched, [a, b], 0, window - 1, work, schema, side, boxed=True)
    return scored.groupBy("image").agg(F.when(F.sum("n") > 0, F.sum("total") / F.sum("n")).otherwise(F.lit(float("nan"))).alias("likeness"))


# --- other grids


def _kernel(distance: np.ndarray, method: str) -> np.ndarray:
    """A tap's weight along one axis; the cubic is Keys' with a = -1/2."""
    t = np.abs(distance)
    if method == "bilinear":
        return np.maximum(1.0 - t, 0.0)
    return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1.0, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4.0) * t + 2.0, 0.0))


def resampled(blocks: DataFrame, grids: DataFrame, method: str = "nearest", nodata: float = 0.0, band: str = "value", side: int = SIDE) -> DataFrame:
    """Blocks of each image on its target grid (one row of ``grids`` an image), as ``rasters.resampled`` has it by pixels:
    image, width, height, gt; source_gt, source_width, source_height.

    A source block works out its own share of the weights and values of each target block that its pixels reach, within the
    box where they do; a target block adds its shares up. So nobody gathers a target's sources, however many there are.
    Source blocks beyond the target's box are not read from.
    """
    low, high = TAPS[method]
    back, reach = (0.0, 1) if method == "nearest" else (0.5, 3)
    g, s = F.col("gt"), F.col("source_gt")
    det = s[1] * s[5] - s[2] * s[4]
    four = []
    for i, j in ((F.lit(0), F.lit(0)), (F.col("width"), F.lit(0)), (F.lit(0), F.col("height")), (F.col("width"), F.col("height"))):
        dx, dy = g[0] + i * g[1] + j * g[2] - s[0], g[3] + i * g[4] + j * g[5] - s[3]
        four.append(((s[5] * dx - s[2] * dy) / det, (s[1] * dy - s[4] * dx) / det))
    span = lambda k, n: (F.greatest(F.floor(F.least(*(c[k] for c in four))) - reach, F.lit(0)), F.least(F.ceil(F.greatest(*(c[k] for c in four))) + reach, F.col(n) - 1))
    asked = grids.filter("width > 0 and height > 0").select("image", F.col("width").alias("_w"), F.col("height").alias("_h"), "gt", "source_gt", "source_width", "source_height", F.struct(*span(1, "source_height")).alias("_rows"), F.struct(*span(0, "source_width")).alias("_cols"))
    ends = lambda c: (F.col(c).getField("col1"), F.col(c).getField("col2"))
    wanted = _keys(asked, ends("_rows"), ends("_cols"), side).drop("_rows", "_cols")
    met = blocks.select(*KEY, *PLACE, band).join(wanted, KEY)
    kind = blocks.schema["image"].dataType.simpleString()
    places = ", ".join(f"{c} int" for c in [*KEY[1:], *PLACE])

    def share(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in them:
            for b in batch.to_dict("records"):
                rows = list(_shares(b, _grid(b[band], b["height"], b["width"])))
                if rows:
                    yield pd.DataFrame(rows)

    def _shares(b: dict, m: np.ndarray) -> Iterator[dict]:
        g, s = (np.asarray(b[n], dtype=float) for n in ("gt", "source_gt"))
        r0, c0, h, w = b["row0"], b["col0"], b["height"], b["width"]
        det = s[1] * s[5] - s[2] * s[4]
        # where this block's pixels, and those that see them, lie on the target
        x, y = np.array([c0 - reach, c0 + w + reach] * 2, dtype=float), np.repeat([r0 - reach, r0 + h + reach], 2).astype(float)
        gx, gy, back_det = s[0] + x * s[1] + y * s[2] - g[0], s[3] + x * s[4] + y * s[5] - g[3], g[1] * g[5] - g[2] * g[4]
        i, j = (g[5] * gx - g[2] * gy) / back_det, (g[1] * gy - g[4] * gx) / back_det
        left, right = max(0, int(np.floor(i.min())) - 1), min(int(b["_w"]), int(np.ceil(i.max())) + 1)
        top, bottom = max(0, int(np.floor(j.min())) - 1), min(int(b["_h"]), int(np.ceil(j.max())) + 1)
        for tr in range(top // side, -(-bottom // side) if top < bottom else 0):
            for tc in range(left // side, -(-right // side) if left < right else 0):
                row0, col0 = max(top, tr * side), max(left, tc * side)
                rows, cols = np.mgrid[row0 : min(bottom, (tr + 1) * side), col0 : min(right, (tc + 1) * side)]
                gx, gy = (g[k] + (cols + 0.5) * g[k + 1] + (rows + 0.5) * g[k + 2] - s[k] for k in (0, 3))
                x, y = (s[5] * gx - s[2] * gy) / det, (s[1] * gy - s[4] * gx) / det
                inside = (x >= 0) & (x < b["source_width"]) & (y >= 0) & (y < b["source_height"])
                x, y = x - back, y - back
                weights, values = np.zeros(x.shape), np.zeros(x.shape)
                for dy in range(low, high + 1):
                    yn = np.floor(y) + dy
                    wy = 1.0 if method == "nearest" else _kernel(y - yn, method)
                    for dx in range(low, high + 1):
                        xn = np.floor(x) + dx
                        weight = (np.ones(x.shape) if method == "nearest" else _kernel(x - xn, method)) * wy
                        k = np.flatnonzero(inside & (xn >= c0) & (xn < c0 + w) & (yn >= r0) & (yn < r0 + h) & (weight != 0))
                        v = m[yn.flat[k].astype(int) - r0, xn.flat[k].astype(int) - c0]
                        good = np.isfinite(v) & (v != nodata)
                        weights.flat[k[good]] += weight.flat[k[good]]
                        values.flat[k[good]] += weight.flat[k[good]] * v[good]
                if weights.any() or values.any():
                    yield {"image": b["image"], "block_row": tr, "block_col": tc, "row0": row0, "col0": col0, "height": x.shape[0], "width": x.shape[1], "_weight": weights.ravel(), "_sum": values.ravel()}

    shares = met.mapInPandas(share, f"image {kind}, {places}, _weight array<double>, _sum array<double>")
    # a target block is there even if nothing reaches it
    all_of = _keys(asked, (F.lit(0), F.col("_h") - 1), (F.lit(0), F.col("_w") - 1), side)
    here = lambda k, n: (F.col(k) * side, F.least(F.lit(side), F.col(n) - F.col(k) * side).cast("int"))
    (r, h), (c, w) = here("block_row", "_h"), here("block_col", "_w")
    empty = all_of.select(*KEY, r.alias("row0"), c.alias("col0"), h.alias("height"), w.alias("width"), *(F.lit(None).cast("array<double>").alias(n) for n in ("_weight", "_sum")))

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        image, i, j = key
        whole = parts[parts["_weight"].isnull()].iloc[0]
        weights, values = (np.zeros((int(whole["height"]), int(whole["width"]))) for _ in "ab")
        for p in parts[parts["_weight"].notnull()].sort_values(["row0", "col0", "height", "width"]).to_dict("records"):
            at = np.s_[p["row0"] - i * side : p["row0"] - i * side + p["height"], p["col0"] - j * side : p["col0"] - j * side + p["width"]]
            weights[at] += _grid(p["_weight"], p["height"], p["width"])
            values[at] += _grid(p["_sum"], p["height"], p["width"])
        found = np.abs(weights) > 1e-6
        return pd.DataFrame([_row(image, i, j, i * side, j * side, {band: np.where(found, values / np.where(found, weights, 1.0), nodata)})])

    return shares.unionByName(empty).groupBy(KEY).applyInPandas(add, _schema(blocks, [band]))


def sampled(points: DataFrame, blocks: DataFrame, bands: Sequence[str], key: Sequence[str], side: int = SIDE) -> DataFrame:
    """``points`` (image, x, y, ...) with ``sampled_<band>`` between the pixels around them, as ``rasters.bilinear`` has it for
    pixels that aren't NaN (such a pixel isn't there, so it counts for nothing where its weight is 0, else there is no value).

    ``key`` names columns that tell points apart (besides image). Spark reads the pixels inside the join. A point whose four
    pixels lie in one block is done with it; only those on the edge of two or four blocks are added up by key.
    """
    size = sizes_of(blocks).select("image", F.col("width").alias("_w"), F.col("height").alias("_h"))
    usable = finite(F.col("x"), F.col("y")) & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") <= F.col("_w") - 1) & (F.col("y") <= F.col("_h") - 1)
    x0, y0 = F.floor("x").cast("int"), F.floor("y").cast("int")
    ends = {"_x0": x0, "_y0": y0, "_x1": F.least(x0 + 1, F.col("_w") - 1), "_y1": F.least(y0 + 1, F.col("_h") - 1)}
    at = points.join(size, "image", "left").withColumn("_ok", F.coalesce(usable, F.lit(False)))
    at = at.withColumns({n: F.when(F.col("_ok"), v) for n, v in ends.items()}).drop("_w", "_h")
    spans = lambda e: (_block_of(F.col(f"_{e}0"), side), _block_of(F.col(f"_{e}1"), side))
    (rows, cols) = spans("y"), spans("x")
    alone = (rows[0] == rows[1]) & (cols[0] == cols[1])
    fx, fy = F.col("x") - F.col("_x0"), F.col("y") - F.col("_y0")
    corners = [("_x0", "_y0", (1 - fx) * (1 - fy)), ("_x1", "_y0", fx * (1 - fy)), ("_x0", "_y1", (1 - fx) * fy), ("_x1", "_y1", fx * fy)]
    table = blocks.select(F.col("image").alias("_image"), F.col("block_row").alias("_br"), F.col("block_col").alias("_bc"), *(F.col(c).alias(f"_{c}") for c in PLACE), *(F.col(b).alias(f"_band_{b}") for b in bands))
    on = (F.col("image") == F.col("_image")) & (F.col("_at.r") == F.col("_br")) & (F.col("_at.c") == F.col("_bc"))
    col, row = (lambda c: F.col(c) - F.col("_col0")), (lambda c: F.col(c) - F.col("_row0"))

    def parts(b: str) -> tuple[Column, Column]:
        """The weighted values, and the weights, of those of the four pixels that lie in the joined block and have a value."""
        values, weights = F.lit(0.0), F.lit(0.0)
        for x, y, weight in corners:
            there = (col(x) >= 0) & (col(x) < F.col("_width")) & (row(y) >= 0) & (row(y) < F.col("_height"))
            v = F.when(there, F.get(F.col(f"_band_{b}"), row(y) * F.col("_width") + col(x)))
            known = v.isNotNull() & ~F.isnan(v)
            values, weights = values + F.when(known, v * weight).otherwise(0.0), weights + F.when(known, weight).otherwise(0.0)
        return values, weights

    named = [c for c in points.columns]
    whole = lambda v, w: F.when(w > 1 - 1e-9, v)
    one = at.filter(alone | ~F.col("_ok")).withColumn("_at", F.struct(rows[0].alias("r"), cols[0].alias("c"))).join(table, on, "left")
    done = one.select(*named, *(whole(*parts(b)).alias(f"sampled_{b}") for b in bands))
    places = F.array_distinct(F.array(*(F.struct(_block_of(F.col(y), side).alias("r"), _block_of(F.col(x), side).alias("c")) for x, y, _ in corners)))
    split = at.filter(F.col("_ok") & ~alone).withColumn("_at", F.explode(places)).join(table, on, "left")
    sums = split.select(*named, *(c.alias(n) for b in bands for c, n in zip(parts(b), (f"_v_{b}", f"_w_{b}"), strict=True)))
    by = ["image", *key]
    added = sums.groupBy(by).agg(*(F.any_value(c).alias(c) for c in named if c not in by), *(F.sum(f"_{k}_{b}").alias(f"_{k}_{b}") for b in bands for k in "vw"))
    return done.unionByName(added.select(*named, *(whole(F.col(f"_v_{b}"), F.col(f"_w_{b}")).alias(f"sampled_{b}") for b in bands)))
