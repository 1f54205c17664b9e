"""Image kernels in numpy, run by Spark on one tile or image pair per row: thin-plate splines, likeness, flow, hulls.

A row holds one image's control points or one tile, whose size the tiling bounds; Spark deals the rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _radial(d2: np.ndarray) -> np.ndarray:
    return np.where(d2 > 0, d2 * np.log(np.maximum(d2, 1e-300)), 0.0)


def spline(x: np.ndarray, y: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Coefficients of the thin-plate spline through ``values`` (n, k) at (x, y): n weights and an affine part."""
    n = len(x)
    a, plane = np.zeros((n + 3, n + 3)), np.stack([np.ones(n), x, y], axis=1)
    a[:n, :n] = _radial((x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2)
    a[:n, n:] = plane
    a[n:, :n] = a[:n, n:].T
    right = np.concatenate([values, np.zeros((3, values.shape[1]))])
    if len(np.unique(plane, axis=0)) == n and np.linalg.matrix_rank(plane - [0, x.mean(), y.mean()]) == 3:
        return np.linalg.solve(a, right)
    return np.linalg.lstsq(a, right, rcond=None)[0]


def spline_at(coefficients: np.ndarray, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    basis = _radial((px[:, None] - x[None, :]) ** 2 + (py[:, None] - y[None, :]) ** 2)
    return np.concatenate([basis, np.stack([np.ones(len(px)), px, py], axis=1)], axis=1) @ coefficients


#: A frame of at most so many control points has a spline through all of them; one of more has NODES x NODES radial
#: functions fitted to all of them.
POINTS_SOLVED = 2000
NODES = 8
FITTED = NODES * NODES + 3


def solved(points: DataFrame, least: int = 6, solved_to: int = POINTS_SOLVED) -> DataFrame:
    """(frame_index, _x, _y, _c, _x0, _y0, _wide): a thin-plate spline per frame by all its control points (x, y) to (u, v).

    Up to ``solved_to`` control points are one array, and the spline goes through each. Larger frames are never gathered:
    radial functions at the nodes of a fixed grid over the frame, and a plane, are fitted to all points by least squares,
    whose normal equations are sums. Frames with fewer than ``least`` give no row.
    """
    points = points.select(F.col("frame_index").cast("int"), *(F.col(c).cast("double") for c in "xyuv"))
    wide = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    frames = points.groupBy("frame_index").agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.when(wide > 0, wide).otherwise(1.0).alias("_wide"))
    sized = points.join(frames.filter(F.col("_n") >= least), "frame_index")
    known = sized.filter(F.col("_n") <= solved_to).groupBy("frame_index").agg(F.sort_array(F.collect_list(F.struct("x", "y", "u", "v"))).alias("_points"))
    kinds = "frame_index int, _x array<double>, _y array<double>, _c array<double>"
    through = known.mapInPandas(_solve, kinds).withColumns({"_x0": F.lit(0.0), "_y0": F.lit(0.0), "_wide": F.lit(1.0)})
    unit = sized.filter(F.col("_n") > solved_to).select("frame_index", ((F.col("x") - F.col("_x0")) / F.col("_wide")).alias("x"), ((F.col("y") - F.col("_y0")) / F.col("_wide")).alias("y"), "u", "v")
    sums = unit.mapInPandas(_normal, "frame_index int, _at int, _sum double").groupBy("frame_index", "_at").agg(F.sum("_sum").alias("_sum"))
    packed = sums.groupBy("frame_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_sum"))), lambda s: s["_sum"]).alias("_sums"))
    fitted = packed.mapInPandas(_fit_nodes, kinds).join(frames.drop("_n"), "frame_index")
    return through.unionByName(fitted)


def solution_at(r: dict, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """(u, v) at the places, by a row of ``solved``."""
    x, y = np.array(r["_x"]), np.array(r["_y"])
    c = np.array(r["_c"]).reshape(len(x) + 3, 2)
    return spline_at(c, x, y, (px - r["_x0"]) / r["_wide"], (py - r["_y0"]) / r["_wide"])


#: Targets that travel together with one copy of their frame's coefficients (a power of two).
TOGETHER = 4096


def in_blocks(rows: DataFrame, *columns: str) -> DataFrame:
    """(frame_index, _them): the rows of a frame as arrays of at most TOGETHER structs."""
    block = F.shiftright(F.monotonically_increasing_id(), TOGETHER.bit_length() - 1)
    return rows.withColumn("_block", block).groupBy("frame_index", "_block").agg(F.collect_list(F.struct(*columns)).alias("_them")).drop("_block")


def warped(points: DataFrame, targets: DataFrame, least: int = 6, solved_to: int = POINTS_SOLVED) -> DataFrame:
    """targets (frame_index, x, y) with (u, v), by the spline of their frame (see ``solved``); none for frames without one.

    Targets of one frame may lie in any number of tasks. They go in blocks of ``TOGETHER``, and each block carries one copy
    of its frame's coefficients: 32 bytes for each control point that is solved, 2,000 at most.
    """

    def at(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in them:
            for r in batch.to_dict("records"):
                x, y = (np.array([t[c] for t in r["_them"]], float) for c in "xy")
                uv = solution_at(r, x, y)
                yield pd.DataFrame({"frame_index": r["frame_index"], "x": x, "y": y, "u": uv[:, 0], "v": uv[:, 1]})

    wanted = targets.select(F.col("frame_index").cast("int"), F.col("x").cast("double"), F.col("y").cast("double"))
    return in_blocks(wanted, "x", "y").join(solved(points, least, solved_to), "frame_index").mapInPandas(at, "frame_index int, x double, y double, u double, v double")


def _nodes() -> tuple[np.ndarray, np.ndarray]:
    x, y = np.meshgrid(np.linspace(0, 1, NODES), np.linspace(0, 1, NODES))
    return x.ravel(), y.ravel()


def _normal(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's part of the frames' normal equations, by place."""
    for batch in them:
        for frame, g in batch.groupby("frame_index", sort=False):
            d = spline_at(np.eye(FITTED), *_nodes(), g["x"].to_numpy(float), g["y"].to_numpy(float))
            both = np.concatenate([(d.T @ d).ravel(), (d.T @ g[["u", "v"]].to_numpy(float)).ravel()])
            yield pd.DataFrame({"frame_index": frame, "_at": np.arange(len(both)), "_sum": both})


def _fit_nodes(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    x, y = _nodes()
    for batch in them:
        sums = [np.array(s) for s in batch["_sums"]]
        c = [np.linalg.lstsq(s[: FITTED**2].reshape(FITTED, FITTED), s[FITTED**2 :].reshape(FITTED, 2), rcond=1e-13)[0] for s in sums]
        yield batch[["frame_index"]].assign(_x=[x.tolist()] * len(c), _y=[y.tolist()] * len(c), _c=[m.ravel().tolist() for m in c])


def _solve(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in them:
        rows = []
        for frame, points in zip(batch["frame_index"], batch["_points"], strict=True):
            p = np.array([(q["x"], q["y"], q["u"], q["v"]) for q in points], dtype=float)
            rows.append((frame, p[:, 0].tolist(), p[:, 1].tolist(), spline(p[:, 0], p[:, 1], p[:, 2:]).reshape(-1).tolist()))
        yield pd.DataFrame(rows, columns=["frame_index", "_x", "_y", "_c"])


def likeness_map(a: np.ndarray, b: np.ndarray, side: int = 7, span: float = 255.0) -> np.ndarray:
    """The structural similarity of two images in each side x side window; none if the images are smaller."""
    a, b = a.astype(float), b.astype(float)
    if min(a.shape) < side:
        return np.zeros((0, 0))
    view = lambda m: np.lib.stride_tricks.sliding_window_view(m, (side, side)).mean(axis=(2, 3))
    fair = side * side / (side * side - 1.0)
    ma, mb = view(a), view(b)
    va, vb, cab = fair * (view(a * a) - ma * ma), fair * (view(b * b) - mb * mb), fair * (view(a * b) - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return ((2 * ma * mb + c1) * (2 * cab + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))


def structural_likeness(a: np.ndarray, b: np.ndarray, side: int = 7, span: float = 255.0) -> float:
    """The mean structural similarity of two images over side x side windows."""
    found = likeness_map(a, b, side, span)
    return float(found.mean()) if found.size else float("nan")


def masked_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness within the box of what is brighter than the first image's darkest part, or of all where that is little."""
    mask = a > max(3, int(np.percentile(a, 15)))
    if mask.mean() >= 0.05:
        rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        box = np.s_[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
        a, b = a[box], b[box]
    return structural_likeness(a, b)


def _smoothed(m: np.ndarray, reach: int) -> np.ndarray:
    padded = np.pad(m, reach, mode="edge")
    size = 2 * reach + 1
    sums = np.cumsum(np.cumsum(np.pad(padded, ((1, 0), (1, 0))), axis=0), axis=1)
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / size**2


#: Of the polynomial expansion (fixed values): half the side and the spread of its weights; half the side of the window
#: that displacements are averaged over; rounds and levels.
EXPANSION_REACH, EXPANSION_SPREAD = 3, 1.5
FLOW_REACH, FLOW_ROUNDS, FLOW_LEVELS = 9, 3, 3


def expansion(m: np.ndarray) -> np.ndarray:
    """(5, H, W): around each pixel the weighted least-squares polynomial's coefficients of x, y, x^2, y^2 and xy."""
    k = np.arange(-EXPANSION_REACH, EXPANSION_REACH + 1)
    g = np.exp(-(k**2) / (2 * EXPANSION_SPREAD**2))
    g /= g.sum()
    s2, s4 = float(g @ k**2), float(g @ k**4)

    def along(m: np.ndarray, axis: int, power: int) -> np.ndarray:
        padded = np.pad(m, [(EXPANSION_REACH, EXPANSION_REACH) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        return np.tensordot(np.lib.stride_tricks.sliding_window_view(padded, len(k), axis=axis), g * k**power, axes=(2, 0))

    rows = [along(m, 0, power) for power in range(3)]
    one, x, y = along(rows[0], 1, 0), along(rows[0], 1, 1), along(rows[1], 1, 0)
    xx, yy, xy = along(rows[0], 1, 2), along(rows[2], 1, 0), along(rows[1], 1, 1)
    back = np.linalg.inv([[1, s2, s2], [s2, s4, s2 * s2], [s2, s2 * s2, s4]])
    _, cxx, cyy = np.tensordot(back, np.stack([one, xx, yy]), axes=1)
    return np.stack([x / s2, y / s2, cxx, cyy, xy / s2**2])


def dense_flow(a: np.ndarray, b: np.ndarray, levels: int = FLOW_LEVELS, reach: int = FLOW_REACH, rounds: int = FLOW_ROUNDS) -> np.ndarray:
    """(H, W, 2) displacements from ``a`` to ``b`` by polynomial expansion (Farnebaeck 2003), from coarse to fine.

    Where both images are quadratic around a pixel, the change of the linear part gives the displacement; it is solved for
    over a window, and the second image is looked at where the displacement so far leads.
    """
    a, b = a.astype(float), b.astype(float)
    if levels > 1 and min(a.shape) >= 16:
        halve = lambda m: _smoothed(m, 1)[::2, ::2]
        flow = 2 * np.repeat(np.repeat(dense_flow(halve(a), halve(b), levels - 1, reach, rounds), 2, axis=0), 2, axis=1)[: a.shape[0], : a.shape[1]]
    else:
        flow = np.zeros((*a.shape, 2))
    rows, cols = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    one, other = expansion(a), expansion(b)
    for _ in range(rounds):
        at = [sampled(c, cols + flow[..., 0], rows + flow[..., 1]) for c in other]
        xx, yy, xy = ((one[i] + at[i]) / 2 for i in (2, 3, 4))
        xy = xy / 2
        dx = (one[0] - at[0]) / 2 + xx * flow[..., 0] + xy * flow[..., 1]
        dy = (one[1] - at[1]) / 2 + xy * flow[..., 0] + yy * flow[..., 1]
        g11, g12, g22, h1, h2 = (_smoothed(m, reach) for m in (xx * xx + xy * xy, xy * (xx + yy), yy * yy + xy * xy, xx * dx + xy * dy, xy * dx + yy * dy))
        det = g11 * g22 - g12 * g12
        ok = det > 1e-9 * np.maximum(g11 + g22, 1e-12) ** 2
        flow = np.where(ok[..., None], np.stack([g22 * h1 - g12 * h2, g11 * h2 - g12 * h1], axis=-1) / np.where(ok, det, 1.0)[..., None], flow)
    return flow


def sampled(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between the pixels of ``m``, the nearest edge beyond them."""
    x, y = np.clip(x, 0, m.shape[1] - 1), np.clip(y, 0, m.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, m.shape[1] - 1), np.minimum(y0 + 1, m.shape[0] - 1)
    fx, fy = x - x0, y - y0
    return (m[y0, x0] * (1 - fx) + m[y0, x1] * fx) * (1 - fy) + (m[y1, x0] * (1 - fx) + m[y1, x1] * fx) * fy


def _tile(values, height: int, width: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(int(height), int(width))


def tile_likeness(pairs: DataFrame) -> DataFrame:
    """Per row of image, height, width, a, b (arrays of pixels by row): its likeness."""
    def score(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in them:
            yield x[["image"]].assign(likeness=[masked_likeness(_tile(a, h, w), _tile(b, h, w)) for a, b, h, w in zip(x["a"], x["b"], x["height"], x["width"], strict=True)])

    return pairs.mapInPandas(score, f"image {pairs.schema['image'].dataType.simpleString()}, likeness double")


def tile_flow(pairs: DataFrame) -> DataFrame:
    """Per pixel of each pair of tiles: (image, row, col, dx, dy)."""
    def flows(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in them:
            for image, a, b, h, w in zip(x["image"], x["a"], x["b"], x["height"], x["width"], strict=True):
                f = dense_flow(_tile(a, h, w), _tile(b, h, w))
                rows, cols = np.mgrid[:h, :w]
                yield pd.DataFrame({"image": image, "row": rows.ravel(), "col": cols.ravel(), "dx": f[..., 0].ravel(), "dy": f[..., 1].ravel()})

    return pairs.mapInPandas(flows, f"image {pairs.schema['image'].dataType.simpleString()}, row int, col int, dx double, dy double")


#: Rows and columns of an image that one tile answers for.
TILE = 512
#: Rows and columns beyond these that a flow tile sees: three rounds of reach 9 and an expansion of reach 3 at three levels are 210,
#: the rest is for displacements.
#: Both are multiples of 4, so that a tile is halved at the same places as the whole image.
MARGIN = 304


def _in_tiles(pixels: DataFrame, ends) -> DataFrame:
    """A row per tile (image, _tile, _across): row0, col0, height, width, a, b.

    ``ends`` says of "row" and of "col" in which tiles a pixel lies, from the first to the last; so a tile is bounded in
    height and width, whatever the image's size.
    """
    dealt = pixels.withColumn("_tile", F.explode(F.sequence(*ends("row")))).withColumn("_across", F.explode(F.sequence(*ends("col"))))
    packed = dealt.groupBy("image", "_tile", "_across").agg(F.array_sort(F.collect_list(F.struct("row", "col", "a", "b"))).alias("_p"))
    corner, end = F.col("_p")[0], F.element_at("_p", -1)
    size = ((end["row"] - corner["row"] + 1).alias("height"), (end["col"] - corner["col"] + 1).alias("width"))
    return packed.select("image", "_tile", "_across", corner["row"].alias("row0"), corner["col"].alias("col0"), *size, F.transform("_p", lambda p: p["a"]).alias("a"), F.transform("_p", lambda p: p["b"]).alias("b"))


def _tile_of(row, tile: int):
    return F.floor(row / F.lit(float(tile))).cast("int")


def darkest(whole: DataFrame) -> DataFrame:
    """(image, _dark): what ``masked_likeness`` takes as dark, from counts of values by their whole part.

    whole: image, _v (the whole part), _n, and the least and greatest of these values (_least, _most).
    """
    up, group = Window.partitionBy("image").orderBy("_v"), Window.partitionBy("image")
    ranked = whole.withColumns({"_end": F.sum("_n").over(up), "_at": F.lit(0.15) * (F.sum("_n").over(group) - 1)})
    holds = lambda k: (F.col("_end") - F.col("_n") <= k) & (k < F.col("_end"))
    lower, upper = holds(F.floor("_at")), holds(F.ceil("_at"))
    low = ranked.groupBy("image").agg(
        F.max(F.when(lower, F.col("_v"))).alias("_v0"), F.max(F.when(upper, F.col("_v"))).alias("_v1"),
        F.max(F.when(lower, F.col("_most"))).alias("_x0"), F.max(F.when(upper, F.col("_least"))).alias("_x1"), F.max(F.col("_at") - F.floor("_at")).alias("_part"),
    )
    between = F.floor(F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("_part"))
    return low.select("image", F.greatest(F.lit(3), F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise(between)).alias("_dark"))


def _boxes(pixels: DataFrame) -> DataFrame:
    """Per image the box of ``masked_likeness``: the percentile from counts of whole values, without gathering pixels."""
    whole = pixels.groupBy("image", F.floor("a").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.min("a").alias("_least"), F.max("a").alias("_most"))
    lit = F.col("a") > F.col("_dark")
    ends = lambda c, f, part: f(F.when(lit, F.col(c)) if part else F.col(c))
    enough = F.avg(lit.cast("double")) >= 0.05
    box = [F.when(enough, ends(c, f, True)).otherwise(ends(c, f, False)).alias(n) for n, c, f in (("_row0", "row", F.min), ("_row1", "row", F.max), ("_col0", "col", F.min), ("_col1", "col", F.max))]
    return pixels.join(darkest(whole), "image").groupBy("image").agg(*box)


def image_likeness(pixels: DataFrame, side: int = 7, tile: int = TILE) -> DataFrame:
    """(image, likeness) of whole images of any size, from pixels (image, row, col, a, b): ``masked_likeness`` by tiles.

    Tiles overlap by side - 1 rows and columns, so each window lies in just one tile that answers for its first pixel; the
    images' sums and counts of windows give the same mean.
    """
    boxed = pixels.join(_boxes(pixels), "image").filter("row between _row0 and _row1 and col between _col0 and _col1").select("image", "row", "col", "a", "b")
    tiles = _in_tiles(boxed, lambda c: (F.greatest(F.lit(0), _tile_of(F.col(c) - (side - 1), tile)), _tile_of(F.col(c), tile)))

    def score(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in them:
            found = [
                likeness_map(_tile(t["a"], t["height"], t["width"]), _tile(t["b"], t["height"], t["width"]), side)[: max(0, (t["_tile"] + 1) * tile - t["row0"]), : max(0, (t["_across"] + 1) * tile - t["col0"])]
                for t in x.to_dict("records")
            ]
            yield x[["image"]].assign(total=[float(f.sum()) for f in found], n=[f.size for f in found])

    scored = tiles.mapInPandas(score, f"image {pixels.schema['image'].dataType.simpleString()}, total double, n long")
    return scored.groupBy("image").agg(F.when(F.sum("n") > 0, F.sum("total") / F.sum("n")).otherwise(F.lit(float("nan"))).alias("likeness"))


def image_flow(pixels: DataFrame, tile: int = TILE, margin: int = MARGIN) -> DataFrame:
    """(image, row, col, dx, dy) of every pixel of whole images of any size, from pixels (image, row, col, a, b).

    A tile also sees ``margin`` rows and columns on each side, which are more than ``dense_flow`` reaches, so its own pixels
    have the flow of the whole image (but for displacements beyond the margin).
    """
    last = pixels.groupBy("image").agg(*(_tile_of(F.max(c), tile).alias(f"_last_{c}") for c in ("row", "col")))
    tiles = _in_tiles(pixels.join(last, "image"), lambda c: (F.greatest(F.lit(0), _tile_of(F.col(c) - margin, tile)), F.least(f"_last_{c}", _tile_of(F.col(c) + margin, tile))))

    def flows(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in them:
            for t in x.to_dict("records"):
                h, w = t["height"], t["width"]
                f = dense_flow(_tile(t["a"], h, w), _tile(t["b"], h, w))
                rows, cols = np.mgrid[t["row0"] : t["row0"] + h, t["col0"] : t["col0"] + w]
                own = (rows // tile == t["_tile"]) & (cols // tile == t["_across"])
                yield pd.DataFrame({"image": t["image"], "row": rows[own], "col": cols[own], "dx": f[..., 0][own], "dy": f[..., 1][own]})

    return tiles.mapInPandas(flows, f"image {pixels.schema['image'].dataType.simpleString()}, row int, col int, dx double, dy double")


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of (n, 2) points, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(them: np.ndarray) -> list:
        out: list = []
        for q in them:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def within_hull(nodes: DataFrame, matches: DataFrame, least: int = 12) -> DataFrame:
    """Grid nodes (image, x, y) inside the hull of their image's matches; all of an image if fewer than ``least`` would stay.

    Batches of matches come down to their own corners first, then an image's corners to one array of half-planes that
    Spark tests node by node.
    """
    kind = matches.schema["image"].dataType.simpleString()

    def partial(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in them:
            for image, g in batch.groupby("image", sort=False):
                at = hull(g[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({"image": image, "x": at[:, 0], "y": at[:, 1]})

    def corners(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in them:
            yield x[["image"]].assign(_hull=[hull(np.array([(q["x"], q["y"]) for q in p])).tolist() for p in x["_p"]])

    outer = matches.select("image", F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(partial, f"image {kind}, x double, y double")
    packed = outer.groupBy("image").agg(F.collect_set(F.struct("x", "y")).alias("_p"))
    kind = nodes.schema["image"].dataType.simpleString()
    edged = packed.mapInPandas(corners, f"image {kind}, _hull array<array<double>>")
    x = nodes.join(edged, "image", "left")
    h, n = F.col("_hull"), F.size("_hull")

    def left_of(i):
        a, b = h[i], h[(i + 1) % n]
        return (b[0] - a[0]) * (F.col("y") - a[1]) - (b[1] - a[1]) * (F.col("x") - a[0]) >= -1e-9

    inside = F.when(h.isNull() | (n < 3), True).otherwise(F.forall(F.sequence(F.lit(0), n - 1), left_of))
    x = x.withColumn("_in", inside)
    enough = x.groupBy("image").agg((F.count_if("_in") >= least).alias("_enough"))
    return x.join(enough, "image").filter("_in or not _enough").drop("_hull", "_in", "_enough")
