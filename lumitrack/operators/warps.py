"""Warps of whole grids by a bounded error: a spline is worked out at the corners of cells, and pixels interpolate.

A grid starts as square cells of ``SIDE`` pixels. In each, the spline at the middle and at the middles of its sides is held
against what the corners say; a cell that is off by more than half the tolerance anywhere is cut into four, down to one
pixel, whose middle is worked out itself. So a smooth warp takes nine evaluations for 4,096 pixels, and a bent one more
where it bends.

Scale: cells go in blocks with one copy of their frame's coefficients; each round keeps what it leaves, there are
log2(SIDE) + 1 of them at most; pixels are made from cells by Spark's own expressions and never go through Python.

Rows: a frame without a spline (see ``kernels.solved``) has no cells. Grids without pixels have none either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumitrack.operators import kernels
from lumitrack.plans.shared import kept

#: Pixels of a first cell's side (a power of two), and how far off, in units of (u, v), a pixel may be.
SIDE, TOLERANCE = 64, 0.125
CELL = "frame_index int, row int, col int, side int"
CORNERS = tuple(f"{c}{i}" for i in range(4) for c in "uv")


def _nine(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a cell (cells, 9) from its corner, in pixels: corners first, then the sides' middles and its own."""
    at = np.array([(0, 0), (0, 1), (1, 0), (1, 1), (0, 0.5), (0.5, 0), (0.5, 1), (1, 0.5), (0.5, 0.5)])
    return at[:, 0] * side[:, None], at[:, 1] * side[:, None]


def _looked_at(cells: DataFrame, solutions: DataFrame) -> DataFrame:
    """``cells`` (with gt) with the spline's (u, v) at their corners and ``off``, the largest error of interpolation."""

    def look(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in them:
            for r in batch.to_dict("records"):
                row, col, side = (np.array([t[c] for t in r["_them"]]) for c in ("row", "col", "side"))
                gt = r["_them"][0]["gt"]
                y, x = _nine(side)
                uv = kernels.solution_at(r, gt[0] + (col[:, None] + x).ravel() * gt[1], gt[3] + (row[:, None] + y).ravel() * gt[5]).reshape(len(row), 9, 2)
                c = uv[:, :4]
                said = np.stack([c[:, [0, 1]].mean(1), c[:, [0, 2]].mean(1), c[:, [1, 3]].mean(1), c[:, [2, 3]].mean(1), c.mean(1)], axis=1)
                off = np.abs(uv[:, 4:] - said).max(axis=(1, 2))
                corners = np.where(side[:, None, None] == 1, uv[:, 8:9], c)  # a single pixel is what its middle is
                out = {"frame_index": r["frame_index"], "row": row, "col": col, "side": side}
                yield pd.DataFrame(out | dict(zip(CORNERS, corners.reshape(len(row), 8).T, strict=True)) | {"off": off})

    blocks = kernels.in_blocks(cells, "row", "col", "side", "gt").join(solutions, "frame_index")
    return blocks.mapInPandas(look, f"{CELL}, {', '.join(f'{c} double' for c in CORNERS)}, off double")


def cells(points: DataFrame, grids: DataFrame, tolerance: float = TOLERANCE, side: int = SIDE) -> DataFrame:
    """(frame_index, row, col, side, and (u, v) at the corners): the cells of each grid (frame_index, warp_width, warp_height, gt)."""
    solutions = kept(kernels.solved(points), "splines")
    sizes = grids.select(F.col("frame_index").cast("int").alias("frame_index"), F.col("warp_width").cast("int").alias("_w"), F.col("warp_height").cast("int").alias("_h"), "gt")
    steps = lambda n: F.sequence(F.lit(0), n - 1, F.lit(side))
    now = sizes.filter("_w > 0 and _h > 0").withColumn("row", F.explode(steps(F.col("_h")))).withColumn("col", F.explode(steps(F.col("_w")))).withColumn("side", F.lit(side))
    done = []
    while True:
        seen = kept(_looked_at(now, solutions), "cells")
        split = (F.col("off") > tolerance / 2) & (F.col("side") > 1)
        done.append(seen.filter(~split).drop("off"))
        if side == 1:
            break
        side //= 2
        four = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, side) for j in (0, side))))
        parts = seen.filter(split).select("frame_index", "row", "col", four.alias("_q")).select("frame_index", (F.col("row") + F.col("_q.i")).alias("row"), (F.col("col") + F.col("_q.j")).alias("col"))
        now = parts.join(sizes, "frame_index").filter("row < _h and col < _w").withColumn("side", F.lit(side))
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def pixels(cells_: DataFrame, grids: DataFrame) -> DataFrame:
    """(frame_index, row, col, u, v) of every pixel of the grids, from their cells."""
    sizes = grids.select(F.col("frame_index").cast("int").alias("frame_index"), F.col("warp_width").cast("int").alias("_w"), F.col("warp_height").cast("int").alias("_h"))
    run = lambda c, n: F.explode(F.sequence(F.col(c), F.least(F.col(c) + F.col("side"), F.col(n)) - 1))
    each = cells_.join(sizes, "frame_index").withColumn("_r", run("row", "_h")).withColumn("_c", run("col", "_w"))
    y, x = (F.col("_r") - F.col("row") + 0.5) / F.col("side"), (F.col("_c") - F.col("col") + 0.5) / F.col("side")
    mixed = lambda c: (1 - y) * ((1 - x) * F.col(f"{c}0") + x * F.col(f"{c}1")) + y * ((1 - x) * F.col(f"{c}2") + x * F.col(f"{c}3"))
    return each.select("frame_index", F.col("_r").alias("row"), F.col("_c").alias("col"), mixed("u").alias("u"), mixed("v").alias("v"))
