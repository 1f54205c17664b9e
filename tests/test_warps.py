"""Warps by cells against the whole spline; tiles that are cut both ways against whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitrack.operators import kernels, warps


def bent(spark, frames=2, n=40):
    rng, rows = np.random.default_rng(4), []
    for f in range(frames):
        x, y = rng.uniform(0, 3, n), rng.uniform(0, 2, n)
        u, v = 100 * x + 8 * np.sin(2 * x) + (f + 1) * 3 * y, 100 * y + 6 * np.cos(3 * y) * x
        rows += [(f, *map(float, r)) for r in zip(x, y, u, v, strict=True)]
    grids = [(f, 300, 170, [0.0, 0.01, 0.0, 2.0, 0.0, -0.0118]) for f in range(frames)] + [(7, 100, 100, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]), (8, 0, 5, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0])]
    return spark.createDataFrame(rows, "frame_index int, x double, y double, u double, v double"), spark.createDataFrame(grids, "frame_index int, warp_width long, warp_height long, gt array<double>")


def test_cells_stay_within_the_bound(spark):
    points, grids = bent(spark)
    cells = warps.cells(points, grids).cache()
    got = warps.pixels(cells, grids)
    assert got.groupBy("frame_index").count().orderBy("frame_index").collect() == [(0, 51_000), (1, 51_000)] and got.distinct().count() == 102_000
    targets = got.withColumns({"x": (F.col("col") + 0.5) * 0.01, "y": 2.0 - (F.col("row") + 0.5) * 0.0118})
    full = kernels.warped(points, targets.filter("row % 3 = 0")).withColumnsRenamed({"u": "fu", "v": "fv"})
    both = targets.join(full, ["frame_index", "x", "y"])
    worst, n = both.agg(F.max(F.greatest(F.abs(F.col("u") - F.col("fu")), F.abs(F.col("v") - F.col("fv")))), F.count(F.lit(1))).first()
    assert worst <= warps.TOLERANCE and n > 30_000
    assert cells.count() * 9 * 4 < 102_000  # evaluations, with those of cells that were cut


def test_cells_down_to_one_pixel(spark):
    points, grids = bent(spark, 1)
    small = grids.limit(1).withColumns({"warp_width": F.lit(9), "warp_height": F.lit(5)})
    got = warps.pixels(warps.cells(points, small, tolerance=1e-9, side=4), small).orderBy("row", "col").collect()
    assert len(got) == 45
    c = kernels.spline(*(np.array([r[k] for r in points.collect()]) for k in ("x", "y")), np.array([(r.u, r.v) for r in points.collect()]))
    x, y = np.array([(r.col + 0.5) * 0.01 for r in got]), np.array([2.0 - (r.row + 0.5) * 0.0118 for r in got])
    p = points.collect()
    want = kernels.spline_at(c, np.array([r.x for r in p]), np.array([r.y for r in p]), x, y)
    assert np.allclose([(r.u, r.v) for r in got], want, atol=1e-6)
    assert warps.cells(points.limit(3), small).count() == 0


@pytest.mark.parametrize("tile", (16, 1000))
def test_tiles_are_cut_both_ways(spark, tile):
    rng = np.random.default_rng(1)
    a = kernels._smoothed(rng.random((40, 70)) * 255, 2)
    b = kernels._smoothed(rng.random((40, 70)) * 255, 2)
    rows = [(0, r, c, float(a[r, c]), float(b[r, c])) for r in range(40) for c in range(70)]
    pixels = spark.createDataFrame(rows, "image int, row int, col int, a double, b double")
    assert kernels.image_likeness(pixels, tile=tile).first().likeness == pytest.approx(kernels.masked_likeness(a, b), abs=1e-9)
    flow = kernels.image_flow(pixels, tile, 304).collect()
    want = kernels.dense_flow(a, b)
    assert len(flow) == 2800 and max(abs(r.dx - want[r.row, r.col, 0]) + abs(r.dy - want[r.row, r.col, 1]) for r in flow) < 1e-6
    widths = kernels._in_tiles(pixels, lambda c: (kernels._tile_of(F.col(c), tile),) * 2).agg(F.max("width"), F.max("height")).first()
    assert tuple(widths) == (min(tile, 70), min(tile, 40))
