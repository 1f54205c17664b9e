"""Rasters in blocks against the same operators by pixels, whole images in numpy, and bounds of what a row holds."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumitrack.operators import blocks, kernels, rasters
from lumitrack.queries import ORACLE_SQL, QUERIES


def image(height, width, seed=1, reach=2):
    return kernels._smoothed(np.random.default_rng(seed).random((height, width)) * 255, reach)


def pixels(spark, bands, ident=0, holes=()):
    h, w = next(iter(bands.values())).shape
    rows, cols = np.mgrid[:h, :w]
    x = pd.DataFrame({"image": ident, "row": rows.ravel(), "col": cols.ravel()} | {n: m.ravel() for n, m in bands.items()})
    return spark.createDataFrame(x.drop(index=[r * w + c for r, c in holes]))


def grids(spark, rows):
    return spark.createDataFrame(rows, "image long, width int, height int, source_width int, source_height int, gt array<double>, source_gt array<double>")


def as_dict(df, *values):
    return {(r.image, r.row, r.col): tuple(r[v] for v in values) for r in df.collect()}


def test_blocks_and_back(spark):
    m = image(20, 37)
    x = pixels(spark, {"value": m}, holes=[(3, 4), (19, 36)])
    odd = spark.createDataFrame([(0, 0, 0, -5.0), (0, 0, 1, None), (None, 1, 1, 9.0), (0, -1, 1, 9.0), (0, None, 1, 9.0), (7, 100, 50, None), (8, 33, 2, float("inf"))], x.schema)
    b = blocks.blocks_of(x.union(odd), side=16).cache()
    got = as_dict(blocks.pixels_of(b), "value")
    want = {(0, r, c): (m[r, c],) for r in range(20) for c in range(37) if (r, c) not in ((3, 4), (19, 36))} | {(8, 33, 2): (float("inf"),)}
    assert got == want
    one = {(r.image, r.block_row, r.block_col): r for r in b.collect()}
    assert sorted(one) == [(0, i, j) for i in range(2) for j in range(3)] + [(7, 6, 3), (8, 2, 0)]
    assert one[0, 0, 0].value_low == m[:16, :16].min() or (3, 4) == tuple(np.unravel_index(m[:16, :16].argmin(), (16, 16)))
    assert one[7, 6, 3].value_low is None and one[8, 2, 0].value_high is None
    assert blocks.sizes_of(b).filter("image = 0").first()[1:] == (37, 20)
    assert blocks.pixels_of(blocks.blocks_of(x.limit(0))).count() == 0


def test_neighbours_give_their_margins(spark):
    m = image(50, 45)
    b = blocks.blocks_of(pixels(spark, {"value": m}), side=16)

    for before, after in ((0, 0), (3, 5), (16, 0), (40, 33)):
        def work(p, before=before, after=after):
            top, left = p.row0, p.col0
            v = p.bands["value"]
            assert v.shape[0] <= 16 + before + after and v[p.own].shape == (p.height, p.width)
            return {"image": p.image, "row0": top, "col0": left, "height": v.shape[0], "width": v.shape[1], "v": v.ravel(), "r": top + p.top, "c": left + p.left}

        found = blocks.around(b, ["value"], before, after, work, "image long, row0 int, col0 int, height int, width int, v array<double>, r int, c int", 16).collect()
        assert sorted((f.r, f.c) for f in found) == [(r, c) for r in (0, 16, 32, 48) for c in (0, 16, 32)]
        for f in found:
            assert (f.row0, f.col0) == (max(0, f.r - before), max(0, f.c - before))
            assert (f.row0 + f.height, f.col0 + f.width) == (min(50, f.r // 16 * 16 + 16 + after), min(45, f.c // 16 * 16 + 16 + after))
            assert np.array_equal(np.array(f.v).reshape(f.height, f.width), m[f.row0 : f.row0 + f.height, f.col0 : f.col0 + f.width])


@pytest.mark.parametrize("shape", ((40, 70), (9, 33), (5, 40)))
def test_likeness_is_that_of_whole_images(spark, shape):
    a, b = np.floor(image(*shape)), image(*shape, seed=2)
    a[: shape[0] // 3] = 0.0  # dark rows
    x = pixels(spark, {"a": a, "b": b}).union(pixels(spark, {"a": b, "b": a}, 1))
    got = {r.image: r.likeness for r in blocks.likeness(blocks.blocks_of(x, ["a", "b"], 16), side=16).collect()}
    for k, pair in enumerate(((a, b), (b, a))):
        assert got[k] == pytest.approx(kernels.masked_likeness(*pair), abs=1e-9, nan_ok=True)
    assert blocks.likeness(blocks.blocks_of(x.limit(0), ["a", "b"], 16), side=16).count() == 0


def test_flow_is_that_of_whole_images(spark):
    a, b = image(90, 130, reach=4), image(90, 130, reach=4)
    b[:, 2:] = a[:, :-2]
    x = pixels(spark, {"a": a, "b": b})
    found = as_dict(blocks.pixels_of(blocks.flow(blocks.blocks_of(x, ["a", "b"], 32), side=32), ["dx", "dy"]), "dx", "dy")
    want = kernels.dense_flow(a, b)
    assert len(found) == 90 * 130 and max(abs(v[i] - want[r, c, i]) for (_, r, c), v in found.items() for i in (0, 1)) < 1e-6
    some = blocks.flow(blocks.blocks_of(pixels(spark, {"a": a, "b": b}, holes=[(40, 40)]), ["a", "b"], 32), side=32)
    assert blocks.pixels_of(some, ["dx", "dy"]).count() == 90 * 130 - 1
    with pytest.raises(ValueError):
        blocks.flow(some, margin=30)


@pytest.mark.parametrize("method", ("nearest", "bilinear", "cubic"))
def test_resampling_is_that_of_pixels(spark, method):
    m = image(60, 41)
    m[10:14, 20:30] = 0.0  # no data
    m[30, 5] = np.nan
    x = pixels(spark, {"value": m}, holes=[(3, 4), (16, 16)])
    x = x.union(pixels(spark, {"value": m * 2}, 1)).union(pixels(spark, {"value": m * 3}, 2)).union(pixels(spark, {"value": m + 1}, 3)).union(pixels(spark, {"value": m}, 4))
    one = [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    g = grids(spark, [
        (0, 41, 60, 41, 60, [0.0, 1.0, 0.0, 0.0, 0.0, 1.0], one),
        (1, 9, 12, 41, 60, [-3.0, 5.3, 0.0, 2.0, 0.0, 5.1], one),  # much coarser, and beyond the left edge
        (2, 50, 70, 41, 60, [8.0, 0.31, 0.1, 5.0, -0.12, 0.3], [0.5, 1.1, 0.05, -0.5, 0.02, 0.9]),  # finer, turned
        (3, 20, 20, 41, 60, [500.0, 1.0, 0.0, 0.0, 0.0, 1.0], one),  # nowhere near
        (4, 41, 60, 41, 60, [41.0, -1.0, 0.0, 60.0, 0.0, -1.0], one),  # upside down
        (5, 3, 3, 41, 60, one, one),  # no source
    ])
    got = as_dict(blocks.pixels_of(blocks.resampled(blocks.blocks_of(x, side=16), g, method, side=16)), "value")
    want = as_dict(rasters.resampled(x, g, method), "value")
    assert set(got) == set(want) and len(got) == 2 * 41 * 60 + 9 * 12 + 50 * 70 + 400 + 9
    assert max(abs(got[k][0] - want[k][0]) for k in want) < 1e-9
    assert len({v for (i, _, _), v in got.items() if i == 3}) == 1


def test_samples_are_those_of_pixels(spark):
    m, rng = image(40, 35), np.random.default_rng(3)
    m[5, 5] = np.nan
    x = pixels(spark, {"v": m, "u": -m}, holes=[(20, 20)])
    at = [(k, 0, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-2, 37, 400), rng.uniform(-2, 42, 400), strict=True))]
    at += [(1000 + k, 0, a, b) for k, (a, b) in enumerate([(15.0, 15.0), (15.5, 15.5), (31.5, 7.0), (34.0, 39.0), (34.0, 2.5), (0.0, 0.0), (5.0, 5.0), (4.0, 5.0), (20.5, 20.0), (15.25, 31.75)])]
    at += [(2000, 9, 1.0, 1.0), (2001, 0, None, 1.0), (2002, 0, float("nan"), 1.0), (2003, None, 1.0, 1.0)]
    points = spark.createDataFrame(at, "id int, image long, x double, y double").withColumn("value", F.lit("own"))
    found = blocks.sampled(points, blocks.blocks_of(x, ["u", "v"], 16), ["v", "u"], ["id"], 16)
    assert found.columns == [*points.columns, "sampled_v", "sampled_u"] and found.count() == len(at)
    # in blocks a NaN pixel is one that isn't there
    want = {r.id: r for r in rasters.bilinear(points, x.filter(~F.isnan("v")), ["v", "u"], ["image", "id"]).collect()}
    for r in found.collect():
        for b in ("sampled_v", "sampled_u"):
            w = want[r.id][b]
            assert (r[b] is None) == (w is None) and (w is None or r[b] == pytest.approx(w, abs=1e-9)), (r, w)
    assert {r.id: r.sampled_v for r in found.filter("id in (1006, 1007, 1008)").collect()} == {1006: None, 1007: pytest.approx(m[5, 4]), 1008: None}


def test_stored_blocks_are_pruned_by_extent(spark, tmp_path):
    m = image(64, 96)
    b = blocks.blocks_of(pixels(spark, {"value": m}).union(pixels(spark, {"value": m}, 1)), side=16)
    grounds = spark.createDataFrame([(0, [10.0, 0.5, 0.0, 50.0, 0.0, -0.25]), (1, [200.0, 0.0, 1.0, 0.0, 1.0, 0.0])], "image long, gt array<double>")
    path = str(tmp_path / "blocks")
    blocks.write_blocks(blocks.placed(b, grounds), path)
    stored = blocks.read_blocks(spark, path)
    assert stored.count() == 48
    found = blocks.in_extent(stored, 20.0, 25.0, 40.0, 44.0)
    assert sorted((r.block_row, r.block_col) for r in found.collect()) == [(1, 1), (2, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(west,25.0)" in plan
    turned = stored.filter("image = 1 and block_row = 1 and block_col = 2").first()
    assert turned.gt == [216.0, 0.0, 1.0, 32.0, 1.0, 0.0] and (turned.west, turned.east, turned.south, turned.north) == (216.0, 232.0, 32.0, 48.0)


def test_stored_blocks_of_long_images_and_of_gaps(spark, tmp_path):
    """Rows whose transform goes on past the pole, and a block that the image's rows fill only in part, as the SQL has them."""
    rows = [(8 * r + i, [float((r * 7 + c * 3 + i) % 11) for c in range(64)]) for i, rows in ((0, (*range(70), *range(6600, 6700))), (3, (40, 41, 45, 20_000))) for r in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["stored_blocks_in_extent"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["stored_blocks_in_extent"])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
    assert {(r.image, r.block_row): r.n_pixels for r in got.collect()} == {(0, 1): 1024, (0, 2): 192, (0, 206): 768, (0, 207): 1024, (0, 208): 1024, (0, 209): 384, (3, 1): 96, (3, 625): 32}


def test_no_row_above_64_mb():
    """What a row may hold at production size, two bands of flow with margins, and that row groups are small."""
    assert 2 * 8 * (blocks.SIDE + 2 * kernels.MARGIN) ** 2 < 64 << 20
    assert blocks.SIDE % 4 == 0
