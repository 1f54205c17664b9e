"""Plans per frame with status rows, resampling, layouts of files and scored candidates, on tiny hand-made inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitrack.operators import rasters, sampling, scoring
from lumitrack.plans import frames as plans
from lumitrack.sources import points, sinks

GT = [10.0, 0.5, 0.0, 40.0, 0.0, -0.5]


def square(frame, n, far=1.0):
    """Control points of an image of 100 x 80 pixels, each pixel 0.01 degrees."""
    rng = np.random.default_rng(frame)
    return [(frame, i, 10.0 + far * 0.01 * x, 40.0 - far * 0.01 * y, x, -y) for i, (x, y) in enumerate((rng.random((n, 2)) * [100, 80]).tolist())]


def test_georeference_frames(spark):
    rows = square(0, 30) + square(1, 5) + square(2, 30, 10000.0) + square(3, 30) + square(5, 30) + [(5, 30, float("nan"), 1.0, 1.0, 1.0)]
    pts = spark.createDataFrame(rows, "frame_index int, row_ordinal int, mapX double, mapY double, sourceX double, sourceY double")
    images = spark.createDataFrame([(i, 100, 80) for i in range(6)], "frame_index int, width int, height int")
    found = plans.georeferenced(pts, images, images.filter("frame_index = 3"))
    status = {r.frame_index: r.status for r in found.status.collect()}
    assert status == {0: "done", 1: "too few points", 2: "points too far apart", 3: "skipped", 4: "too few points", 5: "done"}
    grids = {r.frame_index: r for r in found.grids.collect()}
    assert set(grids) == {0, 5} and (grids[0].warp_width, grids[0].warp_height) == (100, 80) and np.allclose(grids[0].gt, [10, 0.01, 0, 40, 0, -0.01])
    for r in found.mapping.filter("frame_index = 0").collect():
        assert abs(r.geoX + 0.5 - r.sourceX) < 1 and abs(r.geoY + 0.5 + r.sourceY) < 1
    assert found.mapping.filter("frame_index = 5").count() == 31
    image = spark.range(8000).select(F.lit(0).alias("frame_index"), (F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    warped = plans.warped_pixels(image, pts, found.grids.filter("frame_index = 0")).collect()
    assert len(warped) > 7900 and sum(r.value == r.row * 100 + r.col for r in warped) > 0.98 * len(warped)
    assert {r.status for r in plans.georeferenced(pts.filter("frame_index = 0"), images.limit(1), most_side=50).status.collect()} == {"warp too large"}


def test_crop_frames(spark):
    light = spark.createDataFrame([(r, c, 100.0) for r in range(40) for c in range(40)], "row int, col int, value double")
    images = spark.createDataFrame([(0, 60, 50, [12.0, 0.25, 0.0, 38.0, 0.0, -0.25]), (1, 60, 50, [80.0, 0.25, 0.0, 38.0, 0.0, -0.25]), (2, 60, 50, GT), (3, 60, 50, GT)], "frame_index int, width int, height int, gt array<double>")
    mapping = spark.createDataFrame([(f, x, y) for f in (0, 1, 3) for x, y in ((10.0, 10.0), (20.0, 30.0))] + [(2, None, 1.0)], "frame_index int, geoX double, geoY double")
    status, pixels = plans.cropped(mapping, images, light, F.array(*map(F.lit, GT)), 5, done=images.filter("frame_index = 3"))
    got = {r.frame_index: r for r in status.collect()}
    assert {k: r.status for k, r in got.items()} == {0: "done", 1: "no overlap", 2: "no mapped pixels", 3: "skipped"}
    assert (got[0].x0, got[0].x1, got[0].y0, got[0].y1) == (5, 25, 5, 35)
    rows = pixels.collect()
    assert len(rows) == 20 * 30 and {r.frame_index for r in rows} == {0} and all(r.tone == pytest.approx(100 * 0.5**0.4) for r in rows)


def test_flow_frames(spark):
    rng = np.random.default_rng(3)
    base = rng.random((90, 90)) * 255
    for axis in (0, 1, 0, 1, 0, 1):
        base = sum(np.roll(base, k, axis) for k in range(-3, 4)) / 7
    base = (base - base.min()) / (base.max() - base.min()) * 255
    first = [(i, r, c, float(base[r, c])) for i in (0, 1) for r in range(80) for c in range(80)]
    second = [(0, r, c, float(base[r + 8, c + 10])) for r in range(64) for c in range(64)] + [(2, 0, 0, 1.0)]
    kinds = "image int, row int, col int, value double"
    windows = spark.createDataFrame([(i, 8, 8, 72, 72) for i in range(3)], "image int, x0 int, y0 int, x1 int, y1 int")
    status, pixels = plans.flows(spark.createDataFrame(first, kinds), spark.createDataFrame(second, kinds), windows)
    assert {r.image: r.status for r in status.collect()} == {0: "done", 1: "missing light image", 2: "missing image"}
    got = pixels.filter("row between 16 and 47 and col between 16 and 47").agg(F.median("dx").alias("dx"), F.median("dy").alias("dy"), F.count_if(F.col("image") != 0).alias("n")).first()
    assert abs(got.dx + 2) < 0.3 and abs(got.dy) < 0.3 and got.n == 0


def test_resampling_on_planes_and_holes(spark):
    plane = spark.createDataFrame([(0, r, c, 2.0 * c - 3.0 * r + 500) for r in range(20) for c in range(20)], "image int, row int, col int, value double")
    grid = spark.createDataFrame([(0, 8, 6, [5.0, 1.0, 0.0, 5.0, 0.0, 1.0], [0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 20, 20)], "image int, width int, height int, gt array<double>, source_gt array<double>, source_width int, source_height int")
    for method, offset in (("nearest", 5.0), ("bilinear", 5.25), ("cubic", 5.25)):
        moved = grid.withColumn("gt", F.array(*(F.lit(v) for v in (offset, 1.0, 0.0, offset, 0.0, 1.0))))
        got = rasters.resampled(plane, moved, method).collect()
        assert len(got) == 48 and all(r.value == pytest.approx(2 * (r.col + offset) - 3 * (r.row + offset) + 500) for r in got)
    holes = plane.withColumn("value", F.when((F.col("row") == 7) & (F.col("col") == 7), float("nan")).otherwise(F.lit(4.0)))
    assert {(r.row, r.col): r.value for r in rasters.resampled(holes, grid).collect()}[(2, 2)] == 0.0
    assert {r.value for r in rasters.resampled(holes, grid.withColumn("gt", F.array(*(F.lit(v) for v in (5.5, 1.0, 0.0, 5.5, 0.0, 1.0)))), "bilinear").collect()} == {4.0}
    doubled = rasters.resized(plane, spark.createDataFrame([(0, 40, 40, 20, 20)], "image int, width int, height int, source_width int, source_height int"))
    at = {(r.row, r.col): r.value for r in doubled.collect()}
    assert len(at) == 1600 and at[0, 0] == 500.0 and at[0, 1] == pytest.approx(500.5) and at[39, 39] == pytest.approx(2 * 19 - 3 * 19 + 500)
    with pytest.raises(ValueError):
        rasters.tone_mapped(plane, top=0.0)


@pytest.mark.parametrize("method", ("bilinear", "cubic"))
def test_taps_are_never_broadcast_and_lines_are_dealt_out(spark, method):
    gt = F.array(*map(F.lit, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)))
    grids = spark.range(1).select(F.lit(0).alias("image"), F.lit(20).alias("width"), F.lit(400).alias("height"), F.lit(20).alias("source_width"), F.lit(400).alias("source_height"), gt.alias("gt"), gt.alias("source_gt"))
    pixels = spark.range(8000).select(F.lit(0).alias("image"), (F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), (F.col("id") + 1.0).alias("value"))
    out = rasters.resampled(pixels, grids, method)
    assert {(r.row, r.col): round(r.value, 9) for r in out.collect()} == {(i // 20, i % 20): i + 1.0 for i in range(8000)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan.split("== Initial Plan ==")[0]
    assert "REPARTITION_BY_NUM" in plan


def shuffled_rows(spark, df):
    """Rows that all stages of a run of ``df`` have written for shuffles."""
    sc = spark.sparkContext
    none, quantiles = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
    seen = lambda: sum(x.shuffleWriteRecords() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)))
    before = seen()
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return seen() - before


def test_a_pixel_goes_to_tiles_and_not_to_taps(spark):
    one = [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    # the second target lies outside of its source, and is dealt out by its own places; the source has a hole, and one pixel twice
    grids = spark.createDataFrame([(0, 64, 64, 64, 64, [0.25, 1.0, 0.0, 0.25, 0.0, 1.0], one), (1, 64, 64, 64, 64, [900.0, 1.0, 0.0, 0.0, 0.0, 1.0], one)], "image int, width int, height int, source_width int, source_height int, gt array<double>, source_gt array<double>")
    rows = [(i, r, c, 3.0) for i in range(2) for r in range(64) for c in range(64) if (r, c) != (20, 20)] + [(0, 31, 31, 9.0)]
    pixels = spark.createDataFrame(rows, "image int, row int, col int, value double")
    out = rasters.resampled(pixels, grids, "cubic", nodata=-1.0)
    got = {(r.image, r.row, r.col): r.value for r in out.collect()}
    assert len(got) == 2 * 64 * 64 and {v for (i, _, _), v in got.items() if i == 1} == {-1.0}
    key = lambda d: -0.5 * d**3 + 2.5 * d * d - 4 * d + 2 if d >= 1 else 1.5 * d**3 - 2.5 * d * d + 1
    near = [key(abs(0.25 - d)) for d in (-1, 0, 1, 2)]
    w = near[1] * near[1]  # of the pixel itself, which is there twice: 3 and 9
    assert got[0, 31, 31] == pytest.approx((3 + 9 * w) / (1 + w)) and got[0, 20, 20] == pytest.approx(3.0) and got[0, 0, 0] == pytest.approx(3.0)
    # four shuffles: lines, the source, pixels at 1.4 tiles, and their sums again; each tap as a row made 16 of a pixel
    assert shuffled_rows(spark, out) < 5 * 2 * 64 * 64


def test_similarity_is_no_deformation(spark):
    rows = [(0, j, i, x, y, 0.3 + 1.2 * x - 0.5 * y, -0.1 + 0.5 * x + 1.2 * y) for j, y in enumerate(np.linspace(-1, 1, 5).tolist()) for i, x in enumerate(np.linspace(-1, 1, 6).tolist())]
    field = spark.createDataFrame(rows, "image int, iy int, ix int, x double, y double, qx double, qy double")
    d = scoring.deformation(field).first()
    assert max(d.disp_rmse, d.disp_p95, d.bending_energy, d.log_area_rmse, d.aniso_rmse) < 1e-6 and d.fold_ratio == 0
    assert scoring.deformation(field, False).first().disp_rmse > 0.3
    none = scoring.deformation(field, nodes=field.limit(0)).first()
    assert none.disp_rmse == 1e6 and none.bending_energy < 1e-9


def test_candidates(spark):
    rng = np.random.default_rng(7)
    rows = []
    for image, n, wrong in ((0, 120, 0), (1, 120, 12), (2, 10, 0)):
        for i, (x, y) in enumerate(rng.random((n, 2)) * [799, 599]):
            u, v = (0.98 * x + 0.02 * y + 3, -0.02 * x + 0.98 * y + 8)
            rows.append((image, i, x, y, *((u, v) if i >= wrong else (u + 25 * (-1) ** i, v))))
    m = spark.createDataFrame([tuple(map(float, r[2:])) + (r[0], r[1]) for r in rows], "real_x double, real_y double, sim_x double, sim_y double, image int, nth int")
    sizes = spark.createDataFrame([(i, 800, 600) for i in range(3)], "image int, width int, height int")
    got = {r.image: r for r in scoring.scored_candidates(m, sizes).collect()}
    assert set(got) == {0, 1} and got[0].n_inliers == 120 and got[1].n_inliers == 108 and got[1].n_matches_raw == 120
    # a turn of an image that isn't square shears its unit square a little
    assert got[0].cv_rmse < 1e-6 and got[0].disp_rmse < 0.01 and got[0].fold_ratio == 0 and got[0].score > got[1].score


def test_blocks_of_matches_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 7)
    rng = np.random.default_rng(5)
    q, b = rng.random((40, 4)), rng.random((50, 4))
    frame = lambda a, name: spark.createDataFrame([("g", i, r.tolist()) for i, r in enumerate(a)] + [("one side", 0, [0.0] * 4)] * (name == "query_id"), f"label string, {name} int, descriptor array<double>")
    got = {(r.query_id, r.base_id) for r in scoring.ratio_matches(frame(q, "query_id"), frame(b, "base_id"), ["label"], 0.9, 1000, 1).collect()}
    d = np.sqrt(((q[:, None] - b[None]) ** 2).sum(-1))
    two = np.sort(d, axis=1)[:, :2]
    assert got == {(i, int(d[i].argmin())) for i in range(40) if two[i, 0] < 0.9 * two[i, 1]} and got


def test_correction_status_and_layouts(spark):
    ids = lambda *them: spark.createDataFrame([(i,) for i in them], "frame_index int")
    frames = spark.createDataFrame([(i, 10, 10) for i in range(7)], "frame_index int, width int, height int")
    flow = spark.createDataFrame([(i, r, c, 1.0, 0.0) for i in range(3, 7) for r in range(2) for c in range(3)] + [(2, 0, 0, 1.0, 0.0)], "image int, row int, col int, dx double, dy double")
    meta = spark.createDataFrame([(i, 0, 0, 3, 2, None if i == 6 else 10 + (i == 4), 10) for i in (2, 4, 5, 6)], "frame_index int, x0 int, y0 int, x1 int, y1 int, full_width int, full_height int")
    got = {r.frame_index: r.status for r in rasters.correction_status(frames, ids(1, 2, 3, 4, 5, 6), ids(0, 2, 3, 4, 5, 6), flow, meta).collect()}
    assert got == {0: "missing points", 1: "missing mapping", 2: "flow shape differs", 3: "missing flow metadata", 4: "image size differs", 5: "ok", 6: "ok"}

    pts = spark.createDataFrame([(0, i, 0.5, 0.5, float(i), -1.0, i % 2) for i in range(3)], "frame_index int, row_ordinal int, mapX double, mapY double, sourceX double, sourceY double, enable int")
    mapping = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 7.0, 7.0), (0, 2, 1.0, 0.0)], "frame_index int, row_ordinal int, geoX double, geoY double")
    known = spark.createDataFrame([(0, 0, 0, 3, 2, 1.0, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], "a - b", None)], "frame_index int, x0 int, y0 int, x1 int, y1 int, sign double, gt array<double>, flow_definition string, flow_correction string")
    corrected = rasters.corrected_points(pts.drop("sourceX", "sourceY", "enable"), mapping, flow.filter("image = 3").withColumn("image", F.lit(0)), known.select("frame_index", "x0", "y0", "sign", "gt"))
    rows = sinks.corrected_layout(pts, corrected).orderBy("row_ordinal")
    assert rows.columns[2:] == [*points.POINT_COLUMNS, *sinks.CORRECTED] and [(r.mapX, r.dX, r.enable, r.correction_reason) for r in rows.collect()] == [(2.0, 1.0, 0, "applied"), (7.0, 0.0, 1, "outside_flow_roi"), (2.0, 1.0, 0, "applied")]
    said = json.loads(sinks.correction_json(rasters.correction_stats(corrected), known).first().json)
    assert said["roi"] == {"x0": 0, "y0": 0, "x1": 3, "y1": 2, "width": 3, "height": 2} and said["reason_counts"] == {"applied": 2, "outside_flow_roi": 1} and said["flow_correction"] is None and said["flow_sign_source"] == "flow_meta"
    window = spark.createDataFrame([(0, 1, 5, 2, 6, 4, 4, 10, 10)], "frame_index int, x0 int, x1 int, y0 int, y1 int, roi_width int, roi_height int, ref_width int, ref_height int")
    assert list(json.loads(sinks.window_json(window, 100).first().json)) == ["x0", "x1", "y0", "y1", "roi_width", "roi_height", "ref_width", "ref_height", "roi_margin_px", "roi_mode"]
    assert json.loads(sinks.window_json(window, None, "full").first().json) == {"roi_mode": "full", "ref_width": 10, "ref_height": 10}
    made = spark.createDataFrame([(0, "a", "/a", "/b", 10, 10, 1, 2, 5, 6, 4, 4, "roi")], "frame_index int, image_id string, first string, second string, full_width int, full_height int, x0 int, y0 int, x1 int, y1 int, input_width int, input_height int, roi_source string")
    flow_said = json.loads(sinks.flow_json(made, "d", {"levels": 3}).first().json)
    assert (flow_said["flow_width"], flow_said["flow_height"], flow_said["farneback_params"], flow_said["metadata_version"]) == (4, 4, {"levels": 3.0}, 3)
    six = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "sim_x double, sim_y double, real_x double, real_y double, lat double, lon double")
    assert sinks.projected_layout(six).columns == ["Sim Pixel X", "Sim Pixel Y", "Real Pixel X", "Real Pixel Y", "Latitude", "Longitude"]


def test_small_helpers(spark):
    assert points.output_columns(["b", "mapX", "mapY", "sourceX", "sourceY", "__x"], True) == ["b", "mapX", "mapY", "sourceX", "sourceY", "enable", "dX", "dY", "residual", *points.STATUS_COLUMNS]
    assert points.output_columns(["mapX"]) == list(points.POINT_COLUMNS)
    pairs = spark.createDataFrame([(0, [[1.0, 2.0], [float("nan"), 1.0], [3.0, 4.0]], [[5.0, 6.0], [1.0, 1.0]]), (1, [[float("inf"), 1.0]], [[1.0, 1.0]]), (2, None, [[1.0, 1.0]])], "id int, left array<array<double>>, right array<array<double>>")
    got = {r.id: r.matched for r in points.matched_places(pairs).collect()}
    assert [(p.left, p.right) for p in got[0]] == [([1.0, 2.0], [5.0, 6.0])] and got[1] is None and got[2] is None
    rows = spark.range(400).withColumn("g", F.col("id") % 2)
    one, two = (sorted(r.id for r in sampling.seeded(rows.repartition(n), ["g"], ["id"], 150).collect()) for n in (3, 5))
    assert one == two and len(set(one)) == 300 and sampling.seeded(rows.limit(10), ["g"], ["id"]).count() == 10
    assert points.enabled(spark.createDataFrame([(1.0,), (0.0,), (None,)], "enable double")).count() == 1
    assert points.nonempty(spark.createDataFrame([("a", 0), ("b", 3)], "path string, length long")).first().path == "b"
    assert spark.range(1).select(rasters.grey(F.lit(255), F.lit(255), F.lit(255)).alias("g")).first().g == 255


def test_hold_out_without_a_sorted_group(spark):
    from pyspark.sql import Window

    rng = np.random.default_rng(4)
    rows = [(g, i, *map(float, rng.normal(size=4))) for g, n in ((0, 300), (1, 8), (2, 41)) for i in range(n)]
    m = spark.createDataFrame(rows, "g int, nth int, x double, y double, u double, v double")
    out = scoring.holdout_rmse(m, ["g"])
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    place = F.row_number().over(Window.partitionBy("g", "r").orderBy(F.xxhash64(F.lit(1234), "r", "nth"), "nth"))
    sets = m.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("place", place).toPandas()
    terms = lambda s: np.stack([s.x**0, s.x, s.y, s.x**2, s.x * s.y, s.y**2], axis=1)
    for r in out.collect():
        errors = []
        for _, s in sets[sets.g == r.g].groupby("r"):
            held = s.place <= min(max(6, round(len(s) * 0.25)), len(s) - 6)
            fit, test = (s, s) if len(s) < 12 else (s[~held], s[held])
            b = np.linalg.lstsq(terms(fit), fit[["u", "v"]].to_numpy(), rcond=None)[0]
            errors.append(np.sqrt((((terms(test) @ b) - test[["u", "v"]].to_numpy()) ** 2).sum(axis=1).mean()))
        assert r.cv_rmse == pytest.approx(np.mean(errors), rel=1e-6)


def test_quantiles_are_those_of_percentile(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, vs in enumerate((rng.exponential(size=500), [0.0] * 30 + [5.0], [3.0], [0.0, 1e-300, 1e300, 7.0])) for v in vs]
    m = spark.createDataFrame(rows, "image int, v double")
    q = scoring.quantile(m, "image", "v", 0.95, "q")
    assert "percentile" not in q._jdf.queryExecution().optimizedPlan().toString()
    want = {r.image: r.q for r in m.groupBy("image").agg(F.percentile("v", 0.95).alias("q")).collect()}
    assert {r.image: r.q for r in q.collect()} == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}
