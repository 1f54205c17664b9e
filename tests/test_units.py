"""Operators on tiny hand-made inputs: exact fits, outliers, the antimeridian, gaps, boundaries, files, flows, cameras."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitrack.functions import geo, names, numbers
from lumitrack.operators import joins, kernels, projection, rasters, sampling, scoring, search, tracks
from lumitrack.operators.tracks import FilterConfig
from lumitrack.plans.georeference import filter_sequence
from lumitrack.sources import points, sinks
from lumitrack.streaming import frames as streaming

OBS = "track_key string, frame_index int, row_index long, mapX double, mapY double, sourceX double, sourceY double"


def track(values, key="k", start=0):
    return [(key, i, start + i, None if v is None else float(v), None if v is None else float(v) / 2, 0.0, -1.0) for i, v in enumerate(values)]


def run(spark, rows, n, config, radius=None):
    obs = spark.createDataFrame(rows, OBS)
    return filter_sequence(obs, spark.range(n).select(F.col("id").cast("int").alias("frame_index")), config, radius)


def cubic(i):
    return 10 + 0.5 * i + 0.02 * i**2 - 0.003 * i**3


CUBIC = FilterConfig(min_points=6, min_threshold_km=0.01)


def test_exact_cubic_has_no_outlier(spark):
    done = run(spark, track([cubic(i) for i in range(8)]), 8, CUBIC)
    q = done.track_qc.first()
    assert (q.n_fit_used, q.n_temporal_outliers, q.n_imputed, q.n_output, q.fit_degree) == (8, 0, 0, 8, 3) and q.max_residual_km < 1e-6


def test_displaced_point_is_imputed(spark):
    values = [cubic(i) for i in range(14)]
    values[6] += 3.0
    done = run(spark, track(values), 14, FilterConfig(min_points=6, sigma=2.0, min_threshold_km=0.01))
    out = {r.frame_index: r for r in done.written.collect()}
    assert out[6].temporal_status == "imputed" and abs(out[6].mapX - cubic(6)) < 1e-6 and out[5].temporal_status == "kept"


def test_antimeridian(spark):
    lon = [179.6, 179.8, 180.0, -179.8, -179.6, -179.4, -179.2, -179.0]
    rows = [("k", i, i, -180.0 if x == 180.0 else x, 1.0, 0.0, 0.0) for i, x in enumerate(lon)]
    fit = run(spark, rows, 8, FilterConfig(order=1, min_threshold_km=0.01)).track_qc.first()
    assert fit.n_fit_used == 8 and fit.max_residual_km < 1e-6


def test_gaps(spark):
    gap = [1.0] * 3 + [None] + [1.0] * 2 + [None] * 8 + [1.0] * 2 + [None] * 9 + [1.0] * 3 + [None]
    done = run(spark, track(gap), len(gap), FilterConfig(order=1, min_threshold_km=0.01, min_coverage=0.1))
    assert [r.frame_index for r in done.written.filter("temporal_status = 'imputed'").orderBy("frame_index").collect()] == [3, *range(6, 14)]
    done = run(spark, track(gap), len(gap), FilterConfig(order=1, min_threshold_km=0.01, min_coverage=0.1, max_gap=-1, extrapolate=True))
    assert done.written.count() == len(gap)


def test_short_track_vanishes(spark):
    done = run(spark, track([1, 2, 3, 4, 5]), 5, FilterConfig())
    assert done.written.count() == 0 and done.track_qc.first().n_finite == 5


def test_first_finite_and_first_row(spark):
    rows = track([cubic(i) for i in range(8)], start=10) + [("k", 2, 1, float("nan"), None, 0.0, -1.0)]
    done = run(spark, rows, 8, CUBIC, radius=80.0)
    row = done.written.filter("frame_index = 2").first()
    assert row.temporal_status == "kept" and math.isnan(row.mapX)
    assert done.points.filter("frame_index = 2").count() == 0


def test_clip_equals_numpy(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(12):
        n = 40
        seen = rng.random(n) < 0.8
        lon, lat = 5 + 0.1 * np.arange(n) + rng.normal(0, 0.02, n), 3 + 0.05 * np.arange(n) + rng.normal(0, 0.02, n)
        lon[rng.integers(0, n, 3)] += rng.normal(0, 2, 3)
        rows += [(f"t{k}", int(i), int(i), float(lon[i]), float(lat[i]), 0.0, 0.0) for i in range(n) if seen[i]]
        t = 2 * np.arange(n) / (n - 1) - 1
        now, last = seen.copy(), None
        for _ in range(4):
            px, py = np.polyval(np.polyfit(t[now], lon[now], 3), t), np.polyval(np.polyfit(t[now], lat[now], 3), t)
            a = np.sin(np.radians(py - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(py)) * np.sin(np.radians(px - lon) / 2) ** 2
            r = 2 * 6371.0088 * np.arcsin(np.sqrt(a))
            new = seen & (r <= r[now].mean() + 2 * r[now].std(ddof=1))
            if new.sum() < 6:
                used = now
                break
            used = new
            if (last is not None and (new == last).all()) or (new == now).all():
                break
            last, now = now, new
        want[f"t{k}"] = set(np.flatnonzero(used).tolist())
    done = run(spark, rows, 40, FilterConfig(sigma=2.0, min_points=6))
    got = {k: set() for k in want}
    for r in done.tracks.filter("fit_used").collect():
        got[r.track_key].add(r.frame_index)
    assert got == want


def test_radius_boundary(spark):
    lat = math.degrees(80.0 / geo.MEAN_RADIUS_KM)
    rows = [(1, 1, 0.0, 0.0), (1, 2, 0.0, lat * 0.9999), (1, 3, 50.0, 0.0), (1, 4, 50.0, lat * 1.001), (2, 5, 7.0, 7.0), (2, 6, 7.0, 7.0), (2, 7, None, 1.0), (3, 8, 1.0, 1.0), (4, 9, 179.9, 89.99), (4, 10, -0.1, 89.99), (5, 11, 179.99, 0.0), (5, 12, -179.99, 0.0)]
    df = joins.has_neighbour(spark.createDataFrame(rows, "f int, id int, mapX double, mapY double"), 80.0, ["f"], "id")
    assert {r.id for r in df.filter("has_neighbour").collect()} == {1, 2, 5, 6, 9, 10, 11, 12} and df.count() == len(rows)


def test_nearest_ties_and_days(spark):
    at = lambda d, h: datetime(2024, 1, d, h)
    states = spark.createDataFrame([(1, at(1, 0)), (2, at(1, 10)), (3, at(9, 0)), (4, at(9, 0))], "sid int, epoch timestamp")
    probes = spark.createDataFrame([(1, at(1, 5)), (2, at(1, 10)), (3, at(4, 0)), (4, at(20, 0)), (5, at(6, 0))], "id int, t timestamp")
    got = {r.id: r.nearest_sid for r in joins.nearest_in_time(probes, states, "t", "epoch", "sid").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3}
    assert {r.nearest_sid for r in joins.nearest_in_time(probes, states.limit(0), "t", "epoch", "sid").collect()} == {None}


def test_names(spark):
    row = spark.createDataFrame([("/d/ISS067-E-012345_real.points", "x y/ü", -0.0, 1.25)], "p string, q string, a double, b double")
    got = row.select(names.id_by_station(F.col("p")), names.safe_fragment(F.col("q")), names.source_key(F.col("b"), F.col("a")), names.sibling(F.col("p"), "_real.points", ".x")).first()
    assert tuple(got) == (12345, "x_y_", "1.250|-0.000", "/d/ISS067-E-012345.x")
    back = row.select(names.parse_source_key(names.source_key(F.col("b"), F.col("a"))).alias("k")).first().k
    assert (back.x, back.y) == (1.25, 0.0)


def test_numbers(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(numbers.finite(F.col("x"))).collect()] == [True, False, False, False]
    one = spark.range(1)
    assert one.select(numbers.lenient_double(F.lit("x")), numbers.lenient_double(F.lit(" 2.5 "))).first() == (None, 2.5)
    assert one.select(geo.wrap_degrees(F.lit(180.0)), geo.wrap_degrees(F.lit(-181.0)), geo.angle_between(F.lit(10.0), F.lit(350.0))).first() == (-180.0, 179.0, 20.0)
    p = one.select(geo.geo_to_pixel(F.lit(-0.5), F.lit(40.5), [F.lit(float(v)) for v in (0, 1, 0, 40, 0, -1)]).alias("p")).first().p
    assert (p.col, p.row) == (0, 0)


def test_point_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda n, t: (tmp_path / "in" / n).write_text(t)
    write("ISS001-E-100_real.points", "M comment\nmapX,mapY,sourceX,sourceY,enable,dX,dY,residual,note\n1,2,3,-4,1,0,0,0,a\nx,2,5,-6,1,0,0,0,b M cut\n")
    write("ISS001-E-101_real.points", "mapY,sourceX,sourceY\n2,3,-4\n")
    write("ISS001-E-102_real.points", "mapX,mapY,sourceX,sourceY\n")
    got = points.read_points(spark, str(tmp_path / "in")).orderBy("row_index").collect()
    assert [(r.frame_id, r.row_index, r.mapX, r.sourceY, r.extra) for r in got] == [(100, 0, 1.0, -4.0, {"note": "a"}), (100, 1, None, -6.0, {"note": "b"})]
    assert [r.file_name for r in points.rejected_files(spark, str(tmp_path / "in")).collect()] == ["ISS001-E-101_real.points"]
    frames = spark.createDataFrame([("ISS001-E-100_real.points", 0), ("ISS001-E-102_real.points", 1)], "file_name string, frame_index int")
    obs = points.observations(points.read_points(spark, str(tmp_path / "in")), frames)
    assert {r.track_key for r in obs.collect()} == {"3.000|-4.000", "5.000|-6.000"}
    assert [r.frame_id for r in points.ids_in_range(points.read_points(spark, str(tmp_path / "in")), 99, 101).collect()] == [100]
    manifest = sinks.write_points(obs.withColumn("row_ordinal", F.col("row_index")), frames, str(tmp_path / "out"))
    assert {(r.frame_index, r.n) for r in manifest.collect()} == {(0, 2), (1, 0)}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/points")).count() == 2


def test_elements_and_tags(spark):
    text = ["1 25544U 98067A   24061.50000000  .0001", "2 25544  51.6", "junk", "1 25544U 98067A   24062.25000000  .0001", "1 25544U 98067A   24063.00000000  .0001", "2 25544  51.7"]
    got = points.elements(spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "path string, nth int, line string")).orderBy("epoch").collect()
    assert [r.epoch for r in got] == [datetime(2024, 3, 1, 12), datetime(2024, 3, 3)] and got[0].name == "25544U"
    tags = spark.createDataFrame([(1, "2012:03:28 01:50:00", None, "400/10", "10", None, "11", "12"), (2, "bad", "2012:03:28 02:00:00", "35", None, None, "7", "8")], "id int, taken string, changed string, focal string, width string, height string, file_width string, file_height string")
    a, b = points.photo_tags(tags).orderBy("id").collect()
    assert (a.time, a.focal, a.width, a.height) == (datetime(2012, 3, 28, 1, 50), 40.0, 10, 12) and (b.time, b.focal, b.width) == (datetime(2012, 3, 28, 2), 35.0, 7)


def test_flow_correction(spark):
    n = 10
    flow = spark.createDataFrame([(0, r, c, 2.0, -1.0) for r in range(n) for c in range(n)], "image int, row int, col int, dx double, dy double")
    pts = spark.createDataFrame([(0, i, 0.5, 0.5) for i in range(4)] + [(1, 0, 0.0, 0.0)], "frame_index int, row_ordinal int, mapX double, mapY double")
    mapping = spark.createDataFrame([(0, 0, 3.0, 4.0), (0, 1, 9.0, 9.0), (0, 2, 50.0, 4.0), (0, 3, float("nan"), 4.0), (0, 4, 1.0, 1.0)], "frame_index int, row_ordinal int, geoX double, geoY double")
    meta = spark.createDataFrame([(0, 0, 0, 1.0, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0])], "frame_index int, x0 int, y0 int, sign double, gt array<double>")
    got = {r.row_ordinal: (r.correction_reason, r.mapX, r.mapY) for r in rasters.corrected_points(pts, mapping, flow, meta).collect()}
    assert got == {0: ("applied", 5.0, -3.0), 1: ("applied", 11.0, -8.0), 2: ("outside_flow_roi", 50.0, -4.0), 3: ("non_finite_mapping_pixel", 0.5, 0.5)}


def test_bilinear_on_a_plane(spark):
    plane = spark.createDataFrame([(0, r, c, 2.0 * c - 3.0 * r) for r in range(6) for c in range(8)], "image int, row int, col int, v double")
    pts = spark.createDataFrame([(0, 1.25, 2.5), (0, 7.0, 5.0), (0, 7.1, 1.0), (0, -0.1, 0.0), (0, float("nan"), 1.0)], "image int, x double, y double")
    got = [r.sampled_v for r in rasters.bilinear(pts, plane, ["v"]).orderBy("x", "y").collect()]
    assert got[:3] == [None, pytest.approx(-5.0), pytest.approx(-1.0)] and got[3:] == [None, None]
    holes = spark.createDataFrame([(0, 0, 0, 10.0), (0, 0, 1, 10.0), (0, 1, 0, 10.0), (0, 1, 1, None), (0, 2, 2, 1.0)], "image int, row int, col int, v double")
    some = spark.createDataFrame([(0, 0.5, 0.5), (0, 0.5, 0.0), (0, 1.5, 1.5)], "image int, x double, y double")
    assert {(r.x, r.y): r.sampled_v for r in rasters.bilinear(some, holes, ["v"]).collect()} == {(0.5, 0.5): None, (0.5, 0.0): 10.0, (1.5, 1.5): None}


def test_camera_over_the_origin(spark):
    at = spark.createDataFrame([(300.0, 200.0, 0.0), (300.0, 200.0, 89.0)], "px double, py double, pitch double")
    full = at.select("*", *(F.lit(float(v)).alias(k) for k, v in {"width": 601, "height": 401, "fov_x": 40, "cam_lat": 0, "cam_lon": 0, "cam_alt_km": 400, "yaw": 0, "roll": 0}.items()))
    got = projection.projected(full).collect()
    assert abs(got[0].lat) < 1e-9 and abs(got[0].lon) < 1e-9 and got[1].lat is None


def test_time_grid_restarts(spark):
    spans = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1, 30))], "start_ts timestamp, end_ts timestamp")
    got = projection.time_grid(spans, 0.7).orderBy("t").collect()
    assert len(got) == 86 + 43 and got[86].t == datetime(2024, 1, 1, 0, 1)


def test_simplex_finds_the_peak(spark):
    def score(c):
        return c.select("candidate_id", (-(F.pow(geo.angle_between(F.col("yaw"), F.lit(170.0)), 2)) / 100 - F.pow(F.col("pitch") - 50, 2) / 100).alias("score"))

    found = search.search_orientation(spark, score, search.SearchConfig(ranges=((-180, 180), (30, 90), (0, 0)), steps=(40.0, 10.0, 5.0), tolerance_deg=0.5), centre=(-170.0, 60.0, 0.0))
    assert abs(found.best[0] - 170) < 2 and abs(found.best[1] - 50) < 2 and found.best[2] == 0 and len(found.candidates) <= 142
    none = search.search_orientation(spark, lambda c: c.select("candidate_id", F.lit(None).cast("double").alias("score")))
    assert none.best is None


def test_kernels():
    rng = np.random.default_rng(0)
    x, y = rng.random(12), rng.random(12)
    v = np.stack([x * 2 + 1, y - x], axis=1)
    c = kernels.spline(x, y, v)
    assert np.allclose(kernels.spline_at(c, x, y, np.array([0.3]), np.array([0.6])), [[1.6, 0.3]])
    a = rng.random((40, 40)) * 255
    assert kernels.structural_likeness(a, a) == pytest.approx(1.0) and kernels.structural_likeness(a, rng.random((40, 40)) * 255) < 0.2
    smooth = kernels._smoothed(kernels._smoothed(rng.random((64, 64)) * 255, 3), 3)
    flow = kernels.dense_flow(smooth, np.roll(smooth, 2, axis=1))
    assert abs(np.median(flow[16:-16, 16:-16, 0]) - 2) < 0.3 and abs(np.median(flow[16:-16, 16:-16, 1])) < 0.3
    assert len(kernels.hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]]))) == 4


def test_flow_of_moved_tiles():
    rng = np.random.default_rng(2)
    a = rng.random((96, 96)) * 255
    for _ in range(2):
        a = kernels._smoothed(a, 2)
    x, y = np.meshgrid(np.arange(96.0), np.arange(96.0))
    for dx, dy in ((1.0, 0.0), (-2.5, 1.5), (0.25, -3.0)):
        flow = kernels.dense_flow(a, kernels.sampled(a, x - dx, y - dy))[16:-16, 16:-16]
        assert np.abs(flow - [dx, dy]).mean() < 0.15
    assert np.abs(kernels.dense_flow(a, a)).max() < 1e-9


def test_from_files_to_files(spark, tmp_path):
    from lumitrack.plans.georeference import filter_files

    (tmp_path / "in").mkdir()
    nodes = [(sx, sy) for sx in (0, 185, 370) for sy in (0, -185, -370)]
    for f in range(12):
        rows = [f"{10 + 0.1 * f + sx / 1000 + (8 if (f, sx, sy) == (5, 185, -185) else 0)},{20 + sy / 1000},{sx},{sy},{0 if sx == 0 else 1},0.5,0.25,0.125,n{f}" for sx, sy in nodes if not (f == 7 and (sx, sy) == (0, 0))]
        rows += ["1,2,none,5,1,0,0,0,x"] if f == 3 else []
        (tmp_path / "in" / f"ISS001-E-{100 + f}_real.points").write_text("mapX,mapY,sourceX,sourceY,enable,dX,dY,residual,note\n" + "\n".join(rows) + "\n")
    (tmp_path / "in" / "ISS001-E-300_real.points").write_text("mapX,mapY\n1,2\n")
    found = filter_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), tracks.FilterConfig(order=1, min_points=4), 80.0)
    from lumitrack.sources.point_files import read_point_files

    out = read_point_files(spark, str(tmp_path / "out/points")).collect()
    assert len(out) == 12 * 9 and {r.frame_id for r in out} == set(range(100, 112))
    by = {(r.frame_id - 100, r.sourceX, r.sourceY): r for r in out}
    moved, missing, own = by[5, 185, -185], by[7, 0, 0], by[4, 0, -185]
    assert (moved.temporal_status, moved.enable, moved.dX) == ("imputed", 1, 0.0) and moved.mapX == pytest.approx(10.685) and missing.mapX == pytest.approx(10.7)
    assert (own.temporal_status, own.enable, own.dX, own.dY, own.residual) == ("kept", 0, 0.5, 0.25, 0.125)
    notes = {(r.frame_index, r.track_key): r.note for r in found.written.collect()}
    assert notes[5, "185.000|-185.000"] == "n5" and notes[7, "0.000|0.000"] == "n0"
    qc = {int(r.frame_index): r for r in spark.read.option("header", True).csv(str(tmp_path / "out/frame_qc")).collect()}
    assert int(qc[3].input_count) == 10 and int(qc[7].input_count) == 8 and int(qc[5].imputed) == 1 and qc[11].input_name == "ISS001-E-111_real.points"
    tq = {r.track_key: r for r in spark.read.option("header", True).csv(str(tmp_path / "out/track_qc")).collect()}
    assert len(tq) == 9 and tq["185.000|-185.000"].n_temporal_outliers == "1" and tq["0.000|0.000"].n_observed == "11"
    assert {r.n_points for r in read_point_files(spark, str(tmp_path / "out/points"), what="files").collect()} == {9}


def test_switches_of_the_filter(spark):
    rows = [("a", f, f, 1.0 * f if f != 6 else None, 2.0, 0.0, 0.0, f != 4) for f in range(12)]
    obs = spark.createDataFrame(rows, "track_key string, frame_index int, row_index int, mapX double, mapY double, sourceX double, sourceY double, pre_spatial_ok boolean")
    frames = obs.select("frame_index")
    run = lambda **k: {r.frame_index: r for r in tracks.filtered_tracks(obs, frames, tracks.FilterConfig(order=1, min_points=4, **k)).collect()}
    assert run()[6].imputed and run()[4].fit_used and not run(fill_missing=False)[6].imputed
    assert not run(pre_spatial_fit=True)[4].fit_used and not run(pre_spatial_fit=True)[4].temporal_outlier
    off = run(temporal=False)
    assert off[3].kept and not off[6].kept and off[3].fit_degree == -1 and not any(r.imputed or r.temporal_outlier for r in off.values())


def test_numbers_of_files(spark):
    files = spark.createDataFrame([(f"f{i:03}",) for i in range(57)], "file_name string").repartition(5)
    assert [(r.file_name, r.frame_index, r.n_frames) for r in tracks.dense_index(files).orderBy("file_name").collect()] == [(f"f{i:03}", i, 57) for i in range(57)]
    assert tracks.dense_index(files.limit(0)).count() == 0


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 25544U 98067A   24061.50000000  .0001\r\n2 25544  51.6\n")
    assert [r.name for r in points.read_elements(spark, str(tmp_path)).collect()] == ["25544U"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.csv").write_text("sim_x,sim_y,real_x,real_y\n1,2,3,4\n")
    assert tuple(points.read_matches(spark, str(tmp_path / "m")).first()) == (1.0, 2.0, 3.0, 4.0, "a.csv")
    (tmp_path / "m/b.csv").write_text("sim_x,sim_y,real_x,real_y\n1,2,x,4\n")
    with pytest.raises(Exception, match="(?i)malformed|cannot|failfast"):
        points.read_matches(spark, str(tmp_path / "m")).collect()
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.csv").write_text("sourceX,sourceY,mapX,mapY,geoX,geoY\n1,2,3,4,5,6\n")
    assert points.read_mapping(spark, str(tmp_path / "g")).first().geoY == 6
    (tmp_path / "i").mkdir()
    for name in ("a.jpg", "b.JPEG", "c.txt"):
        (tmp_path / "i" / name).write_bytes(b"1234")
    assert {(r.file_name, r.length) for r in points.list_images(spark, str(tmp_path / "i")).collect()} == {("a.jpg", 4), ("b.JPEG", 4)}
    np.save(tmp_path / "flow.npy", np.arange(12.0).reshape(2, 3, 2))
    (tmp_path / "bad.npy").write_bytes(b"no array")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(str(tmp_path))
    got = points.read_flow_arrays(files).collect()
    assert sorted((r.row, r.col, r.dx, r.dy) for r in got if r.error is None) == [(i // 3, i % 3, 2.0 * i, 2.0 * i + 1) for i in range(6)] and sum(r.error is not None for r in got) == 1
    table = spark.createDataFrame([(0, 1), (1, 2)], "frame_index int, v int")
    sinks.replace_frames(table, str(tmp_path / "f"))
    sinks.replace_frames(table.filter("frame_index = 1").withColumn("v", F.lit(9)), str(tmp_path / "f"))
    assert {(r.frame_index, r.v) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {(0, 1), (1, 9)}
    sinks.append_json(table, str(tmp_path / "j"))
    sinks.append_json(table, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.write_by_frame(table, str(tmp_path / "c"), kind="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_polynomial_reproduces(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, float(x), float(y), float(1 + x * y), float(y * y - x)) for i, (x, y) in enumerate(rng.random((40, 2)))]
    m = spark.createDataFrame(rows, "image int, nth int, x double, y double, u double, v double")
    p = scoring.polynomial_2d(m, ["image"]).first()
    assert np.allclose(p.px, [1, 0, 0, 0, 1, 0], atol=1e-7) and np.allclose(p.py, [0, -1, 0, 0, 0, 1], atol=1e-7)
    assert scoring.holdout_rmse(m, ["image"]).first().cv_rmse < 1e-7


def test_samples(spark):
    rows = spark.range(25).withColumn("g", F.lit(1))
    assert [r.id for r in sampling.evenly_spaced(rows, ["g"], ["id"], 4).orderBy("id").collect()] == [0, 8, 16, 24]
    assert sampling.evenly_spaced(rows, ["g"], ["id"], 1).count() == 1 and sampling.evenly_spaced(rows, ["g"], ["id"], 30).count() == 25


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), f"t{m % 3}") for m in range(20)], "ts timestamp, track_key string")
    rows.write.parquet(str(tmp_path / "in"))
    counted = streaming.frame_counts(streaming.read_points_stream(spark, str(tmp_path / "in"), rows.schema), "ts", "5 minutes", "1 minute")
    query = streaming.write_stream(counted, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert {r.n_points for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {5}


def test_files_by_preference(spark):
    files = spark.createDataFrame([("a.png",), ("a.JPG",), ("b.tif",)], "file_name string")
    got = points.first_existing(spark.createDataFrame([("a",), ("b",), ("c",)], "base string"), files, [".JPG", ".png", ".tif"])
    assert {r.base: r.file_name for r in got.collect()} == {"a": "a.JPG", "b": "b.tif", "c": None}


def pixels_of(spark, a, b, image=1):
    import pandas as pd

    rows, cols = np.mgrid[: a.shape[0], : a.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"image": image, "row": rows.ravel().astype("int32"), "col": cols.ravel().astype("int32"), "a": a.ravel(), "b": b.ravel()}))


def test_tiles_are_of_whole_images(spark):
    rng = np.random.default_rng(4)
    for shape, dark in (((61, 9), 0), ((61, 9), 30), ((5, 9), 0), ((40, 12), 38)):
        a = rng.random(shape) * 255
        a[:dark] = 0
        b = a * 0.9 + rng.random(shape) * 20
        got = kernels.image_likeness(pixels_of(spark, a, b), tile=16).first().likeness
        assert got == pytest.approx(kernels.masked_likeness(a, b), nan_ok=True)
    a = rng.random((900, 16)) * 255
    for _ in range(3):
        a = kernels._smoothed(a, 3)
    b = kernels.sampled(a, *np.meshgrid(np.arange(16.0) + 0.2, np.arange(900.0) + 0.3))
    want, got = kernels.dense_flow(a, b), kernels.image_flow(pixels_of(spark, a, b), tile=128).toPandas()
    assert len(got) == a.size and not got.duplicated(["row", "col"]).any()
    assert np.allclose(got[["dx", "dy"]], want[got["row"], got["col"]], atol=1e-6)


def test_tile_queries_see_every_row(spark):
    from lumitrack import queries
    from lumitrack.surrogates import raster

    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["tile_flow"](spark, sf).count() == raster(spark, sf).count()
    p = raster(spark, sf).filter("image = 3").orderBy("row", "col").toPandas()
    a = p["value"].to_numpy().reshape(-1, 64)
    got = queries.QUERIES["tile_likeness"](spark, sf).filter("image = 3").first().likeness
    assert got == pytest.approx(kernels.masked_likeness(a, a * 0.9 + 5.0), abs=2e-5)


def test_warp_uses_all_control_points(spark):
    rng = np.random.default_rng(6)
    x, y = rng.random(400) * 3, rng.random(400) * -8
    u, v = np.sin(x) + y, np.cos(y / 3) * x
    points = spark.createDataFrame([(1, *map(float, p)) for p in zip(x, y, u, v)], "frame_index int, x double, y double, u double, v double").repartition(3)
    targets = spark.createDataFrame([(1, 1.5, -7.0), (1, 0.5, -1.0), (1, 2.0, -4.0), (2, 0.0, 0.0)], "frame_index int, x double, y double")
    for most, off in ((400, 0.02), (399, 0.05)):
        got = kernels.warped(points, targets, solved_to=most).collect()
        assert len(got) == 3 and all(abs(r.u - (math.sin(r.x) + r.y)) < off and abs(r.v - math.cos(r.y / 3) * r.x) < off for r in got)


def test_warp_query_fits_tracks_of_all_source_rows(spark, tmp_path):
    from datetime import timedelta

    from lumitrack import queries

    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i % 20), i, "view", float(i * i % 97)) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    seen = {}
    for n in (165, 400):  # 165 tracks have a sourceY above -1900
        events.filter(f"user_id < {n}").write.parquet(str(tmp_path / f"{n}/events.parquet"))
        seen[n] = [tuple(r) for r in queries.QUERIES["tps_warp"](spark, str(tmp_path / str(n))).orderBy("x", "y").collect()]
    assert len(seen[165]) == len(seen[400]) == 20 and seen[165] != seen[400]
