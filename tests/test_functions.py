"""Small functions and operators on their own: keys, windows, units, turns, rays, searches over a table, one-point tracks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitrack.functions import geo, numbers
from lumitrack.operators import clipping, projection, search, tracks
from lumitrack.plans.georeference import filter_files
from lumitrack.sources import points


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_windows_are_kept_within_the_frame(spark):
    rows = spark.createDataFrame([(-5, 20, 3, 900), (90, 95, 0, 1), (200, 300, 10, 5), (None, 1, 2, 3)], "x0 int, x1 int, y0 int, y1 int")
    got = [r.w for r in rows.select(points.window_of(F.struct("x0", "x1", "y0", "y1"), F.lit(100), F.lit(50)).alias("w")).collect()]
    assert [tuple(w) if w else None for w in got] == [(0, 3, 20, 50), (90, 0, 95, 1), (99, 10, 100, 11), None]


def test_units_and_insides(spark):
    u = numbers.to_unit(F.lit(30.0), F.lit(61))
    assert one(spark, u, numbers.from_unit(u, F.lit(61)), numbers.from_unit(F.lit(0.5), F.lit(1))) == (0.0, 30.0, 0.75)
    inside = lambda x, y: numbers.inside(F.lit(x), F.lit(y), F.lit(4), F.lit(3))
    assert one(spark, inside(0, 0), inside(3, 2), inside(4, 2), inside(3, 3), inside(-1, 0)) == (True, True, False, False, False)


def test_turns_follow_the_right_hand(spark):
    rng = np.random.default_rng(2)
    axes = rng.normal(size=(20, 3))
    axes /= np.linalg.norm(axes, axis=1, keepdims=True)
    rows = [tuple(map(float, (*rng.normal(size=3), *k, rng.uniform(-360, 360)))) for k in axes]
    table = spark.createDataFrame(rows, "x double, y double, z double, kx double, ky double, kz double, a double")
    got = [tuple(r.t) for r in table.select(geo.turned(geo.point(F.col("x"), F.col("y"), F.col("z")), geo.point(F.col("kx"), F.col("ky"), F.col("kz")), F.col("a")).alias("t")).collect()]
    for r, t in zip(rows, got, strict=True):
        (kx, ky, kz), a = r[3:6], math.radians(r[6])
        k = np.array([[0, -kz, ky], [kz, 0, -kx], [-ky, kx, 0]])
        assert np.allclose(t, (np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k) @ np.array(r[:3]))


def test_field_of_view_and_sphere(spark):
    o, d = geo.point(F.lit(3.0), F.lit(0.0), F.lit(0.0)), geo.point(F.lit(-1.0), F.lit(0.0), F.lit(0.0))
    fov, hit, miss = one(spark, projection.field_of_view(F.lit(50.0), F.lit(36.0)), projection.on_sphere(o, d, 1.0), projection.on_sphere(o, geo.point(F.lit(0.0), F.lit(1.0), F.lit(0.0)), 1.0))
    assert fov == pytest.approx(math.degrees(2 * math.atan(0.36))) and tuple(hit) == (1.0, 0.0, 0.0) and miss is None


def test_image_endings(spark, tmp_path):
    for name in ("a.JPG", "b.jpeg", "c.tif", "d.TIFF", "e.txt"):
        (tmp_path / name).write_bytes(b"x")
    named = lambda *e: sorted(r.file_name for r in points.list_images(spark, str(tmp_path), *e).collect())
    assert named() == ["a.JPG", "b.jpeg"] and named("tiff?") == ["c.tif", "d.TIFF"]


def test_tables_with_all_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2.5, 2)], "d double, i int")
    got = points.with_all_columns([a, b, a])
    assert got.columns == ["i", "s", "d"] and sorted(map(tuple, got.collect()), key=str) == [(1, "x", None), (1, "x", None), (2, None, 2.5)]


def test_keys_of_known_and_unknown_tracks(spark):
    known = spark.createDataFrame([("1.000|2.000", 1.0004, 2.0)], "track_key string, sourceX double, sourceY double")
    keys = spark.createDataFrame([(k,) for k in ("1.000|2.000", "3|-4.5", "a|1", "7", "", None, "5|")], "track_key string")
    got = sorted((r.track_key, r.x, r.y) for r in tracks.places_of_keys(keys, known).collect())
    assert got == [("1.000|2.000", 1.0004, -2.0), ("3|-4.5", 3.0, 4.5)]
    assert tracks.places_of_keys(keys.limit(0), known).isEmpty()


def test_a_single_point_is_no_track():
    t, x, y = np.linspace(-1, 1, 5), np.array([np.nan, 3.0, np.nan, np.nan, np.nan]), np.array([np.nan, 1.0, np.nan, np.nan, np.nan])
    got = clipping.clip_track(t, x, y, np.isfinite(x), tracks.FilterConfig(min_points=1))
    assert got.degree == 0 and not got.fit_used.any() and np.isnan(got.pred_x).all()
    none = clipping.clip_track(t, x, y, np.isfinite(x), tracks.FilterConfig(min_points=2))
    assert none.degree == -1 and not none.fit_used.any()
    # all but one fall off in the first round: that one is used, by the fit that came before
    y3 = np.array([0.0, 0.0, 0.0, 40.0, 9.0])
    kept = clipping.clip_track(t, np.zeros(5), y3, np.ones(5, bool), tracks.FilterConfig(order=1, min_points=1, mode="absolute", absolute_km=700.0))
    assert np.isfinite(kept.pred_y).all() and kept.fit_used.any()


def test_files_left_out_are_listed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / f"in/ISS001-E-{100 + i}_real.points").write_text("mapX,mapY,sourceX,sourceY\n1,2,3,-4\n" if i != 2 else "mapX,mapY\n1,2\n")
    filter_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), tracks.FilterConfig(order=1, min_points=2), 80.0, 101, 104, "ISS001")
    got = spark.read.option("header", True).csv(str(tmp_path / "out/left_out")).collect()
    assert sorted((r.frame_id, r.reason) for r in got) == [("100", "id out of range"), ("102", "required column missing"), ("105", "id out of range")]


def ray_places(px, py, yaw, pitch, roll, lat=10.0, lon=20.0, alt=400.0, w=600, h=400, fov=50.0):
    """Where rays meet the sphere, by vectors: a camera that looks down is tipped, turned about the vertical, and rolled."""
    la, lo = math.radians(lat), math.radians(lon)
    up = np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)])
    north = np.array([-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)])
    turn = lambda v, k, a: v * math.cos(a) + np.cross(k, v) * math.sin(a) + k * np.dot(k, v) * (1 - math.cos(a))
    p, y, r = map(math.radians, (pitch, yaw, roll))
    view = -math.cos(p) * up + math.sin(p) * north
    top = up - np.dot(up, view) * view
    top /= np.linalg.norm(top)
    right = np.cross(view, top)
    view, top, right = (turn(v, up, y) for v in (view, top, right))
    top, right = top * math.cos(r) + right * math.sin(r), right * math.cos(r) - top * math.sin(r)
    half = math.tan(math.radians(fov) / 2)
    d = view + np.outer(((px + 0.5) / w * 2 - 1) * half, right) + np.outer(((py + 0.5) / h * 2 - 1) * half * h / w, top)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    o = up * (10 + alt * 10 / 6371)
    b = d @ o
    inside = b * b - (o @ o - 100)
    with np.errstate(invalid="ignore"):
        hit = o + d * (-b - np.sqrt(inside))[:, None]
    return np.degrees(np.arcsin(hit[:, 2] / 10)), np.degrees(np.arctan2(hit[:, 1], hit[:, 0]))


def test_search_over_control_points(spark):
    rng = np.random.default_rng(8)
    px, py = rng.uniform(0, 600, 80).round(), rng.uniform(0, 400, 80).round()
    true = (37.0, 47.0, -4.0)
    lat, lon = ray_places(px, py, *true)
    rows = [(float(a), float(b), 600.0, 400.0, 50.0, 10.0, 20.0, 400.0, float(x), float(y)) for a, b, x, y in zip(px, py, lon, lat, strict=True)]
    table = spark.createDataFrame([*rows, rows[0][:8] + (None, None)], "px double, py double, width double, height double, fov_x double, cam_lat double, cam_lon double, cam_alt_km double, mapX double, mapY double").cache()
    asked = [true, (30.0, 50.0, 0.0), (37.0, 85.0, -4.0), (-150.0, 40.0, 20.0)]
    score = search.by_control_points(table)
    got = {r.candidate_id: r.score for r in score(spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "candidate_id int, yaw double, pitch double, roll double")).collect()}
    for i, a in enumerate(asked):
        la, lo = ray_places(px, py, *a)
        h = np.sin(np.radians(la - lat) / 2) ** 2 + np.cos(np.radians(la)) * np.cos(np.radians(lat)) * np.sin(np.radians(lo - lon) / 2) ** 2
        off = np.minimum(np.nan_to_num(2 * 6371.0088 * np.arcsin(np.sqrt(h)), nan=2000.0), 2000.0) / 100
        assert got[i] == pytest.approx(-math.sqrt((off**2).mean()), abs=1e-5), a
    found = search.search_orientation(spark, score, search.SearchConfig(max_evaluations=8))
    assert found.best[3] > found.candidates[0][3] and found.best[3] == max(c[3] for c in found.candidates) and len(found.candidates) <= 12
