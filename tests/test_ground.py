"""Ground systems held against what defines them: angles kept, the middle meridian's length, areas; the date line, nulls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitrack.functions import ground as systems
from lumitrack.operators import ground, rasters
from lumitrack.plans.frames import cropped

E2 = systems.FLATTENING * (2 - systems.FLATTENING)


def forward(spark, system, places):
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(places)], "i int, lon double, lat double").coalesce(1)
    x, y = system.forward(F.col("lon"), F.col("lat"))
    lon, lat = systems.changed(F.col("x"), F.col("y"), system, systems.geographic())
    got = rows.withColumns({"x": x, "y": y}).withColumns({"blon": lon, "blat": lat}).orderBy("i").collect()
    return np.array([[r.x, r.y, r.blon, r.blat] for r in got], dtype=float)


def meridian(lat):
    """The ellipsoid's meridian from the equator, by numerical integration."""
    t = np.linspace(0, math.radians(lat), 200_001)
    f = systems.SEMI_MAJOR * (1 - E2) / (1 - E2 * np.sin(t) ** 2) ** 1.5
    return float(((f[1:] + f[:-1]) / 2 * np.diff(t)).sum())


def test_transverse_mercator_is_true_on_its_meridian_and_keeps_angles(spark):
    rng = np.random.default_rng(3)
    places = [(9.0 + rng.uniform(-6, 6), rng.uniform(-83, 83)) for _ in range(40)]
    on = [(9.0, lat) for lat in (-80, -45, 0, 10, 45, 84)]
    got = forward(spark, systems.utm(32), [*places, *on])
    assert np.allclose(got[:, 2:], [*places, *on], atol=1e-8)
    for (_, lat), row in zip(on, got[len(places) :], strict=True):
        assert abs(row[0] - 500_000) < 1e-6 and abs(row[1] - 0.9996 * meridian(lat)) < 1e-3
    # a small step east and one north are at right angles and equally enlarged
    d = 1e-4
    moved = forward(spark, systems.utm(32), [p for lon, lat in places for p in ((lon + d, lat), (lon - d, lat), (lon, lat + d), (lon, lat - d))])[:, :2].reshape(-1, 4, 2)
    for (_, lat), m in zip(places, moved, strict=True):
        s = math.sin(math.radians(lat)) ** 2
        east = (m[0] - m[1]) / (math.cos(math.radians(lat)) * systems.SEMI_MAJOR / math.sqrt(1 - E2 * s))
        north = (m[2] - m[3]) / (systems.SEMI_MAJOR * (1 - E2) / (1 - E2 * s) ** 1.5)
        assert np.allclose([east[0], east[1]], [north[1], -north[0]], rtol=0, atol=1e-11)


def test_spherical_systems(spark):
    rng = np.random.default_rng(4)
    places = [(rng.uniform(-179, 179), rng.uniform(-84, 84)) for _ in range(60)]
    for system in (systems.mercator(), systems.sinusoidal()):
        assert np.allclose(forward(spark, system, places)[:, 2:], places, atol=1e-9)
    # the sinusoidal keeps areas: a cell of d by d degrees
    d, r = 1e-3, systems.SINUSOIDAL_RADIUS
    corners = forward(spark, systems.sinusoidal(), [p for lon, lat in places for p in ((lon, lat), (lon + d, lat), (lon, lat + d))])[:, :2].reshape(-1, 3, 2)
    for (_, lat), (o, e, n) in zip(places, corners, strict=True):
        area = (e - o)[0] * (n - o)[1] - (e - o)[1] * (n - o)[0]
        assert abs(area / (r**2 * math.radians(d) ** 2 * math.cos(math.radians(lat))) - 1) < 1e-4


@pytest.mark.parametrize("make", [systems.mercator, systems.sinusoidal, lambda: systems.utm(1)], ids=["mercator", "sinusoidal", "utm"])
def test_places_that_cannot_be_shown_are_null(spark, make):
    system = make()
    bad = [(None, 1.0), (1.0, None), (float("nan"), 0.0), (0.0, float("inf")), (0.0, 91.0)]
    rows = spark.createDataFrame(bad, "lon double, lat double")
    x, y = system.forward(F.col("lon"), F.col("lat"))
    back = systems.changed(F.lit(None).cast("double"), F.lit(1.0), system, systems.geographic())
    assert all(tuple(r) == (None, None, None, None) for r in rows.select(x.alias("x"), y.alias("y"), back[0].alias("a"), back[1].alias("b")).collect())


def image(spark, gt, w=30, h=20):
    return spark.createDataFrame([(0, w, h, gt)], "image int, width int, height int, gt array<double>")


def test_extent_holds_every_place_of_the_edge(spark):
    made = image(spark, [20.0, 0.5, 0.0, 70.0, 0.0, -0.5])
    got = ground.target_grids(made, systems.geographic(), systems.transverse_mercator(27.5)).first()
    x, y = np.meshgrid(np.linspace(20, 35, 61), np.linspace(70, 60, 41))
    each = forward(spark, systems.transverse_mercator(27.5), zip(x.ravel(), y.ravel(), strict=True))
    x0, y1 = got.gt[0], got.gt[3]
    x1, y0 = x0 + got.warp_width * got.gt[1], y1 - got.warp_height * got.gt[1]
    assert got.fits and x0 <= each[:, 0].min() + got.gt[1] / 2 and x1 >= each[:, 0].max() - got.gt[1]
    assert y1 >= each[:, 1].max() - got.gt[1] / 2 and y0 <= each[:, 1].min() + got.gt[1]
    # the lower edge is curved: its corners alone would cut the middle off
    assert forward(spark, systems.transverse_mercator(27.5), [(20, 60), (35, 60)])[:, 1].min() > each[:, 1].min() + got.gt[1] / 2


def test_a_raster_across_the_date_line_stays_whole(spark):
    zone = systems.utm(60)
    source = image(spark, [760_000.0, 2000.0, 0.0, 1_000_000.0, 0.0, -2000.0], 60, 20)  # about 179.4 to 180.5 degrees
    grid = ground.target_grids(source, zone, systems.geographic()).first()
    assert grid.fits and 179 < grid.gt[0] < 180 < grid.gt[0] + grid.warp_width * grid.gt[1] < 181
    pixels = spark.createDataFrame([(0, r, c, float(100 * r + c + 1)) for r in range(20) for c in range(60)], "image int, row int, col int, value double")
    targets = spark.createDataFrame([(0, grid.warp_width, grid.warp_height, list(grid.gt), 60, 20, [760_000.0, 2000.0, 0.0, 1_000_000.0, 0.0, -2000.0])], "image int, width int, height int, gt array<double>, source_width int, source_height int, source_gt array<double>")
    got = {(r.row, r.col): r.value for r in ground.reprojected(pixels, targets, zone, systems.geographic()).collect()}
    assert len(got) == grid.warp_width * grid.warp_height
    at = [(r, c) for r in range(grid.warp_height) for c in range(grid.warp_width)]
    places = forward(spark, zone, [(grid.gt[0] + (c + 0.5) * grid.gt[1], grid.gt[3] + (r + 0.5) * grid.gt[5]) for r, c in at])
    shown = 0
    for key, (x, y) in zip(at, places[:, :2], strict=True):
        col, row = math.floor((x - 760_000) / 2000), math.floor((1_000_000 - y) / 2000)
        inside = 0 <= col < 60 and 0 <= row < 20
        assert got[key] == (100 * row + col + 1 if inside else 0.0)
        shown += inside
    assert shown > 1000


def test_crop_across_systems(spark):
    """A light raster in degrees on frames in a zone: every pixel is the one under its middle; a frame elsewhere has no overlap."""
    light = spark.createDataFrame([(r, c, float((7 * r + 3 * c) % 150 + 20)) for r in range(80) for c in range(80)], "row int, col int, value double")
    gts = {1: [450_000.0, 1000.0, 0.0, 1_100_000.0, 0.0, -1000.0], 2: [450_000.0, 1000.0, 0.0, 5_100_000.0, 0.0, -1000.0]}
    images = spark.createDataFrame([(k, 60, 50, v) for k, v in gts.items()], "frame_index int, width int, height int, gt array<double>")
    mapping = spark.createDataFrame([(k, x, y) for k in gts for x, y in ((10, 10), (40, 30))], "frame_index int, geoX int, geoY int")
    origin = (98.4, 10.1, 0.015)
    gt = F.array(*map(F.lit, (origin[0], origin[2], 0.0, origin[1], 0.0, -origin[2])))
    status, pixels = cropped(mapping, images, light, gt, margin=5, systems=(systems.utm(47), systems.geographic()))
    said = {r.frame_index: r for r in status.collect()}
    assert said[1].status == "done" and said[2].status == "no overlap"
    got = {(r.row, r.col): r.tone for r in pixels.filter("frame_index = 1").collect()}
    assert pixels.filter("frame_index = 2").isEmpty() and len(got) == said[1].roi_width * said[1].roi_height
    want = {(r.row, r.col): r.tone for r in rasters.tone_mapped(light).collect()}
    rows = spark.createDataFrame([(r, c, gts[1][0] + (said[1].x0 + c + 0.5) * 1000, gts[1][3] - (said[1].y0 + r + 0.5) * 1000) for r, c in got], "row int, col int, x double, y double")
    lon, lat = systems.changed(F.col("x"), F.col("y"), systems.utm(47), systems.geographic())
    for p in rows.select("row", "col", lon.alias("lon"), lat.alias("lat")).collect():
        at = (math.floor((origin[1] - p.lat) / origin[2]), math.floor((p.lon - origin[0]) / origin[2]))
        assert got[p.row, p.col] == pytest.approx(want.get(at, 0.0))


def test_sides_across_systems_follow_the_ground(spark):
    side = spark.createDataFrame([(0, 10.0, 60.0, 30.0, 60.0), (0, None, 1.0, 2.0, 3.0)], "image int, x1 double, y1 double, x2 double, y2 double")
    got = ground.edges_across(side, systems.geographic(), systems.utm(34), 8).collect()
    want = forward(spark, systems.utm(34), [(10 + 2.5 * k, 60) for k in range(9)])[:, :2]
    assert len(got) == 8
    for r, a, b in zip(sorted(got, key=lambda r: r.x1), want, want[1:], strict=False):
        assert np.allclose((r.x1, r.y1, r.x2, r.y2), (*a, *b), atol=1e-6)


def test_a_grid_past_the_pole_follows_the_formula(spark):
    """An image of 8,000 rows of 0.02 degrees from 40 north ends at 120 south."""
    at = {"x": 100.0, "y": -120.0}
    row = spark.range(1).select(F.lit(at["x"]).alias("x"), F.lit(at["y"]).alias("y"))
    x, y = systems.sinusoidal(beyond_poles=True).forward(F.col("x"), F.col("y"))
    assert row.select(*systems.sinusoidal().forward(F.col("x"), F.col("y"))).first()[:] == (None, None)
    u, v = row.select(x, y).first()
    assert u == pytest.approx(systems.SINUSOIDAL_RADIUS * math.radians(100) * math.cos(math.radians(120))) and v == pytest.approx(-systems.SINUSOIDAL_RADIUS * math.radians(120))
    gt = F.array(*map(F.lit, (100.0, 0.02, 0.0, 40.0, 0.0, -0.02)))
    image = spark.range(1).select(F.lit(0).alias("image"), F.lit(64).alias("width"), F.lit(8000).alias("height"), gt.alias("gt"))
    grid = ground.target_grids(image, systems.geographic(), systems.sinusoidal(beyond_poles=True)).first()
    assert grid.fits and grid.gt[3] == pytest.approx(systems.SINUSOIDAL_RADIUS * math.radians(40))
    assert grid.gt[0] == pytest.approx(systems.SINUSOIDAL_RADIUS * math.radians(101.28) * math.cos(math.radians(120)))
