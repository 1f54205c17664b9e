"""Homographies, polygons, scans with carry, match decoding and the log of files, each against brute force."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitrack.operators import homography, joins, polygons, tracks
from lumitrack.plans import shared
from lumitrack.sources import match_results, snapshots
from lumitrack.sources.snapshots import Conflict, Log

# --- homographies


def planted(share=0.4, n=400, images=3, seed=1):
    rng, rows, truth = np.random.default_rng(seed), [], {}
    for image in range(images):
        h = np.array([[1 + 0.1 * rng.normal(), 0.1 * rng.normal(), 60 * rng.normal()], [0.1 * rng.normal(), 1 + 0.1 * rng.normal(), 60 * rng.normal()], [2e-5 * rng.normal(), 2e-5 * rng.normal(), 1]])
        truth[image] = h
        for nth in range(n):
            x, y = rng.uniform(0, 1500, 2)
            w = h @ [x, y, 1]
            u, v = w[:2] / w[2] + rng.uniform(-0.5, 0.5, 2)
            good = nth < share * n
            if not good:
                u, v = u + rng.uniform(20, 600) * rng.choice([-1, 1]), v + rng.uniform(20, 600) * rng.choice([-1, 1])
            rows.append((image, nth, float(x), float(y), float(u), float(v), bool(good)))
    return rows, truth


MATCHES = "image int, nth int, x double, y double, u double, v double, good boolean"


def test_planted_homographies_among_wrong_matches(spark):
    rows, truth = planted()
    table = spark.createDataFrame(rows, MATCHES)
    found = {r.image: r for r in homography.homographies(table, ["image"]).collect()}
    for image, h in truth.items():
        assert found[image].n == 400 and found[image].n_inliers == 160
        p = np.array([[100.0, 200, 1], [1400, 100, 1], [700, 1300, 1]]).T
        a, b = h @ p, np.array(found[image].h).reshape(3, 3) @ p
        assert np.abs(a[:2] / a[2] - b[:2] / b[2]).max() < 0.5
    other = {r.image: r.n_inliers for r in homography.homographies(table.repartition(7), ["image"]).collect()}
    assert other == {i: 160 for i in truth}
    flags = homography.with_inliers(table.repartition(2, "nth"), ["image"])
    assert flags.filter("good <> inlier").count() == 0 and flags.columns == [*table.columns, "inlier"]


def test_homographies_of_odd_groups(spark):
    inf, few = float("inf"), [(0, i, float(i), 1.0, 2.0, 3.0, True) for i in range(3)]
    line = [(1, i, float(i), 2.0 * i, 3.0 * i, 1.0, True) for i in range(30)]
    same = [(2, 5, 1.0, 1.0, 2.0, 2.0, True)] * 20
    odd = [(3, i, x, float(y), float(x or 0) + 5, float(y) + 7, True) for i, (x, y) in enumerate((float(a), b) for a in range(0, 60, 10) for b in range(0, 60, 10))]
    odd += [(3, 100, None, 1.0, 1.0, 1.0, False), (3, 101, inf, 1.0, 1.0, 1.0, False), (3, 102, 1.0, 1.0, None, 1.0, False)]
    table = spark.createDataFrame(few + line + same + odd, MATCHES)
    found = homography.homographies(table, ["image"], hypotheses=60).collect()
    assert [(r.image, r.n, r.n_inliers) for r in found] == [(3, 36, 36)] and np.allclose(np.array(found[0].h), [1, 0, 5, 0, 1, 7, 0, 0, 1], atol=1e-6)
    assert homography.with_inliers(table, ["image"], hypotheses=60).filter("inlier").groupBy("image").count().collect() == [(3, 36)]
    assert homography.homographies(table.limit(0), ["image"]).count() == 0


def test_fits_of_four():
    rng = np.random.default_rng(3)
    h = np.array([[1.1, 0.2, 30], [-0.1, 0.9, -20], [1e-4, -2e-4, 1]])
    p = rng.uniform(0, 1000, (50, 4, 2))
    w = p @ h[:, :2].T + h[:, 2]
    q = w[..., :2] / w[..., 2:]
    p[7, 2] = (p[7, 0] + p[7, 1]) / 2  # on a line
    got, good = homography.fitted(p, q)
    assert 7 not in good and len(good) > 40 and np.abs(got - h).max() < 1e-6
    assert homography.distances(got[:1], p[good[0]], q[good[0]]).max() < 1e-6


# --- polygons


def brute_inside(edges, rows, cols):
    out = set()
    for r in range(rows):
        for c in range(cols):
            n = sum((y1 <= r + 0.5) != (y2 <= r + 0.5) and x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) <= c + 0.5 for x1, y1, x2, y2 in edges)
            if n % 2:
                out.add((r, c))
    return out


def test_polygons_with_holes_and_crossings(spark):
    rng = random.Random(2)
    rings = {0: [[(2, 2), (18, 2), (18, 18), (2, 18)], [(6, 6), (6, 12), (12, 12), (12, 6)]], 1: [[(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(9)]], 2: [[(1, 1), (5, 5)]], 3: [[(50, 50), (60, 50), (55, 60)]]}
    vertices = [(i, k, n, float(x), float(y)) for i, rs in rings.items() for k, ring in enumerate(rs) for n, (x, y) in enumerate(ring)] + [(0, 0, 99, None, 1.0)]
    pixels = spark.createDataFrame([(i, r, c) for i in (0, 1, 2, 3, 4) for r in range(20) for c in range(20)], "image int, row int, col int")
    edges = polygons.edges_of(spark.createDataFrame(vertices, "image int, ring int, nth int, x double, y double"))
    by_image = {i: [] for i in range(5)}
    for e in edges.collect():
        by_image[e.image].append(tuple(e)[1:])
    got = {i: set() for i in range(5)}
    for r in polygons.clipped(pixels, edges).collect():
        got[r.image].add((r.row, r.col))
    assert got == {i: brute_inside(e, 20, 20) for i, e in by_image.items()} and len(got[0]) == 16 * 16 - 36 and got[1]
    status = {r.image: r.status for r in polygons.clip_status(pixels.filter("image <> 1"), edges).collect()}
    assert status == {0: "ok", 1: "no pixels", 2: "no overlap", 3: "no overlap", 4: "no overlap"}


def test_outline_and_fill_are_inverse(spark):
    rng = random.Random(5)
    valid = {(i, r, c) for i in range(3) for r in range(15) for c in range(15) if rng.random() < (0.9, 0.5, 0.1)[i]}
    pixels = spark.createDataFrame([(i, r, c) for i in range(3) for r in range(-2, 17) for c in range(-2, 17)], "image int, row int, col int")
    edges = polygons.outline(spark.createDataFrame(sorted(valid) * 2, pixels.schema))
    assert {tuple(r) for r in polygons.clipped(pixels, edges).collect()} == valid
    block = polygons.outline(spark.createDataFrame([(0, r, c) for r in range(3, 8) for c in range(2, 9)], pixels.schema)).collect()
    assert sorted(tuple(e)[1:] for e in block) == [(2.0, 3.0, 2.0, 8.0), (2.0, 3.0, 9.0, 3.0), (9.0, 8.0, 2.0, 8.0), (9.0, 8.0, 9.0, 3.0)]
    assert polygons.outline(pixels.limit(0)).count() == 0


# --- scans


@pytest.mark.parametrize("parts", (1, 3, 16))
def test_nearest_in_time_carries_over_parts(spark, parts):
    rng = random.Random(7)
    stamp = lambda s: f"timestamp_seconds({s})"
    keys = ["hot"] * 300 + ["a", "b", None] * 15 + ["none"] * 3
    probes = [(i, k, rng.randint(0, 5000)) for i, k in enumerate(keys)]
    states = [(i, k, rng.randint(0, 5000)) for i, k in enumerate(["hot"] * 12 + ["a"] + ["b"] * 3 + [None] * 2)] + [(100, "hot", 2500), (99, "hot", 2500), (101, "only", 3)]
    p = spark.createDataFrame(probes, "id int, k string, s int").withColumn("ts", F.expr(stamp("s")))
    e = spark.createDataFrame(states, "sid int, k string, s int").select("sid", "k", F.expr(stamp("s")).alias("epoch"))

    def brute(i, k, s, keyed):
        near = [(abs(s - t), sid) for sid, key, t in states if key == k or not keyed]
        first = {t: min(sid for sid, key, u in states if u == t and (key == k or not keyed)) for _, key, t in states if key == k or not keyed}
        near = [(abs(s - t), sid) for t, sid in first.items()]
        return min(near)[1] if near else None

    for by in (["k"], None):
        got = {r.id: r.nearest_sid for r in joins.nearest_in_time(p, e if by else e.drop("k"), "ts", "epoch", "sid", by, parts).collect()}
        assert got == {i: brute(i, k, s, bool(by)) for i, k, s in probes}


def test_hot_key_is_dealt_to_all_parts(spark):
    p = spark.range(4000).select(F.col("id"), F.lit("one").alias("k"), F.timestamp_seconds("id").alias("ts"))
    e = p.filter("id % 50 = 0").select(F.col("id").alias("sid"), "k", F.col("ts").alias("epoch"))
    out = joins.nearest_in_time(p, e, "ts", "epoch", "sid", ["k"], 8)
    assert out.filter("id <= 3950 and abs(id - nearest_sid) > 25").count() == 0 and out.count() == 4000
    dealt = p.repartitionByRange(8, "k", "ts").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 1500


def test_no_frame_is_scanned_anew_for_each_row(spark):
    p = spark.range(40).select("id", F.timestamp_seconds("id").alias("ts"))
    e = p.select(F.col("id").alias("sid"), F.col("ts").alias("epoch"))
    plan = joins.nearest_in_time(p, e, "ts", "epoch", "sid")._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$()" in plan and "unboundedfollowing$()" not in plan


def test_places_are_counted_once(spark):
    p = spark.range(60).select("id", F.lit(0).alias("g"), (F.col("id") % 6 * 1.0).alias("mapX"), (F.col("id") % 5 * 1.0).alias("mapY")).filter("id < 31")
    found = joins.has_neighbour(p, 80.0, ["g"], "id")
    # of the 30 places one has two points
    assert sorted(r.id for r in found.filter("has_neighbour").collect()) == [0, 30]
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


def by_brute_force(rows, radius):
    """Ids of (group, id, lon, lat) with another row of their group within the radius."""
    out = set()
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g and None not in r[2:]]
        ids, (lon, lat) = np.array([r[1] for r in mine]), np.radians(np.array([r[2:] for r in mine], dtype=float).reshape(-1, 2)).T
        a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        near = 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(a, 0, 1))) <= radius
        np.fill_diagonal(near, False)
        out |= set(ids[near.any(axis=1)].tolist())
    return out


def test_neighbours_anywhere_and_of_any_radius(spark):
    """Poles, the date line, latitudes that have gone on past a pole, dense spots, one place twice, no place, no group."""
    rng = np.random.default_rng(11)
    spots = [(rng.uniform(-180, 180, 120), rng.uniform(-90, 90, 120)), (rng.uniform(-180, 180, 60), rng.uniform(89.0, 90.5, 60)), (rng.choice([-1, 1], 60) * rng.uniform(179.5, 180, 60), rng.uniform(-1, 1, 60))]
    spots += [(rng.uniform(5, 6, 150), rng.uniform(50, 51, 150)), (rng.uniform(0, 40, 60), rng.uniform(-140, -90, 60)), (rng.uniform(20, 20.0001, 40), rng.uniform(10, 10.0001, 40)), ([7.0, 7.0, None], [7.0, 7.0, 1.0])]
    places = [(x if x is None else float(x), y if y is None else float(y)) for a, b in spots for x, y in zip(a, b, strict=True)]
    rows = [(k % 2, k, *p) for k, p in enumerate(places)]
    p = spark.createDataFrame([*rows, (None, -1, 7.0, 7.0), (None, -2, 7.0, 7.0)], "g int, id int, mapX double, mapY double").repartition(3).cache()
    for radius in (0.003, 2.0, 80.0, 3000.0, 30_000.0):
        df = joins.has_neighbour(p, radius, ["g"], "id").cache()
        found = {r.id for r in df.filter("has_neighbour").collect()}
        assert found == by_brute_force(rows, radius) and df.count() == p.count() and df.filter("has_neighbour is null").count() == 0
        assert len(found) < len(rows) - 1 or radius > 3000


def test_no_place_is_sent_to_all_tasks(spark, monkeypatch):
    """More places without a neighbour than may be sent, and their table as a file is smaller than what Spark sends unasked."""
    plans = []
    def stored(df, name):  # noqa: E306
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.kept(df, name)

    monkeypatch.setattr(joins, "kept", stored)
    n = shared.SMALL_ROWS + 10_000
    p = spark.range(n + 1).select("id", F.lit(0).alias("g"), (F.col("id") % 300 * 1.0 - 150.0).alias("mapX"), (F.floor(F.col("id") / 300) * 1.0 - 50.0 - F.when(F.col("id") == n, 0.99).otherwise(0.0)).alias("mapY"))
    found = joins.has_neighbour(p, 5.0, ["g"], "id")
    assert sorted(r.id for r in found.filter("has_neighbour").collect()) == [n - 300, n]
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1 and not any("Broadcast" in plan for plan in plans)


def test_status_of_points_by_one_grouping(spark):
    at = lambda *them: spark.createDataFrame([(f, k) for f, k in them], "frame_index int, track_key string")
    s = tracks.point_status(at((0, "a"), (0, "a"), (0, "b")), at((0, "b"), (0, "c")), at((0, "a"), (0, "d"), (0, "d"), (1, "a")))
    got = {(r.frame_index, r.track_key): (r.is_final, r.is_corrected, r.is_read, r.colour) for r in s.collect()}
    assert got == {(0, "a"): (True, False, True, "blue"), (0, "b"): (True, True, False, "green"), (0, "c"): (False, True, False, "orange"), (0, "d"): (False, False, True, "red"), (1, "a"): (False, False, True, "red")}
    assert s.count() == 5 and "Join" not in s._jdf.queryExecution().executedPlan().toString()


def test_one_element_for_a_minute(spark):
    t = spark.createDataFrame([(i, s) for i, s in enumerate((0, 59, 60, 119, 130))], "id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    e = spark.createDataFrame([(1, 10), (2, 70), (3, 100)], "sid int, s int").select("sid", F.timestamp_seconds("s").alias("epoch"))
    assert {r.id: r.nearest_sid for r in joins.element_per_minute(t, e, "ts", "epoch", "sid").collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}


def test_rows_without_a_time_stay_and_have_no_element(spark):
    t = spark.createDataFrame([(0, 5), (1, None), (2, 65), (3, None)], "id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    e = spark.createDataFrame([(9, None), (1, 10), (2, 70)], "sid int, s int").select("sid", F.timestamp_seconds("s").alias("epoch"))
    near = lambda t, e: {r.id: r.nearest_sid for r in joins.element_per_minute(t, e, "ts", "epoch", "sid").collect()}
    assert near(t, e) == {0: 1, 1: None, 2: 2, 3: None}
    assert near(t.filter("s is null"), e) == {1: None, 3: None} and near(t, e.filter("sid = 9")) == dict.fromkeys(range(4))


def test_a_task_scans_one_part(spark):
    p = spark.range(4000).select("id", F.timestamp_seconds("id").alias("ts"))
    e = p.filter("id % 50 = 0").select(F.col("id").alias("sid"), F.col("ts").alias("epoch"))
    out = joins.nearest_in_time(p, e, "ts", "epoch", "sid", parts=16)
    dealt = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.count() == 4000 and len(dealt) > 12 and max(r["count"] for r in dealt) < 500


def test_minutes_are_no_frame_scanned_anew(spark):
    t = spark.range(40).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    e = t.select(F.col("id").alias("sid"), F.col("ts").alias("epoch"))
    plan = joins.element_per_minute(t, e, "ts", "epoch", "sid")._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$()" in plan and "unboundedfollowing$()" not in plan


# --- results of matchers


def test_matches_of_odd_results(spark):
    rows = {
        "no json": None, "[1, 2]": None, "null": None, "{}": None,
        '{"mkpts0": [[1, 2]], "mkpts1": [[3, 4], [5, 6]]}': [((1, 2), (3, 4))],
        '{"mkpts0": [[1, 2], [3, null], [4, 5]], "mkpts1": [[3, 4], [5, 6], [7, 8]]}': [((1, 2), (3, 4)), ((4, 5), (7, 8))],
        '{"mkpts0": [[1, 2, 9]], "mkpts1": [[[3, 4, 9]]], "inlier_kpts0": [], "inlier_kpts1": [[1, 1]]}': [((1, 2), (3, 4))],
        '{"inlier_kpts0": [[7, 7]], "inlier_kpts1": [[8, 8]], "mkpts0": [[1, 2]], "mkpts1": [[3, 4]]}': [((7, 7), (8, 8))],
        '{"kpts0": [[1, 1], [2, 2]], "kpts1": [[5, 5]], "matches": [[0, 1], [3, 0], [-1, 0]], "matches0": [-1, 0]}': [((2, 2), (5, 5))],
        '{"kpts0": [[1, 1]], "keypoints0": [[3, 3]], "keypoints1": [[4, 4], [6, 6]], "matches1": [7, 0, 0]}': [((3, 3), (6, 6))],
        '{"kpts0": [[1, 1]], "kpts1": [[2, 2]], "matches": []}': None, '{"mkpts0": "text", "mkpts1": 4}': None,
    }
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(99, None)], "id int, result string")
    got = {r.id: r.matched and [(tuple(m.left[:2]), tuple(m.right[:2])) for m in r.matched] for r in match_results.decoded(table).collect()}
    assert got == dict(enumerate(rows.values())) | {99: None}
    variant = table.withColumn("result", F.try_parse_json("result"))
    assert match_results.match_rows(match_results.decoded(variant), "id").count() == sum(len(v or []) for v in rows.values())


# --- the log of files

FILES = "frame_id long, file_name string, length long"


def ids(log, version=None):
    return sorted(r.frame_id for r in log.snapshot(version).collect())


def some(spark, *numbers):
    return spark.createDataFrame([(n, f"f{n}", 1) for n in numbers], FILES)


def test_versions_deletions_and_earlier_ones(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.version() == -1 and ids(log) == []
    assert [log.add(some(spark, 1, 2, 3, 10)), log.delete(2, 5), log.add(some(spark, 3, 4, None, 4)), log.delete(100, 200)] == [0, 1, 2, 3]
    assert [ids(log, v) for v in range(4)] == [[1, 2, 3, 10], [1, 10], [1, 3, 4, 10], [1, 3, 4, 10]]
    with pytest.raises(Conflict):
        log.add(some(spark, 7), read=1)
    assert log.add(some(spark, 7), read=3) == 4 and ids(Log(spark, str(tmp_path / "log"))) == [1, 3, 4, 7, 10]


def test_an_empty_version_counts_for_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "PATIENCE", 1)
    log = Log(spark, str(tmp_path / "log"))
    log.add(some(spark, 1))
    (tmp_path / "log/_log/0000000001.json").write_text("")
    assert log.add(some(spark, 2)) == 2 and ids(log) == [1, 2]


def test_two_writers_at_once(spark, tmp_path):
    made, errors = [], []

    def write(k):
        try:
            for i in range(3):
                made.append(Log(spark, str(tmp_path / "log")).add(some(spark, 10 * k + i)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(made) == list(range(9)) and ids(Log(spark, str(tmp_path / "log"))) == [0, 1, 2, 10, 11, 12, 20, 21, 22]


def test_wholes_are_stored_and_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "EACH", 3)
    log = Log(spark, str(tmp_path / "log"))
    for i in range(7):
        log.add(some(spark, i))
    log.delete(1, 2)
    assert log._names(".whole") == [2, 5] and ids(log) == [0, 3, 4, 5, 6] and ids(log, 4) == [0, 1, 2, 3, 4]


def test_existence_and_counts(spark):
    rng = random.Random(1)
    there = {rng.randrange(0, 200_000) for _ in range(3000)} | {0, 32_767, 32_768, 199_999}
    known = snapshots.bitmaps(some(spark, *there, *list(there)[:50]))
    asked = [*list(there)[:500], *range(32_760, 32_780), -5, 10**9]
    got = {r.frame_id: r.exists for r in snapshots.existing(spark.createDataFrame([(a,) for a in asked], "frame_id long"), known).collect()}
    assert got == {a: a in there for a in asked}
    for low, high in ((0, 200_000), (32_768, 32_768), (1000, 100_000), (5, 4)):
        assert snapshots.count_in_range(some(spark, *there), low, high).first().n == sum(low <= x <= high for x in there)


def test_followers_are_counted_as_distances_say():
    rng = np.random.default_rng(5)
    h = np.eye(3) + rng.normal(size=(40, 3, 3)) * [[0.05, 0.05, 3], [0.05, 0.05, 3], [1e-3, 1e-3, 0]]
    h[0, 2] = (1.0, 0.0, -10.0)  # its horizon is x = 10
    p = rng.uniform(0, 50, (1000, 2))
    p[:5, 0] = 10.0
    q = p + rng.normal(size=p.shape) * 3
    assert (homography.followers(h, p, q, 3.0) == (homography.distances(h, p, q) <= 3.0).sum(axis=1)).all()


def test_places_are_ranked_by_one_mention_of_each_number(spark):
    """The plan puts a column's expression in place of each mention; many mentions made code too long to compile."""
    rows = spark.range(9).select(F.lit(1).alias("g"), F.col("id").alias("nth"), *(F.when(F.col("id") != i, F.col("id") / 3.0 if i % 2 else F.lit(float("inf"))).alias(c) for i, c in enumerate("xyuv")))
    good = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0, 4.0), (1, 2, float("inf"), 2.0, 3.0, 4.0), (1, 3, 1.0, float("nan"), 3.0, 4.0), (1, 4, 1.0, 2.0, None, 4.0)], "g int, nth int, x double, y double, u double, v double")
    assert [(r.nth, r["_rank"], r["_n"]) for r in homography.ranked(good, ["g"], 1).collect()] == [(1, 0, 1)]
    slow = F.udf(lambda v: v, "double")
    plan = homography.ranked(rows.withColumn("x", slow("x")), ["g"], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnan") == 0
