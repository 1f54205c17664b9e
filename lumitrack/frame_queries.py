"""More registered queries over the driver's tables: files, matches, homographies, polygons, elements per minute."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumitrack.clip_sql import fixed as sf_fixed
from lumitrack.functions.names import id_by_mission, render_name, source_key
from lumitrack.functions.numbers import fixed
from lumitrack.operators import homography, joins, polygons, projection, scoring, tracks
from lumitrack.plans.shared import shared_folder
from lumitrack.queries import _projected, _projection_sql, query
from lumitrack.sources import match_results, point_files, snapshots
from lumitrack.surrogates import IMG, NAMES, OBS, frames, names as name_view, observations, raster, table

# --- files


@query(f"""with {OBS}
select 'ISS067-E-' || (300000 + f.frame_index) || '.points' file_name, 300000 + f.frame_index frame_id, count(o.row_index) n_points,
  count(o.mapX) n_placed, coalesce(sum(floor(o.sourceX)), 0)::bigint source_x, count(distinct o.event_type) n_types
from frames f left join (select * from obs where frame_index % 7 <> 3) o using (frame_index) group by f.frame_index""")
def point_files_round_trip(spark, sf_dir):
    """Observations written as a file for each frame, some with a header alone, and read again: a row per file."""
    f = frames(spark, sf_dir).withColumn("output_name", F.concat(F.lit("ISS067-E-"), F.lit(300000) + F.col("frame_index"), F.lit(".points")))
    points = observations(spark, sf_dir).filter("frame_index % 7 <> 3").withColumn("row_ordinal", F.col("row_index").cast("int"))
    path = f"{shared_folder(spark).rstrip('/')}/points-{uuid.uuid4().hex}"
    point_files.write_point_files(points, f, path, ["mapX", "mapY", "sourceX", "sourceY", "event_type"])
    read = point_files.read_point_files(spark, path)
    sums = read.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_points"), F.count("mapX").alias("n_placed"), F.sum(F.floor("sourceX")).alias("source_x"), F.count_distinct(F.nullif(F.col("event_type"), F.lit(""))).alias("n_types"))
    files = point_files.read_point_files(spark, path, what="files").select("file_name", F.col("frame_id").cast("int").alias("frame_id"))
    return files.join(sums, "file_name", "left").fillna(0)


# --- matches and homographies

IMAGES = 6
#: The homography that the matches of image i follow, as text for Spark and DuckDB alike.
_H = ("1 + 0.02e0 * image", "0.03e0 * image", "40e0 - 5 * image", "-0.01e0 * image", "1 - 0.015e0 * image", "12e0 * image", "1e-5 * image", "-5e-6 * image")
_MATCHED = f"""places as (
  select cast(l_orderkey % {IMAGES} as int) image, l_orderkey * 10 + l_linenumber nth, (l_orderkey + l_linenumber) % 5 < 2 good,
         cast((l_partkey * 7919 + l_orderkey * 13) % 2000 as double) x, cast((l_suppkey * 31 + l_orderkey * 17) % 1500 as double) y, cast((l_partkey * 613 + l_orderkey * 29) % 900 as double) off
  from lineitem),
matches as (
  select image, nth, good, x, y, (({_H[0]}) * x + ({_H[1]}) * y + ({_H[2]})) / (({_H[6]}) * x + ({_H[7]}) * y + 1) + case when good then 0 else 20 + off end u,
         (({_H[3]}) * x + ({_H[4]}) * y + ({_H[5]})) / (({_H[6]}) * x + ({_H[7]}) * y + 1) - case when good then 0 else 20 + off * off / 900 end v
  from places)"""


def _matches(spark, sf_dir):
    """Matches of six images of which three fifths are wrong by 20 pixels or more."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem")
    return spark.sql(f"with {_MATCHED.replace('from lineitem', 'from _lineitem')} select * from matches")


@query(f"""with {_MATCHED} select image, count(*) n, sum(good::int)::bigint n_inliers, {', '.join(f'floor(any_value({h}) * 1e6 + 0.5e0) / 1e6 h{i}' for i, h in enumerate(_H[:6]))},
  {', '.join(f'floor(any_value({h}) * 1e9 + 0.5e0) / 1e9 h{i}' for i, h in enumerate(_H) if i > 5)} from matches group by image""")
def homography_ransac(spark, sf_dir):
    """The planted homographies, found among 60 % wrong matches."""
    found = homography.homographies(_matches(spark, sf_dir), ["image"], hypotheses=500)
    return found.select("image", "n", "n_inliers", *(fixed(F.col("h")[i], 6).alias(f"h{i}") for i in range(6)), *(fixed(F.col("h")[i], 9).alias(f"h{i}") for i in (6, 7)))


@query(f"with {_MATCHED} select image, nth from matches where not good and image = 2")
def homography_outliers(spark, sf_dir):
    matches = _matches(spark, sf_dir).filter("image = 2")
    return homography.with_inliers(matches, ["image"], hypotheses=500).filter("not inlier").select("image", "nth")


# --- results of matchers

_ENCODED = """drawn as (
  select c_custkey id, cast(c_custkey % 6 as int) kind, cast(3 + c_custkey % 4 as int) n, cast(c_custkey % 7 as int) a, cast(c_custkey % 5 as int) b from customer)"""


def _results(spark, sf_dir):
    """Results of six kinds by customer: n places a side, place i of the left one is (10 i + a, i), of the right one (2 i + b, 100 + i)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    d = c.withColumns({"kind": (F.col("id") % 6).cast("int"), "n": (3 + F.col("id") % 4).cast("int"), "a": (F.col("id") % 7).cast("int"), "b": (F.col("id") % 5).cast("int")})
    steps = F.sequence(F.lit(0), F.col("n") - 1)
    left, right = F.transform(steps, lambda i: F.array(10 * i + F.col("a"), i)), F.transform(steps, lambda i: F.array(2 * i + F.col("b"), 100 + i))
    other = F.transform(steps, lambda i: F.col("n") - 1 - i)
    pairs = F.concat(F.transform(steps, lambda i: F.array(i, F.col("n") - 1 - i)), F.array(F.array(F.col("n"), F.lit(0)), F.array(F.lit(-1), F.lit(0))))
    gaps = F.transform(other, lambda j: F.when(j % 2 == 1, F.lit(-1)).otherwise(j))
    none = F.array().cast("array<array<int>>")
    kinds = [
        F.struct(left.alias("mkpts0"), F.array(right).alias("mkpts1")),
        F.struct(none.alias("inlier_kpts0"), none.alias("inlier_kpts1"), left.alias("matched_kpts0"), F.slice(right, F.lit(1), F.lit(2)).alias("matched_kpts1")),
        F.struct(left.alias("kpts0"), right.alias("kpts1"), pairs.alias("matches")),
        F.struct(F.array(left).alias("keypoints0"), right.alias("keypoints1"), gaps.alias("matches0")),
        F.struct(left.alias("kpts0"), right.alias("kpts1"), F.array(other).alias("matches1")),
        F.struct(left.alias("kpts0"), F.lit("none").alias("note")),
    ]
    text = F.coalesce(*(F.when(F.col("kind") == i, F.to_json(k)) for i, k in enumerate(kinds)))
    return d.select("id", text.alias("result"))


@query(f"""with {_ENCODED}, i as (select drawn.*, cast(unnest(range(n)) as int) i from drawn),
p as (select id, i l, i r from i where kind = 0 or kind = 1 and i < 2 union all select id, i, n - 1 - i from i where kind in (2, 4) union all select id, i, n - 1 - i from i where kind = 3 and (n - 1 - i) % 2 = 0)
select id, count(l) n_matches, coalesce(sum(10 * l + a), 0)::double left_x, coalesce(sum((10 * l + a) * (100 + r)), 0)::double crossed, coalesce(sum((2 * r + b) * (l + 1)), 0)::double right_x
from drawn left join p using (id) group by id""")
def match_decoder(spark, sf_dir):
    """Matches from results of every encoding, read from VARIANT by path."""
    found = match_results.decoded(_results(spark, sf_dir))
    sums = match_results.match_rows(found, "id").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_matches"), F.sum("sim_x").alias("left_x"), F.sum(F.col("sim_x") * F.col("real_y")).alias("crossed"), F.sum(F.col("real_x") * (F.col("sim_y") + 1)).alias("right_x")
    )
    return found.select("id").join(sums, "id", "left").fillna(0)


# --- polygons

_RINGS = """vertices as (select cast(c_custkey % 8 as int) image, cast(c_custkey // 8 % 2 as int) ring, c_custkey nth, (c_custkey * 37 % 640) / 10e0 x, (c_custkey * 91 % 600) / 10e0 y from customer),
edges as (select image, x x1, y y1, coalesce(lead(x) over w, first_value(x) over w) x2, coalesce(lead(y) over w, first_value(y) over w) y2 from vertices window w as (partition by image, ring order by nth)),
inside as (select i.image, i."row", i.col, value from img i join edges e on e.image = i.image and (y1 <= i."row" + 0.5e0) <> (y2 <= i."row" + 0.5e0) and x1 + (i."row" + 0.5e0 - y1) * (x2 - x1) / (y2 - y1) <= i.col + 0.5e0
  group by all having count(*) % 2 = 1)"""


def _edges(spark, sf_dir):
    c = F.col("c_custkey")
    at = lambda k, m: ((c * k) % m) / F.lit(10.0)
    vertices = table(spark, sf_dir, "customer").select((c % 8).cast("int").alias("image"), (F.floor(c / 8) % 2).cast("int").alias("ring"), c.alias("nth"), at(37, 640).alias("x"), at(91, 600).alias("y"))
    return polygons.edges_of(vertices)


@query(f"""with {IMG}, {_RINGS} select image, "row", col from inside""")
def polygon_clip(spark, sf_dir):
    """Pixels inside rings of customers, by the even-odd rule."""
    return polygons.clipped(raster(spark, sf_dir), _edges(spark, sf_dir)).select("image", "row", "col")


@query(f"""with {IMG}, {_RINGS} select image, count(*) n_pixels, count(x.col) n_inside, case when count(x.col) = 0 then 'no overlap' else 'ok' end status
from img left join inside x using (image, "row", col) group by image""")
def polygon_clip_status(spark, sf_dir):
    return polygons.clip_status(raster(spark, sf_dir), _edges(spark, sf_dir))


@query(f"""with {IMG}, ok as (select image, "row" r, col c from img where value > 100e0),
sides as (select image, 'v' kind, c line, r pos, 1 sign from ok union all select image, 'v', c + 1, r, -1 from ok union all select image, 'h', r, c, 1 from ok union all select image, 'h', r + 1, c, -1 from ok),
bare as (select image, kind, line, pos, sum(sign)::int sign from sides group by 1, 2, 3, 4 having sum(sign) <> 0),
parts as (select *, pos - row_number() over (partition by image, kind, line, sign order by pos) p from bare),
pieces as (select image, kind, line, sign, min(pos) lo, max(pos) + 1 hi from parts group by image, kind, line, sign, p)
select image, (case when kind = 'v' then line when sign > 0 then lo else hi end)::double x1, (case when kind = 'h' then line when sign > 0 then lo else hi end)::double y1,
  (case when kind = 'v' then line when sign > 0 then hi else lo end)::double x2, (case when kind = 'h' then line when sign > 0 then hi else lo end)::double y2 from pieces""")
def valid_outline(spark, sf_dir):
    """The outline of the pixels above 100."""
    return polygons.outline(raster(spark, sf_dir).filter("value > 100.0"))


@query(f"""with {IMG} select image, "row", col from img where value > 100e0""")
def outline_filled(spark, sf_dir):
    """The outline filled again: the pixels that it was made from."""
    pixels = raster(spark, sf_dir)
    return polygons.clipped(pixels, polygons.outline(pixels.filter("value > 100.0"))).select("image", "row", "col")


# --- elements and finished files


@query("""with e as (select epoch, min(sid) sid from (select ts epoch, event_id sid from events where event_type = 'signup') group by 1),
v as (select event_id, date_trunc('minute', ts) m from events where event_type = 'view'), u as (select distinct m from v),
b as (select m, e.sid, e.epoch from u asof left join e on u.m >= e.epoch), a as (select m, e.sid, e.epoch from u asof left join e on u.m <= e.epoch),
n as (select m, case when b.sid is null then a.sid when a.sid is null then b.sid when (epoch_us(m) - epoch_us(b.epoch), b.sid) <= (epoch_us(a.epoch) - epoch_us(m), a.sid) then b.sid else a.sid end sid from b join a using (m))
select event_id, sid nearest_sid from v left join n using (m)""")
def element_per_minute(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    elements = e.filter("event_type = 'signup'").select(F.col("event_id").alias("sid"), F.col("ts").alias("epoch"))
    times = e.filter("event_type = 'view'").select("event_id", "ts")
    return joins.element_per_minute(times, elements, "ts", "epoch", "sid").select("event_id", "nearest_sid")


@query(f"""with {NAMES}, p as (select event_id id from names where event_id % 2 = 0 and event_id % 11 <> 0)
select 0 as version, count(*) n, coalesce(sum(id), 0)::bigint total from p where id % 3 = 0 union all select 1, count(*), coalesce(sum(id), 0)::bigint from p where id % 3 = 0 and not id between 100 and 400
union all select 2, count(*), coalesce(sum(id), 0)::bigint from p where id % 3 = 0 and not id between 100 and 400 or id % 12 = 2""")
def snapshot_versions(spark, sf_dir):
    """A log of point files: some added, a range of ids deleted, others added; a row for each version."""
    log, files = _log(spark, sf_dir)
    log.add(files.filter("frame_id % 3 = 0"))
    log.delete(100, 400)
    log.add(files.filter("frame_id % 12 = 2"))
    each = [log.snapshot(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("frame_id"), F.lit(0)).alias("total")) for v in range(3)]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query(f"""with {NAMES}, p as (select event_id id from names where event_id % 2 = 0 and event_id % 11 <> 0) select event_id, event_id in (select id from p where id % 3 = 0 and not id between 100 and 400) "exists" from events""")
def snapshot_existence(spark, sf_dir):
    """Which ids a log's last version has, by bitmaps."""
    log, files = _log(spark, sf_dir)
    log.add(files.filter("frame_id % 3 = 0"))
    log.delete(100, 400)
    probes = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"))
    return snapshots.existing(probes, snapshots.bitmaps(log.snapshot())).withColumnRenamed("frame_id", "event_id")


def _log(spark, sf_dir):
    files = name_view(spark, sf_dir).filter("file_name like '%.points'").select(F.col("event_id").alias("frame_id"), "file_name", F.lit(1).alias("length"))
    return snapshots.Log(spark, f"{shared_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}"), files


@query(f"""with {_MATCHED} select image, count(*) n_matches_raw, sum(good::int)::bigint n_inliers, floor(sum(good::int) / count(*)::double * 1e6 + 0.5e0) / 1e6 inlier_ratio,
  floor(tanh(sum(good::int) / 120e0) * 1e6 + 0.5e0) / 1e6 match_count_norm from matches group by image having sum(good::int) >= 20""")
def candidate_inliers(spark, sf_dir):
    """Candidates scored from raw matches, three fifths of them wrong: what their scores count."""
    matches = _matches(spark, sf_dir).withColumnsRenamed({"x": "real_x", "y": "real_y", "u": "sim_x", "v": "sim_y"})
    sizes = matches.select("image").distinct().withColumns({"width": F.lit(2000), "height": F.lit(1500)})
    found = scoring.scored_candidates(matches, sizes)
    return found.select("image", "n_matches_raw", "n_inliers", fixed(F.col("inlier_ratio"), 6).alias("inlier_ratio"), fixed(F.col("match_count_norm"), 6).alias("match_count_norm"))


# --- keys, names, ranges


@query(f"""with {OBS}, t as (select track_key, any_value(sourceX) x, any_value(-sourceY) y from obs where user_id % 2 = 0 group by 1),
k as (select event_id, case event_id % 3 when 0 then printf('%.3f|%.3f', 185e0 * (user_id % 15), -185e0 * floor(user_id / 15e0)) when 1 then value::varchar || '|' || (-event_id / 2)::varchar else 'no key ' || event_id end track_key from events)
select event_id, track_key, {sf_fixed('coalesce(t.x, try_cast(split_part(track_key, chr(124), 1) as double))', 3)} x, {sf_fixed('coalesce(t.y, -try_cast(split_part(track_key, chr(124), 2) as double))', 3)} y from k left join t using (track_key) where event_id % 3 <> 2""")
def places_of_keys(spark, sf_dir):
    """Places of keys: of known tracks, of keys that say theirs, and of some that say none."""
    o = observations(spark, sf_dir)
    known = o.filter("user_id % 2 = 0").groupBy("track_key").agg(F.first("sourceX").alias("sourceX"), F.first("sourceY").alias("sourceY"))
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    own = source_key(F.lit(185.0) * (F.col("user_id") % 15), F.lit(-185.0) * F.floor(F.col("user_id") / 15.0))
    key = F.when(k % 3 == 0, own).when(k % 3 == 1, F.concat_ws("|", F.col("value").cast("string"), (-k / 2.0).cast("string"))).otherwise(F.concat(F.lit("no key "), k))
    found = tracks.places_of_keys(e.select("event_id", key.alias("track_key")), known)
    return found.select("event_id", "track_key", fixed(F.col("x"), 3).alias("x"), fixed(F.col("y"), 3).alias("y"))


@query("""with n as (select event_id, ts, event_id % 1700 / 10e0 - 85 la, event_id % 3600 / 10e0 - 180 lo, 400 + event_id % 97 / 8e0 al, user_id % 7 / 4e0 ya, user_id % 90 + 0e0 pi, -(event_id % 11) / 100e0 ro from events),
s as (select event_id, ts, unnest(['L', 'G', 'H', 'Y', 'P', 'R']) k, unnest(range(6)) j, unnest([la, lo, al, ya, pi, ro]) v from n)
select event_id, 'render_output_' || strftime(any_value(ts), '%Y-%m-%dT%H-%M-%S-') || lpad((epoch_us(any_value(ts)) // 1000 % 1000)::varchar, 3, '0') || string_agg('_' || k || replace(round_even(v, 2)::varchar, '.', '-'), '' order by j) || '.png' as file_name from s group by event_id""")
def render_names(spark, sf_dir):
    """Whole names of renders, with all six numbers."""
    e, k, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    numbers = (k % 1700 / 10.0 - 85, k % 3600 / 10.0 - 180, F.lit(400) + k % 97 / 8.0, u % 7 / 4.0, (u % 90).cast("double"), -(k % 11) / 100.0)
    return e.select("event_id", render_name(F.col("ts").cast("timestamp"), *numbers).alias("file_name"))


@query(f"""with {NAMES}, n as (select event_id, try_cast(nullif(regexp_extract(file_name, '[A-Za-z0-9]+-E-([0-9]+)', 1), '') as int) frame_id, user_id % 5 > 0 complete from names)
select event_id, frame_id, case when not frame_id between 300100 and 303000 then 'id out of range' when not complete then 'required column missing' end reason from n where frame_id is not null""")
def files_left_out(spark, sf_dir):
    """Why files are no frames of a run: their ids, or their columns; null for those that are."""
    files = name_view(spark, sf_dir).select("event_id", id_by_mission(F.col("file_name")).alias("frame_id"), (F.col("user_id") % 5 > 0).alias("complete")).filter("frame_id is not null")
    return files.select("event_id", "frame_id", point_files.left_out(300100, 303000).alias("reason"))


@query(f"""with r as ({_projection_sql(False)}) select n_nationkey, lon "mapX", lat "mapY", px "sourceX", py - 400 "sourceY", 1 enable, 0e0 residual from r where lat is not null""")
def control_points_of_rays(spark, sf_dir):
    """Control points where rays of pixels meet the ground; the others give none."""
    found = projection.control_points(_projected(spark, sf_dir, False).withColumns({"real_x": F.col("px"), "real_y": F.col("py"), "height": F.lit(400.0)}))
    return found.select("n_nationkey", "mapX", "mapY", "sourceX", "sourceY", "enable", "residual")
