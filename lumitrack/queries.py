"""The registered queries over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumitrack import clip_sql as Q
from lumitrack.clip_sql import fixed as sf_fixed
from lumitrack.functions import geo, names, numbers
from lumitrack.functions.numbers import fixed
from lumitrack.operators import joins, kernels, projection, rasters, sampling, scoring, search, tracks
from lumitrack.operators.tracks import FilterConfig
from lumitrack.plans.georeference import filter_sequence, stage_decisions
from lumitrack.plans.shared import kept
from lumitrack.sources import points as sources
from lumitrack.surrogates import IMG, NAMES, OBS, frames, names as name_view, observations, raster, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The filter over the surrogates: some tracks are too short, some gaps too long.
CONFIG = FilterConfig(order=3, min_points=20, max_gap=2)
RADIUS = 20.0


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def yes(c: str | Column) -> Column:
    """A flag as 0 or 1."""
    return (F.col(c) if isinstance(c, str) else c).cast("int")


# --- observations and tracks


@query(f"with {OBS} select track_key, frame_index, row_index, (mapX is not null)::int finite from (select *, row_number() over (partition by track_key, frame_index order by case when mapX is not null then 0 else 1 end, row_index) k from obs) where k = 1")
def obs_first_finite(spark, sf_dir):
    return tracks.first_finite(observations(spark, sf_dir)).select("track_key", "frame_index", "row_index", yes(F.col("mapX").isNotNull()).alias("finite"))


@query(f"with {OBS} select track_key, frame_index, row_index, first_value(row_index) over (partition by track_key order by frame_index, row_index) template_row from (select *, row_number() over (partition by track_key, frame_index order by row_index) k from obs) where k = 1")
def obs_first_row_template(spark, sf_dir):
    return tracks.first_rows(observations(spark, sf_dir)).select("track_key", "frame_index", "row_index", "template_row")


@query(f"with {OBS} select file_name, cast(row_number() over (order by file_name) - 1 as int) frame_index, cast(count(*) over () as int) n_frames from (select 'ISS067-E-' || (300000 + frame_index) || '_real.points' file_name from frames where frame_index % 7 <> 3)")
def frame_dense_index(spark, sf_dir):
    valid = frames(spark, sf_dir).filter("frame_index % 7 <> 3").select(F.concat(F.lit("ISS067-E-"), F.lit(300000) + F.col("frame_index"), F.lit("_real.points")).alias("file_name"))
    return tracks.dense_index(valid).select("file_name", "frame_index", "n_frames")


@query(f"with {OBS} select row_index, track_key, cast(split_part(track_key, '|', 1) as double) x, cast(split_part(track_key, '|', 2) as double) + 0e0 y from obs")
def track_key_format(spark, sf_dir):
    parsed = names.parse_source_key(F.col("track_key"))
    return observations(spark, sf_dir).select("row_index", "track_key", parsed["x"].alias("x"), (parsed["y"] + 0.0).alias("y"))


@query(f"""with {OBS} select t.track_key, f.frame_index from (select distinct track_key from obs) t cross join frames f""")
def track_frame_scaffold(spark, sf_dir):
    return tracks.scaffold(observations(spark, sf_dir), frames(spark, sf_dir))


@query(f"""with {Q.DENSE}, {Q.fit_steps('dense', 'finite_geo', 1, 'z')[0]}
select track_key, frame_index, {sf_fixed('u')} lon from z1 where finite_geo""")
def lon_unwrap(spark, sf_dir):
    dense = tracks.dense_tracks(observations(spark, sf_dir), frames(spark, sf_dir))
    return dense.withColumn("u", tracks.unwrapped(F.col("mapX"), F.col("finite_geo"))).filter("finite_geo").select("track_key", "frame_index", fixed(F.col("u")).alias("lon"))


def _gaps(spark, sf_dir, max_gap, extrapolate):
    dense = tracks.dense_tracks(observations(spark, sf_dir), frames(spark, sf_dir))
    marked = tracks.gap_fill(dense, ~F.col("finite_geo"), F.col("finite_geo"), max_gap, extrapolate)
    return marked.filter("not finite_geo").select("track_key", "frame_index", yes("gap_filled").alias("filled"))


def _gaps_sql(max_gap, extrapolate):
    return f"with {Q.DENSE}, {Q.gap('dense', 'not finite_geo', 'finite_geo', max_gap, extrapolate)} select track_key, frame_index, filled::int filled from gapped where not finite_geo"


@query(_gaps_sql(2, False))
def gap_fill_bounded(spark, sf_dir):
    return _gaps(spark, sf_dir, 2, False)


@query(_gaps_sql(2, True))
def gap_fill_extrapolated(spark, sf_dir):
    return _gaps(spark, sf_dir, 2, True)


@query(_gaps_sql(-1, False))
def gap_fill_any(spark, sf_dir):
    return _gaps(spark, sf_dir, -1, False)


@query(f"""with {Q.DENSE}, {Q.fit_steps('dense', 'finite_geo', 1, 'z')[0]}
select track_key, count(u) n, {sf_fixed('regr_slope(u, t)', 5)} slope_x, {sf_fixed('regr_intercept(u, t)', 5)} intercept_x, {sf_fixed('regr_slope(mapY, t)', 5)} slope_y, {sf_fixed('regr_intercept(mapY, t)', 5)} intercept_y
from z1 where finite_geo group by 1""")
def temporal_fit_linear(spark, sf_dir):
    fit = tracks.linear_fit(tracks.dense_tracks(observations(spark, sf_dir), frames(spark, sf_dir))).filter("n > 0")
    return fit.select("track_key", "n", *(fixed(F.col(c), 5).alias(c) for c in ("slope_x", "intercept_x", "slope_y", "intercept_y")))


@query(f"with {Q.DENSE}, {Q.fit_steps('dense', 'finite_geo', 3, 'z')[0]} select track_key, frame_index, {sf_fixed('px', 5)} pred_x, {sf_fixed('py', 5)} pred_y from z3")
def temporal_fit_cubic(spark, sf_dir):
    dense = tracks.dense_tracks(observations(spark, sf_dir), frames(spark, sf_dir))
    return tracks.polynomial_fit(dense, "finite_geo", 3).select("track_key", "frame_index", fixed(F.col("pred_x"), 5).alias("pred_x"), fixed(F.col("pred_y"), 5).alias("pred_y"))


def _clip(config):
    def run(spark, sf_dir):
        dense = tracks.dense_tracks(observations(spark, sf_dir), frames(spark, sf_dir))
        clipped = tracks.sigma_clip(dense, config).filter("observed")
        return clipped.select("track_key", "frame_index", yes("fit_used").alias("fit_used"), yes("can_fit").alias("can_fit"), yes("temporal_outlier").alias("outlier"), fixed(F.col("residual_km"), 3).alias("residual_km"))

    return run


for _mode in ("sigma", "absolute", "hybrid"):
    _config = FilterConfig(order=3, mode=_mode, min_points=20, absolute_km=150.0, min_threshold_km=5.0)
    QUERIES[f"temporal_clip_{_mode}"] = _clip(_config)
    ORACLE_SQL[f"temporal_clip_{_mode}"] = f"with {Q.clip(_config)} select track_key, frame_index, fit_used::int fit_used, can_fit::int can_fit, outlier::int outlier, {sf_fixed('r', 3)} residual_km from clipped where observed"


@query(f"with {Q.written(CONFIG)} select frame_index, track_key, row_ordinal, temporal_status, {sf_fixed('mapX', 5)} mapX, {sf_fixed('mapY', 5)} mapY, sourceX, sourceY + 0e0 sourceY, enable, event_type from written")
def track_outputs(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("enable", (F.col("row_index") % 3 > 0).cast("int"))
    out = filter_sequence(obs, frames(spark, sf_dir), CONFIG, None).written
    return out.select("frame_index", "track_key", "row_ordinal", "temporal_status", fixed(F.col("mapX"), 5).alias("mapX"), fixed(F.col("mapY"), 5).alias("mapY"), "sourceX", (F.col("sourceY") + 0.0).alias("sourceY"), "enable", "event_type")


@query(f"with {Q.written(CONFIG)}, {Q.with_neighbours('written', RADIUS)} select frame_index, track_key, temporal_status from final")
def post_spatial_filter(spark, sf_dir):
    return filter_sequence(observations(spark, sf_dir), frames(spark, sf_dir), CONFIG, RADIUS).points.select("frame_index", "track_key", "temporal_status")


@query(f"""with {Q.written(CONFIG)}, {Q.with_neighbours('written', RADIUS)}, {Q.read_neighbours(RADIUS)}
select f.frame_index, coalesce(a.n, 0) input_count, coalesce(p.n, 0) pre_spatial_kept_diagnostic, coalesce(o, 0)::bigint temporal_outliers, coalesce(i, 0)::bigint imputed, coalesce(w.n, 0) output_before_post_spatial, coalesce(k.n, 0) post_spatial_kept, coalesce(w.n, 0) - coalesce(k.n, 0) post_spatial_rejected
from frames f left join (select frame_index, count(*) n from obs group by 1) a using (frame_index)
left join (select frame_index, count(*) n from obs join near using (row_index) group by 1) p using (frame_index)
left join (select frame_index, sum(outlier::int) o, sum(imputed::int) i from filt group by 1) b using (frame_index)
left join (select frame_index, count(*) n from written group by 1) w using (frame_index)
left join (select frame_index, count(*) n from final group by 1) k using (frame_index)""")
def frame_qc(spark, sf_dir):
    return filter_sequence(observations(spark, sf_dir), frames(spark, sf_dir), CONFIG, RADIUS).frame_qc


@query(f"""with {Q.filtered(CONFIG)}, {Q.read_neighbours(RADIUS)},
heads as (select track_key, sourceX, sourceY + 0e0 sourceY from (select *, row_number() over (partition by track_key order by frame_index, row_index) k from obs) where k = 1),
ok as (select track_key, count(near.row_index) n_pre_spatial_ok_diagnostic from (
  select track_key, row_index, row_number() over (partition by track_key, frame_index order by case when mapX is not null then 0 else 1 end, row_index) k from obs) o left join near using (row_index) where k = 1 group by 1)
select track_key, max(sourceX) sourceX, max(sourceY) sourceY, max(n_pre_spatial_ok_diagnostic) n_pre_spatial_ok_diagnostic, sum(finite_geo::int)::bigint n_observed, sum(finite_geo::int)::bigint n_finite, sum(fit_used::int)::bigint n_fit_used, sum(outlier::int)::bigint n_temporal_outliers, sum(imputed::int)::bigint n_imputed,
  sum((kept or imputed)::int)::bigint n_output, max(can_impute::int) can_impute, case when max(can_fit::int) = 1 then least({CONFIG.order}, max(n_last) - 1) else -1 end::int fit_degree,
  {sf_fixed("max(case when thr < cast('infinity' as double) then thr end)", 3)} threshold_km, {sf_fixed('max(case when can_fit then mean end)', 3)} residual_mean_km,
  {sf_fixed('max(case when can_fit then sd end)', 3)} residual_std_km,
  {sf_fixed('sqrt(avg(case when fit_used then r * r end))', 3)} rmse_km, {sf_fixed('max(r)', 3)} max_residual_km
from filt join heads using (track_key) join ok using (track_key) group by 1""")
def track_qc(spark, sf_dir):
    qc = filter_sequence(observations(spark, sf_dir), frames(spark, sf_dir), CONFIG, RADIUS).track_qc
    rounded = {c: fixed(F.col(c), 3) for c in ("threshold_km", "residual_mean_km", "residual_std_km", "rmse_km", "max_residual_km")}
    return qc.withColumns(rounded | {"can_impute": yes("can_impute"), "sourceY": F.col("sourceY") + 0.0})


def _diagnostic_sql():
    aims = (("top_left_inner", 0.15, 0.15), ("top_right_inner", 0.85, 0.15), ("center", 0.5, 0.5), ("bottom_left_inner", 0.15, 0.85), ("bottom_right_inner", 0.85, 0.85))
    picks, before = [], []
    for i, (name, u, v) in enumerate(aims):
        free = "".join(f" and track_key not in (select track_key from pick{j})" for j in before)
        d = f"(sx - (x0 + {u}e0 * (x1 - x0))) * (sx - (x0 + {u}e0 * (x1 - x0))) + (sy - (y0 + {v}e0 * (y1 - y0))) * (sy - (y0 + {v}e0 * (y1 - y0)))"
        picks.append(f"pick{i} as (select '{name}' target, track_key from rich, b where true{free} order by {d}, track_key limit 1)")
        before.append(i)
    union = " union all ".join(f"select * from pick{i}" for i in range(5))
    return f"with {OBS}, t as (select track_key, any_value(sourceX) sx, any_value(-sourceY) sy, count(mapX) n from obs group by 1), rich as (select * from t where n >= 20), b as (select min(sx) x0, max(sx) x1, min(sy) y0, max(sy) y1 from rich), {', '.join(picks)} {union}"


@query(_diagnostic_sql())
def diagnostic_tracks(spark, sf_dir):
    each = observations(spark, sf_dir).groupBy("track_key").agg(F.first("sourceX").alias("sx"), (-F.first("sourceY")).alias("sy"), F.count("mapX").alias("n_observed"))
    return tracks.diagnostic_tracks(each, 20)


@query(f"""with {Q.written(CONFIG)}, {Q.with_neighbours('written', RADIUS)},
f as (select distinct frame_index, track_key from final), c as (select distinct frame_index, track_key from written where temporal_status = 'imputed'), r as (select distinct frame_index, track_key from obs)
select frame_index, track_key, (f.track_key is not null)::int is_final, (c.track_key is not null)::int is_corrected, (r.track_key is not null)::int is_read,
  case when f.track_key is not null and c.track_key is null then 'blue' when f.track_key is not null then 'green' when c.track_key is not null then 'orange' else 'red' end colour
from f full join c using (frame_index, track_key) full join r using (frame_index, track_key)""")
def point_status_colour(spark, sf_dir):
    obs = observations(spark, sf_dir)
    done = filter_sequence(obs, frames(spark, sf_dir), CONFIG, RADIUS)
    s = tracks.point_status(done.points, done.written.filter("temporal_status = 'imputed'"), obs)
    return s.withColumns({c: yes(c) for c in ("is_final", "is_corrected", "is_read")})


# --- joins


def _neighbours_sql(radius):
    near = Q.haversine("a.mapY", "a.mapX", "b.mapY", "b.mapX")
    return f"with {OBS} select row_index, (mapX is not null and exists (select 1 from obs b where b.frame_index = a.frame_index and b.row_index <> a.row_index and b.mapX is not null and a.mapX is not null and {near} <= {radius}e0))::int has_neighbour from obs a"


def _neighbours(radius):
    return lambda spark, sf_dir: joins.has_neighbour(observations(spark, sf_dir), radius, ["frame_index"], "row_index").select("row_index", yes("has_neighbour").alias("has_neighbour"))


for _km in (5, 20, 80):
    QUERIES[f"radius_neighbours_{_km}km"] = _neighbours(float(_km))
    ORACLE_SQL[f"radius_neighbours_{_km}km"] = _neighbours_sql(_km)


@query(f"""with c as (select c_custkey, (c_custkey * 37 % 3600) / 10e0 - 180e0 x, (abs(c_acctbal) * 100 % 1400)::bigint / 10e0 - 70e0 y from customer)
select c_custkey, exists (select 1 from c b where b.c_custkey <> a.c_custkey and {Q.haversine('a.y', 'a.x', 'b.y', 'b.x')} <= 80e0)::int has_neighbour from c a""")
def radius_neighbours_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cents = F.floor(F.abs("c_acctbal") * 100 + 0.0)
    at = c.select("c_custkey", F.lit(1).alias("one"), ((F.col("c_custkey") * 37 % 3600) / 10.0 - 180.0).alias("mapX"), (F.bround(F.abs("c_acctbal") * 100 % 1400).cast("long") / 10.0 - 70.0).alias("mapY"))
    return joins.has_neighbour(at, 80.0, ["one"], "c_custkey").select("c_custkey", yes("has_neighbour").alias("has_neighbour"))


_EPOCHS = """s as (select event_id sid, user_id, ts epoch from events where event_type = 'signup'), v as (select event_id, user_id, ts from events where event_type = 'view')"""


@query(f"""with {_EPOCHS} select event_id, sid nearest_sid, abs(epoch_us(ts) - epoch_us(epoch)) / 1e6 seconds_apart from (
  select v.event_id, v.ts, s.sid, s.epoch, row_number() over (partition by v.event_id order by abs(epoch_us(v.ts) - epoch_us(s.epoch)), sid) k from v left join s using (user_id)) where k = 1""")
def nearest_epoch_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    states = e.filter("event_type = 'signup'").select(F.col("event_id").alias("sid"), "user_id", F.col("ts").alias("epoch"))
    return joins.nearest_in_time(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), states, "ts", "epoch", "sid", ["user_id"]).select("event_id", "nearest_sid", "seconds_apart")


@query(f"""with {_EPOCHS}, e as (select epoch, min(sid) sid from s group by 1),
b as (select event_id, ts, e.sid, e.epoch from v asof left join e on v.ts >= e.epoch), a as (select event_id, e.sid, e.epoch from v asof left join e on v.ts <= e.epoch)
select event_id, case when b.sid is null then a.sid when a.sid is null then b.sid when (epoch_us(ts) - epoch_us(b.epoch), b.sid) <= (epoch_us(a.epoch) - epoch_us(ts), a.sid) then b.sid else a.sid end nearest_sid,
  least(coalesce(epoch_us(ts) - epoch_us(b.epoch), 9e18::bigint), coalesce(epoch_us(a.epoch) - epoch_us(ts), 9e18::bigint)) / 1e6 seconds_apart from b join a using (event_id)""")
def nearest_epoch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    states = e.filter("event_type = 'signup'").select(F.col("event_id").alias("sid"), F.col("ts").alias("epoch"))
    return joins.nearest_in_time(e.filter("event_type = 'view'").select("event_id", "ts"), states, "ts", "epoch", "sid").select("event_id", "nearest_sid", "seconds_apart")


@query(f"""with l as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 o from events where event_type = 'signup'),
r as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 o from events where event_type = 'view')
select user_id, cast(l.o as int) ordinal, l.event_id left_id, r.event_id right_id from l join r using (user_id, o)""")
def ordinal_pairing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    left = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("left_id"), F.col("ts").alias("lt"))
    right = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("right_id"), F.col("ts").alias("rt"))
    return joins.by_ordinal(left, right, ["lt", "left_id"], ["rt", "right_id"], ["user_id"]).select("user_id", "ordinal", "left_id", "right_id")


@query(f"""with {NAMES}, w as (select distinct 'ISS067-E-' || (300000 + event_id) n from names where event_type = 'view'), f as (select distinct file_name from names)
select n, coalesce((select file_name from f where file_name = n), (select min(file_name) from f where starts_with(file_name, n))) found from w""")
def csv_prefix_lookup(spark, sf_dir):
    v = name_view(spark, sf_dir)
    wanted = v.filter("event_type = 'view'").select(F.concat(F.lit("ISS067-E-"), F.lit(300000) + F.col("event_id")).alias("n")).distinct()
    return joins.by_name_or_prefix(wanted, "n", v.select("file_name").distinct(), "file_name", 15).select("n", "found")


@query(f"""with {NAMES}, f as (select distinct event_id id from names), p as (select distinct event_id id from names where file_name like '%_real.points'), c as (select distinct event_id id from names where event_type = 'purchase'), i as (select distinct event_id id from names where file_name like '%.JPG')
select id, case when p.id is not null then 'points' when c.id is not null then 'corrected' end chosen, case when i.id is null then 'missing image' when p.id is null and c.id is null then 'missing points' else 'ok' end status
from f left join p using (id) left join c using (id) left join i using (id)""".replace("select id,", "select f.id,"))
def points_preference(spark, sf_dir):
    v = name_view(spark, sf_dir).withColumnRenamed("event_id", "id")
    pick = lambda c: v.filter(c).select("id").distinct()
    return joins.preferred(v.select("id").distinct(), "id", [("points", pick(F.col("file_name").endswith("_real.points"))), ("corrected", pick(F.col("event_type") == "purchase"))], pick(F.col("file_name").endswith(".JPG"))).select("id", "chosen", "status")


@query(f"""with {NAMES} select path, event_id, try_cast(nullif(regexp_extract(file_name, '[A-Za-z0-9]+-E-([0-9]+)', 1), '') as int) a, try_cast(nullif(regexp_extract(file_name, '([0-9]{{5,8}})', 1), '') as int) b,
try_cast(nullif(split_part(string_split(regexp_replace(file_name, '\\.[^.]+$', ''), '-')[-1], '_', 1), '') as int) c, try_cast(nullif(string_split(regexp_replace(file_name, '\\.[^.]+$', ''), '-')[-1], '') as int) d,
try_cast(coalesce(nullif(regexp_extract(file_name, 'ISS[0-9]+-E-([0-9]+)', 1), ''), nullif(regexp_extract(file_name, '([0-9]{{5,8}})', 1), '')) as int) e, regexp_replace(file_name, '\\.[^.]+$', '') stem from names""")
def frame_id_variants(spark, sf_dir):
    p = F.col("path")
    ids = {"a": names.id_by_mission(F.col("file_name")), "b": names.id_by_digits(p), "c": names.id_before_underscore(p), "d": names.id_after_dash(p), "e": names.id_by_station(p), "stem": names.stem(p)}
    return name_view(spark, sf_dir).select("path", "event_id", *(v.alias(k) for k, v in ids.items()))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S-') || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0') as stamp, epoch_us(ts) // 1000 millis from events""")
def render_name_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    zero = F.lit(0.0)
    named = e.withColumn("name", names.render_name(F.col("t"), zero, zero, zero, F.col("value"), zero, zero))
    stamp = F.substring_index(F.substring("name", len(names.RENDER) + 1, 100), "_L", 1)
    return named.select("event_id", stamp.alias("stamp"), F.unix_millis(names.render_time(F.col("name"))).alias("millis"))


@query(f"""with {NAMES}, w as (select event_id, try_cast(nullif(regexp_extract(file_name, '[A-Za-z0-9]+-E-([0-9]+)', 1), '') as int) id, event_type from names)
select distinct id from w where id between 300100 and 309000 and not exists (select 1 from w d where d.id = w.id and d.event_type = 'click')""")
def missing_outputs(spark, sf_dir):
    v = name_view(spark, sf_dir).select(names.id_by_mission(F.col("file_name")).alias("id"), "event_type")
    return joins.unfinished(v.filter(F.col("id").between(300100, 309000)).select("id").distinct(), v.filter("event_type = 'click'"), "id")


@query("""with k as (select vec_id image, nth - 1 nth, embedding[nth]::double x, embedding[nth + 32]::double y from embeddings, range(1, 33) r(nth)),
m as (select vec_id image_a, vec_id + 1 image_b, j - 1 match, (vec_id * 7 + j * 5) % 40 ia, (vec_id * 3 + j * 11) % 40 ib from embeddings, range(1, 9) r(j))
select m.image_a, m.match, a.x a_x, a.y a_y, b.x b_x, b.y b_y from m join k a on a.image = m.image_a and a.nth = m.ia join k b on b.image = m.image_b and b.nth = m.ib""")
def match_index_gather(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    points = e.select(F.col("vec_id").alias("image"), F.posexplode(F.slice("embedding", 1, 32)).alias("nth", "x"), "embedding").withColumn("y", F.expr("embedding[nth + 32]").cast("double")).withColumn("x", F.col("x").cast("double")).drop("embedding")
    found = e.select(F.col("vec_id").alias("image_a"), (F.col("vec_id") + 1).alias("image_b"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("j"))
    pairs = found.select("image_a", "image_b", (F.col("j") - 1).cast("long").alias("match"), ((F.col("image_a") * 7 + F.col("j") * 5) % 40).alias("ia"), ((F.col("image_a") * 3 + F.col("j") * 11) % 40).alias("ib"))
    return joins.gathered(joins.gathered(pairs, points, "image_a", "ia", "a"), points, "image_b", "ib", "b").select("image_a", "match", "a_x", "a_y", "b_x", "b_y")


@query("""with q as (select label, vec_id, embedding from embeddings where vec_id % 2 = 0), b as (select label, vec_id, embedding from embeddings where vec_id % 2 = 1),
d as (select q.label, q.vec_id query_id, b.vec_id base_id, list_distance(q.embedding::double[], b.embedding::double[]) dist from q join b using (label)),
r as (select *, row_number() over (partition by label, query_id order by dist, base_id) k, lead(dist) over (partition by label, query_id order by dist, base_id) nx from d),
p as (select *, count(*) over (partition by label) n, row_number() over (partition by label order by dist, query_id) rk from r where k = 1 and dist < 0.95e0 * nx)
select label, query_id, base_id, floor(dist * 1e5 + 0.5e0) / 1e5 distance, cast(rk as int) "rank" from p where n >= 3 and rk <= 50""")
def knn2_ratio_test(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q, b = e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")
    found = scoring.ratio_matches(q.select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("descriptor")), b.select("label", F.col("vec_id").alias("base_id"), F.col("embedding").alias("descriptor")), ["label"], 0.95, 50, 3)
    return found.select("label", "query_id", "base_id", fixed(F.col("distance"), 5).alias("distance"), "rank")


# --- rasters and corrections

GT = "[100e0, 0.02e0, 0e0, 40e0, 0e0, -0.02e0]"


def _gt() -> list[Column]:
    return [F.lit(v) for v in (100.0, 0.02, 0.0, 40.0, 0.0, -0.02)]


@query(f"""with {OBS}, p as (select row_index, cast(trunc((mapX - 100e0) / 0.02e0) as int) geoX, cast(trunc((mapY - 40e0) / -0.02e0) as int) geoY from obs where mapX is not null)
select *, {sf_fixed('100e0 + geoX * 0.02e0')} x, {sf_fixed('40e0 + geoY * -0.02e0')} y from p""")
def pixel_mapping_affine(spark, sf_dir):
    p = observations(spark, sf_dir).filter("mapX is not null").withColumn("p", geo.geo_to_pixel(F.col("mapX"), F.col("mapY"), _gt()))
    back = geo.pixel_to_geo(F.col("geoX"), F.col("geoY"), _gt())
    return p.select("row_index", F.col("p.col").alias("geoX"), F.col("p.row").alias("geoY")).select("*", fixed(back["x"]).alias("x"), fixed(back["y"]).alias("y"))


@query(f"""with {OBS} select frame_index, count(mapX) n_points, {sf_fixed('max(mapX) - min(mapX)')} lon_span, {sf_fixed('max(mapY) - min(mapY)')} lat_span, (max(mapX) - min(mapX) < 60 and max(mapY) - min(mapY) < 60)::int valid_extent, (max(mapX) - min(mapX) < 60 and max(mapY) - min(mapY) < 60 and count(mapX) >= 6)::int can_warp from obs group by 1""")
def gcp_extent_check(spark, sf_dir):
    c = rasters.extent_check(observations(spark, sf_dir))
    return c.withColumns({"lon_span": fixed(F.col("lon_span")), "lat_span": fixed(F.col("lat_span")), "valid_extent": yes("valid_extent"), "can_warp": yes("can_warp")})


@query(f"""with {OBS}, g as (select frame_index, value / 2 gx, user_id % 97 * 3.5e0 gy from obs where mapX is not null),
e as (select frame_index, floor(min(gx) - 10) a, ceil(max(gx) + 10) b, floor(min(gy) - 10) c, ceil(max(gy) + 10) d from g group by 1),
w as (select frame_index, cast(least(greatest(a, 0), 199) as int) x0, b, cast(least(greatest(c, 0), 299) as int) y0, d from e)
select frame_index, x0, cast(least(greatest(b, x0 + 1), 200) as int) x1, y0, cast(least(greatest(d, y0 + 1), 300) as int) y1, cast(least(greatest(b, x0 + 1), 200) as int) - x0 roi_width, cast(least(greatest(d, y0 + 1), 300) as int) - y0 roi_height from w""")
def roi_from_mapping(spark, sf_dir):
    m = observations(spark, sf_dir).filter("mapX is not null").select("frame_index", (F.col("value") / 2).alias("geoX"), (F.col("user_id") % 97 * F.lit(3.5)).alias("geoY"))
    return rasters.roi_from_mapping(m, 10, F.lit(200), F.lit(300))


@query("""with p as (select p_partkey, 640 + p_size size, p_retailprice % 100 / 50 - 0.5e0 f0, p_retailprice % 70 / 50 - 0.1e0 f1 from part), c as (select p_partkey, size, least(greatest(f0, 0e0), 1e0) a, least(greatest(f1, 0e0), 1e0) b from p),
w as (select *, least(greatest(cast(trunc(size * a) as int), 0), size - 1) first from c)
select p_partkey, case when b > a then first end "first", case when b > a then least(greatest(cast(trunc(size * b) as int), first + 1), size) end past from w""")
def crop_fraction_window(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w = numbers.crop_window(F.col("p_retailprice") % 100 / 50 - 0.5, F.col("p_retailprice") % 70 / 50 - 0.1, F.lit(640) + F.col("p_size"))
    return p.select("p_partkey", w.alias("w")).select("p_partkey", F.col("w.first").alias("first"), F.col("w.past").alias("past"))


@query(f"""with {IMG} select image, min(col) x0, min("row") y0, max(col) + 1 x1, max("row") + 1 y1 from img where value > 120e0 group by 1""")
def valid_pixel_box(spark, sf_dir):
    r = raster(spark, sf_dir).withColumn("value", F.when(F.col("value") > 120, F.col("value")).otherwise(0.0))
    return rasters.valid_box(r)


@query(f"""with {IMG} select image, "row", col, {sf_fixed('pow(least(greatest(value, 0e0), 200e0) / (200e0 + 1e-9), 0.4e0) * 100e0', 5)} tone from img""")
def tone_map(spark, sf_dir):
    return rasters.tone_mapped(raster(spark, sf_dir)).select("image", "row", "col", fixed(F.col("tone"), 5).alias("tone"))


_BYTES = f"""{IMG}, bends as (select image, min(value) lo, max(value) hi from img group by 1), bytes as (select image, "row", col, cast(floor((value - lo) * 255e0 / (hi - lo)) as int) byte from img join bends using (image))"""


@query(f"""with {_BYTES} select image, "row", col, byte from bytes""")
def uint8_normalise(spark, sf_dir):
    return rasters.to_bytes(raster(spark, sf_dir)).select("image", "row", "col", "byte")


@query(f"""with {_BYTES}, s as (select * from bytes where "row" % 2 = 0), r as (select * from bytes where "row" % 2 = 1),
sh as (select image, byte::double lv, count(*) n, 1 kind from s group by 1, 2 union all select image, byte::double, count(*), 0 from r group by 1, 2),
cum as (select image, kind, lv, sum(n) over (partition by image, kind order by lv) / sum(n) over (partition by image, kind) q from sh),
m as (select s.image, s.lv, s.q, max(case when r.q <= s.q then r.lv end) b, max(case when r.q <= s.q then r.q end) bq, min(case when r.q >= s.q then r.lv end) o, min(case when r.q >= s.q then r.q end) oq from cum s join cum r on r.image = s.image and s.kind = 1 and r.kind = 0 group by 1, 2, 3)
select s.image, s."row", s.col, {sf_fixed('case when b is null then o when o is null or oq = bq or bq = q then b else b + (o - b) * (q - bq) / (oq - bq) end', 5)} matched from s join m on m.image = s.image and m.lv = s.byte""")
def histogram_match(spark, sf_dir):
    b = rasters.to_bytes(raster(spark, sf_dir))
    return rasters.histogram_matched(b.filter("row % 2 = 0"), b.filter("row % 2 = 1")).select("image", "row", "col", fixed(F.col("matched"), 5).alias("matched"))


_ASKED = """asked as (select event_id, cast(event_id % 8 as int) image, value / 5 x, user_id % 70 + 0.25e0 y from events)"""
_SAMPLED = f"""{IMG}, size as (select image, max(col) + 1 w, max("row") + 1 h from img group by 1), {_ASKED},
ins as (select a.*, w, h, cast(floor(x) as int) x0, cast(floor(y) as int) y0 from asked a join size using (image) where x between 0 and w - 1 and y between 0 and h - 1),
samp as (select event_id, (p00.value * (1 - (x - x0)) + p10.value * (x - x0)) * (1 - (y - y0)) + (p01.value * (1 - (x - x0)) + p11.value * (x - x0)) * (y - y0) v from ins i
  join img p00 on p00.image = i.image and p00.col = x0 and p00."row" = y0 join img p10 on p10.image = i.image and p10.col = least(x0 + 1, w - 1) and p10."row" = y0
  join img p01 on p01.image = i.image and p01.col = x0 and p01."row" = least(y0 + 1, h - 1) join img p11 on p11.image = i.image and p11.col = least(x0 + 1, w - 1) and p11."row" = least(y0 + 1, h - 1))"""


@query(f"with {_SAMPLED} select a.event_id, {sf_fixed('v')} sampled from asked a left join samp using (event_id)")
def bilinear_sample(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 8).cast("int").alias("image"), (F.col("value") / 5).alias("x"), (F.col("user_id") % 70 + 0.25).alias("y"))
    return rasters.bilinear(asked, raster(spark, sf_dir), ["value"]).select("event_id", fixed(F.col("sampled_value")).alias("sampled"))


_CORR = f"""{IMG}, e as (select event_id, cast(event_id % 8 as int) f, row_number() over (partition by event_id % 8 order by event_id) - 1 o, event_type, value, user_id from events),
p as (select f, o, event_id, 10e0 + value / 100 mx, 20e0 - user_id / 100e0 my, case when event_type <> 'error' then cast(trunc(value / 4) as double) end gx, cast(user_id % 80 as double) gy from e),
fl as (select image f, "row", col, (value - 100e0) / 40e0 dx, (150e0 - value) / 60e0 dy from img), size as (select f, max(col) + 1 w, max("row") + 1 h from fl group by 1),
c as (select p.*, fl.dx, fl.dy, fl.dx is not null and gx is not null ins from p left join size using (f) left join fl on fl.f = p.f and fl.col = gx - 5 and fl."row" = gy - 3),
k as (select *, case when ins then case when f % 2 = 0 then 1e0 else -1e0 end * dx else 0e0 end rx, case when ins then case when f % 2 = 0 then 1e0 else -1e0 end * dy else 0e0 end ry from c),
z as (select *, case when gx is null then 'non_finite_mapping_pixel' when not ins then 'outside_flow_roi' when sqrt(rx * rx + ry * ry) > 2e0 then 'too_large_filtered' when sqrt(rx * rx + ry * ry) > 1e-9 then 'applied' else 'zero_flow' end reason from k),
corr as (select f frame_index, cast(o as int) row_ordinal, reason correction_reason, ins::int flow_inside, (reason = 'applied')::int flow_applied, case when reason = 'applied' then sqrt(rx * rx + ry * ry) else 0e0 end mag,
  case when gx is null then mx else 100e0 + (gx + case when reason = 'applied' then rx else 0e0 end) * 0.02e0 end mapX, case when gx is null then my else 40e0 - (gy + case when reason = 'applied' then ry else 0e0 end) * 0.02e0 end mapY from z)"""


def _corrected(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("frame_index", (F.col("event_id") % 8).cast("int"))
    e = e.withColumn("row_ordinal", F.row_number().over(Window.partitionBy("frame_index").orderBy("event_id")) - 1)
    points = e.select("frame_index", "row_ordinal", (F.lit(10.0) + F.col("value") / 100).alias("mapX"), (F.lit(20.0) - F.col("user_id") / 100).alias("mapY"))
    mapping = e.select("frame_index", "row_ordinal", F.when(F.col("event_type") != "error", (F.col("value") / 4).cast("int").cast("double")).alias("geoX"), (F.col("user_id") % 80).cast("double").alias("geoY"))
    r = raster(spark, sf_dir)
    flow = r.select("image", "row", "col", ((F.col("value") - 100.0) / 40.0).alias("dx"), ((F.lit(150.0) - F.col("value")) / 60.0).alias("dy"))
    said = F.when(F.col("id") % 2 == 0, "new = Old_pixel + flow").otherwise("old_pixel - flow")
    meta = spark.range(8).select(F.col("id").cast("int").alias("frame_index"), F.lit(5).alias("x0"), F.lit(3).alias("y0"), rasters.flow_sign(said, F.lit(None).cast("string")).alias("sign"), F.array(*_gt()).alias("gt"))
    return rasters.corrected_points(points, mapping, flow, meta, 2.0)


@query(f"with {_CORR} select frame_index, row_ordinal, correction_reason, flow_inside, flow_applied, {sf_fixed('mag')} correction_mag, {sf_fixed('mapX')} mapX, {sf_fixed('mapY')} mapY from corr")
def corrected_points(spark, sf_dir):
    return _corrected(spark, sf_dir).select("frame_index", "row_ordinal", "correction_reason", "flow_inside", "flow_applied", *(fixed(F.col(c)).alias(c) for c in ("correction_mag", "mapX", "mapY")))


@query(f"""with {_CORR} select frame_index, count(*) n_points, sum(flow_inside)::bigint inside_flow_count, sum(flow_applied)::bigint applied_count, sum((correction_reason = 'outside_flow_roi')::int)::bigint n_outside,
{sf_fixed('quantile_cont(mag, 0.5)')} p50, {sf_fixed('quantile_cont(mag, 0.9)')} p90, {sf_fixed('quantile_cont(mag, 0.95)')} p95, {sf_fixed('max(mag)')} "max" from corr group by 1""")
def correction_stats(spark, sf_dir):
    s = rasters.correction_stats(_corrected(spark, sf_dir))
    n = F.coalesce(F.try_element_at("reason_counts", F.lit("outside_flow_roi")), F.lit(0)).cast("long")
    return s.select("frame_index", "n_points", "inside_flow_count", "applied_count", n.alias("n_outside"), *(fixed(F.col(c)).alias(c) for c in ("p50", "p90", "p95", "max")))


_NEW = "[100.1e0, 0.03e0, 0e0, 39.9e0, 0e0, -0.025e0]"
_TARGETS = f"""{IMG}, size as (select image, max(col) + 1 w, max("row") + 1 h from img group by 1),
target as (select image, w, h, cast(r as int) "row", cast(c as int) col, (0.1e0 + (c + 0.5e0) * 0.03e0) / 0.02e0 x, (-0.1e0 - (r + 0.5e0) * 0.025e0) / -0.02e0 y from size, range(0, 50) a(c), range(0, 100000) b(r) where r < h * 2 // 3 + 5)"""
_KERNELS = {
    "nearest": "(x0 = floor(x))::int * (y0 = floor(y))::int::double",
    "bilinear": "greatest(1e0 - abs(x - 0.5e0 - x0), 0e0) * greatest(1e0 - abs(y - 0.5e0 - y0), 0e0)",
    "cubic": " * ".join(f"case when {t} < 1 then 1.5e0 * pow({t}, 3) - 2.5e0 * pow({t}, 2) + 1 when {t} < 2 then -0.5e0 * pow({t}, 3) + 2.5e0 * pow({t}, 2) - 4 * {t} + 2 else 0e0 end" for t in ("abs(x - 0.5e0 - x0)", "abs(y - 0.5e0 - y0)")),
}


def _resampled(method):
    def run(spark, sf_dir):
        r = raster(spark, sf_dir)
        sizes = r.groupBy("image").agg((F.max("col") + 1).alias("source_width"), (F.max("row") + 1).alias("source_height"))
        gt = [F.lit(v) for v in (100.1, 0.03, 0.0, 39.9, 0.0, -0.025)]
        grids = sizes.withColumns({"width": F.lit(50), "height": F.floor(F.col("source_height") * 2 / 3).cast("int") + 5, "gt": F.array(*gt), "source_gt": F.array(*_gt())})
        return rasters.resampled(r, grids, method).select("image", "row", "col", fixed(F.col("value"), 4).alias("value"))

    return run


for _method, _weight in _KERNELS.items():
    QUERIES[f"resampled_{_method}"] = _resampled(_method)
    ORACLE_SQL[f"resampled_{_method}"] = f"""with {_TARGETS}, near as (select t.image, t."row", t.col, t.x, t.y, cast(floor(x) as int) + dx x0, cast(floor(y) as int) + dy y0 from target t, range(-2, 4) p(dx), range(-2, 4) q(dy) where x >= 0 and x < w and y >= 0 and y < h),
    found as (select n.image, n."row", n.col, sum(({_weight}) * i.value) / sum({_weight}) v from near n join img i on i.image = n.image and i.col = x0 and i."row" = y0 where i.value <> 0 group by all)
    select t.image, t."row", t.col, {sf_fixed('coalesce(v, 0e0)', 4)} as value from target t left join found using (image, "row", col)"""


@query(f"""with {OBS}, e as (select frame_index, min(mapX) u0, max(mapX) u1, min(mapY) v0, max(mapY) v1 from obs where mapX is not null group by 1),
s as (select *, 1000 + frame_index * 50 w, 800 h, case when frame_index % 5 = 0 then 2e-4 else 1e0 end k from e),
p as (select *, sqrt(pow((u1 - u0) * k, 2) + pow((v0 - v1) * k, 2)) / sqrt((w * w + h * h)::double) px from s),
q as (select *, greatest(1, cast(floor((u1 - u0) / px + 0.5e0) as bigint)) warp_width, greatest(1, cast(floor((v1 - v0) / px + 0.5e0) as bigint)) warp_height from p)
select frame_index, warp_width, warp_height, (warp_width <= 50000 and warp_height <= 50000 and warp_width * warp_height <= 2500000000)::int fits from q""")
def warp_size_guard(spark, sf_dir):
    """Each frame's box as a warp's edge; in one of five frames its corners lie next to each other."""
    o = observations(spark, sf_dir).filter("mapX is not null").groupBy("frame_index").agg(F.min("mapX").alias("u0"), F.max("mapX").alias("u1"), F.min("mapY").alias("v0"), F.max("mapY").alias("v1"))
    sized = o.withColumns({"width": F.lit(1000) + F.col("frame_index") * 50, "height": F.lit(800), "k": F.when(F.col("frame_index") % 5 == 0, 2e-4).otherwise(1.0)})
    node = lambda x, y, u, v: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), u.alias("u"), v.alias("v"))
    far = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k")
    corners = F.array(node(F.lit(0), F.lit(0), F.col("u0"), F.col("v1")), node(F.col("width"), F.col("height"), far("u0", "u1"), far("v1", "v0")), node(F.col("width"), F.lit(0), F.col("u1"), F.col("v0")))
    edges = sized.select("frame_index", F.inline(corners))
    return rasters.warp_size(edges, sized).select("frame_index", "warp_width", "warp_height", yes("fits").alias("fits"))


_STATS = f"""{IMG}, nb as (select *, lag(value) over (partition by image, "row" order by col) l, lead(value) over (partition by image, "row" order by col) r, lag(value) over (partition by image, col order by "row") u, lead(value) over (partition by image, col order by "row") d from img),
st as (select image, count(*) n_pixels, avg((value > 60)::int::double) nd, stddev_pop(value) sd, var_pop(coalesce(l, r, value) + coalesce(r, l, value) + coalesce(u, d, value) + coalesce(d, u, value) - 4 * value) tx from nb group by 1)"""


@query(f"""with {_STATS} select image, n_pixels, {sf_fixed('nd')} non_dark_fraction, {sf_fixed('sd', 4)} contrast, {sf_fixed('tx', 2)} texture,
{sf_fixed("2e0 * (image / 10e0) + 1.5e0 * tanh(image * 60 / 1000e0) + 0.5e0 * least(greatest(sd / 64e0, 0e0), 1e0) + 0.5e0 * least(greatest(ln(1 + tx) / ln(2001e0), 0e0), 1e0) + 0.35e0 * least(greatest(nd / 0.35e0, 0e0), 1e0) - case when nd < 0.01e0 then 1 else 0 end - case when image * 60 < 100 then 1 else 0 end - case when image / 10e0 < 0.1e0 then 0.5e0 else 0e0 end", 5)} score from st""")
def image_statistics(spark, sf_dir):
    s = rasters.image_statistics(raster(spark, sf_dir), dark=60.0)
    score = rasters.reference_score((F.col("image") * 60).cast("double"), F.col("image") / 10.0, F.col("contrast"), F.col("texture"), F.col("non_dark_fraction"))
    return s.select("image", "n_pixels", fixed(F.col("non_dark_fraction")).alias("non_dark_fraction"), fixed(F.col("contrast"), 4).alias("contrast"), fixed(F.col("texture"), 2).alias("texture"), fixed(score, 5).alias("score"))


# --- grids, cameras, time


@query("""with s as (select n_nationkey, 400 + n_nationkey * 37 width, 300 + n_nationkey * 53 height from nation),
recursive_n as (select * from s),
g as (select n_nationkey, width, height, greatest(2, cast(round_even((width - 1) / 185e0, 0) as int) + 1) nx, greatest(2, cast(round_even((height - 1) / 185e0, 0) as int) + 1) ny from s),
grow as (with recursive r as (select *, 0 k from g union all select n_nationkey, width, height, case when width / nx >= height / ny then nx + 1 else nx end, case when width / nx >= height / ny then ny else ny + 1 end, k + 1 from r where nx * ny < 60)
  select n_nationkey, width, height, max(nx) nx, max(ny) ny from r group by all)
select n_nationkey, nx, ny, cast(ix as int) ix, cast(iy as int) iy, floor(ix * ((width - 1) / (nx - 1)) * 1e6 + 0.5e0) / 1e6 x, floor(iy * ((height - 1) / (ny - 1)) * 1e6 + 0.5e0) / 1e6 y from grow, range(0, 100) a(ix), range(0, 100) b(iy) where ix < nx and iy < ny""")
def grid_mesh(spark, sf_dir):
    s = table(spark, sf_dir, "nation").select("n_nationkey", (F.lit(400) + F.col("n_nationkey") * 37).alias("width"), (F.lit(300) + F.col("n_nationkey") * 53).alias("height"))
    return rasters.grid_mesh(s, 185, 60).select("n_nationkey", "nx", "ny", "ix", "iy", fixed(F.col("x")).alias("x"), fixed(F.col("y")).alias("y"))


_GRID = """s as (select n_nationkey, 400 + n_nationkey * 37 width, 300 + n_nationkey * 53 height from nation),
g as (select n_nationkey, width, height, cast(x as int) x, cast(y as int) y from s, range(0, 2000) a(x), range(0, 2000) b(y) where (x % 180 = 0 or x = width - 1) and x < width and (y % 180 = 0 or y = height - 1) and y < height)"""


def _grid(spark, sf_dir):
    s = table(spark, sf_dir, "nation").select("n_nationkey", (F.lit(400) + F.col("n_nationkey") * 37).alias("width"), (F.lit(300) + F.col("n_nationkey") * 53).alias("height"))
    return rasters.grid_points(s, 180)


@query(f"with {_GRID} select n_nationkey, x, y, floor((2e0 * x / (width - 1) - 1e0) * 1e6 + 0.5e0) / 1e6 + 0e0 u, floor((2e0 * y / (height - 1) - 1e0) * 1e6 + 0.5e0) / 1e6 + 0e0 v from g")
def grid_points_unit(spark, sf_dir):
    return _grid(spark, sf_dir).select("n_nationkey", "x", "y", fixed(numbers.to_unit(F.col("x"), F.col("width"))).alias("u"), fixed(numbers.to_unit(F.col("y"), F.col("height"))).alias("v"))


def _pixels(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("double"))
    at = n.select("n_nationkey", (F.col("k") * 5.0 - 60.0).alias("cam_lat"), (F.col("k") * 14.0 - 170.0).alias("cam_lon"), (F.lit(400.0) + F.col("k")).alias("cam_alt_km"), (F.col("k") * 11.0 - 130.0).alias("yaw"), (F.col("k") + 20.0).alias("pitch"), (F.col("k") - 12.0).alias("roll"), F.lit(600.0).alias("width"), F.lit(400.0).alias("height"), F.lit(50.0).alias("fov_x"), F.lit(0.3).alias("hx"), F.lit(-0.5).alias("hy"), F.lit(0.8).alias("hz"))
    return at.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(600), F.lit(100)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(400), F.lit(100)))).withColumns({"px": F.col("px").cast("double"), "py": F.col("py").cast("double")})


def _projected(spark, sf_dir, heading):
    p = projection.projected(_pixels(spark, sf_dir), 10.0, heading)
    return p.select("n_nationkey", "px", "py", fixed(F.col("lat"), 5).alias("lat"), fixed(F.col("lon"), 5).alias("lon"))


def _projection_sql(heading):
    """The same by vectors: axes built by cross products and turned by Rodrigues' formula."""
    dot = lambda a, b: f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"
    crossed = lambda a, b: (f"{a}y * {b}z - {a}z * {b}y", f"{a}z * {b}x - {a}x * {b}z", f"{a}x * {b}y - {a}y * {b}x")
    cross = lambda a, b, o: ", ".join(f"{v} {o}{c}" for c, v in zip("xyz", crossed(a, b), strict=True))
    combine = lambda o, *terms: ", ".join(" + ".join(f"({k}) * {v}{c}" for k, v in terms) + f" {o}{c}" for c in "xyz")
    unit = lambda a, o: ", ".join(f"{a}{c} / sqrt({dot(a, a)}) {o}{c}" for c in "xyz")
    turn = lambda v, k, angle, o: ", ".join(f"{v}{c} * cos(radians({angle})) + ({r}) * sin(radians({angle})) + {k}{c} * {dot(k, v)} * (1 - cos(radians({angle}))) {o}{c}" for c, r in zip("xyz", crossed(k, v), strict=True))
    steps = [
        "n as (select n_nationkey, n_nationkey * 5e0 - 60e0 la, n_nationkey * 14e0 - 170e0 lo, 400e0 + n_nationkey alt, n_nationkey * 11e0 - 130e0 yaw, n_nationkey + 20e0 pitch, n_nationkey - 12e0 roll, px::double px, py::double py, 0.3e0 vel_x, -0.5e0 vel_y, 0.8e0 vel_z from nation, range(0, 601, 100) a(px), range(0, 401, 100) b(py))",
        "s1 as (select *, -sin(radians(la)) * cos(radians(lo)) nor_x, -sin(radians(la)) * sin(radians(lo)) nor_y, cos(radians(la)) nor_z, cos(radians(la)) * cos(radians(lo)) up_x, cos(radians(la)) * sin(radians(lo)) up_y, sin(radians(la)) up_z from n)",
    ]
    if heading:
        steps += [f"s2 as (select *, {combine('tan_', ('1', 'vel_'), ('-' + dot('vel_', 'up_'), 'up_'))} from s1)", f"s3 as (select *, {unit('tan_', 'ah_')} from s2)"]
    else:
        steps += ["s3 as (select *, nor_x ah_x, nor_y ah_y, nor_z ah_z from s1)"]
    steps += [
        f"s4 as (select *, {combine('view0_', ('-cos(radians(pitch))', 'up_'), ('sin(radians(pitch))', 'ah_'))} from s3)",
        f"s5 as (select *, {combine('over_', ('1', 'up_'), ('-' + dot('up_', 'view0_'), 'view0_'))} from s4)",
        f"s6 as (select *, {unit('over_', 'top0_')} from s5)",
        f"s7 as (select *, {cross('view0_', 'top0_', 'right0_')} from s6)",
        f"s8 as (select *, {turn('view0_', 'up_', 'yaw', 'view_')}, {turn('top0_', 'up_', 'yaw', 'top1_')}, {turn('right0_', 'up_', 'yaw', 'right1_')} from s7)",
        f"s9 as (select *, {combine('top_', ('cos(radians(roll))', 'top1_'), ('sin(radians(roll))', 'right1_'))}, {combine('right_', ('-sin(radians(roll))', 'top1_'), ('cos(radians(roll))', 'right1_'))} from s8)",
        "t1 as (select *, ((px + 0.5e0) / 600 * 2 - 1) * tan(radians(50e0) / 2) sx, ((py + 0.5e0) / 400 * 2 - 1) * tan(radians(50e0) / 2) / (600e0 / 400e0) sy from s9)",
        f"t2 as (select *, {combine('out_', ('sx', 'right_'), ('sy', 'top_'), ('1', 'view_'))} from t1)",
        f"t3 as (select *, {unit('out_', 'ray_')}, (10e0 + alt * 10e0 / 6371e0) * up_x eye_x, (10e0 + alt * 10e0 / 6371e0) * up_y eye_y, (10e0 + alt * 10e0 / 6371e0) * up_z eye_z from t2)",
        f"t4 as (select *, {dot('eye_', 'ray_')} half_b, {dot('eye_', 'eye_')} - 100e0 cc from t3)",
        "t5 as (select *, case when half_b * half_b - cc >= 0 then -half_b - sqrt(half_b * half_b - cc) end far from t4)",
        f"t6 as (select *, {combine('hit_', ('1', 'eye_'), ('far', 'ray_'))} from t5)",
    ]
    return f"with {', '.join(steps)} select n_nationkey, px, py, {sf_fixed('degrees(asin(hit_z / sqrt(hit_x * hit_x + hit_y * hit_y + hit_z * hit_z)))', 5)} lat, {sf_fixed('degrees(atan2(hit_y, hit_x))', 5)} lon from t6"


@query(_projection_sql(False))
def ray_projection_north(spark, sf_dir):
    return _projected(spark, sf_dir, False)


@query(_projection_sql(True))
def ray_projection_forward(spark, sf_dir):
    return _projected(spark, sf_dir, True)


@query(f"""with p as (select c_custkey, (c_custkey % 180 - 90) * 0.9e0 la, c_custkey * 7 % 360 - 180e0 lo, c_acctbal / 1000 vx, c_nationkey - 12e0 vy, c_custkey % 17 - 8e0 vz from customer),
v as (select c_custkey, -sin(radians(lo)) * vx + cos(radians(lo)) * vy e, -sin(radians(la)) * cos(radians(lo)) * vx - sin(radians(la)) * sin(radians(lo)) * vy + cos(radians(la)) * vz n from p)
select c_custkey, {sf_fixed('degrees(atan2(e, n)) + 360e0 - 360e0 * floor((degrees(atan2(e, n)) + 360e0) / 360e0)', 5)} bearing from v""")
def heading_bearing(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    v = geo.point(F.col("c_acctbal") / 1000, F.col("c_nationkey") - 12.0, F.col("c_custkey") % 17 - 8.0)
    b = projection.heading_bearing((F.col("c_custkey") % 180 - 90) * 0.9, F.col("c_custkey") * 7 % 360 - 180.0, v)
    return c.select("c_custkey", fixed(b, 5).alias("bearing"))


@query("""with s as (select n_nationkey, timestamp '2024-03-01 10:00:00' + to_minutes(n_nationkey::int) a, timestamp '2024-03-01 10:00:00' + to_minutes(n_nationkey::int) + to_seconds(95 + n_nationkey) z from nation),
m as (select n_nationkey, a + to_minutes(k::int) mi, z from s, range(0, 3) r(k) where a + to_minutes(k::int) <= z)
select n_nationkey, epoch_ms(mi) minute_ms, cast(st as int) step, epoch_us(mi) + cast(floor(st * 700000e0 + 0.5e0) as bigint) t_us from m, range(0, 86) q(st) where epoch_us(mi) + cast(floor(st * 700000e0 + 0.5e0) as bigint) <= epoch_us(z)""")
def time_grid_minutes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.lit("2024-03-01 10:00:00").cast("timestamp") + F.make_interval(mins=F.col("n_nationkey"))).alias("start_ts"))
    spans = n.withColumn("end_ts", F.col("start_ts") + F.make_interval(secs=F.lit(95) + F.col("n_nationkey")))
    return projection.time_grid(spans, 0.7).select("n_nationkey", F.unix_millis("minute").alias("minute_ms"), "step", F.unix_micros("t").alias("t_us"))


@query("select user_id, count(*) n, case when count(*) >= 2 and max(ts) > min(ts) then floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1) * 1e3 + 0.5e0) / 1e3 end delta_seconds from events group by 1")
def time_step_delta(spark, sf_dir):
    return projection.time_step(table(spark, sf_dir, "events"), ["user_id"], "ts").withColumn("delta_seconds", fixed(F.col("delta_seconds"), 3))


@query("""select user_id, lead(ts) over w is not null has_next, floor((lead(value) over w - value) / nullif((epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6, 0) * 1e9 + 0.5e0) / 1e9 + 0e0 vx, event_id from events window w as (partition by user_id order by ts, event_id)""".replace("lead(ts) over w is not null has_next, ", ""))
def state_velocity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("t"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return projection.velocities(e, ["user_id"]).select("user_id", fixed(F.col("vx"), 9).alias("vx"), "event_id")


# --- scores and fits


@query(f"""with {OBS} select frame_index, count(distinct (least(greatest(cast(trunc(sourceX / 2775 * 6) as int), 0), 5)) * 6 + least(greatest(cast(trunc(value / 500 * 6) as int), 0), 5)) / 36e0 coverage from obs group by 1""")
def coverage_cells(spark, sf_dir):
    p = observations(spark, sf_dir).select("frame_index", F.col("sourceX").alias("x"), F.col("value").alias("y"))
    return scoring.coverage(p, ["frame_index"], F.lit(2775), F.lit(500))


@query(f"""with p as (select p_brand, p_partkey % 360 - 180e0 yaw, p_retailprice % 90 pitch, p_size - 25e0 roll from part),
m as (select p_brand, degrees(atan2(avg(sin(radians(yaw))), avg(cos(radians(yaw))))) y, avg(pitch) pitch, avg(roll) roll from p group by 1)
select p_brand, {sf_fixed('y', 4)} yaw, {sf_fixed('pitch', 4)} pitch, {sf_fixed('roll', 4)} roll from m""")
def circular_mean(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 360 - 180.0).alias("yaw"), (F.col("p_retailprice") % 90).alias("pitch"), (F.col("p_size") - 25.0).alias("roll"))
    return scoring.mean_angles(p, ["p_brand"]).select("p_brand", *(fixed(F.col(c), 4).alias(c) for c in ("yaw", "pitch", "roll")))


_METRICS = """m as (select p_brand, p_partkey, p_size / 50e0 coverage, p_partkey % 10 / 10e0 inlier_ratio, tanh(p_size / 120e0) match_count_norm, p_partkey % 7 / 7e0 masked_ssim, p_retailprice / 20000 cv_rmse, p_partkey % 13 / 130e0 disp_rmse,
  p_partkey % 17 / 170e0 log_area_rmse, p_partkey % 19 / 190e0 aniso_rmse, p_partkey % 3 / 100e0 bending_energy, p_partkey % 5 / 50e0 fold_ratio from part),
sc as (select *, 1.5e0 * coverage + 0.6e0 * inlier_ratio + 0.8e0 * match_count_norm + 0.35e0 * masked_ssim - 4e0 * cv_rmse - 3e0 * disp_rmse - 1.75e0 * log_area_rmse - 1.75e0 * aniso_rmse - bending_energy - 4e0 * fold_ratio score from m)"""


def _candidates(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    m = p.select("p_brand", k, (F.col("p_size") / 50.0).alias("coverage"), (k % 10 / 10.0).alias("inlier_ratio"), F.tanh(F.col("p_size") / 120.0).alias("match_count_norm"), (k % 7 / 7.0).alias("masked_ssim"), (F.col("p_retailprice") / 20000).alias("cv_rmse"), (k % 13 / 130.0).alias("disp_rmse"), (k % 17 / 170.0).alias("log_area_rmse"), (k % 19 / 190.0).alias("aniso_rmse"), (k % 3 / 100.0).alias("bending_energy"), (k % 5 / 50.0).alias("fold_ratio"))
    return m.withColumn("score", scoring.candidate_score())


@query(f"with {_METRICS} select p_partkey, {sf_fixed('score')} score from sc")
def candidate_score(spark, sf_dir):
    return _candidates(spark, sf_dir).select("p_partkey", fixed(F.col("score")).alias("score"))


@query(f"with {_METRICS} select p_brand, p_partkey, {sf_fixed('score')} score from (select *, row_number() over (partition by p_brand order by floor(score * 1e6 + 0.5e0) desc, p_partkey) k from sc) where k = 1")
def best_candidate(spark, sf_dir):
    c = _candidates(spark, sf_dir).select("p_brand", "p_partkey", fixed(F.col("score")).alias("score"))
    return scoring.best_candidate(c, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "score")


_FIELD = f"""{IMG}, field as (select image, "row" iy, col ix, col::double x, "row"::double y, col + (value - 100e0) / 300e0 qx, "row" + (value - 100e0) / 500e0 + col / 50e0 qy from img)"""


def _field(spark, sf_dir):
    r, v = raster(spark, sf_dir), F.col("value") - 100.0
    return r.select("image", F.col("row").alias("iy"), F.col("col").alias("ix"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.col("col") + v / 300.0).alias("qx"), (F.col("row") + v / 500.0 + F.col("col") / 50.0).alias("qy"))


def _deformation_sql(field: str) -> str:
    return f"""j as (select image, iy, ix, lead(qx) over a - qx ax, lead(qy) over a - qy ay, lead(qx) over d - qx bx, lead(qy) over d - qy by_ from {field} window a as (partition by image, iy order by ix), d as (partition by image, ix order by iy)),
k as (select *, ax * by_ - bx * ay det, ax * ax + ay * ay + bx * bx + by_ * by_ tot from j where ax is not null and bx is not null),
s as (select *, sqrt((tot + sqrt(greatest(tot * tot - 4 * det * det, 0e0))) / 2) s1, sqrt(greatest((tot - sqrt(greatest(tot * tot - 4 * det * det, 0e0))) / 2, 0e0)) s2 from k),
f as (select image, avg((det <= 0)::int::double) fold_ratio, coalesce(sqrt(avg(case when det > 1e-9 then pow(ln(case when det > 1e-9 then det else 1 end), 2) end)), 10) log_area_rmse, coalesce(sqrt(avg(case when det > 1e-9 then pow(ln(greatest(s1, 1e-9) / greatest(s2, 1e-9)), 2) end)), 10) aniso_rmse from s group by 1),
r as (select *, qx - x rx, qy - y ry from {field}),
b as (select *, pow(lead(rx, 2) over a - 2 * lead(rx) over a + rx, 2) + pow(lead(ry, 2) over a - 2 * lead(ry) over a + ry, 2) b1, pow(lead(rx, 2) over d - 2 * lead(rx) over d + rx, 2) + pow(lead(ry, 2) over d - 2 * lead(ry) over d + ry, 2) b2 from r window a as (partition by image, iy order by ix), d as (partition by image, ix order by iy)),
e as (select image, sqrt(avg(rx * rx + ry * ry)) disp_rmse, quantile_cont(sqrt(rx * rx + ry * ry), 0.95) disp_p95, (avg(b1) + avg(b2)) / 2 bending_energy from b group by 1)
select image, {', '.join(f'{sf_fixed(c, 5)} {c}' for c in ('disp_rmse', 'disp_p95', 'bending_energy', 'fold_ratio', 'log_area_rmse', 'aniso_rmse'))} from e join f using (image)"""


_MEASURES = ("disp_rmse", "disp_p95", "bending_energy", "fold_ratio", "log_area_rmse", "aniso_rmse")


@query(f"with {_FIELD}, {_deformation_sql('field')}")
def warp_deformation(spark, sf_dir):
    return scoring.deformation(_field(spark, sf_dir), False).select("image", *(fixed(F.col(c), 5).alias(c) for c in _MEASURES))


_BACK = """m as (select image, var_pop(x) + var_pop(y) s, covar_pop(x, qx) + covar_pop(y, qy) a, covar_pop(x, qy) - covar_pop(y, qx) b_, avg(x) mx, avg(y) my, avg(qx) mqx, avg(qy) mqy from field group by 1),
sim as (select image, a / s c, b_ / s d, mqx - (a * mx - b_ * my) / s tx, mqy - (b_ * mx + a * my) / s ty from m),
rest as (select image, iy, ix, x, y, (c * (qx - tx) + d * (qy - ty)) / (c * c + d * d) qx, (c * (qy - ty) - d * (qx - tx)) / (c * c + d * d) qy from field join sim using (image))"""


@query(f"with {_FIELD}, {_BACK}, {_deformation_sql('rest')}")
def warp_deformation_baseline(spark, sf_dir):
    return scoring.deformation(_field(spark, sf_dir)).select("image", *(fixed(F.col(c), 5).alias(c) for c in _MEASURES))


def _matches(spark, sf_dir):
    r = raster(spark, sf_dir)
    x, y, v = F.col("col") / 32.0 - 1.0, F.col("row") / 32.0 - 1.0, F.col("value") - 100.0
    return r.select("image", (F.col("row") * 64 + F.col("col")).alias("nth"), x.alias("x"), y.alias("y"), (x * 1.1 + y * y * 0.2 + v / 1e4).alias("u"), (y * 0.9 - x * y * 0.1 - v / 1e4).alias("v"))


def _least_squares_sql(terms: list[str], targets: list[str], by: str, source: str) -> str:
    """CTEs that end in ``beta`` (by, n and a column <target><i> for each term): terms made orthogonal one by one, then back."""
    steps, kept_terms = [f"g as (select *, {', '.join(f'{t} t{i}' for i, t in enumerate(terms))} from {source})", "g0 as (select *, t0 q0 from g)"], len(terms)
    for k in range(1, kept_terms):
        shares = ", ".join(f"sum(t{k} * q{j}) / sum(q{j} * q{j}) r{j}_{k}" for j in range(k))
        left = " - ".join([f"t{k}", *(f"r{j}_{k} * q{j}" for j in range(k))])
        steps += [f"s{k} as (select {by}, {shares} from g{k - 1} group by {by})", f"g{k} as (select g{k - 1}.*, {', '.join(f'r{j}_{k}' for j in range(k))}, {left} q{k} from g{k - 1} join s{k} using ({by}))"]
    along = ", ".join(f"sum({t} * q{k}) / sum(q{k} * q{k}) c{k}_{t}" for k in range(kept_terms) for t in targets)
    crosses = "".join(f", any_value(r{j}_{k}) r{j}_{k}" for k in range(kept_terms) for j in range(k))
    steps.append(f"b{kept_terms} as (select {by}, count(*) n, {along}{crosses} from g{kept_terms - 1} group by {by})")
    for k in reversed(range(kept_terms)):
        steps.append(f"b{k} as (select *, " + ", ".join(" - ".join([f"c{k}_{t}", *(f"r{k}_{m} * {t}{m}" for m in range(k + 1, kept_terms))]) + f" {t}{k}" for t in targets) + f" from b{k + 1})")
    return ", ".join([*steps, "beta as (select * from b0)"])


_FLAT = f"""{IMG}, matches as (select image, x, y, x * 1.1e0 + y * y * 0.2e0 + v / 1e4 u, y * 0.9e0 - x * y * 0.1e0 - v / 1e4 v
  from (select image, col / 32e0 - 1 x, "row" / 32e0 - 1 y, value - 100 v from img))"""


@query(f"""with {_FLAT}, {_least_squares_sql(['1e0', 'x', 'y', 'x * x', 'x * y', 'y * y'], ['u', 'v'], 'image', 'matches')}
{' union all '.join(f"select image, n, {i} term, {sf_fixed(f'u{i}', 5)} px, {sf_fixed(f'v{i}', 5)} py from beta" for i in range(6))}""")
def poly2d_fit(spark, sf_dir):
    """A row per coefficient of each image's fit."""
    p = scoring.polynomial_2d(_matches(spark, sf_dir), ["image"], 2)
    each = p.select("image", "n", F.posexplode(F.arrays_zip("px", "py")).alias("term", "_c"))
    return each.select("image", "n", "term", fixed(F.col("_c.px"), 5).alias("px"), fixed(F.col("_c.py"), 5).alias("py"))


@query()
def holdout_cv_rmse(spark, sf_dir):
    return scoring.holdout_rmse(_matches(spark, sf_dir), ["image"]).withColumn("cv_rmse", fixed(F.col("cv_rmse"), 6))


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 nth, count(*) over (partition by user_id) n from events)
select user_id, event_id from r where n <= 10 or nth in (select cast(round_even(i * (n - 1) / 9e0, 0) as bigint) from range(0, 10) q(i))""")
def evenly_spaced_sample(spark, sf_dir):
    return sampling.evenly_spaced(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 10).select("user_id", "event_id")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 nth from events) where nth % 7 = 0")
def every_nth_frame(spark, sf_dir):
    return sampling.every_nth(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 7).select("user_id", "event_id")


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 nth, count(*) over (partition by user_id) n from events)
select user_id, event_id from r where nth in (select cast(round_even(f * (n - 1), 0) as bigint) from (values (0.1e0), (0.3e0), (0.5e0), (0.7e0), (0.9e0)) q(f))""")
def reference_fractions(spark, sf_dir):
    return sampling.at_fractions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], [0.1, 0.3, 0.5, 0.7, 0.9]).select("user_id", "event_id")


@query(f"with {OBS} select 0 place, 0 frame_index union all select 1, cast(count(*) // 2 as int) from frames union all select 2, cast(count(*) - 1 as int) from frames union all select 3, 12")
def reference_frames(spark, sf_dir):
    return sampling.reference_frames("first, mid,last,12,no,0,999999", frames(spark, sf_dir)).select("place", "frame_index")


# --- control


@query("""with s as (select n_nationkey, n_name, n_regionkey, n_nationkey % 2 = 0 forced, 10 expected, cast(n_nationkey as int) actual, n_nationkey % 3 = 0 up, n_nationkey % 5 <> 0 known, n_nationkey % 7 <> 0 same from nation)
select n_name stage, (forced or actual < expected)::int runs, (not (forced or actual < expected) and (up or not known or not same))::int notes_config,
case when forced then 'forced' when actual < expected then 'incomplete' when up or not known or not same then 'complete, configuration noted' else 'complete' end reason from s""")
def stage_gate_decisions(spark, sf_dir):
    k = F.col("n_nationkey")
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("stage"), (k % 2 == 0).alias("forced"), F.lit(10).alias("expected"), k.alias("actual"), (k % 3 == 0).alias("upstream_changed"), (k % 5 != 0).alias("config_known"), (k % 7 != 0).alias("same_config"))
    return stage_decisions(s).withColumns({"runs": yes("runs"), "notes_config": yes("notes_config")})


@query("select user_id, n, least(n, greatest(1, 50, cast(ceil(n * 0.2e0) as bigint))) needed from (select user_id, count(*) n from events group by 1)")
def accepted_counts(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("needed", numbers.accepted_count(F.col("n"), 50, 0.2).cast("long"))


@query("select event_id, cast(json_extract(props, '$.k') as int) k from events")
def json_config_read(spark, sf_dir):
    return sources.read_json_text(table(spark, sf_dir, "events"), "k INT", "props").select("event_id", F.col("parsed.k").alias("k"))


@query("select event_id::varchar file_name, x.key, x.value from (select event_id, unnest([{'key': 'user', 'value': user_id::varchar}, {'key': 'type', 'value': event_type || '=x'}]) x from events)")
def settings_parse(spark, sf_dir):
    text = F.concat(F.lit("user = "), F.col("user_id"), F.lit("\nno setting\n type="), F.col("event_type"), F.lit("=x\n"))
    return sources.read_settings(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("file_name"), text.alias("value"))).select("file_name", "key", "value")


#: The orientation that the camera of the search has.
PLANTED = (37.0, 47.0, -4.0)


def camera_points(spark, sf_dir):
    """Control points of customers' pixels, where the planted orientation sees them, and a few metres off."""
    k = F.col("c_custkey")
    pixels = table(spark, sf_dir, "customer").select(
        k, (k * 37 % 600).cast("double").alias("px"), (k * 53 % 400).cast("double").alias("py"), F.lit(600.0).alias("width"), F.lit(400.0).alias("height"), F.lit(50.0).alias("fov_x"), F.lit(10.0).alias("cam_lat"),
        F.lit(20.0).alias("cam_lon"), F.lit(400.0).alias("cam_alt_km"), (F.col("c_acctbal").cast("double") * 1e-8).alias("off"),
    )
    seen = projection.projected(pixels.withColumns({n: F.lit(v) for n, v in zip(("yaw", "pitch", "roll"), PLANTED, strict=True)}))
    return seen.filter("lat is not null").select(*pixels.columns, (F.col("lon") + F.col("off")).alias("mapX"), (F.col("lat") - F.col("off")).alias("mapY")).drop("off")


@query()
def simplex_search(spark, sf_dir):
    """The orientation whose rays meet the ground nearest to the control points, from a coarse start; cut off after 30 scores, each a job."""
    points = kept(camera_points(spark, sf_dir), "camera_points")
    found = search.search_orientation(spark, search.by_control_points(points), search.SearchConfig(max_evaluations=30))
    return spark.createDataFrame(found.candidates, "yaw double, pitch double, roll double, score double")


# --- kernels


@query()
def tps_warp(spark, sf_dir):
    """A spline per frame by all its control points, at the nodes of a grid."""
    o = observations(spark, sf_dir).filter("mapX is not null").groupBy("frame_index", "sourceX", "sourceY").agg(F.min("mapX").alias("u"), F.min("mapY").alias("v"))
    ground = o.select(F.col("frame_index"), (F.col("sourceX") / 1000).alias("x"), (F.col("sourceY") / 1000).alias("y"), "u", "v")
    grid = spark.range(5).select((F.col("id") * 0.5).alias("x")).crossJoin(spark.range(4).select((F.col("id") * -0.4).alias("y")))
    out = kernels.warped(ground, frames(spark, sf_dir).crossJoin(grid))
    return out.select("frame_index", "x", "y", fixed(F.col("u"), 3).alias("u"), fixed(F.col("v"), 3).alias("v"))


def _image_pairs(spark, sf_dir):
    return raster(spark, sf_dir).select("image", "row", "col", F.col("value").alias("a"), (F.col("value") * 0.9 + 5.0).alias("b"))


@query()
def tile_likeness(spark, sf_dir):
    return kernels.image_likeness(_image_pairs(spark, sf_dir)).select("image", fixed(F.col("likeness"), 5).alias("likeness"))


@query()
def tile_flow(spark, sf_dir):
    along = Window.partitionBy("image", "row").orderBy("col")
    moved = F.coalesce(F.lag("value").over(along), F.col("value"))  # one pixel to the right
    f = kernels.image_flow(raster(spark, sf_dir).select("image", "row", "col", F.col("value").alias("a"), moved.alias("b")))
    return f.select("image", "row", "col", fixed(F.col("dx"), 4).alias("dx"), fixed(F.col("dy"), 4).alias("dy"))


_SIDE_OF = "(b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)"


@query(f"""with {_GRID}, m as (select distinct c_nationkey image, (c_custkey * 7 % 500)::double x, (c_custkey * 13 % 400)::double y from customer),
lines as (select a.image, a.x ax, a.y ay, b.x bx, b."y" "by", min({_SIDE_OF}) low, max({_SIDE_OF}) high from m a join m b on a.image = b.image and (a.x <> b.x or a.y <> b.y) join m p on p.image = a.image group by all),
edges as (select * from lines where low >= 0 and image in (select image from lines where high > 0)),
nodes as (select n_nationkey image, g.x, g.y, bool_and(coalesce((bx - ax) * (g.y - ay) - ("by" - ay) * (g.x - ax) >= -1e-9, true)) inside from g left join edges e on e.image = n_nationkey group by all)
select image, x, y from (select *, count_if(inside) over (partition by image) >= 3 enough from nodes) where inside or not enough""")
def grid_in_hull(spark, sf_dir):
    n = _grid(spark, sf_dir).withColumnRenamed("n_nationkey", "image")
    m = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image"), (F.col("c_custkey") * 7 % 500).alias("x"), (F.col("c_custkey") * 13 % 400).alias("y"))
    return kernels.within_hull(n, m, 3).select("image", "x", "y")


from lumitrack import block_queries, frame_queries, ground_queries  # noqa: E402,F401  (add their own)
