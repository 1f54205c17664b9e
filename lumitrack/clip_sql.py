"""DuckDB SQL for the chain of the temporal filter, written out step by step as an independent check."""

from __future__ import annotations

from lumitrack.operators.tracks import FilterConfig
from lumitrack.surrogates import OBS

W = "over (partition by track_key)"
DENSE = f"""{OBS},
first_ok as (select * from (select *, row_number() over (partition by track_key, frame_index order by case when mapX is not null then 0 else 1 end, row_index) k from obs) where k = 1),
dense as (
  select t.track_key, f.frame_index, o.row_index, o.mapX, o.mapY, o.row_index is not null observed, o.mapX is not null finite_geo,
         count(*) over (partition by t.track_key) n_frames,
         2e0 * (row_number() over (partition by t.track_key order by f.frame_index) - 1) / (count(*) over (partition by t.track_key) - 1) - 1e0 t
  from (select distinct track_key from obs) t cross join frames f left join first_ok o on o.track_key = t.track_key and o.frame_index = f.frame_index)"""


def fixed(c: str, decimals: int = 6) -> str:
    k = f"1e{decimals}"
    return f"floor(({c}) * {k} + 0.5e0) / {k} + 0e0"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    d = f"(({lon2}) - ({lon1}) + 180e0 - 360e0 * floor((({lon2}) - ({lon1}) + 180e0) / 360e0) - 180e0)"
    a = f"pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({d}) / 2), 2)"
    return f"2 * 6371.0088e0 * asin(sqrt(least(greatest({a}, 0e0), 1e0)))"


def fit_steps(source: str, mask: str, order: int, tag: str) -> tuple[str, str]:
    """CTEs that add px and py to ``source``; returns them and the last one's name."""
    steps = [f"""{tag}a as (select *, case when {mask} then mapX - last_value(case when {mask} then mapX end ignore nulls) over (partition by track_key order by frame_index rows between unbounded preceding and 1 preceding) end d from {source}),
{tag}b as (select *, case when {mask} then mapX + sum(case when d is null then 0e0 else (d + 180e0 - 360e0 * floor((d + 180e0) / 360e0) - 180e0) - d end) over (partition by track_key order by frame_index rows unbounded preceding) end u from {tag}a),
{tag}0 as (select *, sum(case when {mask} then 1e0 end) {W} cnt, 1e0 p0, sum(case when {mask} then u end) {W} / sum(case when {mask} then 1e0 end) {W} px, sum(case when {mask} then mapY end) {W} / sum(case when {mask} then 1e0 end) {W} py from {tag}b)"""]
    last = f"{tag}0"
    for k in range(1, order + 1):
        s = lambda x: f"sum(case when {mask} then {x} end) {W}"
        lower = f" - {s(f'p{k - 1} * p{k - 1}')} / nullif({s(f'p{k - 2} * p{k - 2}')}, 0) * p{k - 2}" if k > 1 else ""
        steps.append(f"{tag}{k}p as (select *, (t - {s(f't * p{k - 1} * p{k - 1}')} / nullif({s(f'p{k - 1} * p{k - 1}')}, 0)) * p{k - 1}{lower} as p{k} from {last})")
        steps.append(f"""{tag}{k} as (select * replace (px + case when cnt > {k} then {s(f'u * p{k}')} / nullif({s(f'p{k} * p{k}')}, 0) * p{k} else 0e0 end as px, py + case when cnt > {k} then {s(f'mapY * p{k}')} / nullif({s(f'p{k} * p{k}')}, 0) * p{k} else 0e0 end as py) from {tag}{k}p)""")
        last = f"{tag}{k}"
    return ",\n".join(steps), last


def clip(config: FilterConfig) -> str:
    """The CTEs from the events to ``clipped``."""
    parts = [DENSE, f"start_0 as (select *, finite_geo and sum(case when finite_geo then 1 else 0 end) {W} >= {config.min_points} st from dense)", "round_0 as (select *, st m, cast(null as boolean) lst from start_0)"]
    by_sigma = f"mean + {config.sigma}e0 * coalesce(sd, 0e0)"
    limit = {"sigma": by_sigma, "absolute": f"{config.absolute_km}e0", "hybrid": f"greatest({config.absolute_km}e0, {by_sigma})"}[config.mode]
    for i in range(config.rounds):
        steps, last = fit_steps(f"round_{i}", "m", config.order, f"f{i}_")
        parts += [
            steps,
            f"g{i}a as (select *, case when finite_geo and px is not null then {haversine('mapY', 'mapX', 'py', 'px')} end r from {last})",
            f"g{i}b as (select *, avg(case when m then r end) {W} mean, stddev_samp(case when m then r end) {W} sd, count(case when m then r end) {W} nr from g{i}a)",
            f"g{i}c as (select *, case when nr = 0 then cast('infinity' as double) else greatest({limit}, {config.min_threshold_km}e0) end thr from g{i}b)",
            f"g{i}d as (select *, st and coalesce(r <= thr, false) nw from g{i}c)",
            f"g{i}e as (select *, sum(nw::int) {W} < {config.min_points} few, max((nw <> m)::int) {W} = 1 dm, max((nw <> coalesce(lst, not nw))::int) {W} = 1 dl from g{i}d)",
        ]
        keep = "track_key, frame_index, row_index, mapX, mapY, observed, finite_geo, n_frames, t, st"
        if i < config.rounds - 1:
            goes = "not few and dm and dl"
            parts.append(f"round_{i + 1} as (select {keep}, case when {goes} then nw else m end m, case when {goes} then m else lst end lst from g{i}e)")
        else:
            parts.append(f"clipped as (select {keep}, px, py, r, thr, mean, coalesce(sd, case when nr > 0 then 0e0 end) sd, sum(m::int) {W} n_last, case when few then m else nw end fit_used, max(st::int) {W} = 1 can_fit, coalesce(finite_geo and r > thr, false) outlier from g{i}e)")
    return ",\n".join(parts)


def gap(source: str, missing: str, anchor: str, max_gap: int, extrapolate: bool) -> str:
    """CTEs from ``source`` to ``gapped`` with the column filled."""
    op = "or" if extrapolate else "and"
    size = "true" if max_gap < 0 else f"count(*) over (partition by track_key, mi, g) <= {max_gap}"
    return f"""gp1 as (select *, {missing} mi, {anchor} an from {source}),
gp2 as (select *, row_number() over (partition by track_key order by frame_index) - row_number() over (partition by track_key, mi order by frame_index) g,
  coalesce(lag(an) over (partition by track_key order by frame_index), false) lf, coalesce(lead(an) over (partition by track_key order by frame_index), false) rt from gp1),
gapped as (select *, mi and {size} and (first_value(lf) over (partition by track_key, mi, g order by frame_index) {op} last_value(rt) over (partition by track_key, mi, g order by frame_index rows between unbounded preceding and unbounded following)) filled from gp2)"""


def filtered(config: FilterConfig) -> str:
    """The CTEs from the events to ``filt``."""
    return f"""{clip(config)},
flags as (select *, can_fit and sum(fit_used::int) {W} >= {config.min_points} and sum(finite_geo::int) {W} / n_frames::double >= {config.min_coverage}e0 can_impute from clipped),
{gap('flags', 'not finite_geo', 'fit_used', config.max_gap, config.extrapolate)},
filt as (select *, can_impute and (outlier or filled) imputed, fit_used and not (can_impute and (outlier or filled)) kept from gapped)"""


def written(config: FilterConfig) -> str:
    """The CTEs from the events to ``written``."""
    return f"""{filtered(config)},
cells as (select * from (select *, row_number() over (partition by track_key, frame_index order by row_index) k from obs) where k = 1),
head as (select * from (select *, row_number() over (partition by track_key order by frame_index, row_index) k from obs) where k = 1),
wr as (
  select f.frame_index, f.track_key, case when imputed then 'imputed' else 'kept' end temporal_status,
    case when imputed then px + 180e0 - 360e0 * floor((px + 180e0) / 360e0) - 180e0 else c.mapX end mapX, case when imputed then py else c.mapY end mapY,
    case when imputed then h.sourceX else c.sourceX end sourceX, case when imputed then h.sourceY else c.sourceY end sourceY, r, thr,
    case when imputed then 1 else (c.row_index % 3 > 0)::int end enable, coalesce(c.event_type, h.event_type) event_type
  from filt f left join cells c on c.track_key = f.track_key and c.frame_index = f.frame_index join head h on h.track_key = f.track_key
  where kept or imputed),
written as (select *, cast(row_number() over (partition by frame_index order by -sourceY, sourceX, track_key) - 1 as int) row_ordinal from wr)"""


def read_neighbours(radius: float) -> str:
    """A CTE of the rows of ``obs`` that have another row of their frame within the radius, by brute force."""
    return f"""near as (select row_index from obs a where a.mapX is not null and exists (select 1 from obs b
  where b.frame_index = a.frame_index and b.row_index <> a.row_index and b.mapX is not null and {haversine('a.mapY', 'a.mapX', 'b.mapY', 'b.mapX')} <= {radius}e0))"""


def with_neighbours(source: str, radius: float, out: str = "final") -> str:
    """A CTE of the rows of ``source`` that have a neighbour within the radius in their frame, by brute force."""
    return f"""{out} as (select * from {source} a where a.mapX is not null and exists (select 1 from {source} b
  where b.frame_index = a.frame_index and b.track_key <> a.track_key and b.mapX is not null and {haversine('a.mapY', 'a.mapX', 'b.mapY', 'b.mapX')} <= {radius}e0))"""
