"""Orientation search: a simplex that climbs, its candidates scored in batches by a Spark job.

The objective takes a DataFrame of candidates (candidate_id, yaw, pitch, roll) and returns (candidate_id, score), null or
absent where a candidate can't be scored. Only the few vertices of the simplex are on the driver; all that a score needs
is the objective's plan. Vertices that are asked for together (the first simplex, and a shrunken one) are one job.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumitrack.functions.geo import haversine_km
from lumitrack.operators.projection import projected

Angles = tuple[float, float, float]
INVALID = -1e12


@dataclass(frozen=True)
class SearchConfig:
    """Ranges in degrees of yaw, pitch and roll, the first steps, and when to stop."""

    ranges: tuple[tuple[float, float], ...] = ((-180.0, 180.0), (30.0, 90.0), (-45.0, 45.0))
    steps: Angles = (10.0, 5.0, 5.0)
    tolerance_deg: float = 2.0
    tolerance_score: float = 1e-3
    max_rounds: int = 45
    max_evaluations: int = 140
    reflect: float = 1.0
    expand: float = 2.0
    contract: float = 0.5
    shrink: float = 0.5


@dataclass
class Search:
    """A search that ran: ``candidates`` in the order of their evaluation, each (yaw, pitch, roll, score)."""

    best: tuple | None = None
    rounds: int = 0
    candidates: list[tuple] = field(default_factory=list)


def _wrap(x: float) -> float:
    return (x + 180.0) % 360.0 - 180.0


def _delta(a: Angles, b: Angles) -> Angles:
    return (_wrap(a[0] - b[0]), a[1] - b[1], a[2] - b[2])


def _within(x: Angles, config: SearchConfig) -> Angles:
    bounds = [sorted(r) for r in config.ranges]
    return tuple(min(max(v, low), high) for v, (low, high) in zip((_wrap(x[0]), x[1], x[2]), bounds, strict=True))


def _along(origin: Angles, direction: Angles, k: float, config: SearchConfig) -> Angles:
    return _within(tuple(o + k * d for o, d in zip(origin, direction, strict=True)), config)


def _centre(points: list[Angles]) -> Angles:
    n = len(points)
    yaw = math.degrees(math.atan2(sum(math.sin(math.radians(p[0])) for p in points) / n, sum(math.cos(math.radians(p[0])) for p in points) / n))
    return (_wrap(yaw), sum(p[1] for p in points) / n, sum(p[2] for p in points) / n)


def first_simplex(centre: Angles, config: SearchConfig) -> list[Angles]:
    """The centre and a step along each free axis, backwards at a bound."""
    centre = _within(centre, config)
    out = [centre]
    for i, (low, high) in enumerate(config.ranges):
        if abs(high - low) <= 1e-9 or not config.steps[i]:
            continue
        for sign in (1, -1):
            moved = _within(tuple(v + sign * abs(config.steps[i]) * (j == i) for j, v in enumerate(centre)), config)
            if math.hypot(*_delta(moved, centre)) >= 1e-9:
                out.append(moved)
                break
    return out


def by_control_points(points: DataFrame, miss_km: float = 2000.0, radius: float = 10.0) -> Callable[[DataFrame], DataFrame]:
    """An objective: minus the root mean square, in hundreds of km, of how far each point's ray meets the ground from its place.

    points: px, py, width, height, fov_x, cam_lat, cam_lon, cam_alt_km, mapX, mapY. A ray that misses the ground counts
    ``miss_km``, as does one that is further off; points without a place count for nothing. The candidates of one job, a
    handful, go to all points; the score is rounded, so that it doesn't hang on the order of sums.
    """
    placed = points.filter("mapX is not null and mapY is not null")

    def score(candidates: DataFrame) -> DataFrame:
        seen = projected(placed.crossJoin(F.broadcast(candidates)), radius)
        off = F.least(F.coalesce(haversine_km(F.col("mapY"), F.col("mapX"), F.col("lat"), F.col("lon")), F.lit(miss_km)), F.lit(miss_km)) / 100.0
        return seen.groupBy("candidate_id").agg(F.round(-F.sqrt(F.avg(off * off)), 9).alias("score"))

    return score


def search_orientation(spark: SparkSession, objective: Callable[[DataFrame], DataFrame], config: SearchConfig = SearchConfig(), centre: Angles | None = None) -> Search:
    """Climbs from ``centre`` (the middle of the ranges by default) until the simplex is small and level, or a limit."""
    run, known = Search(), {}

    def scores(points: list[Angles]) -> list[float]:
        keys = [tuple(round(v, 6) for v in p) for p in points]
        new = [k for k in dict.fromkeys(keys) if k not in known]
        if new:
            asked = spark.createDataFrame([(i, *map(float, k)) for i, k in enumerate(new)], "candidate_id int, yaw double, pitch double, roll double")
            got = {r["candidate_id"]: r["score"] for r in objective(asked).select("candidate_id", F.col("score").cast("double").alias("score")).collect()}
            for i, k in enumerate(new):
                s = got.get(i)
                known[k] = INVALID if s is None or math.isnan(s) else s
                if known[k] > INVALID:
                    run.candidates.append((*k, known[k]))
        return [known[k] for k in keys]

    start = centre or tuple((low + high) / 2 for low, high in config.ranges)
    points = first_simplex(start, config)
    simplex = sorted(zip(scores(points), points, strict=True), key=lambda v: -v[0])
    while run.rounds < config.max_rounds and len(simplex) > 1 and simplex[0][0] > INVALID:
        valid = [s for s, _ in simplex if s > INVALID]
        wide = max(math.hypot(*_delta(a, b)) for _, a in simplex for _, b in simplex)
        if (wide <= config.tolerance_deg and valid[0] - valid[-1] <= config.tolerance_score) or len(known) >= config.max_evaluations:
            break
        run.rounds += 1
        worst_score, worst = simplex[-1]
        middle = _centre([p for _, p in simplex[:-1]])
        away = _delta(worst, middle)
        mirrored = _along(middle, away, -config.reflect, config)
        mirrored_score = scores([mirrored])[0]
        taken = None
        if mirrored_score > simplex[0][0]:
            further = _along(middle, _delta(mirrored, middle), config.expand, config)
            taken = max((mirrored_score, mirrored), (scores([further])[0], further), key=lambda v: v[0])
        elif mirrored_score > simplex[-2][0]:
            taken = (mirrored_score, mirrored)
        else:
            outside = mirrored_score > worst_score
            nearer = _along(middle, _delta(mirrored, middle) if outside else away, config.contract, config)
            nearer_score = scores([nearer])[0]
            if nearer_score > max(mirrored_score, worst_score):
                taken = (nearer_score, nearer)
        if taken:
            simplex[-1] = taken
        else:
            best = simplex[0]
            drawn = [_along(best[1], _delta(p, best[1]), config.shrink, config) for _, p in simplex[1:]]
            simplex = [best, *zip(scores(drawn), drawn, strict=True)]
        simplex.sort(key=lambda v: -v[0])
    run.best = max(run.candidates, key=lambda c: c[3], default=None)
    return run
