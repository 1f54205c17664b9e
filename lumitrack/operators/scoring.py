"""Scores of match sets and warps: coverage, circular means, deformation of a grid, polynomial fits, candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumitrack.functions.geo import wrap_degrees
from lumitrack.functions.numbers import clamp, to_unit
from lumitrack.operators.homography import with_inliers
from lumitrack.operators.kernels import within_hull
from lumitrack.operators.rasters import grid_points
from lumitrack.plans.shared import beside, kept

#: Weights of a candidate's terms (fixed values); what is bad counts against it.
CANDIDATE_WEIGHTS = {
    "coverage": 1.50, "inlier_ratio": 0.60, "match_count_norm": 0.80, "masked_ssim": 0.35, "cv_rmse": -4.00,
    "disp_rmse": -3.00, "log_area_rmse": -1.75, "aniso_rmse": -1.75, "bending_energy": -1.00, "fold_ratio": -4.00,
}


def coverage(points: DataFrame, by: list[str], width: Column, height: Column, bins: int = 6) -> DataFrame:
    """Per group: the share of bins x bins cells that hold a point."""
    cell = lambda c, size: clamp((F.col(c) / F.greatest(size, F.lit(1)) * bins).cast("int"), 0, bins - 1)
    return points.groupBy(*by).agg((F.count_distinct(F.struct(cell("x", width), cell("y", height))) / F.lit(float(bins * bins))).alias("coverage"))


def mean_angles(points: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the circular mean of yaw and the means of pitch and roll."""
    yaw = F.radians("yaw")
    mean = F.degrees(F.atan2(F.avg(F.sin(yaw)), F.avg(F.cos(yaw))))
    return points.groupBy(*by).agg(wrap_degrees(mean).alias("yaw"), F.avg("pitch").alias("pitch"), F.avg("roll").alias("roll"))


def candidate_score() -> Column:
    total = F.lit(0.0)
    for name, weight in CANDIDATE_WEIGHTS.items():
        total = total + F.lit(weight) * F.col(name)
    return total


def best_candidate(candidates: DataFrame, by: list[str], order: str) -> DataFrame:
    """Per group the candidate with the highest score; of equals the first in ``order``."""
    rest = [c for c in candidates.columns if c not in (*by, "score", order)]
    best = F.max_by(F.struct("score", order, *rest), F.struct("score", (-F.col(order)).alias("first"))).alias("b")
    return candidates.groupBy(*by).agg(best).select(*by, "b.*")


def jacobians(field: DataFrame) -> DataFrame:
    """Per inner cell of a field (image, iy, ix, x, y, qx, qy): determinant and singular values of dq/dp.

    Spacing is that of the grid's first cell, also for a narrower last one.
    """
    start = lambda line, c: F.first(c).over(Window.partitionBy("image", line).orderBy("ix" if line == "iy" else "iy").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    across, down = Window.partitionBy("image", "iy").orderBy("ix"), Window.partitionBy("image", "ix").orderBy("iy")
    second = lambda line, c: F.nth_value(c, 2).over(Window.partitionBy("image", line).orderBy("ix" if line == "iy" else "iy").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    step = lambda line, c: F.when(F.abs(second(line, c) - start(line, c)) < 1e-12, F.lit(1.0)).otherwise(second(line, c) - start(line, c))
    d = field.withColumns({
        "_dx": step("iy", "x"), "_dy": step("ix", "y"),
        "_ax": F.lead("qx").over(across) - F.col("qx"), "_ay": F.lead("qy").over(across) - F.col("qy"),
        "_bx": F.lead("qx").over(down) - F.col("qx"), "_by": F.lead("qy").over(down) - F.col("qy"),
    }).filter("_ax is not null and _bx is not null")
    a, b, c, e = F.col("_ax") / F.col("_dx"), F.col("_bx") / F.col("_dy"), F.col("_ay") / F.col("_dx"), F.col("_by") / F.col("_dy")
    det, total = a * e - b * c, a * a + b * b + c * c + e * e
    root = F.sqrt(F.greatest(total * total - F.lit(4.0) * det * det, F.lit(0.0)))
    s1, s2 = F.sqrt((total + root) / 2.0), F.sqrt(F.greatest((total - root) / 2.0, F.lit(0.0)))
    return d.select("image", "iy", "ix", det.alias("det"), s1.alias("s1"), s2.alias("s2"))


def without_similarity(field: DataFrame) -> DataFrame:
    """``field`` (image, x, y, qx, qy) with (qx, qy) taken back by the similarity of its image that leads (x, y) nearest to it.

    That similarity (scale, turn and shift by least squares) comes from moments, so an image may lie in any number of
    tasks; it's the identity where all places are one.
    """
    c = F.covar_pop
    sums = field.groupBy("image").agg(
        (F.var_pop("x") + F.var_pop("y")).alias("_s"), (c("x", "qx") + c("y", "qy")).alias("_a"), (c("x", "qy") - c("y", "qx")).alias("_b"),
        *(F.avg(v).alias(f"_m{v}") for v in ("x", "y", "qx", "qy")),
    )
    known = F.coalesce((F.col("_s") > 0) & (F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b") > 0), F.lit(False))
    turn = sums.withColumns({"_a": F.when(known, F.col("_a") / F.col("_s")).otherwise(1.0), "_b": F.when(known, F.col("_b") / F.col("_s")).otherwise(0.0)})
    shift = {"_tx": F.col("_mqx") - F.col("_a") * F.col("_mx") + F.col("_b") * F.col("_my"), "_ty": F.col("_mqy") - F.col("_b") * F.col("_mx") - F.col("_a") * F.col("_my")}
    solved = turn.withColumns({k: F.when(known, v).otherwise(0.0) for k, v in shift.items()}).select("image", "_a", "_b", "_tx", "_ty")
    x, y, size = F.col("qx") - F.col("_tx"), F.col("qy") - F.col("_ty"), F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")
    back = {"qx": (F.col("_a") * x + F.col("_b") * y) / size, "qy": (F.col("_a") * y - F.col("_b") * x) / size}
    return field.join(solved, "image").withColumns(back).drop("_a", "_b", "_tx", "_ty")


def quantile(rows: DataFrame, by: str, value: str, share: float, out: str) -> DataFrame:
    """(by, out): the exact quantile of a group's lengths (0 or more), between the two places next to it, as ``percentile`` has it.

    ``percentile`` holds all different values of a group in one task's memory. Here counts of narrow bins (a 4,096th wide
    in the logarithm) say which bins hold the two places, and only the values of these are put in order.
    """
    known = rows.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("_v"))
    bin_ = F.when(F.isnan("_v"), F.lit(2**40)).when(F.col("_v") > 0, F.floor(F.log("_v") * 4096.0)).otherwise(F.lit(-(2**40)))
    binned = known.withColumn("_bin", bin_.cast("long"))
    counts = binned.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_many"))
    group = Window.partitionBy(by)
    at = (F.sum("_many").over(group) - 1) * F.lit(share)
    placed = counts.withColumns({"_before": F.sum("_many").over(group.orderBy("_bin")) - F.col("_many"), "_at": at})
    near = placed.filter("_before <= ceil(_at) and _before + _many > floor(_at)").select(by, "_bin", "_before", "_at")
    values = binned.join(near, [by, "_bin"]).groupBy(by, "_bin", "_before", "_at", "_v").agg(F.count(F.lit(1)).alias("_n"))
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(by, "_bin").orderBy("_v"))
    ended = values.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))
    holds = lambda k: F.max(F.when((F.col("_start") <= k(F.col("_at"))) & (k(F.col("_at")) < F.col("_end")), F.col("_v")))
    ends = ended.groupBy(by).agg(holds(F.floor).alias("_low"), holds(F.ceil).alias("_high"), F.first("_at").alias("_at"))
    part = F.col("_at") - F.floor("_at")
    return ends.select(by, F.when(part == 0, F.col("_low")).otherwise((1 - part) * F.col("_low") + part * F.col("_high")).alias(out))


def deformation(field: DataFrame, baseline: bool = True, nodes: DataFrame | None = None) -> DataFrame:
    """Per image of a field on a rectangular grid (x, y to qx, qy): the six measures of how a warp deforms it.

    With ``baseline`` what a similarity does counts as no deformation. ``nodes`` (image, iy, ix) are those whose
    displacements count (within the hull of the matches, say); the other measures are of the whole grid.
    """
    shown = field if nodes is None else field.join(nodes.select("image", "iy", "ix").distinct(), ["image", "iy", "ix"], "left_semi")
    if baseline:
        field, shown = without_similarity(field), without_similarity(shown)
    j = jacobians(field)
    valid = F.col("det") > 1e-9
    area, ratio = F.when(valid, F.log("det")), F.when(valid, F.abs(F.log(F.greatest(F.col("s1"), F.lit(1e-9)) / F.greatest(F.col("s2"), F.lit(1e-9)))))
    folds = j.groupBy("image").agg(
        F.avg((F.col("det") <= 0).cast("double")).alias("fold_ratio"), F.coalesce(F.sqrt(F.avg(area * area)), F.lit(10.0)).alias("log_area_rmse"),
        F.coalesce(F.sqrt(F.avg(ratio * ratio)), F.lit(10.0)).alias("aniso_rmse"),
    )
    r = field.withColumns({"_rx": F.col("qx") - F.col("x"), "_ry": F.col("qy") - F.col("y")})
    bent = {}
    for name, line, along in (("x", "iy", "ix"), ("y", "ix", "iy")):
        w = Window.partitionBy("image", line).orderBy(along)
        second = [F.lead(c, 2).over(w) - F.lit(2.0) * F.lead(c, 1).over(w) + F.col(c) for c in ("_rx", "_ry")]
        bent[f"_b{name}"] = second[0] * second[0] + second[1] * second[1]
    size = F.col("_rx") * F.col("_rx") + F.col("_ry") * F.col("_ry")
    both = F.array_compact(F.array(F.avg("_bx"), F.avg("_by")))
    energy = F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.size(both)).otherwise(F.lit(0.0))
    shifts = shown.withColumns({"_rx": F.col("qx") - F.col("x"), "_ry": F.col("qy") - F.col("y")}).select("image", size.alias("_size"), F.sqrt(size).alias("_far"))
    moved = shifts.groupBy("image").agg(F.sqrt(F.avg("_size")).alias("disp_rmse")).join(quantile(shifts, "image", "_far", 0.95, "disp_p95"), "image", "left")
    sums = r.withColumns(bent).groupBy("image").agg(energy.alias("bending_energy")).join(moved, "image", "left")
    return sums.join(folds, "image", "left").fillna({"disp_rmse": 1e6, "disp_p95": 1e6, "fold_ratio": 1.0, "log_area_rmse": 10.0, "aniso_rmse": 10.0})


def _terms(x, y, order: int) -> list:
    """The monomials of a two-dimensional polynomial by degree: 1; x, y; x^2, xy, y^2; ..."""
    return [x ** (d - k) * y**k for d in range(order + 1) for k in range(d + 1)]


def polynomial_2d(matches: DataFrame, by: list[str], order: int = 2) -> DataFrame:
    """Per group the least-squares polynomial from (x, y) to (u, v): arrays px and py of coefficients by degree.

    The normal equations are sums, so each group comes down to one small matrix, however many its matches.
    """
    terms = _terms(F.col("x"), F.col("y"), order)
    n = len(terms)
    # x and y to the power 0 is 1 also where a base is 0
    gram = F.array(*(F.sum(terms[i] * terms[j]) for i in range(n) for j in range(n)))
    right = [F.array(*(F.sum(t * F.col(c)) for t in terms)) for c in ("u", "v")]
    sums = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), gram.alias("_g"), right[0].alias("_u"), right[1].alias("_v"))

    def solve(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in them:
            out = {"px": [], "py": []}
            for g, u, v in zip(x["_g"], x["_u"], x["_v"], strict=True):
                a = np.array(g, dtype=float).reshape(n, n)
                p = np.linalg.lstsq(a, np.stack([u, v], axis=1), rcond=None)[0]
                out["px"].append(p[:, 0].tolist())
                out["py"].append(p[:, 1].tolist())
            yield x[[*by, "n"]].assign(**out)

    kinds = ", ".join(f"{c} {matches.schema[c].dataType.simpleString()}" for c in by)
    return sums.mapInPandas(solve, f"{kinds}, n long, px array<double>, py array<double>")


def evaluated_2d(points: DataFrame, px: Column, py: Column, order: int = 2) -> DataFrame:
    """``points`` with (qx, qy): the polynomial at (x, y)."""
    terms = _terms(F.col("x"), F.col("y"), order)
    total = lambda p: sum((p[i] * t for i, t in enumerate(terms)), F.lit(0.0))
    return points.withColumns({"qx": total(px), "qy": total(py)})


#: Ranges of hashes, of which one is sorted to find where a shuffle's held-out part ends.
HASH_RANGES = 4096


def holdout_rmse(matches: DataFrame, by: list[str], order: int = 2, repeats: int = 4, holdout: float = 0.25, seed: int = 1234) -> DataFrame:
    """Per group: the mean error of polynomial fits on what a seeded shuffle holds out; small groups are fitted as a whole.

    The shuffle is the order of a hash of ``nth``. Fits are by normal equations and errors are sums, and the last place held
    out is found from counts of ranges of hashes and the rows of one range, so no group is gathered or sorted. Rows that
    share their ``nth`` are held out together.
    """
    counts = beside(kept(matches.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "counts"))
    small = F.col("_n") < max(12, order * 4)
    times = F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(repeats - 1)))
    each = matches.join(counts, by).withColumn("_repeat", F.explode(times)).withColumn("_hash", F.xxhash64(F.lit(seed), "_repeat", "nth"))
    each = each.withColumn("_range", F.shiftright("_hash", 64 - HASH_RANGES.bit_length() + 1))
    out = F.least(F.greatest(F.lit(6), F.bround(F.col("_n") * F.lit(holdout)).cast("long")), F.col("_n") - 6)
    shuffled = [*by, "_repeat"]
    ranges = each.groupBy(*shuffled, "_range").agg(F.count(F.lit(1)).alias("_many"), F.first("_n").alias("_n"))
    before = F.sum("_many").over(Window.partitionBy(*shuffled).orderBy("_range")) - F.col("_many")
    last = ranges.withColumns({"_before": before, "_out": out}).filter("_before < _out and _before + _many >= _out").select(*shuffled, "_range", (F.col("_out") - F.col("_before")).alias("_place"))
    inside = each.join(beside(kept(last, "last_ranges")), [*shuffled, "_range"])
    own = Window.partitionBy(*shuffled).orderBy("_hash", "nth")
    ends = inside.withColumn("_nth", F.row_number().over(own)).filter("_nth = _place").select(*shuffled, F.struct("_hash", "nth").alias("_end"))
    split = each.join(beside(kept(ends, "ends")), shuffled, "left").withColumn("_held", F.coalesce(F.struct("_hash", "nth") <= F.col("_end"), F.lit(False)))
    fits = beside(kept(polynomial_2d(split.filter(small | ~F.col("_held")), shuffled, order).drop("n"), "fits"))
    tested = evaluated_2d(split.filter(small | F.col("_held")).join(fits, shuffled), F.col("px"), F.col("py"), order)
    error = F.sqrt(F.avg(F.pow(F.col("qx") - F.col("u"), 2) + F.pow(F.col("qy") - F.col("v"), 2)))
    return tested.groupBy(*by, "_repeat").agg(F.max("_n").alias("n"), error.alias("e")).groupBy(*by).agg(F.max("n").alias("n"), F.avg("e").alias("cv_rmse"))


#: About how many descriptors of either side a task compares at a time.
BLOCK = 1024


def ratio_matches(queries: DataFrame, base: DataFrame, by: list[str], ratio: float = 0.75, most: int = 2000, least: int = 20) -> DataFrame:
    """Descriptor matches that pass the ratio test: the nearest of ``base`` is clearly nearer than the second.

    queries: by, query_id, descriptor; base: by, base_id, descriptor (unit-free arrays), ids once per group. Both sides of
    a group are dealt to blocks by a hash of their ids, as many as its size asks for; a task takes one block of each, whose
    distances are one product, and gives the two nearest per query, of which a window keeps the two over all blocks. Groups
    with fewer than ``least`` survivors give none.
    """
    def dealt(rows: DataFrame, id_: str, own: str, other: DataFrame, far: str) -> DataFrame:
        """``rows`` in block ``own``, once for each block ``far`` of the other side."""
        count = lambda x, name: x.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name))
        sized = rows.join(count(rows, "_own"), by).join(count(other, "_far"), by)
        placed = sized.withColumns({own: F.pmod(F.xxhash64(id_), F.col("_own")).cast("int"), far: F.explode(F.sequence(F.lit(0), F.col("_far") - 1))})
        return placed.select(*(F.col(c).alias(c) for c in (*by, own, far, id_, "descriptor")))  # columns of its own, as both sides may be of one table

    def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame(columns=[*by, "query_id", "base_id", "distance"])
        b = b.sort_values("base_id")
        x, y = (np.array(s["descriptor"].tolist(), dtype=float) for s in (q, b))
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))
        two = np.argsort(d, axis=1, kind="stable")[:, :2]
        return pd.concat([q[[*by, "query_id"]].assign(base_id=b["base_id"].to_numpy()[two[:, k]], distance=d[np.arange(len(q)), two[:, k]]) for k in range(two.shape[1])])

    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in (*by, "query_id"))
    blocks = [*by, "_q", "_b"]
    left, right = dealt(queries, "query_id", "_q", base, "_b"), dealt(base, "base_id", "_b", queries, "_q")
    found = left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(nearest, f"{kinds}, base_id {base.schema['base_id'].dataType.simpleString()}, distance double")
    own = Window.partitionBy(*by, "query_id").orderBy("distance", "base_id")
    firsts = found.withColumns({"_k": F.row_number().over(own), "_second": F.lead("distance").over(own)}).filter("_k = 1")
    passed = firsts.filter(F.col("distance") < F.lit(ratio) * F.col("_second"))
    order, group = Window.partitionBy(*by).orderBy("distance", "query_id"), Window.partitionBy(*by)
    ranked = passed.withColumns({"rank": F.row_number().over(order), "_n": F.count(F.lit(1)).over(group)})
    return ranked.filter((F.col("_n") >= least) & (F.col("rank") <= most)).drop("_n", "_k", "_second")


def consensus(matches: DataFrame, by: list[str], limit: float, order: int = 1, rounds: int = 3) -> DataFrame:
    """``matches`` with ``inlier``: within ``limit`` of a polynomial fitted again and again to what was within before.

    It starts from all matches of a group, so it suits sets whose wrong matches are few or scattered. Each round is kept in
    the shared folder, as the next uses it twice.
    """
    now = matches.withColumn("inlier", F.lit(True))
    for _ in range(rounds):
        fit = polynomial_2d(now.filter("inlier"), by, order).drop("n")
        at = evaluated_2d(now.join(fit, by), F.col("px"), F.col("py"), order)
        off = F.sqrt(F.pow(F.col("qx") - F.col("u"), 2) + F.pow(F.col("qy") - F.col("v"), 2))
        now = kept(at.withColumn("inlier", off <= limit).drop("px", "py", "qx", "qy"), "consensus")
    return now


def scored_candidates(matches: DataFrame, sizes: DataFrame, step: int = 180, limit_px: float = 3.0, least: int = 20, likeness: DataFrame | None = None) -> DataFrame:
    """Per candidate (image): its matches' inliers, polynomial, hold-out error, deformation and score.

    matches: image, nth, real_x, real_y, sim_x, sim_y in pixels; sizes: image, width, height; likeness: image,
    masked_ssim (0 without). Inliers follow a homography found by samples. Candidates with fewer than ``least`` matches or
    inliers give no row.
    """
    unit = lambda c, s: to_unit(F.col(c), F.col(s))
    enough = matches.groupBy("image").agg(F.count(F.lit(1)).alias("n_matches_raw")).filter(F.col("n_matches_raw") >= least).join(sizes, "image")
    pixels = matches.join(beside(kept(enough, "enough")), "image").withColumns({"x": F.col("real_x"), "y": F.col("real_y"), "u": F.col("sim_x"), "v": F.col("sim_y")})
    inside = kept(with_inliers(pixels, ["image"], limit_px).filter("inlier"), "inside")
    counts = inside.groupBy("image").agg(F.count(F.lit(1)).alias("n_inliers"), F.max("n_matches_raw").alias("n_matches_raw")).filter(F.col("n_inliers") >= least)
    counts = beside(kept(counts, "counts"))
    inside = inside.join(counts.select("image"), "image", "left_semi")
    on_unit = inside.withColumns({"x": unit("real_x", "width"), "y": unit("real_y", "height"), "u": unit("sim_x", "width"), "v": unit("sim_y", "height")})
    fits = kept(polynomial_2d(on_unit, ["image"]).drop("n"), "fits")
    grid = grid_points(sizes.join(counts.select("image"), "image", "left_semi"), step)
    placed = {"iy": F.dense_rank().over(Window.partitionBy("image").orderBy("y")) - 1, "ix": F.dense_rank().over(Window.partitionBy("image").orderBy("x")) - 1}
    nodes = grid.withColumns(placed)
    shown = within_hull(nodes, inside.select("image", F.col("real_x").alias("x"), F.col("real_y").alias("y")))
    field = evaluated_2d(nodes.withColumns({"x": unit("x", "width"), "y": unit("y", "height")}).join(fits, "image"), F.col("px"), F.col("py"))
    bent = deformation(kept(field.select("image", "iy", "ix", "x", "y", "qx", "qy"), "field"), True, shown)
    covered = [coverage(inside.select("image", "width", "height", F.col(f"{k}_x").alias("x"), F.col(f"{k}_y").alias("y")), ["image"], F.col("width"), F.col("height")).withColumnRenamed("coverage", f"coverage_{k}") for k in ("real", "sim")]
    errors = holdout_rmse(on_unit, ["image"]).drop("n")
    out = counts.join(fits, "image").join(errors, "image").join(bent, "image").join(covered[0], "image").join(covered[1], "image")
    out = out.withColumn("masked_ssim", F.lit(0.0)) if likeness is None else out.join(likeness, "image", "left").fillna(0.0, ["masked_ssim"])
    out = out.withColumns({"coverage": F.least("coverage_real", "coverage_sim"), "inlier_ratio": F.col("n_inliers") / F.col("n_matches_raw"), "match_count_norm": F.tanh(F.col("n_inliers") / F.lit(120.0))})
    return out.withColumn("score", candidate_score())
