"""Homographies by hypothesise and verify: samples of four matches, each fitted, counted over all matches, the best refitted.

Matches are (group, nth, x, y, u, v): the place (x, y) is where (u, v) is seen. For each group ``hypotheses`` samples of
four are drawn by ranks of a seeded hash, one row each; a fit of eight parameters for many samples at once gives their
homographies; blocks of matches meet all hypotheses of their group and count what lies within the limit; the hypothesis
with the most (of these the least in number) wins, and is fitted again to what lies within it by least squares, whose
sums Spark makes. The refitted one stays if no fewer matches lie within the limit.

Scale: matches are ranked within hash buckets whose counts are added up, so a hot group is no single sorted stream. Its
blocks are dealt to any number of tasks, each with the group's hypotheses (72 bytes each). A draw depends on seed and
ranks, and ranks on the hash of ``nth`` alone, so the result is the same on any partitioning.

Rows: a match with a null or non-finite number belongs to no sample and is no inlier. Repeated matches count as often as
they occur. A sample that takes one match twice or has three places on a line gives no hypothesis. A group of fewer than
four matches, or whose samples are all of that kind, has no homography.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumitrack.plans.shared import beside, kept

#: Samples of a group, and the limit in pixels (fixed by the matching steps).
HYPOTHESES, LIMIT_PX = 1000, 3.0
#: Hash buckets that a group's matches are ranked in, how many matches meet the hypotheses as a block, and how many of these
#: at a time, so that what is worked out stays in a processor's cache.
BUCKETS, BLOCK, AT_ONCE = 64, 4096, 128
#: Groups whose hypotheses (72 bytes each) may go to every task (some 70 MB).
MOST_LISTS = 1_000
#: Draws of a group, an image, a hypothesis and a rank each, that may go to every task (some 20 MB).
MOST_DRAWS = 500_000
#: Three places are on a line where twice their triangle's area is below this part of the sample's squared width.
FLAT = 1e-4


def ranked(matches: DataFrame, by: list[str], seed: int) -> DataFrame:
    """The finite matches with ``_rank`` (from 0, in the order of a hash) and ``_n``, the number in their group."""
    # each number is named once, as the plan puts its whole expression in place of every mention, until the code is too long to compile
    nothing = sum((F.col(c) * F.lit(0.0) for c in ("y", "u", "v")), F.col("x") * F.lit(0.0))
    usable = matches.filter(nothing == 0.0).withColumn("_hash", F.xxhash64(F.lit(seed), "nth"))
    usable = usable.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - BUCKETS.bit_length() + 1))
    counts = usable.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_many"))
    group = Window.partitionBy(*by)
    offsets = counts.select(*by, "_bucket", (F.sum("_many").over(group.orderBy("_bucket")) - F.col("_many")).alias("_before"), F.sum("_many").over(group).alias("_n"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", "nth", "x", "y", "u", "v")
    placed = usable.withColumn("_place", F.row_number().over(inside) - 1).join(beside(kept(offsets, "offsets")), [*by, "_bucket"])
    return placed.withColumn("_rank", F.col("_before") + F.col("_place")).drop("_hash", "_bucket", "_place", "_before")


def samples(places: DataFrame, by: list[str], hypotheses: int, seed: int) -> DataFrame:
    """(by, _h, _four): for each group and hypothesis four matches (x, y, u, v), by draws of ranks."""
    groups = places.filter("_rank = 0").select(*by, "_n").filter("_n >= 4")
    each = groups.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(hypotheses - 1)))).withColumn("_k", F.explode(F.array(*map(F.lit, range(4)))))
    drawn = each.select(*by, "_h", "_k", F.pmod(F.xxhash64(F.lit(seed + 1), "_h", "_k"), F.col("_n")).alias("_rank"))
    met = beside(kept(drawn, "drawn"), MOST_DRAWS).join(places.select(*by, "_rank", "x", "y", "u", "v"), [*by, "_rank"])
    return met.groupBy(*by, "_h").agg(F.sort_array(F.collect_list(F.struct("_k", "_rank", "x", "y", "u", "v"))).alias("_four"))


def _normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (m, k, 2) around their middle in units of their width; the middles and widths."""
    middle = p.mean(axis=1, keepdims=True)
    width = np.maximum(np.abs(p - middle).max(axis=(1, 2)), 1e-300)
    return (p - middle) / width[:, None, None], middle[:, 0], width


def _flat(p: np.ndarray) -> np.ndarray:
    """Which samples have three of their four places on a line."""
    out = np.zeros(len(p), bool)
    for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        a, b = p[:, j] - p[:, i], p[:, k] - p[:, i]
        out |= np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) < FLAT
    return out


def _undo(h: np.ndarray, from_: tuple[np.ndarray, np.ndarray], to: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Homographies between normal places as ones between places; the last number is 1 where it can be."""
    m = len(h)
    down, up = np.zeros((m, 3, 3)), np.zeros((m, 3, 3))
    (c, s), (d, t) = from_, to
    down[:, 0, 0] = down[:, 1, 1] = 1 / s
    down[:, 0, 2], down[:, 1, 2], down[:, 2, 2] = -c[:, 0] / s, -c[:, 1] / s, 1
    up[:, 0, 0] = up[:, 1, 1] = t
    up[:, 0, 2], up[:, 1, 2], up[:, 2, 2] = d[:, 0], d[:, 1], 1
    out = up @ h @ down
    last = out[:, 2:, 2:]
    return out / np.where(np.abs(last) > 1e-12, last, 1.0)


def fitted(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For samples of four places each (m, 4, 2): the homographies (k, 3, 3) from p to q, and which samples have one."""
    a, c, s = _normal(p)
    b, d, t = _normal(q)
    good = np.flatnonzero(~(_flat(a) | _flat(b)))
    a, b = a[good], b[good]
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, none = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, none, none, none, -u * x, -u * y], axis=2), np.stack([none, none, none, x, y, one, -v * x, -v * y], axis=2)], axis=1)
    sure = np.abs(np.linalg.det(rows)) > 1e-12
    good, rows = good[sure], rows[sure]
    h = np.linalg.solve(rows, np.concatenate([u[sure], v[sure]], axis=1)[..., None])[..., 0]
    full = np.concatenate([h, np.ones((len(h), 1))], axis=1).reshape(-1, 3, 3)
    return _undo(full, (c[good], s[good]), (d[good], t[good])), good


def _hypotheses(drawn: DataFrame, by: list[str]) -> DataFrame:
    """(by, _h, _m): the homography of each sample that has one, as nine numbers."""
    kinds = ", ".join(f"{c} {drawn.schema[c].dataType.simpleString()}" for c in by)

    def solve(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            four = batch.column(len(by) + 1)
            sizes, flat = np.diff(four.offsets.to_numpy()), four.flatten()
            full = np.flatnonzero(sizes == 4)
            at = (four.offsets.to_numpy()[:-1] - four.offsets.to_numpy()[0])[full][:, None] + np.arange(4)
            rank, *xy = (flat.field(i).to_numpy(zero_copy_only=False)[at] for i in range(1, 6))
            apart = (np.diff(np.sort(rank, axis=1), axis=1) > 0).all(axis=1)
            full, xy = full[apart], [c[apart].astype(float) for c in xy]
            h, good = fitted(np.stack(xy[:2], axis=2), np.stack(xy[2:], axis=2))
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * 9), pa.array(h.ravel()))
            rows = pa.array(full[good])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(by) + 1)), made], names=[*by, "_h", "_m"])

    return drawn.select(*by, "_h", "_four").mapInArrow(solve, f"{kinds}, _h int, _m array<double>")


def distances(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How far each homography (m, 3, 3) takes each place of p (b, 2) from that of q: (m, b); infinite beyond the horizon."""
    x = p @ h[:, :2, :2].transpose(0, 2, 1) + h[:, None, :2, 2]
    w = p @ h[:, 2, :2].T + h[:, 2, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.hypot(x[..., 0] / w.T - q[:, 0], x[..., 1] / w.T - q[:, 1])
    return np.where(np.isfinite(d), d, np.inf)


def followers(h: np.ndarray, p: np.ndarray, q: np.ndarray, limit: float) -> np.ndarray:
    """How many places of p (b, 2) each homography (m, 3, 3) takes within ``limit`` of those of q; none beyond the horizon.

    Both sides are multiplied by the homography's third term, so that nothing is divided.
    """
    found = np.zeros(len(h), np.int64)
    for k in range(0, len(p), AT_ONCE):
        (x, y), (u, v) = p[k : k + AT_ONCE].T, q[k : k + AT_ONCE].T
        at = np.stack([x, y, np.ones_like(x)])
        w = h[:, 2] @ at
        off, down = h[:, 0] @ at, h[:, 1] @ at
        off -= w * u
        down -= w * v
        off *= off
        down *= down
        off += down
        ahead = w != 0
        w *= w
        w *= limit * limit
        found += ((off <= w) & ahead).sum(axis=1)
    return found


def _best(places: DataFrame, hypotheses: DataFrame, by: list[str], limit: float) -> DataFrame:
    """(by, _m, _count): the hypothesis of each group that most matches follow; of several, the first."""
    listed = hypotheses.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_h", "_m"))).alias("_all"))
    block = F.floor(F.col("_rank") / BLOCK).alias("_block")
    blocks = places.groupBy(*by, block).agg(*(F.collect_list(F.struct("x", "y", "u", "v")).alias("_them"),))
    pairs = blocks.join(beside(kept(listed, "listed"), MOST_LISTS), by).select(*by, "_all", "_them")
    kinds = ", ".join(f"{c} {places.schema[c].dataType.simpleString()}" for c in by)

    def count(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for i in range(batch.num_rows):
                every, rows = batch.column(len(by))[i].values, batch.column(len(by) + 1)[i].values
                h = np.array(every.field(1).flatten()).reshape(-1, 3, 3)
                x, y, u, v = (rows.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(4))
                found = followers(h, np.stack([x, y], axis=1), np.stack([u, v], axis=1), limit)
                own = [pa.array([batch.column(k)[i].as_py()] * len(h), batch.column(k).type) for k in range(len(by))]
                yield pa.RecordBatch.from_arrays([*own, every.field(0), pa.array(found)], names=[*by, "_h", "_count"])

    counted = pairs.mapInArrow(count, f"{kinds}, _h int, _count long").groupBy(*by, "_h").agg(F.sum("_count").alias("_count"))
    first = counted.groupBy(*by).agg(F.max_by(F.struct("_h", "_count"), F.struct("_count", (-F.col("_h")).alias("_less"))).alias("_b"))
    return first.select(*by, F.col("_b._h").alias("_h"), F.col("_b._count").alias("_count")).join(hypotheses, [*by, "_h"]).select(*by, "_m", "_count")


def error(m: Column) -> Column:
    """How far the homography ``m`` (nine numbers) takes (x, y) from (u, v); null on the horizon."""
    w = m[6] * F.col("x") + m[7] * F.col("y") + m[8]
    at = lambda k: F.try_divide(m[k] * F.col("x") + m[k + 1] * F.col("y") + m[k + 2], w)
    return F.hypot(at(0) - F.col("u"), at(3) - F.col("v"))


def least_squares(matches: DataFrame, by: list[str]) -> DataFrame:
    """(by, _r): the homography that fits all matches of a group best in the algebraic sense, from sums of products; a null
    where fewer than four or places on a line fix none. Coordinates are moved and scaled per group before."""
    stats = matches.groupBy(*by).agg(*(f(c).alias(f"_{n}{c}") for c in ("x", "y", "u", "v") for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scale = lambda a, b: F.greatest(F.col(a), F.col(b), F.lit(1e-12))
    sized = stats.withColumns({"_sp": scale("_sx", "_sy"), "_sq": scale("_su", "_sv")}).drop("_sx", "_sy", "_su", "_sv")
    sized = beside(kept(sized, "sized"))
    near = matches.join(sized, by)
    x, y, u, v = ((F.col(c) - F.col(f"_m{c}")) / F.col(s) for c, s in (("x", "_sp"), ("y", "_sp"), ("u", "_sq"), ("v", "_sq")))
    places, seen = {"xx": x * x, "xy": x * y, "yy": y * y, "x": x, "y": y, "1": F.lit(1.0)}, {"1": F.lit(1.0), "u": u, "v": v, "q": u * u + v * v}
    names = [(p, s) for p in places for s in seen]
    sums = near.groupBy(*by).agg(F.array(*(F.sum(places[p] * seen[s]) for p, s in names)).alias("_sums"))
    at = {k: i for i, k in enumerate(names)}

    def one(r: dict) -> list[float] | None:
        m = {k: r["_sums"][i] for k, i in at.items()}
        block = lambda q: np.array([[m["xx", q], m["xy", q], m["x", q]], [m["xy", q], m["yy", q], m["y", q]], [m["x", q], m["y", q], m["1", q]]])
        a, right = np.zeros((8, 8)), np.zeros(8)
        a[:3, :3] = a[3:6, 3:6] = block("1")
        a[:3, 6:], a[3:6, 6:] = -block("u")[:, :2], -block("v")[:, :2]
        a[6:, :6], a[6:, 6:] = a[:6, 6:].T, block("q")[:2, :2]
        right[:3], right[3:6], right[6:] = block("u")[:, 2], block("v")[:, 2], -block("q")[:2, 2]
        if m["1", "1"] < 4 or np.linalg.cond(a) > 1e12:
            return None
        h = np.append(np.linalg.solve(a, right), 1.0).reshape(1, 3, 3)
        sides = [(np.array([[r[f"_m{c}"], r[f"_m{e}"]]]), np.array([r[k]])) for c, e, k in (("x", "y", "_sp"), ("u", "v", "_sq"))]
        return _undo(h, *sides)[0].ravel().tolist()

    def solve(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in them:
            yield rows[by].assign(_r=[one(r) for r in rows.to_dict("records")])

    both = sums.join(sized, by)
    kinds = ", ".join(f"{c} {matches.schema[c].dataType.simpleString()}" for c in by)
    return both.mapInPandas(solve, f"{kinds}, _r array<double>")


def homographies(matches: DataFrame, by: list[str], limit: float = LIMIT_PX, hypotheses: int = HYPOTHESES, seed: int = 1234) -> DataFrame:
    """Per group: ``n`` matches, ``n_inliers`` within ``limit`` of its homography, and the homography ``h`` (nine numbers)."""
    places = kept(ranked(matches.select(*by, "nth", "x", "y", "u", "v"), by, seed), "places")
    found = kept(_hypotheses(samples(places, by, hypotheses, seed), by), "hypotheses")
    best = beside(kept(_best(places, found, by, limit), "best"))
    inside = places.join(best, by).filter(error(F.col("_m")) <= limit)
    again = beside(kept(least_squares(inside, by), "again"))
    tried = places.join(beside(kept(best.join(again, by), "both")), by)
    sums = tried.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(error(F.col("_m")) <= limit).alias("_first"), F.count_if(error(F.col("_r")) <= limit).alias("_then"), F.first("_m").alias("_m"), F.first("_r").alias("_r"))
    better = F.col("_r").isNotNull() & (F.col("_then") >= F.col("_first"))
    return sums.select(*by, "n", F.when(better, F.col("_then")).otherwise(F.col("_first")).alias("n_inliers"), F.when(better, F.col("_r")).otherwise(F.col("_m")).alias("h"))


def with_inliers(matches: DataFrame, by: list[str], limit: float = LIMIT_PX, hypotheses: int = HYPOTHESES, seed: int = 1234) -> DataFrame:
    """``matches`` with ``inlier``: within ``limit`` of their group's homography; false where there is none."""
    found = beside(kept(homographies(matches, by, limit, hypotheses, seed).select(*by, F.col("h").alias("_h9")), "homographies"))
    return matches.join(found, by, "left").withColumn("inlier", F.coalesce(error(F.col("_h9")) <= limit, F.lit(False))).drop("_h9")
