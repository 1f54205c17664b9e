"""Matches out of a matcher's result, whatever its encoding: six pairs of names for matched places, or key points of two
images with pairs of indices, or an array of indices for either side. Results are JSON or VARIANT; what fits first counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumitrack.functions.numbers import finite

#: Names of matched places, by priority, and of key points (fixed values of the matchers).
DIRECT = (
    ("inlier_kpts0", "inlier_kpts1"), ("inlier_mkpts0", "inlier_mkpts1"), ("mkpts0", "mkpts1"), ("m_kpts0", "m_kpts1"), ("matched_kpts0", "matched_kpts1"),
    ("matched_keypoints0", "matched_keypoints1"),
)
KEY_POINTS = (("kpts0", "kpts1"), ("keypoints0", "keypoints1"))
PLACE = "array<double>"


def _array(result: Column, name: str, of: str) -> Column:
    """The array of that name, also where it is the only one within another. What is of another kind becomes null."""
    plain, within = (F.try_variant_get(result, f"$.{name}", f"array<{k}>") for k in (of, f"array<{of}>"))
    inner = F.get(within, F.lit(0))
    nested = (F.size(within) == 1) & (F.size(inner) > 0) & ~F.exists(inner, lambda x: x.isNull())
    return F.when(F.coalesce(nested, F.lit(False)), inner).otherwise(plain)


def _sound(pairs: Column) -> Column:
    """Pairs of two finite places as floats; null if there is none."""
    as_float = lambda p: F.transform(F.slice(p, F.lit(1), F.lit(2)), lambda v: v.cast("float"))
    made = F.transform(pairs, lambda p: F.struct(as_float(p["left"]).alias("left"), as_float(p["right"]).alias("right")))
    whole = lambda p: (F.size(p) >= 2) & finite(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    good = F.filter(made, lambda p: whole(p["left"]) & whole(p["right"]))
    return F.when(F.size(good) > 0, good)


def _zipped(left: Column, right: Column) -> Column:
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def _taken(left: Column, right: Column, indices: Column) -> Column:
    """The places that pairs of indices (struct a, b) name; those out of range drop out."""
    fine = F.filter(indices, lambda m: (m["a"] >= 0) & (m["a"] < F.size(left)) & (m["b"] >= 0) & (m["b"] < F.size(right)))
    at = lambda of, i: F.get(of, i.cast("int"))
    return F.transform(fine, lambda m: F.struct(at(left, m["a"]).alias("left"), at(right, m["b"]).alias("right")))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def decoded(results: DataFrame, column: str = "result") -> DataFrame:
    """``results`` with ``matched``: an array of struct(left, right), the places of both images; null if no encoding fits.

    Direct pairs come first, as far as both sides go. Then, for either name of key points: ``matches`` (pairs of indices),
    ``matches0`` (of each left place the right one's index, or -1), ``matches1`` (the same from the right). An encoding
    whose pairs are all out of range or not finite is passed over, and so is a text that is no JSON. Each array is read
    once, in a step of its own.
    """
    value = F.try_parse_json(F.col(column)) if results.schema[column].dataType.simpleString() == "string" else F.col(column)
    places = {f"_{n}": _array(F.col("_variant"), n, PLACE) for pair in (*DIRECT, *KEY_POINTS) for n in pair}
    indices = {f"_{n}": _array(F.col("_variant"), n, k) for n, k in (("matches", "array<bigint>"), ("matches0", "bigint"), ("matches1", "bigint"))}
    read = results.withColumn("_variant", value).withColumns(places | indices)
    tries = {f"_try{i}": _sound(_zipped(F.col(f"_{a}"), F.col(f"_{b}"))) for i, (a, b) in enumerate(DIRECT)}
    both = F.transform(F.filter("_matches", lambda m: F.size(m) == 2), lambda m: _pair(m[0], m[1]))
    for a, b in KEY_POINTS:
        left, right = F.col(f"_{a}"), F.col(f"_{b}")
        on = F.transform(F.slice("_matches0", F.lit(1), F.size(left)), lambda m, i: _pair(i, m))
        back = F.transform(F.slice("_matches1", F.lit(1), F.size(right)), lambda m, i: _pair(m, i))
        tries |= {f"_try{len(tries) + k}": _sound(_taken(left, right, i)) for k, i in enumerate((both, on, back))}
    return read.withColumns(tries).withColumn("matched", F.coalesce(*tries)).select(*results.columns, "matched")


def match_rows(found: DataFrame, *keys: str) -> DataFrame:
    """A row per match: keys, nth, sim_x, sim_y (left), real_x, real_y (right)."""
    # an inner explode would have its condition worked out by the whole decoder once more
    each = found.select(*keys, F.posexplode_outer("matched").alias("nth", "_m")).filter("_m is not null")
    place = {"sim_x": ("left", 0), "sim_y": ("left", 1), "real_x": ("right", 0), "real_y": ("right", 1)}
    return each.select(*keys, "nth", *(F.col("_m")[side][i].cast("double").alias(c) for c, (side, i) in place.items()))
