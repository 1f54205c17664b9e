"""Joins that equality alone doesn't say: nearest in time, within a radius, by ordinal, by name prefix, by preference."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumitrack.functions.geo import MEAN_RADIUS_KM, haversine_km
from lumitrack.functions.numbers import finite
from lumitrack.plans.shared import SMALL_ROWS, kept


def nearest_in_time(probes: DataFrame, states: DataFrame, time: str, epoch: str, order: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Each probe with the state nearest in time, before or after; of equally near ones that of the least ``order``.

    A scan with carry: both sides are dealt together by ranges of key and time, each part (of a key) says which its first
    and last states are, a prefix over the parts tells each what lies before and after it, and every part is finished by
    itself. So one key, or all of it without ``by``, takes as many tasks as there are ``parts`` (as many as a shuffle has,
    unless given), and no pairs are made. Rows are shuffled twice and written once; the prefix is a row per part and key.
    """
    by = by or []
    states = states.groupBy(*by, epoch).agg(F.min(order).alias(order))  # of states at one time, the first
    keyed = probes.withColumns({"_at": F.col(time), "_probe": F.lit(1)})
    held = states.select(*by, F.col(epoch).alias("_at"), F.lit(0).alias("_probe"), F.struct(F.col(epoch).alias("at"), F.col(order).alias("id")).alias("_state"))
    stream = keyed.unionByName(held, allowMissingColumns=True)
    n = parts or int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(stream.repartitionByRange(n, *by, "_at", "_probe").withColumn("_part", F.spark_partition_id()), "stream")
    ends = dealt.groupBy(*by, "_part").agg(F.min("_state").alias("_first"), F.max("_state").alias("_last"))
    over = Window.partitionBy(*by).orderBy("_part")
    before = F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_first", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    lent = ends.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_of"), before.alias("_before"), after.alias("_after"))
    inside = Window.partitionBy("_part", *by)
    back = F.last("_state", ignorenulls=True).over(inside.orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0))
    # what follows is what came before in falling order: a frame that ends at its row is carried on, one that begins there is scanned anew for each row
    on = F.last("_state", ignorenulls=True).over(inside.orderBy(F.desc("_at"), "_probe").rowsBetween(Window.unboundedPreceding, 0))
    lent = lent if by else F.broadcast(lent)  # a row a part
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_of"))
    # a part goes to the task of its number: by a hash of so few numbers, several would meet in one task
    seen = dealt.repartitionById(n, "_part").withColumns({"_back": back, "_on": on}).filter("_probe = 1").join(lent, same)
    apart = lambda s: F.when(s.isNotNull(), F.struct(F.abs(_micros(F.col("_at")) - _micros(s["at"])).alias("micros"), s["id"].alias("id"), s["at"].alias("at")))
    best = F.array_min(F.array_compact(F.array(apart(F.coalesce("_back", "_before")), apart(F.coalesce("_on", "_after")))))
    found = seen.withColumn("_best", best)
    return found.select(*probes.columns, F.col("_best.id").alias(f"nearest_{order}"), F.col("_best.at").alias(f"nearest_{epoch}"), (F.col("_best.micros") / F.lit(1e6)).alias("seconds_apart"))


def element_per_minute(times: DataFrame, elements: DataFrame, time: str, epoch: str, order: str) -> DataFrame:
    """``times`` with ``minute`` and the element set nearest to its beginning: all times of a minute go by one set.

    Rows without a time stay and have none; elements without an epoch are near nothing.
    """
    each = times.withColumn("minute", F.date_trunc("minute", F.col(time)))
    minutes = each.select("minute").filter("minute is not null").distinct()
    chosen = nearest_in_time(minutes, elements.filter(F.col(epoch).isNotNull()), "minute", epoch, order)
    return each.join(chosen, "minute", "left")


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def has_neighbour(points: DataFrame, radius_km: float, group: list[str], key: str, lon: str = "mapX", lat: str = "mapY", out: str = "has_neighbour") -> DataFrame:
    """Marks points with another one of their group within the radius (inclusive). Points at one place are neighbours.

    Each place is one row, written once; copies are counted. On the unit sphere the radius is a chord and cells are cubes, so
    poles and the date line are like any other place. Places in one cube whose diagonal is shorter than the chord are
    neighbours without a distance. A place alone in its cube asks in the wider cubes that its chord reaches, eight at most,
    and every place passes those that ask in its own: no more than a wider cube has small ones, so that pairs grow with the
    places and no task gathers a cube's places. Only up to SMALL_ROWS places without a neighbour are sent to all tasks.
    Points that aren't finite have no neighbours. ``key`` names a point.
    """
    chord = 2.0 * math.sin(min(radius_km / (2.0 * MEAN_RADIUS_KM), math.pi / 2))
    inner, reach = (chord * 0.9999 - 1e-12) / math.sqrt(3.0), chord * 1.0001 + 1e-11  # beyond what rounding can do
    there = finite(F.col(lon), F.col(lat))
    usable = points.filter(there).select(*group, key, F.col(lon).alias("_x"), F.col(lat).alias("_y"))
    places = kept(usable.groupBy(*group, "_x", "_y").agg(F.count(F.lit(1)).alias("_n")), "places")
    x, y = F.radians("_x"), F.radians("_y")
    axes = {"_i": F.cos(y) * F.cos(x), "_j": F.cos(y) * F.sin(x), "_k": F.sin(y)}
    cubes = lambda side: {n: F.floor(c / F.lit(side)) for n, c in axes.items()}
    small = cubes(inner) if inner > 0 else {"_i": F.col("_x"), "_j": F.col("_y"), "_k": F.lit(0)}
    alone = places.withColumns(small).groupBy(*group, *axes).agg(F.sum("_n").alias("_n"), F.min("_x").alias("_x"), F.min("_y").alias("_y")).filter("_n = 1").select(*group, "_x", "_y")
    asking = alone
    for n, c in axes.items():
        asking = asking.withColumn(n, F.explode(F.sequence(*(F.floor((c + F.lit(by)) / F.lit(2.0 * reach)) for by in (-reach, reach)))))
    asking = asking.withColumnsRenamed({"_x": "_x1", "_y": "_y1"})
    apart = (F.col("_x") != F.col("_x1")) | (F.col("_y") != F.col("_y1"))
    near = haversine_km(F.col("_y1"), F.col("_x1"), F.col("_y"), F.col("_x")) <= F.lit(radius_km)
    # a plan that reckons by the size of files doesn't see that rows are repeated and would send them to all tasks
    met = places.withColumns(cubes(2.0 * reach)).join(asking.hint("merge"), [*group, *axes]).filter(apart & near).select(*group, F.col("_x1").alias("_x"), F.col("_y1").alias("_y")).distinct()
    lone = kept(alone.join(met.hint("merge"), [*group, "_x", "_y"], "left_anti").select(*group, F.col("_x").alias(lon), F.col("_y").alias(lat), F.lit(True).alias("_lone")), "lone")
    lone = F.broadcast(lone) if lone.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else lone.hint("merge")
    whole = reduce(lambda a, b: a & b, (F.col(g).isNotNull() for g in group), there)
    return points.join(lone, [*group, lon, lat], "left").withColumn(out, whole & F.col("_lone").isNull()).drop("_lone")


def by_ordinal(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], by: list[str]) -> DataFrame:
    """Pairs the nth row of either side within a group, as far as both go."""
    nth = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return left.withColumn("ordinal", nth(left_order)).join(right.withColumn("ordinal", nth(right_order)), [*by, "ordinal"])


def by_name_or_prefix(names: DataFrame, name: str, files: DataFrame, file: str, prefix_length: int) -> DataFrame:
    """Each name with the file of that name, else the first (sorted) that begins with it; ``name`` has prefix_length characters or more.

    The first characters are an equality key, so that only files which share them are compared.
    """
    exact = files.select(F.col(file).alias("_exact")).distinct()
    heads = files.select(F.col(file).alias("_file"), F.substring(file, 1, prefix_length).alias("_head"))
    keyed = names.withColumn("_head", F.substring(name, 1, prefix_length))
    wanted = keyed.select(name, "_head").distinct()
    first = wanted.join(heads, "_head").filter(F.col("_file").startswith(F.col(name))).groupBy(name).agg(F.min("_file").alias("_prefixed"))
    found = names.join(exact, names[name] == F.col("_exact"), "left").join(first, name, "left")
    return found.withColumn("found", F.coalesce("_exact", "_prefixed")).drop("_exact", "_prefixed")


def preferred(frames: DataFrame, key: str, choices: list[tuple[str, DataFrame]], needed: DataFrame | None = None) -> DataFrame:
    """Each frame with the first of the choices (name, table with the key) that has it, and a status."""
    out = frames
    for i, (_, table) in enumerate(choices):
        out = out.join(table.select(key).distinct().withColumn(f"_has{i}", F.lit(True)), key, "left")
    chosen = F.coalesce(*(F.when(F.col(f"_has{i}"), F.lit(name)) for i, (name, _) in enumerate(choices)))
    status = F.when(chosen.isNull(), "missing points").otherwise("ok")
    if needed is not None:
        out = out.join(needed.select(key).distinct().withColumn("_needed", F.lit(True)), key, "left")
        status = F.when(F.col("_needed").isNull(), "missing image").otherwise(status)
    return out.withColumns({"chosen": chosen, "status": status}).drop(*(f"_has{i}" for i in range(len(choices))), "_needed")


def unfinished(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def gathered(matches: DataFrame, keypoints: DataFrame, image: str, index: str, prefix: str) -> DataFrame:
    """Matches with the keypoint that their index names in an image; indices out of range drop out."""
    points = keypoints.select(F.col("image").alias(image), F.col("nth").alias(index), F.col("x").alias(f"{prefix}_x"), F.col("y").alias(f"{prefix}_y"))
    return matches.join(points, [image, index])
