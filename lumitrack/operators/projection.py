"""From pixels to the ground: camera axes, rays, their meeting with the sphere, time grids and orbit states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumitrack.functions.geo import added, bearing_degrees, cross, dot, local_axes, point, scaled, to_geographic, to_xyz, unit


def field_of_view(focal: Column, sensor: Column) -> Column:
    """The angle in degrees that a sensor side sees."""
    return F.degrees(F.lit(2.0) * F.atan(sensor / (F.lit(2.0) * focal)))


def ahead_of(lat: Column, lon: Column, velocity: Column | None = None) -> Column:
    """The horizontal unit vector that pitch tips towards: north, or a velocity made tangent (north if that vanishes)."""
    axes = local_axes(lat, lon)
    if velocity is None:
        return axes["north"]
    flat = added(velocity, scaled(axes["up"], -dot(velocity, axes["up"])))
    return F.when(F.sqrt(dot(flat, flat)) < 1e-6, axes["north"]).otherwise(unit(flat))


def with_rays(pixels: DataFrame, out: str = "_ray") -> DataFrame:
    """``pixels`` with the unit direction through each pixel's centre.

    pixels: px, py (from below), width, height, fov_x (degrees across the width), yaw, pitch, roll, and the unit vectors
    _up, _ahead and _east. The camera looks down, tipped by pitch towards _ahead, then turned about _up by yaw and about
    its own view by roll. All turns are worked out in the frame (up, ahead, side), where they are plane rotations; looking
    straight down, east stands for the image's upward direction.
    """
    side = cross(F.col("_ahead"), F.col("_up"))
    x = pixels.withColumn("_side", side).withColumns({
        "_c": F.cos(F.radians("pitch")), "_s": F.sin(F.radians("pitch")), "_cy": F.cos(F.radians("yaw")), "_sy": F.sin(F.radians("yaw")), "_cr": F.cos(F.radians("roll")), "_sr": F.sin(F.radians("roll")),
        "_half": F.tan(F.radians("fov_x") / F.lit(2.0)), "_ea": dot(F.col("_east"), F.col("_ahead")), "_es": dot(F.col("_east"), F.col("_side")),
    })
    across = ((F.col("px") + 0.5) / F.col("width") * 2.0 - 1.0) * F.col("_half")
    upwards = ((F.col("py") + 0.5) / F.col("height") * 2.0 - 1.0) * F.col("_half") / (F.col("width") / F.col("height"))
    x = x.withColumns({"_x": across, "_y": upwards})
    # what the image's upward and rightward directions count for, once rolled
    x = x.withColumns({"_a": F.col("_y") * F.col("_cr") - F.col("_x") * F.col("_sr"), "_b": F.col("_x") * F.col("_cr") + F.col("_y") * F.col("_sr")})
    down, sign = F.abs("_s") < 1e-6, F.signum("_s")
    x = x.withColumns({
        "_du": F.when(down, -F.col("_c")).otherwise(F.col("_a") * sign * F.col("_s") - F.col("_c")),
        "_da": F.when(down, F.col("_a") * F.col("_ea") - F.col("_b") * F.col("_es")).otherwise(F.col("_s") + F.col("_a") * sign * F.col("_c")),
        "_ds": F.when(down, F.col("_a") * F.col("_es") + F.col("_b") * F.col("_ea")).otherwise(F.col("_b") * sign),
    })
    x = x.withColumns({"_fa": F.col("_da") * F.col("_cy") + F.col("_ds") * F.col("_sy"), "_fs": F.col("_ds") * F.col("_cy") - F.col("_da") * F.col("_sy")})
    x = x.withColumn("_long", F.sqrt(F.col("_du") * F.col("_du") + F.col("_fa") * F.col("_fa") + F.col("_fs") * F.col("_fs")))
    mixed = lambda c: (F.col("_du") * F.col("_up")[c] + F.col("_fa") * F.col("_ahead")[c] + F.col("_fs") * F.col("_side")[c]) / F.col("_long")
    x = x.withColumn(out, point(mixed("x"), mixed("y"), mixed("z")))
    return x.drop("_side", "_c", "_s", "_cy", "_sy", "_cr", "_sr", "_half", "_ea", "_es", "_x", "_y", "_a", "_b", "_du", "_da", "_ds", "_fa", "_fs", "_long")


def on_sphere(origin: Column, direction: Column, radius: float) -> Column:
    """The nearer point where a line meets the sphere, or null; also behind the origin."""
    b, c = dot(origin, direction), dot(origin, origin) - F.lit(radius * radius)
    inside = b * b - c
    return F.when(inside >= 0, added(origin, scaled(direction, -b - F.sqrt(inside))))


def projected(pixels: DataFrame, radius: float = 10.0, heading: bool = False) -> DataFrame:
    """``pixels`` with lat and lon on the ground, null where a ray misses.

    pixels: px, py (from below), width, height, fov_x, cam_lat, cam_lon, cam_alt_km, yaw, pitch, roll (and hx, hy, hz with
    heading). The steps are kept in columns, so that each is worked out once a row.
    """
    at = (F.col("cam_lat"), F.col("cam_lon"))
    velocity = point(F.col("hx"), F.col("hy"), F.col("hz")) if heading else None
    axes = local_axes(*at)
    x = pixels.withColumns({"_up": axes["up"], "_east": axes["east"], "_ahead": ahead_of(*at, velocity), "_o": to_xyz(*at, F.col("cam_alt_km"), radius)})
    x = with_rays(x, "_d")
    x = x.withColumns({"_od": dot(F.col("_o"), F.col("_d")), "_oo": dot(F.col("_o"), F.col("_o")) - F.lit(radius * radius)})
    x = x.withColumn("_in", F.col("_od") * F.col("_od") - F.col("_oo")).withColumn("_t", F.when(F.col("_in") >= 0, -F.col("_od") - F.sqrt("_in")))
    x = x.withColumns({f"_h{c}": F.col("_o")[c] + F.col("_d")[c] * F.col("_t") for c in "xyz"})
    hit = to_geographic(point(F.col("_hx"), F.col("_hy"), F.col("_hz")), radius)
    # a generator, as a filter on its result isn't rewritten in terms of all the steps, each used many times
    ground = F.inline(F.array(F.struct(hit["lat"].alias("lat"), hit["lon"].alias("lon"))))
    return x.select(*(c for c in pixels.columns if c not in ("lat", "lon")), ground)


def control_points(projected_pixels: DataFrame, source: str = "real") -> DataFrame:
    """Control points of hits: mapX, mapY, and the source pixel counted downwards as a negative row."""
    hit = projected_pixels.filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    x, y = (F.col(f"{source}_x"), F.col(f"{source}_y"))
    zero = lambda: F.lit(0.0)
    return hit.withColumns({"mapX": F.col("lon"), "mapY": F.col("lat"), "sourceX": x, "sourceY": -(F.col("height") - y), "enable": F.lit(1), "dX": zero(), "dY": zero(), "residual": zero()})


def velocities(states: DataFrame, by: list[str]) -> DataFrame:
    """Positions (t, x, y, z) with the velocity to the next state of the group; the last has none."""
    w = Window.partitionBy(*by).orderBy("t")
    dt = (F.unix_micros(F.lead("t").over(w).cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / F.lit(1e6)
    ahead = {f"v{c}": F.try_divide(F.lead(c).over(w) - F.col(c), dt) for c in "xyz"}
    return states.withColumns(ahead)


def heading_bearing(lat: Column, lon: Column, velocity: Column) -> Column:
    """The bearing of a velocity over the ground, in degrees."""
    axes = local_axes(lat, lon)
    return bearing_degrees(dot(velocity, axes["east"]), dot(velocity, axes["north"]))


def time_grid(spans: DataFrame, seconds: float) -> DataFrame:
    """Times every ``seconds`` that start anew with each minute, from ``start_ts`` to ``end_ts`` of each row, with ``minute``.

    Where a minute isn't a whole number of steps, the last step of a minute is shorter.
    """
    per_minute = F.sequence(F.lit(0), F.lit(int(-(-60.0 // seconds)) - 1))
    minutes = spans.withColumn("minute", F.explode(F.expr("sequence(cast(start_ts as timestamp), cast(end_ts as timestamp), interval 1 minute)")))
    steps = minutes.withColumn("step", F.explode(per_minute))
    micros = F.unix_micros("minute") + F.floor(F.col("step") * F.lit(seconds * 1e6) + F.lit(0.5)).cast("long")
    return steps.withColumn("t", F.timestamp_micros(micros)).filter(F.col("t") <= F.col("end_ts").cast("timestamp"))


def time_step(times: DataFrame, by: list[str], time: str) -> DataFrame:
    """Per group: (last - first) / (n - 1) in seconds; null unless there are two and they differ."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    span = (F.max(micros) - F.min(micros)) / F.lit(1e6)
    return times.groupBy(*by).agg(F.count(micros).alias("n"), F.when((F.count(micros) >= 2) & (span > 0), span / (F.count(micros) - 1)).alias("delta_seconds"))
