"""Tracks: the positions of one grid node over the frames of a sequence, and their temporal filter.

A track is fitted by a polynomial in time, clipped by its residuals for a few rounds, and its gaps are filled. For the
clip a track is one row with an array of its cells, at most one a frame, so no row grows with the number of tracks; all
else is windows over tracks.

Longitudes are unwrapped within each round over the rows that the round fits. The fit uses orthogonal polynomials by
three-term recursion (Forsythe 1957), so that there is no matrix to solve.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumitrack.functions.geo import haversine_km, wrap_degrees
from lumitrack.functions.names import parse_source_key
from lumitrack.functions.numbers import finite, normalised_time
from lumitrack.operators.clipping import clip_batches
from lumitrack.plans.shared import kept


def by_track():
    return Window.partitionBy("track_key")


def in_time():
    return by_track().orderBy("frame_index")


def before():
    return in_time().rowsBetween(Window.unboundedPreceding, -1)


def so_far():
    return in_time().rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class FilterConfig:
    """How tracks are filtered; the defaults are those of a whole pipeline run."""

    order: int = 3
    mode: str = "sigma"  # or "absolute" or "hybrid"
    sigma: float = 3.0
    absolute_km: float = 80.0
    min_threshold_km: float = 0.0
    min_points: int = 6
    min_coverage: float = 0.20
    max_gap: int = 8  # -1: any
    extrapolate: bool = False
    rounds: int = 4
    temporal: bool = True  # False: finite rows are kept, nothing is fitted or imputed
    fill_missing: bool = True
    pre_spatial_fit: bool = False  # only rows with pre_spatial_ok start a fit


def first_finite(observations: DataFrame) -> DataFrame:
    """One row per track and frame: the first with a finite position, else the first."""
    order = Window.partitionBy("track_key", "frame_index").orderBy(F.when(finite(F.col("mapX"), F.col("mapY")), 0).otherwise(1), "row_index")
    return observations.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def first_rows(observations: DataFrame) -> DataFrame:
    """The first row per track and frame, finite or not, with the track's own first row index as ``template_row``."""
    order = Window.partitionBy("track_key", "frame_index").orderBy("row_index")
    first = observations.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
    return first.withColumn("template_row", F.first("row_index").over(by_track().orderBy("frame_index", "row_index")))


def dense_index(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Indices without gaps by file name, and the count; per ``sequence`` if that column is there.

    Without it, sorted files are numbered within their partitions, and what the partitions before hold is added, so that
    no task gets all files.
    """
    if "sequence" in files.columns:
        order, n = Window.partitionBy("sequence").orderBy(name), F.count(F.lit(1)).over(Window.partitionBy("sequence")).cast("int")
        return files.withColumns({"frame_index": F.row_number().over(order) - 1, "n_frames": n})
    numbered = kept(files.orderBy(name).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    before, total = {}, 0
    for r in sorted(counts):
        before[r["_part"]], total = total, total + r["n"]
    offsets = files.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    own = F.col("_id") - F.shiftleft(part, 33)
    indexed = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return indexed.select(*files.columns, (own + F.col("_before")).cast("int").alias("frame_index"), F.lit(total).cast("int").alias("n_frames"))


def scaffold(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """Every track at every frame. The frames are a sequence's few thousand at most, so they go to all tasks as one array."""
    tracks = observations.select("track_key").distinct()
    every = frames.agg(F.sort_array(F.collect_set("frame_index")).alias("_frames"))
    return tracks.crossJoin(F.broadcast(every)).select("track_key", F.explode("_frames").alias("frame_index"))


def dense_tracks(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """The scaffold with the first finite observation of each cell, ``finite_geo``, and time ``t`` on [-1, 1].

    ``pre_spatial_ok`` is the observations' own, or true where they have none; false where there is no observation.
    """
    near = F.col("pre_spatial_ok") if "pre_spatial_ok" in observations.columns else F.lit(True)
    first = first_finite(observations).select("track_key", "frame_index", "row_index", "mapX", "mapY", near.alias("pre_spatial_ok"), F.lit(True).alias("_seen"))
    cells = scaffold(observations, frames).join(first, ["track_key", "frame_index"], "left")
    n = F.count(F.lit(1)).over(by_track())
    return cells.withColumns({
        "observed": F.coalesce("_seen", F.lit(False)),
        "pre_spatial_ok": F.coalesce("pre_spatial_ok", F.lit(False)),
        "finite_geo": finite(F.col("mapX"), F.col("mapY")),
        "n_frames": n,
        "t": normalised_time(F.row_number().over(in_time()) - 1, n),
    }).drop("_seen")


def unwrapped(longitude: Column, used: Column) -> Column:
    """Longitudes of the used rows of a track without jumps, in the order of frames; null elsewhere."""
    earlier = F.last(F.when(used, longitude), ignorenulls=True).over(before())
    step = longitude - earlier
    turn = F.when(used & earlier.isNotNull(), wrap_degrees(step) - step).otherwise(F.lit(0.0))
    return F.when(used, longitude + F.sum(turn).over(so_far()))


def polynomial_fit(rows: DataFrame, used: str, order: int) -> DataFrame:
    """Adds pred_x and pred_y at every frame: least squares over the rows ``used``, of degree order or n - 1 if less.

    pred_x is an unwrapped longitude.
    """
    m = F.col(used)
    total = lambda c: F.sum(F.when(m, c)).over(by_track())
    now = rows.withColumn("_u", unwrapped(F.col("mapX"), m)).withColumns({"_n": total(F.lit(1.0)), "_p0": F.lit(1.0)})
    now = now.withColumns({"pred_x": total(F.col("_u")) / F.col("_n"), "pred_y": total(F.col("mapY")) / F.col("_n")})
    for k in range(1, order + 1):
        p, q = F.col(f"_p{k - 1}"), F.col(f"_p{k - 2}") if k > 1 else None
        now = now.withColumns({"_s": total(p * p), "_a": total(F.col("t") * p * p)} | ({"_r": total(q * q)} if k > 1 else {}))
        next_p = (F.col("t") - F.try_divide("_a", "_s")) * p
        if k > 1:
            next_p = next_p - F.try_divide("_s", "_r") * q
        now = now.withColumn(f"_p{k}", next_p)
        pk, enough = F.col(f"_p{k}"), F.col("_n") > k
        now = now.withColumns({"_s": total(pk * pk), "_cx": total(F.col("_u") * pk), "_cy": total(F.col("mapY") * pk)})
        now = now.withColumns({
            "pred_x": F.col("pred_x") + F.when(enough, F.try_divide("_cx", "_s") * pk).otherwise(F.lit(0.0)),
            "pred_y": F.col("pred_y") + F.when(enough, F.try_divide("_cy", "_s") * pk).otherwise(F.lit(0.0)),
        })
    return now.drop("_u", "_s", "_a", "_r", "_cx", "_cy", "_n", *(f"_p{k}" for k in range(order + 1)))


def sigma_clip(dense: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Adds to dense tracks: pred_x, pred_y, residual_km, fit_used, temporal_outlier, and, of the track's last fit,
    threshold_km (infinite without residuals), residual_mean_km, residual_std_km, fit_degree and can_fit.

    A track is one row for it. Tracks with too few points aren't fitted: nothing is used, and the degree is -1.
    """
    start = F.col("finite_geo") & F.col("pre_spatial_ok") if config.pre_spatial_fit else F.col("finite_geo")
    cells = F.struct("frame_index", *(c for c in dense.columns if c not in ("track_key", "frame_index")), start.alias("_start"))
    packed = dense.groupBy("track_key").agg(F.array_sort(F.collect_list(cells)).alias("_cells"))
    lists = {"_t": "t", "_x": "mapX", "_y": "mapY", "_start": "_start"}
    packed = packed.select("track_key", "_cells", *(F.col(f"_cells.{c}").alias(n) for n, c in lists.items()))
    kind = packed.schema["_cells"].dataType.simpleString()
    schema = f"track_key string, _cells {kind}, _px array<double>, _py array<double>, _r array<double>, _used array<boolean>, threshold_km double, residual_mean_km double, residual_std_km double, fit_degree int"
    done = packed.mapInArrow(clip_batches(config), schema).withColumn("_z", F.explode(F.arrays_zip("_cells", "_px", "_py", "_r", "_used")))
    own = [F.col(f"_z._cells.{c}").alias(c) for c in dense.columns if c != "track_key"]
    rows = done.select("track_key", *own, F.col("_z._px").alias("pred_x"), F.col("_z._py").alias("pred_y"), F.col("_z._r").alias("residual_km"), F.col("_z._used").alias("fit_used"), "threshold_km", "residual_mean_km", "residual_std_km", "fit_degree")
    return rows.withColumns({"can_fit": F.col("fit_degree") >= 1, "temporal_outlier": F.coalesce(F.col("finite_geo") & (F.col("residual_km") > F.col("threshold_km")), F.lit(False))})


def gap_fill(rows: DataFrame, missing: Column, anchor: Column, max_gap: int, extrapolate: bool = False, out: str = "gap_filled") -> DataFrame:
    """Marks the missing rows of each run of at most ``max_gap`` (-1: any) between two anchors; or beside one, if wanted."""
    marked = rows.withColumns({"_missing": missing, "_anchor": anchor})
    kind = Window.partitionBy("track_key", "_missing").orderBy("frame_index")
    run = F.row_number().over(in_time()) - F.row_number().over(kind)
    marked = marked.withColumn("_run", run)
    marked = marked.withColumns({"_left": F.coalesce(F.lag("_anchor").over(in_time()), F.lit(False)), "_right": F.coalesce(F.lead("_anchor").over(in_time()), F.lit(False))})
    one = Window.partitionBy("track_key", "_missing", "_run")
    ends = one.orderBy("frame_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left, right = F.first("_left").over(ends), F.last("_right").over(ends)
    held = (left | right) if extrapolate else (left & right)
    short = F.lit(True) if max_gap < 0 else F.count(F.lit(1)).over(one) <= max_gap
    return marked.withColumn(out, F.col("_missing") & short & held).drop("_missing", "_anchor", "_run", "_left", "_right")


def filtered_tracks(observations: DataFrame, frames: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Dense tracks with everything that the filter decides: sigma_clip's columns, gap_filled, can_impute, imputed, kept."""
    dense = dense_tracks(observations, frames)
    if not config.temporal:
        no = {c: F.lit(None).cast("double") for c in ("pred_x", "pred_y", "residual_km", "threshold_km", "residual_mean_km", "residual_std_km")}
        never = {c: F.lit(False) for c in ("can_fit", "temporal_outlier", "can_impute", "gap_filled", "imputed")}
        return dense.withColumns(no | never | {"fit_degree": F.lit(-1), "fit_used": F.col("finite_geo"), "kept": F.col("finite_geo")})
    rows = sigma_clip(dense, config)
    n_fit, n_fin = F.sum(F.col("fit_used").cast("int")).over(by_track()), F.sum(F.col("finite_geo").cast("int")).over(by_track())
    rows = rows.withColumn("can_impute", F.col("can_fit") & (n_fit >= config.min_points) & (n_fin / F.col("n_frames") >= config.min_coverage))
    rows = gap_fill(rows, ~F.col("finite_geo") & F.lit(config.fill_missing), F.col("fit_used"), config.max_gap, config.extrapolate)
    imputed = F.col("can_impute") & (F.col("temporal_outlier") | F.col("gap_filled"))
    return rows.withColumns({"imputed": imputed, "kept": F.col("fit_used") & ~imputed})


#: What a written point has instead of a column that wasn't read.
DEFAULTS = {"enable": 1, "dX": 0.0, "dY": 0.0, "residual": 0.0}
#: Columns of observations that a written point works out itself.
WORKED_OUT = {"track_key", "frame_index", "row_index", "mapX", "mapY", "sourceX", "sourceY", "pre_spatial_ok", *DEFAULTS}


def outputs(filtered: DataFrame, observations: DataFrame) -> DataFrame:
    """The points to write: kept ones as they were read, imputed ones at the fitted place.

    A kept cell writes its first row even where a later one was the finite one, with the row's own enable, dX, dY, residual
    and other columns. An imputed cell takes its source position from the track's first row, other columns from its own
    row, or the track's first one where it has none, and is enabled. ``row_ordinal`` is the order within the frame: from
    below, then from the left.
    """
    read = [c for c in ("mapX", "mapY", "sourceX", "sourceY", *(c for c in DEFAULTS if c in observations.columns)) if c in observations.columns]
    rest = [c for c in observations.columns if c not in WORKED_OUT]
    own = F.struct(*read, *rest)
    cells = first_rows(observations).select("track_key", "frame_index", own.alias("_own"))
    template = observations.groupBy("track_key").agg(F.min_by(own, F.struct("frame_index", "row_index")).alias("_head"))
    rows = filtered.filter("kept or imputed").join(cells, ["track_key", "frame_index"], "left").join(template, "track_key")
    place = lambda made, read: F.when(F.col("imputed"), made).otherwise(read)
    marks = [place(F.lit(v), F.col(f"_own.{c}") if c in read else F.lit(v)).alias(c) for c, v in DEFAULTS.items()]
    carried = [F.when(F.col("_own").isNotNull(), F.col("_own")[c]).otherwise(F.col("_head")[c]).alias(c) for c in rest]
    rows = rows.select(
        "frame_index", "track_key", F.when(F.col("imputed"), F.lit("imputed")).otherwise("kept").alias("temporal_status"),
        place(wrap_degrees(F.col("pred_x")), F.col("_own.mapX")).alias("mapX"), place(F.col("pred_y"), F.col("_own.mapY")).alias("mapY"),
        place(F.col("_head.sourceX"), F.col("_own.sourceX")).alias("sourceX"), place(F.col("_head.sourceY"), F.col("_own.sourceY")).alias("sourceY"),
        *marks, F.col("residual_km").alias("temporal_residual_km"), F.when(F.col("threshold_km") < float("inf"), F.col("threshold_km")).alias("temporal_threshold_km"), *carried,
    )
    order = Window.partitionBy("frame_index").orderBy(-F.col("sourceY"), "sourceX", "track_key")
    return rows.withColumn("row_ordinal", F.row_number().over(order) - 1)


def frame_qc(filtered: DataFrame, observations: DataFrame, written: DataFrame, final: DataFrame, frames: DataFrame) -> DataFrame:
    """Per frame: rows read, those with a neighbour as they were read (all where that isn't known), outliers, imputed,
    written, and left by the spatial filter (``final``). Empty frames count 0."""
    near = F.col("pre_spatial_ok") if "pre_spatial_ok" in observations.columns else F.lit(True)
    read = observations.groupBy("frame_index").agg(F.count(F.lit(1)).alias("input_count"), F.count_if(near).alias("pre_spatial_kept_diagnostic"))
    each = lambda df, name: df.groupBy("frame_index").agg(F.count(F.lit(1)).alias(name))
    marks = filtered.groupBy("frame_index").agg(F.count_if("temporal_outlier").alias("temporal_outliers"), F.count_if("imputed").alias("imputed"))
    out = frames.select("frame_index").distinct()
    for part in (read, marks, each(written, "output_before_post_spatial"), each(final, "post_spatial_kept")):
        out = out.join(part, "frame_index", "left")
    counts = ["input_count", "pre_spatial_kept_diagnostic", "temporal_outliers", "imputed", "output_before_post_spatial", "post_spatial_kept"]
    out = out.select("frame_index", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))
    return out.withColumn("post_spatial_rejected", F.col("output_before_post_spatial") - F.col("post_spatial_kept"))


def track_qc(filtered: DataFrame, observations: DataFrame) -> DataFrame:
    """Per track: its source place (of its first row), counts, degree, threshold, mean and deviation of the residuals that the last fit used, the root mean
    square over the rows used, and the maximum over all finite ones. Observed are finite positions only."""
    r, first = F.col("residual_km"), lambda c: F.max(c).alias(c)  # noqa: E731  one value a track
    used = F.when(F.col("fit_used"), r)
    head = F.min_by(F.struct("sourceX", "sourceY"), F.struct("frame_index", "row_index"))
    places = observations.groupBy("track_key").agg(head.alias("_head")).select("track_key", "_head.sourceX", "_head.sourceY")
    counted = filtered.groupBy("track_key").agg(
        F.count_if("finite_geo").alias("n_observed"), F.count_if("finite_geo").alias("n_finite"), F.count_if("pre_spatial_ok").alias("n_pre_spatial_ok_diagnostic"), F.count_if("fit_used").alias("n_fit_used"),
        F.count_if("temporal_outlier").alias("n_temporal_outliers"), F.count_if("imputed").alias("n_imputed"), F.count_if(F.col("kept") | F.col("imputed")).alias("n_output"),
        F.bool_or("can_impute").alias("can_impute"), first("fit_degree"),
        F.max(F.when(F.col("threshold_km") < float("inf"), F.col("threshold_km"))).alias("threshold_km"),
        first("residual_mean_km"), first("residual_std_km"), F.sqrt(F.avg(used * used)).alias("rmse_km"), F.max(r).alias("max_residual_km"),
    )
    return places.join(counted, "track_key")


def linear_fit(dense: DataFrame) -> DataFrame:
    """Slopes and intercepts of both coordinates over time, per track, over its finite rows: two built-in aggregates."""
    x, y, t = F.when(F.col("finite_geo"), unwrapped(F.col("mapX"), F.col("finite_geo"))), F.when(F.col("finite_geo"), F.col("mapY")), F.col("t")
    flat = dense.withColumns({"_x": x, "_y": y})
    return flat.groupBy("track_key").agg(F.count("_x").alias("n"), *(f("_" + c, t).alias(f"{name}_{c}") for c in "xy" for name, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))))


def diagnostic_tracks(tracks: DataFrame, min_observed: int = 1, inset: float = 0.15) -> DataFrame:
    """Up to five tracks to look at: the nearest to each inset corner and the centre of the grid, none twice.

    ``tracks``: track_key, sx, sy (downwards), n_observed. If none has enough observations, all that have any count. Each
    pick is a sum over the tracks, without those picked before.
    """
    rich = tracks.filter(F.col("n_observed") >= min_observed)
    pool = tracks.filter("n_observed > 0") if rich.isEmpty() else rich
    b = pool.agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1")).first()
    schema = "target string, track_key string"
    if b["x0"] is None:
        return tracks.sparkSession.createDataFrame([], schema)
    part = min(max(inset, 0.0), 0.49)
    at = lambda low, high, share: low + share * (high - low)
    # labels are fixed values
    aims = {"top_left_inner": (part, part), "top_right_inner": (1 - part, part), "center": (0.5, 0.5), "bottom_left_inner": (part, 1 - part), "bottom_right_inner": (1 - part, 1 - part)}
    picked: list[tuple[str, str]] = []
    for name, (u, v) in aims.items():
        x, y = at(b["x0"], b["x1"], u), at(b["y0"], b["y1"], v)
        distance = (F.col("sx") - x) * (F.col("sx") - x) + (F.col("sy") - y) * (F.col("sy") - y)
        nearest = pool.filter(~F.col("track_key").isin([k for _, k in picked])).agg(F.min(F.struct(distance.alias("d"), "track_key")).alias("m")).first()["m"]
        if nearest is None:
            break
        picked.append((name, nearest["track_key"]))
    return tracks.sparkSession.createDataFrame(picked, schema)


def places_of_keys(keys: DataFrame, tracks: DataFrame) -> DataFrame:
    """``keys`` (track_key, ...) with x and y, counted downwards: the track's own source place (track_key, sourceX, sourceY, one
    row a track), else the one that the key itself says. Keys that say none drop out."""
    own = tracks.select("track_key", F.col("sourceX").alias("_sx"), F.col("sourceY").alias("_sy"), F.lit(True).alias("_known"))
    said = parse_source_key(F.col("track_key"))
    place = lambda own, key: F.when(F.col("_known"), F.col(own)).otherwise(said[key])
    met = keys.join(own, "track_key", "left").withColumns({"x": place("_sx", "x"), "y": -place("_sy", "y")})
    return met.filter(F.coalesce("_known", F.lit(False)) | (F.col("x").isNotNull() & F.col("y").isNotNull())).drop("_sx", "_sy", "_known")


def point_status(final: DataFrame, corrected: DataFrame, read: DataFrame) -> DataFrame:
    """Per key of any of the three sets (frame_index, track_key): where it is found, and its colour in diagnostics."""
    keys = ["frame_index", "track_key"]
    flags = {"_f": final, "_c": corrected, "_r": read}
    each = [df.select(*keys, *(F.lit(n == name).alias(n) for n in flags)) for name, df in flags.items()]
    every = each[0].unionAll(each[1]).unionAll(each[2]).groupBy(*keys).agg(*(F.bool_or(n).alias(n) for n in flags))
    f, c = F.col("_f"), F.col("_c")
    colour = F.when(f & ~c, "blue").when(f & c, "green").when(c, "orange").otherwise("red")
    return every.select(*keys, f.alias("is_final"), c.alias("is_corrected"), F.col("_r").alias("is_read"), colour.alias("colour"))
