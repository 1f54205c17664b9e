"""The rounds of a track's temporal clip in numpy: one track, a row a frame, at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

EARTH_KM = 6371.0088


class Clipped(NamedTuple):
    pred_x: np.ndarray  # unwrapped
    pred_y: np.ndarray
    residual_km: np.ndarray
    fit_used: np.ndarray
    threshold_km: float
    mean_km: float
    std_km: float
    degree: int  # of the last fit; -1 without one


def wrapped(d: np.ndarray) -> np.ndarray:
    return d + 180.0 - 360.0 * np.floor((d + 180.0) / 360.0) - 180.0


def distance_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(wrapped(lon2 - lon1)) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(a, 0.0, 1.0)))


def fitted(t: np.ndarray, values: np.ndarray, used: np.ndarray, order: int) -> np.ndarray:
    """Least squares of the columns of ``values`` over the rows ``used``, at every t, by orthogonal polynomials."""
    p, q, last = np.ones_like(t), None, 0.0
    out = np.repeat(values.mean(axis=0, keepdims=True), len(t), axis=0)
    for k in range(1, min(order, int(used.sum()) - 1) + 1):
        s = float((p[used] ** 2).sum())
        if s == 0:
            break
        new = (t - float((t[used] * p[used] ** 2).sum()) / s) * p - (s / last * q if q is not None else 0.0)
        p, q, last = new, p, s
        s = float((p[used] ** 2).sum())
        if s > 0:
            out += np.outer(p, p[used] @ values / s)
    return out


def limit_km(residuals: np.ndarray, config) -> tuple[float, float, float]:
    """(threshold, mean, standard deviation) of the residuals in use; no limit without any."""
    if not len(residuals):
        return float("inf"), float("nan"), float("nan")
    mean, std = float(residuals.mean()), float(residuals.std(ddof=1)) if len(residuals) > 1 else 0.0
    by_sigma = mean + config.sigma * std
    found = {"absolute": config.absolute_km, "hybrid": max(config.absolute_km, by_sigma)}.get(config.mode, by_sigma)
    return max(found, config.min_threshold_km), mean, std


def clip_track(t: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray, config) -> Clipped:
    """Each round fits the rows in use and takes the starting rows within the threshold of the residuals in use; it ends
    where these are too few or repeat the present or the last choice. One row alone isn't fitted (degree 0)."""
    none = np.full(len(t), np.nan)
    if config.order < 1 or start.sum() < config.min_points:
        return Clipped(none, none, none, np.zeros(len(t), bool), float("inf"), float("nan"), float("nan"), -1)
    finite, now, last = np.isfinite(x) & np.isfinite(y), start, None
    pred, residual, used = np.stack([none, none], axis=1), none, np.zeros(len(t), bool)
    threshold, mean, std = float("inf"), float("nan"), float("nan")
    for _ in range(max(config.rounds, 1)):
        degree = min(config.order, int(now.sum()) - 1)
        if degree < 1:
            break
        lon = x[now]
        step = np.diff(lon)
        lon = lon + np.concatenate([[0.0], np.cumsum(wrapped(step) - step)])
        pred = fitted(t, np.stack([lon, y[now]], axis=1), now, config.order)
        residual = np.where(finite, distance_km(y, x, pred[:, 1], pred[:, 0]), np.nan)
        threshold, mean, std = limit_km(residual[now], config)
        new = start & (residual <= threshold)
        used = now if new.sum() < config.min_points else new
        if used is now or np.array_equal(new, now) or (last is not None and np.array_equal(new, last)):
            break
        last, now = now, new
    return Clipped(pred[:, 0], pred[:, 1], residual, used, threshold, mean, std, degree)


def clip_batches(config):
    """For mapInArrow: rows (track_key, _cells, _t, _x, _y, _start) with a list per frame's value, to what Clipped has."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            values = [c.values.to_numpy(zero_copy_only=False) for c in batch.columns[2:6]]
            ends = batch.column(2).offsets.to_numpy()
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            with np.errstate(invalid="ignore"):
                found = [clip_track(*(v[a:b].astype(float) for v in values[:3]), values[3][a:b].astype(bool), config) for a, b in spans]
            base = pa.array(np.concatenate([[0], np.cumsum([b - a for a, b in spans])]), pa.int32())
            whole = lambda k: np.concatenate([f[k] for f in found]) if found else np.zeros(0)
            lists = [pa.ListArray.from_arrays(base, pa.array(whole(k), from_pandas=True, type=pa.float64() if k < 3 else pa.bool_())) for k in range(4)]
            single = [pa.array([f[k] for f in found], pa.float64(), from_pandas=True) for k in (4, 5, 6)]
            columns = [batch.column(0), batch.column(1), *lists, *single, pa.array([f.degree for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["track_key", "_cells", "_px", "_py", "_r", "_used", "threshold_km", "residual_mean_km", "residual_std_km", "fit_degree"])

    return batches
