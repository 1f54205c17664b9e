"""Whitening of embeddings by a covariance in tiles.

An entry c becomes the whole number floor(64 c) (the query contract adds 1,000,000 to each, which moves the mean alone).
The fit list holds each distinct vector of these once. Its sums per dimension are exact. Its covariance is made in tiles:
a row block (``ROWS`` vectors) is cut into column blocks of ``TILE`` dimensions, which are shuffled by row block; pairs of
column blocks of one row block meet, are centred and multiplied; products are summed per pair of column blocks, in each
task first. The tiles (all together as many numbers as the dimension's square, however many vectors there are) are
assembled on the driver, whose eigenvectors give the map. How far the whitened fit list's covariance is from the identity
is found by the same tiles over projected vectors.

Scale: distinct vectors are one shuffle of two bytes an entry, with sums on the map side, so a vector that repeats is one
row of each task; the fit list is stored once and read three times. A row block's number comes from the stored table's
part and place, so a task that runs again makes the same blocks. Column blocks are shuffled once. A task keeps at most
``TILES_HELD`` products before it passes them on.

Rows: vectors that are null, or hold null or entries that are not finite, are left out; so are vectors of another length
than most of the distinct ones have (of equally many, the longer). Repeated rows are each answered, whatever their ids,
null among them; copies count once in the fit. Entries beyond 2^47 count as 2^47. A deviation beyond 64 bits is null.
Components of no variance (below 10^-12 of the largest) are left out: of fewer than 17 distinct vectors there are fewer
than 16. Without any component, and for an empty table, the result is empty. Columns but vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lumitrack.llm.common import Scratch, in_arrow

SCALE, COMPONENTS = 64, 16
#: Vectors of a row block, dimensions of a column block, products that a task holds.
ROWS, TILE, TILES_HELD = 1024, 64, 64
MOST = 1 << 53
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums per dimension; columns of ``components`` are unit eigenvectors by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def map(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries as whole numbers, where each list begins, how long it is, and which lists count."""
    starts = column.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(starts)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes not-a-number
    finite = np.isfinite(values)
    wrong = np.concatenate([[0], np.cumsum(~finite)])
    fine = column.is_valid().to_numpy(zero_copy_only=False).astype(bool) & (wrong[starts[1:]] == wrong[starts[:-1]])
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(SCALE * np.where(finite, values, 0.0)), -MOST, MOST).astype(np.int64)
    return whole, starts[:-1], lengths, fine


def _binary(data: np.ndarray) -> pa.Array:
    """Each row of the matrix as bytes."""
    width = data.shape[1] * data.itemsize
    offsets = (np.arange(len(data) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _vectors(vectors: DataFrame) -> DataFrame:
    """(_d, _x) of each row that counts: its length and entries, two bytes each where that is enough, otherwise eight."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            whole, starts, lengths, fine = _whole(batch.column(0))
            for d in np.unique(lengths[fine]).tolist():
                x = whole[starts[fine & (lengths == d)][:, None] + np.arange(d)]
                narrow = (np.abs(x) < 1 << 15).all(axis=1)
                for some, kind in ((x[narrow], "<i2"), (x[~narrow], "<i8")):
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d, np.int32)), _binary(some.astype(kind))], names=["_d", "_x"])

    return in_arrow(vectors.select("embedding"), batches, "_d int, _x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of ``_x`` of d entries each."""
    sizes = pc.binary_length(column).to_numpy()
    out = np.empty((len(column), d), np.int64)
    for width, kind in ((2, "<i2"), (8, "<i8")):
        at = np.flatnonzero(sizes == width * d)
        if len(at):
            out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(len(at), d)
    return out


def _sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """How many vectors, and exact sums per dimension: high and low halves apart, a row per task and dimension."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in them:
            x = _matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 20).sum(axis=0), low + (x & 0xFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["_dim", "_n", "_high", "_low"])

    parts = in_arrow(fit.select("_x"), batches, "_dim int, _n long, _high long, _low long")
    rows = parts.groupBy("_dim").agg(*(F.sum(c).alias(c) for c in ("_n", "_high", "_low"))).orderBy("_dim").collect()  # d rows
    return (rows[0]["_n"] if rows else 0), tuple((r["_high"] << 20) + r["_low"] for r in rows)


def _pack(m: np.ndarray) -> bytes:
    kind = m.dtype.str
    return bytes([len(kind)]) + kind.encode() + m.tobytes()


def _unpack(them: bytes, rows: int) -> np.ndarray:
    size = them[0]
    return np.frombuffer(them, them[1 : 1 + size].decode(), offset=1 + size).reshape(rows, -1)


BLOCK = "_block long, _col int, _rows int, _m binary"


def _column_blocks(fit: DataFrame, d: int, mean: np.ndarray | None, project: np.ndarray | None) -> DataFrame:
    """(_block, _col, _rows, _m): column blocks of each row block, of the vectors or, centred, of what a map makes of them."""

    def cut(x: np.ndarray, block: int) -> pa.RecordBatch:
        if project is not None:
            x = (x - mean) @ project
        elif (np.abs(x) < 1 << 15).all():
            x = x.astype("<i2")
        parts = [_pack(np.ascontiguousarray(x[:, c : c + TILE])) for c in range(0, x.shape[1], TILE)]
        n = len(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, len(x), np.int32)), pa.array(parts, pa.binary())], names=["_block", "_col", "_rows", "_m"])

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in them:
            for low in range(0, batch.num_rows, ROWS):
                held.append(_matrix(batch.column(0).slice(low, ROWS), d))
                n += len(held[-1])
                while n >= ROWS:
                    x = np.concatenate(held)
                    yield cut(x[:ROWS], block)
                    held, n, block = [x[ROWS:]], n - ROWS, block + 1
        if n:
            yield cut(np.concatenate(held), block)

    return in_arrow(fit.select("_x"), batches, BLOCK)


def _products(pairs: DataFrame, mean: np.ndarray) -> DataFrame:
    """(_a, _b, _tile): products of the two column blocks in each row, summed within a task."""

    def rows(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["_a", "_b", "_tile"])

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in them:
            for a, b, n, left, right in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                sides = [_unpack(m, n) - mean[c * TILE : (c + 1) * TILE] for c, m in ((a, left), (b, right))]
                product = sides[0].T @ sides[1]
                held[a, b] = held[a, b] + product if (a, b) in held else product
                if len(held) > TILES_HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return in_arrow(pairs, batches, "_a int, _b int, _tile binary")


def _tile_sums(tiles: DataFrame) -> DataFrame:
    """Tiles summed by their place, in an order that does not depend on the tasks."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in them:
            for a, b, tile in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = np.frombuffer(tile, np.float64)
                if (a, b) == key:
                    total = total + part
                    continue
                if key is not None:
                    yield _one(key, total)
                key, total = (a, b), part
        if key is not None:
            yield _one(key, total)

    def _one(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["_a", "_b", "_tile"])

    ordered = tiles.repartition("_a", "_b").sortWithinPartitions("_a", "_b", F.xxhash64("_tile"), "_tile")
    return in_arrow(ordered, batches, "_a int, _b int, _tile binary")


def covariance(fit: DataFrame, n: int, d: int, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor n) of the vectors of ``fit``, or of what ``project`` makes of them once centred."""
    blocks = _column_blocks(fit, d, mean, project)
    pairs = blocks.alias("a").join(blocks.alias("b"), (F.col("a._block") == F.col("b._block")) & (F.col("a._col") <= F.col("b._col")))
    pairs = pairs.select(F.col("a._col").alias("_a"), F.col("b._col").alias("_b"), "a._rows", F.col("a._m").alias("_left"), F.col("b._m").alias("_right"))
    size = d if project is None else project.shape[1]
    centre, out = (mean if project is None else np.zeros(size)), np.zeros((size, size))
    for r in _tile_sums(_products(pairs, centre)).collect():  # size * size numbers, whatever n is
        a, b = r["_a"] * TILE, r["_b"] * TILE
        tile = np.frombuffer(bytes(r["_tile"]), np.float64).reshape(min(TILE, size - a), min(TILE, size - b))
        out[a : a + TILE, b : b + TILE] = tile
        out[b : b + TILE, a : a + TILE] = tile.T
    return out / n


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (embedding); None where no vector counts or none has any entry."""
    with Scratch(vectors.sparkSession) as scratch:
        distinct = scratch.stored(_vectors(vectors).distinct(), "fit")
        most = distinct.groupBy("_d").count().orderBy(F.desc("count"), F.desc("_d")).first()
        if most is None or not (d := most["_d"]):
            return None
        chosen = distinct.filter(F.col("_d") == d)
        n, sums = _sums(chosen, d)
        mean = np.array([s / n for s in sums])
        v = covariance(chosen, n, d, mean)
        values, vectors_ = np.linalg.eigh(v)
        values, vectors_ = values[::-1], vectors_[:, ::-1]
        k = int((values[:components] > NO_VARIANCE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
        out = Whitening(n, sums, values[:k], vectors_[:, :k], float(np.trace(v)))
        if not k:
            return out
        error = np.abs(covariance(chosen, n, d, mean, out.map) - np.eye(k)).max()
        return Whitening(n, sums, out.eigenvalues, out.components, out.trace, float(error))


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
    about = ((float(n) * x - np.array(sums, float)) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(x)
    small = about < 2.0**62 if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62 else np.zeros(len(x), bool)
    if small.any():
        for i, value in zip(np.flatnonzero(small).tolist(), ((n * x[small] - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist(), strict=True):
            out[i] = value
    for i in np.flatnonzero(~small & (about < 2.0**64)).tolist():
        value = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), sums, strict=True))
        out[i] = value if value < 1 << 63 else None
    return out


def applied(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) of each row that counts: its distance from the sums and its whitened entries."""
    d, mean, by = len(model.sums), model.mean, model.map
    k = by.shape[1]
    schema = StructType([vectors.schema["vec_id"], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            whole, starts, lengths, fine = _whole(batch.column(1))
            at = np.flatnonzero(fine & (lengths == d))
            x = whole[starts[at][:, None] + np.arange(d)]
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(((x - mean) @ by).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(_deviation(x, model.n, model.sums), pa.int64()), made], names=schema.names)

    return in_arrow(vectors.select("vec_id", "embedding"), batches, schema)


OP13 = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def op13(vectors: DataFrame) -> DataFrame:
    model = fit(vectors)
    if model is None or not len(model.eigenvalues):
        schema = StructType([vectors.schema["vec_id"], *StructType.fromDDL(OP13).fields])
        return vectors.sparkSession.createDataFrame([], schema)
    shares = F.array(*(F.lit(float(e) / model.trace) for e in model.eigenvalues))
    each = applied(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
