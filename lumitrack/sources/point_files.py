"""Control-point files as a Spark data source: ``spark.read.format("points")`` and ``df.write.format("points")``.

Reading: a row per point, with the file's name, the frame's id, the row's place and every column that any header names (the
known ones as numbers, others as text; a name that a header repeats is numbered, ``note``, ``note.1``). With the option
``what`` = ``files`` a row per file instead: its columns, whether the required ones are there, and its number of points, so
that a file with a header alone is a frame too. With ``lines`` the text of each row comes along as ``line``.

Writing: a file for each ``file_name`` under its own name. Rows are written in the order they come; a row whose ``line`` is
not null is written as it stands, and one whose ``row_index`` is null only makes sure that its file exists with a header.
Tasks write into a folder of their attempt and tell the driver what they made; once all have, it moves the files to their
places; a run that fails leaves none behind, at most an empty folder ``_waiting-...`` of a task that outlived it, which
readers pass over. A file's rows have to be in one task; ``write_point_files`` sees to that.

Scale: the driver lists names and, unless ``columns`` (a comma-separated list) are given, reads each first line; everything
else is one task for each group of files of about ``bytesPerPartition``. Paths are any that Arrow's file systems open.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lumitrack.sources.points import POINT_COLUMNS, REQUIRED

OWN = "file_name string, frame_id long, row_index int"
FILES = "file_name string, frame_id long, columns array<string>, complete boolean, n_points int"
BATCH = 10_000


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _listed(path: str, pattern: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    files, root = _file_system(path)
    found = files.get_file_info(pafs.FileSelector(root.rstrip("/"), allow_not_found=True))
    return files, sorted((f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern)), key=lambda f: f.base_name)


def header_of(line: str) -> list[str]:
    """The names in a header; repeated ones are numbered."""
    out: list[str] = []
    for name in next(csv.reader([line]), []):
        name, n = name.strip(), 1
        made = name
        while made in out:
            made, n = f"{name}.{n}", n + 1
        out.append(made)
    return out


def _first_line(files: pafs.FileSystem, path: str) -> str:
    held = b""
    with files.open_input_stream(path) as f:
        while b"\n" not in held and (part := f.read(1 << 14)):
            held += part
    return held.split(b"\n", 1)[0].decode("utf-8", "replace").lstrip("﻿").rstrip("\r")


def frame_of(name: str) -> int | None:
    """The digits after ``-E-`` in a file's name."""
    after = name.split("-E-", 1)[1] if "-E-" in name else ""
    digits = after[: len(after) - len(after.lstrip("0123456789"))]
    return int(digits) if digits else None


def number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None and text.strip() else None
    except ValueError:
        return None


@dataclass
class Group(InputPartition):
    paths: tuple[str, ...]


class PointReader(DataSourceReader):
    def __init__(self, path: str, options: dict, schema: StructType):
        self.path, self.pattern, self.names = path, options.get("glob", "*.points"), schema.names
        self.what, self.most = options.get("what", "points"), int(options.get("bytesPerPartition", 32 << 20))
        self.lines = "line" in schema.names

    def partitions(self) -> list[Group]:
        out, held, size = [], [], 0
        for f in _listed(self.path, self.pattern)[1]:
            if held and size + f.size > self.most:
                out.append(Group(tuple(held)))
                held, size = [], 0
            held.append(f.path)
            size += f.size + (1 << 12)
        return [*out, Group(tuple(held))] if held else [Group(())]

    def read(self, partition: Group) -> Iterator[tuple]:
        files = _file_system(self.path)[0]
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            with files.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace").lstrip("﻿")
            rows = [line for line in text.replace("\r\n", "\n").split("\n") if line.strip()]
            header = header_of(rows[0]) if rows else []
            complete = set(REQUIRED) <= set(header)
            if self.what == "files":
                yield name, frame_of(name), header, complete, max(len(rows) - 1, 0)
            elif complete:
                yield from self._points(name, header, rows[1:])

    def _points(self, name: str, header: list[str], rows: list[str]) -> Iterator[tuple]:
        at, frame = {c: i for i, c in enumerate(header)}, frame_of(name)
        for i, (line, values) in enumerate(zip(rows, csv.reader(rows), strict=True)):
            taken = (values[at[c]] if c in at and at[c] < len(values) else None for c in self.names[3 : len(self.names) - self.lines])
            row = (name, frame, i, *(number(v) if c in POINT_COLUMNS else v for c, v in zip(self.names[3:], taken, strict=False)))
            yield (*row, line) if self.lines else row


@dataclass
class Made(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class PointWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.columns = [c for c in schema.names if c not in ("file_name", "row_index", "line")]
        self.lines = "line" in schema.names

    @property
    def _waiting(self) -> str:
        return f"{_file_system(self.path)[1]}/_waiting-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Made:
        files, folder = _file_system(self.path)[0], f"{self._waiting}/{uuid.uuid4().hex}"
        try:
            return Made(folder, tuple(self._written(iterator, files, folder)))
        except BaseException:
            if files.get_file_info(folder).type == pafs.FileType.Directory:
                files.delete_dir(folder)
            raise

    def _written(self, iterator: Iterator[pa.RecordBatch], files: pafs.FileSystem, folder: str) -> list[str]:
        names, now, out = [], None, None
        for batch in iterator:
            rows = batch.to_pydict()
            for i, name in enumerate(rows["file_name"]):
                if name != now:
                    if out is not None:
                        out.close()
                    if name in names:
                        raise ValueError(f"the rows of {name} are not together")
                    if not names:
                        files.create_dir(folder, recursive=True)
                    names.append(name)
                    now, out = name, files.open_output_stream(f"{folder}/{name}")
                    out.write(_line(self.columns))
                if rows["row_index"][i] is not None:
                    kept = rows["line"][i] if self.lines else None
                    out.write(f"{kept}\n".encode() if kept is not None else _line([_text(rows[c][i]) for c in self.columns]))
        if out is not None:
            out.close()
        return names

    def commit(self, messages: list[Made | None]) -> None:
        files, root = _file_system(self.path)
        made = [m for m in messages if m is not None]
        names = [n for m in made for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("the rows of a file were in several tasks")
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for f in _listed(self.path, "*.points")[1]:
                if f.base_name not in set(names):
                    files.delete_file(f.path)
        for m in made:
            for name in m.names:
                files.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear(files)

    def abort(self, messages: list[Made | None]) -> None:
        self._clear(_file_system(self.path)[0])

    def _clear(self, files: pafs.FileSystem) -> None:
        if files.get_file_info(self._waiting).type == pafs.FileType.Directory:
            files.delete_dir(self._waiting)


def _text(value: object) -> str:
    return "" if value is None else repr(value) if isinstance(value, float) else str(value)


def _line(values: list[str]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(values)
    return out.getvalue().encode()


class PointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        if self.options.get("what") == "files":
            return FILES
        if self.options.get("columns"):
            names = self.options["columns"].split(",")
        else:
            files, found = _listed(self.options["path"], self.options.get("glob", "*.points"))
            headers = (header_of(_first_line(files, f.path)) for f in found)
            names = list(dict.fromkeys(c for h in headers if set(REQUIRED) <= set(h) for c in h)) or list(POINT_COLUMNS)
        quoted = (f"`{c.replace('`', '``')}` {'double' if c in POINT_COLUMNS else 'string'}" for c in names)
        return ", ".join([OWN, *quoted, *(["line string"] if self.options.get("lines", "false").lower() == "true" else [])])

    def reader(self, schema: StructType) -> PointReader:
        return PointReader(self.options["path"], dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> PointWriter:
        return PointWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; done again it changes nothing."""
    spark.dataSource.register(PointSource)


def read_point_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("points").options(**options).load(path)


def left_out(first: int | None, last: int | None) -> Column:
    """Why a file (frame_id, complete) is no frame: its id is outside the range, or a required column is missing; else null."""
    outside = F.lit(False) if first is None or last is None else ~F.col("frame_id").between(first, last)
    return F.when(outside, "id out of range").when(~F.col("complete"), "required column missing")


def left_out_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(input_name, frame_id, reason) of the files that ``frames_of_files`` leaves out."""
    from lumitrack.operators.tracks import dense_index

    files = dense_index(read_point_files(spark, path, what="files"))
    given = files.withColumn("frame_id", F.coalesce("frame_id", F.lit(first or 0) + F.col("frame_index")))
    return given.select(F.col("file_name").alias("input_name"), "frame_id", left_out(first, last).alias("reason")).filter("reason is not null")


def frames_of_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, mission: str = "ISS067") -> DataFrame:
    """The frames of a sequence: frame_index, frame_id, input_name, output_name, columns, for each file with the required
    columns, in the order of names. An id that a name lacks is ``first`` and the file's place; frames outside the range drop
    out before they are counted."""
    from lumitrack.operators.tracks import dense_index

    files = dense_index(read_point_files(spark, path, what="files")).withColumnRenamed("frame_index", "_place")
    given = files.withColumn("frame_id", F.coalesce("frame_id", F.lit(first or 0) + F.col("_place")))
    inside = given.filter(left_out(first, last).isNull())
    frames = dense_index(inside.drop("n_frames", "_place"))
    named = F.concat(F.lit(f"{mission}-E-"), F.col("frame_id").cast("string"), F.lit(".points"))
    return frames.select("frame_index", "frame_id", F.col("file_name").alias("input_name"), named.alias("output_name"), "columns")


def write_point_files(points: DataFrame, frames: DataFrame, path: str, columns: list[str]) -> None:
    """A file for each frame (frame_index, output_name), those without points with a header alone; ``points`` has
    frame_index, row_ordinal, the columns, and perhaps ``line``."""
    register(points.sparkSession)
    own = [*columns, *(["line"] if "line" in points.columns else [])]
    placed = points.select("frame_index", "row_ordinal", *own)
    rows = placed.join(frames.select("frame_index", F.col("output_name").alias("file_name")), "frame_index").select("file_name", F.col("row_ordinal").cast("int").alias("row_index"), *own)
    empty = frames.select(F.col("output_name").alias("file_name"), F.lit(None).cast("int").alias("row_index"), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in own))
    together = rows.unionByName(empty).repartition("file_name").sortWithinPartitions("file_name", "row_index")
    together.write.format("points").mode("overwrite").save(path)
