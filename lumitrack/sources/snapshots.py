"""A log of finished files: versions of a list of frames, with adds and deletions of id ranges, that writers share.

Each version is one small JSON file, ``_log/<version>.json``, that only one writer can create (a writer that is lost before
it writes leaves an empty one, which counts for nothing); it names a Parquet folder of
added rows or a range of ids that go. A writer that finds its version taken reads on and tries the next, so two at once
both get in, one after the other. A version is what was added up to it and not deleted after that; earlier ones stay
readable. Every ``EACH`` versions the writer also stores what is there as a whole (``_log/<version>.whole``), so that a
reader looks at that and the few versions since.

Whether ids exist is asked of bitmaps: ``bitmaps`` has a row for each 32,768 ids, probes join it on that number and look at
one bit, and counts in a range are of whole bitmaps but for those at its ends.

Scale: adds are written by Spark; the driver only handles a line per version. A deletion is a comparison of ids, not a
rewrite. Rows: a null id is never there; ids added again are there again; deleting what isn't there changes nothing. A log
without versions is empty.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EACH = 50
#: How often a reader looks again, half a second apart, at a version that is still empty.
PATIENCE = 10
SCHEMA = "frame_id long, file_name string, length long"


class Conflict(Exception):
    """The version was taken by another writer."""


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/_log/{name}" if name else self.path)

    def _names(self, ending: str) -> list[int]:
        if not self._files.exists(self._at(".").getParent()):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(".").getParent())]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(ending) and n[0].isdigit())

    def version(self) -> int:
        """The last version; -1 where there is none."""
        return max(self._names(".json"), default=-1)

    def _entries(self, first: int, last: int) -> list[dict]:
        """What the versions from ``first`` to ``last`` say, in their order. One that stays empty came to nothing."""
        paths = [str(self._at(f"{v:010d}.json")) for v in self._names(".json") if first <= v <= last]
        for _ in range(PATIENCE):
            rows = [r["value"] for r in self.spark.read.text(paths, wholetext=True).collect()] if paths else []
            if len(rows) == len(paths) and all(rows):
                break
            time.sleep(0.5)
        return sorted((json.loads(r) for r in rows if r), key=lambda e: e["version"])

    def _create(self, version: int, entry: dict) -> None:
        """Makes the version's file, which fails where it is there, and writes it."""
        target, text = self._at(f"{version:010d}.json"), bytearray(json.dumps(entry | {"version": version}).encode())
        local = self._files.getScheme() == "file"
        if local:  # Hadoop's local files are looked for and then made, in two steps
            self._files.mkdirs(target.getParent())
            if not self.spark.sparkContext._jvm.java.io.File(target.toUri().getPath()).createNewFile():
                raise Conflict(version)
        try:
            out = self._files.create(target, local)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(version) from None
            raise
        out.write(text)
        out.close()

    def _commit(self, entry: dict, read: int | None, tries: int) -> int:
        for _ in range(tries):
            version = (self.version() if read is None else read) + 1
            try:
                self._create(version, entry)
            except Conflict:
                if read is not None:
                    raise
                continue
            if version % EACH == EACH - 1:
                self.snapshot(version).write.mode("overwrite").parquet(str(self._at(f"{version:010d}.whole")))
            return version
        raise Conflict(f"no version in {tries} tries")

    def add(self, files: DataFrame, read: int | None = None, tries: int = 20) -> int:
        """Adds files (frame_id, file_name, length) and returns the version. With ``read`` it must follow that version."""
        folder = f"{self.path}/added-{uuid.uuid4().hex}"
        files.select(F.col("frame_id").cast("long").alias("frame_id"), "file_name", F.col("length").cast("long").alias("length")).filter("frame_id is not null").write.parquet(folder)
        return self._commit({"add": folder.rsplit("/", 1)[-1]}, read, tries)

    def delete(self, first: int, last: int, read: int | None = None, tries: int = 20) -> int:
        """Takes out the ids from ``first`` to ``last`` and returns the version."""
        return self._commit({"delete": [first, last]}, read, tries)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The files (frame_id, file_name, length) at that version, the last one unless it is given."""
        last = self.version() if version is None else version
        whole = max((v for v in self._names(".whole") if v <= last and self._complete(v)), default=None)
        entries = self._entries(0 if whole is None else whole + 1, last)
        parts = [] if whole is None else [(whole, self.spark.read.schema(SCHEMA).parquet(str(self._at(f"{whole:010d}.whole"))))]
        parts += [(e["version"], self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{e['add']}")) for e in entries if "add" in e]
        gone = [(e["version"], *e["delete"]) for e in entries if "delete" in e]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)

        def left(at: int, rows: DataFrame) -> DataFrame:
            later = [F.col("frame_id").between(a, b) for v, a, b in gone if v > at]
            return rows.filter(~reduce(lambda x, y: x | y, later)) if later else rows

        return reduce(DataFrame.unionAll, (left(v, rows) for v, rows in parts)).distinct()

    def _complete(self, version: int) -> bool:
        return self._files.exists(self._at(f"{version:010d}.whole/_SUCCESS"))


def bitmaps(files: DataFrame) -> DataFrame:
    """(bucket, bits): which ids are there, a row for each 32,768 of them. Ids are not negative."""
    place = F.col("frame_id") + 1
    return files.filter("frame_id >= 0").groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def _bit(bits, place):
    """The bit of a bitmap: bytes in order, the lowest bit of each first."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2


def existing(probes: DataFrame, known: DataFrame) -> DataFrame:
    """``probes`` (frame_id, ...) with ``exists``, by the bitmaps ``known``."""
    place = F.col("frame_id") + 1
    asked = probes.withColumns({"_bucket": F.bitmap_bucket_number(place), "_place": F.bitmap_bit_position(place)})
    met = asked.join(known.select(F.col("bucket").alias("_bucket"), "bits"), "_bucket", "left")
    found = F.coalesce((F.col("frame_id") >= 0) & (_bit(F.col("bits"), F.col("_place")) == 1), F.lit(False))
    return met.withColumn("exists", found).select(*probes.columns, "exists")


def count_in_range(files: DataFrame, first: int, last: int) -> DataFrame:
    """One row: how many distinct ids from ``first`` to ``last`` there are, as the sum of bitmaps of what lies in it."""
    return bitmaps(files.filter(F.col("frame_id").between(first, last))).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
