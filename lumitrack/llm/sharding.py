"""Sharding by fixed virtual slots.

A record's slot is a hash of its key columns modulo a number of slots that never changes. Bytes are added up per slot,
and a versioned map says which shard has a slot. To rebalance or to change the number of shards, the map is edited: only
the slots that an overfull or a closed shard gives up change place. Everything here is DataFrame functions; the map has
``n_slots`` rows whatever the input's size, so it may be gathered into one row and broadcast.

Null texts weigh nothing but the overhead; null keys hash like any other value. Repeated rows share a slot and are each
placed. Equal texts of different ids have slots of their own: a text that a third of all rows have would make its shard
larger than the law of near equal bytes allows. An empty table gives a map with empty slots and no rows. Columns of
``docs``, whatever their names, are carried along, but for earlier ``shard`` and ``virtual_slot``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumitrack.llm.common import Scratch, cut, utf8_bytes

SLOTS = 8192
OVERHEAD = 16


def record_size(text: Column) -> Column:
    return utf8_bytes(text) + F.lit(OVERHEAD)


def slot_of(*key: Column, n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def slot_stats(sized: DataFrame) -> DataFrame:
    """Bytes and rows per slot, from the columns ``_slot`` and ``_size``; summed on the map side first."""
    return sized.groupBy("_slot").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _placed(pool: DataFrame, kept: DataFrame | None, n_shards: int) -> DataFrame:
    """Slots of ``pool``, largest first, each to the shard that has least: (slot, shard).

    ``kept`` (shard, load) is what the shards hold before. One fold over at most ``n_slots`` entries in one row.
    """
    zeros = F.array_repeat(F.lit(0).cast("long"), n_shards)
    rows = pool.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes") - 1).alias("less"), "slot"))).alias("slots"))
    if kept is None:
        rows = rows.withColumn("loads", zeros)
    else:
        held = kept.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("held"))
        rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(held.withColumn("one", F.lit(1))), "one")
        rows = rows.withColumn("loads", F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.coalesce(F.col("held")[s], F.lit(0).cast("long"))))

    def state(loads: Column, shards: Column) -> Column:
        least = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        return F.struct(loads.alias("loads"), least.alias("next"), shards.alias("shards"))

    def step(acc: Column, slot: Column) -> Column:
        loads = F.transform(acc["loads"], lambda x, i: F.when(i == acc["next"], x - slot["less"]).otherwise(x))
        # the one-element array gives the new loads a name, so that they are worked out once
        return F.transform(F.array(loads), lambda new: state(new, F.concat(acc["shards"], F.array(acc["next"]))))[0]

    none = F.array().cast("array<int>")
    folded = rows.select("slots", F.aggregate("slots", state(F.col("loads"), none), step, lambda acc: acc["shards"]).alias("shards"))
    return folded.select(F.explode(F.arrays_zip(F.col("slots.slot").alias("slot"), F.col("shards").alias("shard"))).alias("x")).select("x.slot", "x.shard")


def _all_slots(spark: SparkSession, stats: DataFrame, n_slots: int) -> DataFrame:
    every = spark.range(n_slots).select(F.col("id").cast("int").alias("slot"))
    filled = every.join(stats.withColumnRenamed("_slot", "slot"), "slot", "left")
    return filled.select("slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def plan_map(stats: DataFrame, n_shards: int, n_slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map for ``stats`` (see ``slot_stats``): slot, shard, bytes, rows, version."""
    slots = _all_slots(stats.sparkSession, stats, n_slots)
    return slots.join(_placed(slots, None, n_shards), "slot").select("slot", "shard", "bytes", "rows", F.lit(1).alias("version"))


def edit_map(old: DataFrame, stats: DataFrame, n_shards: int, n_slots: int = SLOTS) -> DataFrame:
    """The next version: slots beyond a shard's even share, and those of shards that are no more, are placed anew.

    With one shard more, slots move only where a shard holds more than the new share; a slot that stays has its old shard.
    """
    slots = _all_slots(stats.sparkSession, stats, n_slots).join(old.select("slot", "shard", "version"), "slot")
    share = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    total = slots.agg(F.sum(F.col("bytes") + 1)).first()[0]
    marked = slots.withColumn("stays", (F.sum(F.col("bytes") + 1).over(share) <= -(-total // n_shards)) & (F.col("shard") < n_shards))
    kept = marked.filter("stays").groupBy("shard").agg(F.sum(F.col("bytes") + 1).alias("load"))
    moved = _placed(marked.filter("not stays"), kept, n_shards).withColumnRenamed("shard", "to")
    return marked.join(moved, "slot", "left").select("slot", F.coalesce("to", "shard").alias("shard"), "bytes", "rows", (F.col("version") + 1).alias("version"))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the maps under ``path``; earlier versions stay readable, and one that is there is an error."""
    version = slot_map.select("version").first()[0]
    slot_map.drop("version").write.parquet(f"{path.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest by default."""
    maps = spark.read.parquet(path)
    version = version or maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version).select("slot", "shard", "bytes", "rows", F.col("version").cast("int").alias("version"))


def sharded(docs: DataFrame, n_shards: int, slot_map: DataFrame | None = None, key: tuple[str, ...] = ("doc_id", "text"), n_slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``virtual_slot`` and ``shard``, and the map used (planned from ``docs`` if none is given)."""
    own = [c for c in docs.columns if c.lower() not in ("shard", "virtual_slot")]
    slot = slot_of(*map(F.col, key), n_slots=n_slots)
    if slot_map is None:
        slot_map = cut(plan_map(slot_stats(docs.select(slot.alias("_slot"), record_size(F.col("text")).alias("_size"))), n_shards, n_slots))
    places = F.broadcast(slot_map.select(F.col("slot").alias("virtual_slot"), "shard"))
    placed = docs.select(F.struct(*own).alias("_docs"), slot.alias("virtual_slot")).join(places, "virtual_slot")
    return placed.select("_docs.*", "virtual_slot", "shard"), slot_map


def op2(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """The contract's columns under the law ``bytes``: the shards' sizes are near equal.

    The map is stored as version 1, edited for one shard more, stored as version 2, and both are read back.
    ``slot`` numbers the records of a shard from 0 without gaps: rows of the shard's earlier virtual slots, from the map,
    plus the record's place in its own, where repeated rows are counted as one before they meet. ``virtual_slot`` is the
    hashed slot, ``rebalanced_shard`` the shard by version 2.
    """
    text = F.col("text")
    narrow = docs.select("doc_id", record_size(text).alias("_size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), text).alias("_slot"))
    stats = cut(slot_stats(narrow))
    with Scratch(docs.sparkSession) as scratch:
        maps = f"{scratch.path}/map"
        write_map(plan_map(stats, n_shards), maps)
        first = read_map(docs.sparkSession, maps, 1)
        write_map(edit_map(first, stats, n_shards + 1), maps)
        grown = read_map(docs.sparkSession, maps, 2).select("slot", F.col("shard").alias("rebalanced_shard"))
        before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        places = cut(first.join(grown, "slot").select(F.col("slot").alias("_slot"), "shard", "rebalanced_shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_first")))
    inside = Window.partitionBy("_slot").orderBy("doc_id", "text_crc32", "_size").rowsBetween(Window.unboundedPreceding, -1)
    each = narrow.groupBy("doc_id", "text_crc32", "_size", "_slot").agg(F.count(F.lit(1)).alias("_copies"))
    return (
        each.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .join(F.broadcast(places), "_slot")
        .select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.col("_before") + F.col("_copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_slot").alias("virtual_slot"), "rebalanced_shard")
    )
