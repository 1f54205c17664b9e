"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources get targets in words: shares of all words by weight, at most ``MOST`` times what a source has, the excess shared
again by weight. A source's documents fall into a fixed number of blocks by hash; the blocks are permuted by a seed and
taken round after round until the target is met, the last round taking only blocks that still fit. So the mix is an exact
quota of blocks per source. The quotas are split among the output shards by a binary tree: at each node a multivariate
hypergeometric draw says how many blocks of each source go left, so that every shard's mix is a random draw without
replacement from the whole. Shards take their quotas from the permuted blocks one after the other, hence disjointly, and
order their rows by a hash of their own.

Scale: ``BLOCKS`` blocks a source, whatever the number of rows; a row a source passes through the driver. The plan, a
row a block, is sent to all tasks up to ``ROWS_SENT`` rows and joined beyond. Blocks of a hot source are as many as any
other's and lie apart; where blocks are large, each is dealt to several tasks.

Null sources are one source, which comes last. Null and wordless texts have size 0 and are taken with their block. A
repeated row is in its twin's block and taken as often. An empty table gives an empty result. Equal inputs, in any order,
give the same mix. Columns of ``docs``, whatever their names, are carried along; only a ``mix_shard`` of theirs is kept
instead of the mix's own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumitrack.llm.common import WORD, cut, small_enough

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCKS = 512
ROWS_SENT = 512_000
#: Rows of a block that one task shuffles.
TASK_ROWS = 200_000
SHARDS = 16
SEED = 20_240_101


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A key that isn't null and sorts null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: dict[str, int], weights=WEIGHTS, most: float = MOST) -> dict[str, float]:
    """Words to take of each source, by sorted key; ``weights`` repeat along them."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    found: dict[str, float] = {}
    total = float(sum(sizes.values()))
    while free := [s for s in weight if s not in found]:
        left, by = total - sum(found.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / by for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        found |= {s: most * sizes[s] for s in over} if over else share
    return found


def split_quotas(quotas: np.ndarray, n_shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard: rows add up to ``quotas``, and the columns' sums differ by one at most."""
    draws, out = np.random.default_rng(seed), np.zeros((len(quotas), n_shards), dtype=np.int64)
    total = int(quotas.sum())
    room = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    nodes = [(0, n_shards, quotas.astype(np.int64))]
    while nodes:
        low, high, here = nodes.pop()
        if high - low == 1:
            out[:, low] = here
            continue
        middle = (low + high) // 2
        left = draws.multivariate_hypergeometric(here, sum(room[low:middle]), method="marginals")
        nodes += [(middle, high, here - left), (low, middle, left)]
    return out


def _order(source: str, block: int) -> bytes:
    return hashlib.blake2b(f"{SEED}|{source}|{block}".encode(), digest_size=8).digest()


def _taken(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of one source's blocks (BLOCKS at most): how often each is taken, and its place among the takes of a round."""
    source, target, total = blocks["_s"].iloc[0], float(blocks["_target"].iloc[0]), int(blocks["words"].sum())
    blocks = blocks.iloc[sorted(range(len(blocks)), key=lambda i: _order(source, int(blocks["_block"].iloc[i])))].reset_index(drop=True)
    rounds = int(target // total) if total else 0
    left, extra, words = target - rounds * total, [False] * len(blocks), blocks["words"].tolist()
    for i, n in enumerate(words):
        if 0 < n <= left:
            extra[i], left = True, left - n
    rest = [(n, i) for i, n in enumerate(words) if not extra[i] and 0 < n < 2 * left]
    if rest and rounds < MOST:  # one block too many is nearer than one too few
        extra[min(rest)[1]] = True
    nth = np.cumsum(extra) - 1
    return pd.DataFrame({"_s": source, "_block": blocks["_block"], "copies": [rounds + e for e in extra], "place": range(len(blocks)), "last_place": [int(n) if e else -1 for n, e in zip(nth, extra, strict=True)], "rounds": rounds, "of": len(blocks)})


@dataclass(frozen=True)
class Mix:
    """sources: _s, source_size, target; blocks: a row per source and block with the shards of its copies."""

    sources: DataFrame
    blocks: DataFrame
    n_shards: int


def _block(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BLOCKS)).cast("int")


def _sent(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if small_enough(plan, ROWS_SENT) else plan


def _marked(docs: DataFrame, *more: Column) -> DataFrame:
    """_s, _block, _size and ``more`` of each document."""
    return docs.select(_source_key(F.col("source")).alias("_s"), _block(F.col("doc_id"), F.col("text")).alias("_block"), n_words(F.col("text")).alias("_size"), *more)


def plan(marked: DataFrame, weights=WEIGHTS, most: float = MOST, n_shards: int = SHARDS) -> Mix:
    spark = marked.sparkSession
    blocks = cut(marked.groupBy("_s", "_block").agg(F.sum("_size").alias("words")))
    sizes = {r["_s"]: r["n"] for r in blocks.groupBy("_s").agg(F.sum("words").alias("n")).collect()}
    aims = targets(sizes, weights, most)
    sources = spark.createDataFrame([(s, sizes[s], aims[s]) for s in sizes], "_s string, source_size long, target double")
    per_source = _sent(sources.select("_s", F.col("target").alias("_target")))
    schema = "_s string, _block int, copies int, place int, last_place int, rounds int, of int"
    taken = cut(blocks.join(per_source, "_s").groupBy("_s").applyInPandas(_taken, schema))
    quota = {r["_s"]: r["n"] for r in taken.groupBy("_s").agg(F.sum("copies").alias("n")).collect()}
    keys = sorted(quota)
    shares = split_quotas(np.array([quota[s] for s in keys], dtype=np.int64), n_shards)
    ends = spark.createDataFrame([(s, [int(x) for x in np.cumsum(row)]) for s, row in zip(keys, shares, strict=True)], "_s string, _ends array<long>")

    # a block's copy of round r is the take number r * of + place; the copy of the last round comes after all full rounds
    full = F.transform(F.when(F.col("rounds") > 0, F.sequence(F.lit(0), F.col("rounds") - 1)).otherwise(F.array().cast("array<int>")), lambda r: r * F.col("of") + F.col("place"))
    last = F.when(F.col("last_place") >= 0, F.array(F.col("rounds") * F.col("of") + F.col("last_place"))).otherwise(F.array().cast("array<int>"))
    shards = F.transform(F.concat(full, last), lambda n: F.size(F.filter("_ends", lambda e: e <= n)))
    placed = taken.join(_sent(ends), "_s").select("_s", "_block", shards.alias("_shards"))
    return Mix(sources, cut(placed), n_shards)


def mixed(docs: DataFrame, weights=WEIGHTS, most: float = MOST, n_shards: int = SHARDS) -> DataFrame:
    """The mix: rows of ``docs``, repeated or left out, with ``mix_shard``; shuffled within each shard."""
    marked = _marked(docs, F.xxhash64("doc_id", "text").alias("_row"), F.struct(*docs.columns).alias("_docs"))
    mix = plan(marked.select("_s", "_block", "_size"), weights, most, n_shards)
    drawn = marked.join(_sent(mix.blocks), ["_s", "_block"]).withColumn("_c", F.explode(F.transform("_shards", lambda s, i: F.struct(s.alias("shard"), i.alias("copy")))))
    parts = 1 + marked.count() // (BLOCKS * TASK_ROWS)
    shard, order = F.col("_c.shard").alias("mix_shard"), F.xxhash64(F.lit(SEED), "_c.shard", "_c.copy", "_row")
    shuffled = drawn.withColumns({"_part": F.pmod("_row", F.lit(parts)), "_order": order}).repartition("_c.shard", "_block", "_part").sortWithinPartitions("_c.shard", "_order")
    own = [] if "mix_shard" in {c.lower() for c in docs.columns} else [shard]
    return shuffled.select("_docs.*", *own)


def op7(docs: DataFrame) -> DataFrame:
    marked = _marked(docs, F.col("doc_id"))
    mix = plan(marked)
    found = marked.join(_sent(mix.blocks), ["_s", "_block"]).join(_sent(mix.sources), "_s")
    return found.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.size("_shards")).cast("long").alias("taken"), F.col("_shards").alias("shards"))
