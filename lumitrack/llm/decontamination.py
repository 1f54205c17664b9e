"""Benchmark decontamination by spaced seeds.

Texts become sequences of word hashes (lower-cased runs of letters and digits). Fixed masks each look at six of six to
eleven successive words and ignore the rest; a mask's hash of a benchmark place equals that of a training place where the
six words agree, whatever stands between. Places that agree give a diagonal (item, shift), along which all words are then
compared. A document is contaminated by an item if at least ``MATCHES`` words, or four fifths of a shorter item, agree
within the overlap, which is the best stretch (a word that agrees counts 1, a substituted one -2) or, where that holds too
few, all that is aligned: from the first to the last agreeing word of the item, or of ``REACH`` words of a longer one.

Of several diagonals with one item, the row is that of most agreeing words, then of the least start, then of the least end.
Items of fewer than eight words are compared as they are: a document holds one if its words are the item's words.

The benchmark's seeds are sent to all tasks if they are at most ``SEEDS_SENT``; beyond that, training seeds that pass a
bitmap of fixed size join them by hash, and the words of documents and items that meet are joined. Both ways give the
same rows.

Null, empty and wordless texts match nothing; what no mask sees is not found. Texts are compared whole. Items that repeat
are each reported; repeated documents too. Empty tables give empty results. Ids may have any type. Other columns,
whatever their names, are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lumitrack.llm.common import cut, fresh, in_arrow, small_batches, small_enough

#: Each mask's places that are looked at (fixed values): of any 8 to 16 words with a fifth of them substituted, the most
#: that ``needed`` lets pass, some mask sees none of these.
MASKS = (
    (0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 6, 7), (0, 1, 3, 5, 6, 7), (0, 2, 3, 4, 7, 8), (0, 1, 4, 5, 6, 9), (0, 2, 3, 5, 8, 10), (0, 1, 2, 5, 7, 8),
    (0, 1, 3, 4, 6, 8),
)
LEAST_WORDS = 8
MATCHES, SHARE = 13, 0.8
SUBSTITUTED = -2
#: Agreeing words outside a stretch count together over so many words; on longer diagonals common words agree by chance.
REACH = 64
SEEDS_SENT = 4_000_000
BITMAP = 1 << 24


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per mask: places in ``words`` (texts one after the other, text i from starts[i] to starts[i + 1]) and their hashes."""
    w, ends = words.astype(np.uint64, copy=False), np.repeat(starts[1:], np.diff(starts))
    for m, mask in enumerate(MASKS):
        n = len(w) - mask[-1]
        if n <= 0:
            continue
        h = np.full(n, np.uint64(0x9E3779B97F4A7C15 * (m + 1) % (1 << 64)))
        for k in mask:
            h = (h ^ w[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        at = np.flatnonzero(np.arange(n) + mask[-1] < ends[:n])
        yield at, h[at]


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """The overlap where word i of the item lies at i + shift of the document: (agreeing words, start, end) in the document."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[low:high] == doc[low + shift : high + shift]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, SUBSTITUTED))])
    least = np.minimum.accumulate(score)
    end = int(np.argmax(score - least))
    start = int(np.flatnonzero(score[: end + 1] == least[end])[-1])
    n = int(same[start:end].sum())
    if n < needed(len(item)):
        agreed = np.concatenate([[0], np.cumsum(same)])
        reach = min(REACH, len(same))
        within = agreed[reach:] - agreed[: len(agreed) - reach]
        first = int(np.argmax(within))
        at = first + np.flatnonzero(same[first : first + reach])
        if len(at) > n:
            n, start, end = len(at), int(at[0]), int(at[-1]) + 1
    return n, low + shift + start, low + shift + end


def needed(n_words: int) -> int:
    return min(MATCHES, -(-n_words * 4 // 5))


def rank(found: tuple[int, int, int]) -> tuple[int, int, int]:
    """The order of a text's overlaps with one item, the best first."""
    return -found[0], found[1], found[2]


class Benchmark:
    """The items' words and their seeds, sorted by hash."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        starts = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
        words = np.concatenate(items) if items else np.zeros(0, np.int64)
        found = list(seeds(words, starts))
        at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
        h = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.item = (np.searchsorted(starts, at, side="right") - 1)[order]
        self.place = (at - starts[np.searchsorted(starts, at, side="right") - 1])[order]
        self.bits = np.zeros(BITMAP, dtype=bool)
        self.bits[(self.hashes >> np.uint64(40)).astype(np.int64)] = True

    def overlaps(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, agreeing words, start, end), the best overlap of each text and item that is long enough."""
        diagonals = set()
        for at, h in seeds(words, starts):
            may = self.bits[(h >> np.uint64(40)).astype(np.int64)]
            at, h = at[may], h[may]
            first, last = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
            hit = last > first
            if not hit.any():
                continue
            at, first, many = at[hit], first[hit], (last - first)[hit]
            nth = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at, many)
            text = np.searchsorted(starts, at, side="right") - 1
            diagonals.update(zip(text.tolist(), self.item[nth].tolist(), (at - starts[text] - self.place[nth]).tolist(), strict=True))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, shift in sorted(diagonals):
            found = overlap(words[starts[text] : starts[text + 1]], self.items[item], shift)
            if found[0] >= needed(len(self.items[item])) and ((text, item) not in best or rank(found) < rank(best[text, item])):
                best[text, item] = found
        return [(*k, *v) for k, v in sorted(best.items())]


FOUND = ("n_agree", "word_start", "word_end", "n_item_words")
OUT = ", ".join(f"{c} int" for c in FOUND)


def _arrays(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The lists' values one after the other, and where each begins."""
    starts = column.offsets.to_numpy()
    return column.values.to_numpy()[starts[0] : starts[-1]], (starts - starts[0]).astype(np.int64)


def _words(texts: DataFrame, *keep: str) -> DataFrame:
    return texts.select(*keep, word_hashes(F.col("text")).alias("_words")).filter(F.size("_words") > 0)


def overlaps(docs: DataFrame, benchmark: DataFrame, seeds_sent: int = SEEDS_SENT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per contaminated document and item: the columns ``keep``, item_id, n_agree, word_start, word_end, n_item_words."""
    every = cut(_words(benchmark, "item_id"))
    items, short = every.filter(F.size("_words") >= LEAST_WORDS), every.filter(F.size("_words") < LEAST_WORDS)
    n_seeds = (items.agg(F.sum(F.size("_words"))).first()[0] or 0) * len(MASKS)
    texts = _words(docs, *keep)
    long = _overlaps_by_join(texts, items, keep) if n_seeds > seeds_sent else _overlaps_by_broadcast(texts, items, keep)
    n = F.size("_words")
    same = texts.filter(n < LEAST_WORDS).join(short, "_words").select(*keep, "item_id", n.alias("n_agree"), F.lit(0).alias("word_start"), n.alias("word_end"), n.alias("n_item_words"))
    return long.union(same)


def _overlaps_by_broadcast(texts: DataFrame, items: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    rows = items.toArrow()  # at most seeds_sent / len(MASKS) words
    ids = rows["item_id"].combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast((ids, Benchmark([np.array(x, dtype=np.int64) for x in rows["_words"].to_pylist()])))
    schema = StructType([*(texts.schema[k] for k in keep), items.schema["item_id"], *(StructField(c, IntegerType()) for c in FOUND)])

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = shared.value
        for batch in them:
            found = known.overlaps(*_arrays(batch.column(len(keep))))
            text, item = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
            values = ([f[2] for f in found], [f[3] for f in found], [f[4] for f in found], [len(known.items[f[1]]) for f in found])
            columns = [*(batch.column(i).take(text) for i in range(len(keep))), ids.take(item), *(pa.array(v, pa.int32()) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_arrow(texts, batches, schema)


def _seed_rows(texts: DataFrame, bits=None) -> DataFrame:
    """(_key, _hash, _place) of every seed of the column ``_words``, or of those that a bitmap lets pass."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(bits.value, bitorder="little").astype(bool) if bits is not None else None
        for batch in them:
            key = batch.column(0)
            words, starts = _arrays(batch.column(1))
            for at, h in seeds(words, starts):
                if mask is not None:
                    may = mask[(h >> np.uint64(40)).astype(np.int64)]
                    at, h = at[may], h[may]
                text = np.searchsorted(starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([key.take(pa.array(text)), pa.array(h.view(np.int64)), pa.array((at - starts[text]).astype(np.int32))], names=["_key", "_hash", "_place"])

    return in_arrow(texts.select("_key", "_words"), batches, "_key long, _hash long, _place int")


def _overlaps_by_join(texts: DataFrame, items: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The same rows for a benchmark of any size: seeds join by hash, diagonals join the words on either side."""
    keyed = items.withColumn("_key", F.xxhash64("item_id", "_words"))
    item_seeds = cut(_seed_rows(keyed.select("_key", "_words").distinct()).withColumnRenamed("_key", "_item").withColumnRenamed("_place", "_item_place"))
    # which of the bitmap's places are taken: a row for each 32,768 of BITMAP places
    place = F.shiftrightunsigned("_hash", 40) + 1
    taken = item_seeds.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros((BITMAP // 32_768, 4096), np.uint8)
    for r in taken:
        bits[r["at"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits.reshape(-1))
    docs = texts.withColumn("_key", F.xxhash64(*keep, "_words"))
    found = _seed_rows(docs, shared).join(item_seeds, "_hash").select("_key", "_item", (F.col("_place") - F.col("_item_place")).alias("_shift")).distinct()
    both = found.join(docs.select("_key", "_words").dropDuplicates(["_key"]), "_key").join(keyed.select(F.col("_key").alias("_item"), F.col("_words").alias("_item_words")).dropDuplicates(["_item"]), "_item")

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            key, item, shift = (batch.column(i).to_pylist() for i in range(3))
            (words, starts), (item_words, item_starts) = _arrays(batch.column(3)), _arrays(batch.column(4))
            rows = [[], [], [], [], [], []]
            for i in range(len(key)):
                x = item_words[item_starts[i] : item_starts[i + 1]]
                agree, start, end = overlap(words[starts[i] : starts[i + 1]], x, shift[i])
                if agree >= needed(len(x)):
                    for col, v in zip(rows, (key[i], item[i], agree, start, end, len(x)), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["_key", "_item", "n_agree", "word_start", "word_end", "n_item_words"])

    checked = in_arrow(both.select("_key", "_item", "_shift", "_words", "_item_words"), batches, f"_key long, _item long, {OUT}")
    first = F.min(F.struct((-F.col("n_agree")).alias("less"), (F.col("word_start")).alias("word_start"), "word_end", "n_item_words", "n_agree")).alias("o")
    best = checked.groupBy("_key", "_item").agg(first).select("_key", "_item", "o.n_agree", "o.word_start", "o.word_end", "o.n_item_words")
    named = best.join(keyed.select(F.col("_key").alias("_item"), "item_id"), "_item")
    return docs.select("_key", *keep).join(named, "_key").select(*keep, "item_id", "n_agree", "word_start", "word_end", "n_item_words")


#: Up to so many contaminated documents (24 bytes each), their keys are sent to all tasks.
KEYS_SENT = 500_000


def decontaminated(docs: DataFrame, benchmark: DataFrame, seeds_sent: int = SEEDS_SENT) -> DataFrame:
    """``docs``, with their columns, without the contaminated ones."""
    k1, k2 = fresh(docs, "_k1", "_k2")
    keyed = docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.xxhash64(F.lit(1), "text", "doc_id")})
    with small_batches(docs.sparkSession):
        bad = cut(overlaps(keyed.select("text", k1, k2), benchmark, seeds_sent, keep=(k1, k2)).select(k1, k2).distinct())
    bad = F.broadcast(bad) if small_enough(bad, KEYS_SENT) else bad
    return keyed.join(bad, [k1, k2], "left_anti").select(*docs.columns)


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return overlaps(docs, benchmark)
