"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Texts become sets of hashed word n-grams; equal sets are one node. The n-grams are ordered from rare to frequent. Two sets alike enough share one of the first n - ceil(t n) + 1 n-grams of each, so only such
prefixes are joined. A pair is a candidate where it passes the length filter and, at a shared n-gram, the positional one.
The suffix filter compares histograms of the two sets' hashes, a sixty-fourth of the sets' size, so whole sets are made
and joined only for pairs that pass it; each such pair is compared once.

``links`` lists every pair of nodes alike. ``components`` gives the classes that the links connect without listing all
pairs of a large group: first each node meets, for one of its n-grams, the node that has it earliest (a star: as many
pairs as nodes); the links found are merged; then only pairs from different classes are left, and are all compared. A
pair left out lies in one class already, so the classes are those of all links.

Scale: n-grams never leave their task but for prefixes (about 1 - t of them) and counts of frequent ones. Each task counts
the n-grams that it meets more than once and keeps the ``KEPT`` most frequent whenever it has gathered ``MERGED`` more, so
its memory does not grow with the corpus; these counts are summed by n-gram over all tasks, and the ``FREQUENT`` most
frequent make the order, the rest coming before them by their hashes. Any order gives the same links; a count that a task
dropped makes an n-gram look rarer. Rows of a hot n-gram are summed on the map side, and dealt to
blocks of bounded size where pairs of them are left. Texts are shuffled only where more than ``KEYS_SENT`` of them have
to be compared. Tables in between lie in the shared folder and are removed at the end; results until the driver ends.

A document's key and a node have 128 bits each; of a node 64 are used, and nodes that agree in these (about ten pairs of
2 * 10^10) take the other 64. n-grams have 64 bits: within a pair of sets of 10,000, two differ yet agree with a chance
of 10^-11.

Null and wordless texts have the empty set and are linked with nothing, each a class of its own. Texts with fewer words
than n are one n-gram. Repeated rows and copies are one node and all returned. Ties are broken by id. A null id is the
largest. An empty table gives an empty result. Only doc_id and text are read; other columns, whatever their names, come
back as they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from lumitrack.llm.common import Scratch, fresh, in_arrow, small_batches, small_enough, stored

#: Counts that a task keeps, n-grams that it gathers before it merges them, and n-grams whose frequency all tasks know.
KEPT, MERGED, FREQUENT = 1 << 18, 1 << 20, 1 << 20
#: Steps of the scale of frequencies for each doubling; n-grams from step HOT on are spread over SALTS.
STEPS, HOT, SALTS = 8, 96, 64
MEMO = 100_000
#: n-grams for each part of the histogram that the suffix filter compares, and its parts at most.
PART, PARTS = 16, 4096
#: Up to so many row keys (16 bytes each) are sent to all tasks instead of being joined.
KEYS_SENT = 1_000_000
#: Rows of one n-gram that meet each other in one place; more are dealt to blocks.
BLOCK = 2_000


@dataclass(frozen=True)
class Measure:
    """n-grams of ``n`` words; alike: 100 * intersection >= percent * union."""

    n: int = 5
    percent: int = 80

    def prefix(self, size: int) -> int:
        return size - -(-self.percent * size // 100) + 1

    def shared(self, a: int, b: int) -> int:
        """The least intersection of sets of these sizes that are alike."""
        return -(-self.percent * (a + b) // (100 + self.percent))


class _Words(dict):
    """Word to hash, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 100:
            self[word] = h
        return h


def ngrams(text: str | None, n: int, memo: dict) -> np.ndarray:
    """Sorted distinct n-gram hashes. Only A-Z are lower-cased, and only ASCII white space parts words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(0x2545F4914F6CDD1D + width))
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(grams: np.ndarray) -> tuple[int, int]:
    """128 bits for a set: the node's number and what stands in for it where two nodes have one number."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def histogram(grams: np.ndarray) -> np.ndarray:
    """How many of the hashes lie in each of 2^k equal parts, k by the set's size."""
    bits = min(max(len(grams) // PART, 1), PARTS).bit_length() - 1
    if not bits:
        return np.array([len(grams)], np.uint16 if len(grams) < 1 << 16 else np.uint32)
    counts = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32)


def histograms_allow(a: np.ndarray, b: np.ndarray, measure: Measure) -> bool:
    """The suffix filter: whether sets with these histograms can be alike. No pair alike is lost."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    parts = min(len(a), len(b))
    a, b = a.reshape(parts, -1).sum(axis=1), b.reshape(parts, -1).sum(axis=1)
    return int(np.minimum(a, b).sum()) >= measure.shared(int(a.sum()), int(b.sum()))


def _histogram_bytes(grams: np.ndarray) -> bytes:
    h = histogram(grams)
    return bytes([h.itemsize]) + h.tobytes()


def _histogram_of(them: bytes) -> np.ndarray:
    return np.frombuffer(them, np.uint16 if them[0] == 2 else np.uint32, offset=1)


def _tallied(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams, each once, with their counts added up."""
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    if counts is None:
        return grams[first], np.diff(np.append(first, len(grams)))
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


class Counts:
    """How many sets have each n-gram, of those that a task meets most often."""

    def __init__(self):
        self.grams, self.counts, self._held, self._n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, grams: np.ndarray) -> None:
        self._held.append(grams)
        self._n += len(grams)
        if self._n >= MERGED:
            self.merge()

    def merge(self) -> None:
        """Takes in what was gathered. Beyond KEPT n-grams those met once go, then the rarest."""
        new, times = _tallied(np.sort(np.concatenate(self._held or [self.grams[:0]])))
        if len(self.grams) + len(new) > KEPT:  # most n-grams are met once, and would only be sorted again
            often = (times > 1) | np.isin(new, self.grams, assume_unique=True)
            new, times = new[often], times[often]
        grams, counts = np.concatenate([self.grams, new]), np.concatenate([self.counts, times])
        by = np.argsort(grams, kind="stable")
        grams, counts = _tallied(grams[by], counts[by])
        if len(grams) > KEPT:
            least = max(2, int(np.partition(counts, len(counts) - KEPT)[len(counts) - KEPT]))
            at = np.flatnonzero(counts >= least)
            if len(at) > KEPT:
                at = np.sort(at[np.argsort(-counts[at], kind="stable")[:KEPT]])
            grams, counts = grams[at], counts[at]
        self.grams, self.counts, self._held, self._n = grams, counts, [], 0


class Order:
    """The frequent n-grams, sorted, each with its step; all others are rarer (step 0)."""

    def __init__(self, grams: np.ndarray, steps: np.ndarray):
        by = np.argsort(grams)
        self.grams, self.steps = grams[by], steps[by]
        self.seen = np.zeros(1 << 24, bool)
        self.seen[(self.grams >> np.uint64(40)).astype(np.int64)] = True

    def of(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.uint8)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(40)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
            out[at] = np.where(self.grams[place] == grams[at], self.steps[place], 0)
        return out


def _profile(docs: DataFrame, measure: Measure) -> DataFrame:
    """A row per document (doc_id, _k1, _k2, _n, _node, _more, _hist), and per task the rows (_gram, _count) of what it met often."""
    long, binary = LongType(), BinaryType()
    kinds = (("_k1", long), ("_k2", long), ("_n", IntegerType()), ("_node", long), ("_more", long), ("_hist", binary), ("_gram", long), ("_count", long))
    schema = StructType([docs.schema["doc_id"], *(StructField(c, t) for c, t in kinds)])
    names, types = [f.name for f in schema.fields], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts, id_type = _Words(), Counts(), None
        for batch in them:
            id_type, sizes, nodes, hists = batch.column(0).type, [], [], []
            for text in batch.column(3).to_pylist():
                s = ngrams(text, measure.n, memo)
                counts.add(s)
                sizes.append(len(s))
                nodes.append(node_of(s))
                hists.append(_histogram_bytes(s))
            made = (sizes, [n[0] for n in nodes], [n[1] for n in nodes], hists)
            columns = [*batch.columns[:3], *(pa.array(c, t) for c, t in zip(made, types[2:6], strict=True)), *(pa.nulls(len(sizes), t) for t in types[6:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        counts.merge()
        often = counts.counts > 1
        if often.any():
            none = [pa.nulls(int(often.sum()), t) for t in (id_type, *types[:6])]
            yield pa.RecordBatch.from_arrays([*none, pa.array(counts.grams[often].view(np.int64)), pa.array(counts.counts[often])], names=names)

    return in_arrow(docs.select("doc_id", "_k1", "_k2", "text"), batches, schema)


def _order(profile: DataFrame, scratch: Scratch) -> Order:
    """The FREQUENT most frequent n-grams of all tasks and their steps; a step that would pass that number is left out whole."""
    step = F.least(F.floor(STEPS * F.log2(1.0 + F.sum("_count"))), F.lit(255)).cast("int").alias("_step")
    found = scratch.stored(profile.filter("_gram is not null").groupBy("_gram").agg(step), "frequent")
    room, least = FREQUENT, 256
    for r in found.groupBy("_step").count().orderBy(F.desc("_step")).collect():  # 256 rows at most
        if (room := room - r["count"]) < 0:
            break
        least = r["_step"]
    rows = found.filter(F.col("_step") >= least).toArrow()  # FREQUENT rows at most
    return Order(rows["_gram"].to_numpy().astype(np.int64).view(np.uint64), rows["_step"].to_numpy().astype(np.uint8))


PREFIX = "_gram long, _node long, _n int, _at int"


def _prefixes(docs: DataFrame, measure: Measure, order: Order, clashes: frozenset[int]) -> DataFrame:
    """(_gram, _node, _n, _at, _salt): the rare-first prefix of each set, once for all copies that a task sees.

    _salt is 0 but for n-grams that many sets have, whose rows it spreads.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, order, seen = _Words(), shared.value, set()
        for batch in them:
            columns = [[], [], [], [], []]
            for text in batch.column(0).to_pylist():
                s = ngrams(text, measure.n, memo)
                node, more = node_of(s)
                node = more if node in clashes else node
                if not len(s) or node in seen:
                    continue
                if len(seen) >= MEMO:
                    seen.clear()
                seen.add(node)
                p, step = measure.prefix(len(s)), order.of(s)
                first = np.lexsort((s, step))[:p]
                made = (s[first], np.full(p, node, np.int64), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32), np.where(step[first] >= HOT, 1 + node % SALTS, 0).astype(np.int32))
                for c, x in zip(columns, made, strict=True):
                    c.append(x)
            if columns[0]:
                gram, *rest = map(np.concatenate, columns)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *map(pa.array, rest)], names=["_gram", "_node", "_n", "_at", "_salt"])

    return in_arrow(docs.select("text"), batches, f"{PREFIX}, _salt int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """Prefix rows, each once, without those whose n-gram no other set has.

    One shuffle and sort; a task reads on through its rows and holds back the last one. Rows of a salted n-gram all stay.
    """

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32)]  # the last row, and whether its n-gram came before
        met = False
        for batch in them:
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [r[new] for r in rows]
            same = rows[0][1:] == rows[0][:-1]
            keep = rows[4] > 0
            keep[1:] |= same
            keep[:-1] |= same
            keep[:1] |= met
            out, keep_last = [r[:-1][keep[:-1]] for r in rows[:4]], bool(keep[-1])
            held, met = [r[-1:] for r in rows], keep_last and bool(rows[4][-1] == 0)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["_gram", "_node", "_n", "_at"])
        if len(held[0]) and (met or held[4][0] > 0):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, held[:4])), names=["_gram", "_node", "_n", "_at"])

    return in_arrow(prefixes.repartition("_gram", "_salt").sortWithinPartitions("_gram", "_node"), batches, PREFIX)


def _may_be_alike(measure: Measure, a: str, b: str):
    """The length and the positional filter for two prefix rows that share their n-gram."""
    an, bn, aa, ba = (F.col(f"{t}.{c}") for c in ("_n", "_at") for t in (a, b))
    least = F.ceil(F.lit(measure.percent) * (an + bn) / F.lit(100.0 + measure.percent) - F.lit(1e-9))
    return (100 * F.least(an, bn) >= measure.percent * F.greatest(an, bn)) & (F.least(an - aa, bn - ba) >= least)


def _sets(docs: DataFrame, asked: DataFrame, measure: Measure) -> DataFrame:
    """(_a, _b, _grams) for each row of ``asked`` (_k1, _k2, _a, _b) and document with that key: its set as bytes.

    A task makes a row once, as a rule, however often the document is repeated. Texts aren't shuffled where few are asked for.
    """

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, done = _Words(), set()
        for batch in them:
            last, made, keep, out = None, b"", [], []
            for i, (k1, k2, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if (row := (k1, k2, a, b)) in done:
                    continue
                if len(done) >= MEMO:  # a row that is made again is left out later
                    done.clear()
                done.add(row)
                if (k1, k2) != last:  # the rows of a document follow one another
                    last, made = (k1, k2), ngrams(batch.column(4)[i].as_py(), measure.n, memo).tobytes()
                keep.append(i)
                out.append(made)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at), pa.array(out, pa.binary())], names=["_a", "_b", "_grams"])

    keys = F.broadcast(asked) if small_enough(asked, KEYS_SENT) else asked
    return in_arrow(docs.join(keys, ["_k1", "_k2"]).select("_k1", "_k2", "_a", "_b", "text"), batches, "_a long, _b long, _grams binary")


def _pairs_where(sides: DataFrame, test) -> DataFrame:
    """(_a, _b) of the rows (_a, _b, left, right) whose two binary values pass ``test``."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            keep = pa.array([test(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["_a", "_b"])

    return in_arrow(sides, batches, "_a long, _b long")


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(_node, _class) of the nodes in ``edges`` (_a, _b): the least node that each is connected with.

    Large and small stars in turn (a published algorithm), each step a join and a sum, until nothing changes; the number
    of steps grows with the logarithm of the largest class.
    """

    def hung(pairs: DataFrame, to_larger: bool) -> DataFrame:
        least = pairs.groupBy("_a").agg(F.min("_b").alias("_m")).withColumn("_m", F.least("_a", "_m"))
        both = pairs.join(least, "_a")
        if to_larger:
            return both.filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        return both.select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).union(least.select("_a", F.col("_m").alias("_b")))

    now, mark = scratch.stored(edges.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).filter("_a <> _b").distinct(), "edges"), None
    while True:
        large = hung(now.union(now.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))), True).filter("_a <> _b").distinct()
        now = scratch.stored(hung(large, False).filter("_a <> _b").distinct(), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return scratch.stored(now.select(F.col("_a").alias("_node"), F.col("_b").alias("_class")).union(now.select("_b", "_b")).distinct(), "classes")


class Join:
    """The parts that ``links`` and ``components`` share. ``profile`` has a row per document, ``nodes`` one per node."""

    def __init__(self, docs: DataFrame, measure: Measure, scratch: Scratch):
        self.measure, self.scratch = measure, scratch
        self.docs = keyed(docs.select("doc_id", "text"))
        with small_batches(docs.sparkSession):
            profile = scratch.stored(_profile(self.docs, measure), "profile")
            each = profile.filter("_gram is null")
            halves = each.groupBy("_node").agg(F.min("_more").alias("low"), F.max("_more").alias("high"))
            clashes = frozenset(r["_node"] for r in halves.filter("low <> high").select("_node").collect())  # of m nodes about m^2 / 2^65
            if clashes:
                each = each.withColumn("_node", F.when(F.col("_node").isin(*clashes), F.col("_more")).otherwise(F.col("_node")))
            self.profile = each.drop("_more", "_gram", "_count")
            one = self.profile.filter("_n > 0").groupBy("_node").agg(F.min(F.struct("_k1", "_k2", "_hist")).alias("d"))
            self.nodes = scratch.stored(one.select("_node", "d.*"), "nodes")
            self.rows = scratch.stored(_shared(_prefixes(self.docs, measure, _order(profile, scratch), clashes)), "shared")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are alike: by the suffix filter first; then the sets of what is left are made in one
        pass over the texts, one for each pair and one for each node on its other side, and joined."""
        with small_batches(self.docs.sparkSession):
            return self._compared(pairs)

    def _compared(self, pairs: DataFrame) -> DataFrame:
        measure, nodes, stored = self.measure, self.nodes, self.scratch.stored
        hists = [nodes.select(F.col("_node").alias(c), F.col("_hist").alias(f"_h{c}")) for c in ("_a", "_b")]
        sides = pairs.join(hists[0], "_a").join(hists[1], "_b").select("_a", "_b", "_h_a", "_h_b")
        left = stored(_pairs_where(sides, lambda a, b: histograms_allow(_histogram_of(a), _histogram_of(b), measure)), "candidates")
        asked = left.select("_a", "_b", F.col("_a").alias("_node")).union(left.select(F.lit(None).cast("long"), "_b", "_b").distinct())
        sets = stored(_sets(self.docs, stored(asked.join(nodes, "_node").select("_k1", "_k2", "_a", "_b"), "asked"), measure), "sets")
        ours, theirs = sets.filter("_a is not null"), sets.filter("_a is null").select("_b", F.col("_grams").alias("_others"))
        if theirs.count() > left.select("_b").distinct().count():  # a repeated row that several tasks saw
            theirs = theirs.dropDuplicates(["_b"])

        def alike(a, b) -> bool:
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            return len(np.intersect1d(a, b, assume_unique=True)) >= measure.shared(len(a), len(b))

        return stored(_pairs_where(ours.join(theirs, "_b").select("_a", "_b", "_grams", "_others"), alike).distinct(), "links")

    def pairs(self, rows: DataFrame, differ: str | None = None) -> DataFrame:
        """Candidates among ``rows``, each once; with ``differ``, only those that differ in that column.

        The rows of an n-gram that more than BLOCK have are dealt to blocks, and meet by pairs of blocks.
        """
        many = rows.groupBy("_gram").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_of")).filter("_of > 1")
        of = F.coalesce("_of", F.lit(1))
        dealt = rows.join(many, "_gram", "left").withColumns({"_in": F.pmod(F.xxhash64("_node", "_gram"), of).cast("int"), "_of": of})
        dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        dealt = dealt.withColumns({"_low": F.least("_in", "_with"), "_high": F.greatest("_in", "_with")})
        where = _may_be_alike(self.measure, "a", "b") & (F.col("a._node") < F.col("b._node"))
        for c in ("_gram", "_low", "_high"):
            where &= F.col(f"a.{c}") == F.col(f"b.{c}")
        where &= (F.least("a._in", "b._in") == F.col("a._low")) & (F.greatest("a._in", "b._in") == F.col("a._high"))
        if differ:
            where &= F.col(f"a.{differ}") != F.col(f"b.{differ}")
        return dealt.alias("a").join(dealt.alias("b"), where).select(F.col("a._node").alias("_a"), F.col("b._node").alias("_b")).distinct()

    def stars(self, rows: DataFrame) -> DataFrame:
        """One pair a node at most: with the node that has one of its n-grams earliest, of these the one most often met."""
        first = rows.groupBy("_gram").agg(F.min(F.struct("_at", "_n", "_node")).alias("f")).select("_gram", "f.*").alias("b")
        met = rows.alias("a").join(first, F.col("a._gram") == F.col("b._gram")).filter((F.col("a._node") != F.col("b._node")) & _may_be_alike(self.measure, "a", "b"))
        counted = met.groupBy(F.col("a._node").alias("_a"), F.col("b._node").alias("_b")).agg(F.count(F.lit(1)).alias("_times"))
        return counted.groupBy("_a").agg(F.max(F.struct("_times", "_b")).alias("m")).select("_a", F.col("m._b").alias("_b"))


def keyed(docs: DataFrame, names: tuple[str, str] = ("_k1", "_k2")) -> DataFrame:
    """``docs`` with a key of 128 bits of doc_id and text, in two columns."""
    return docs.withColumns({names[0]: F.xxhash64("doc_id", "text"), names[1]: F.xxhash64(F.lit(1), "text", "doc_id")})


def links(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """Every pair of different sets that are alike, once: (_a, _b), as node numbers. See ``nodes`` for the members."""
    with Scratch(docs.sparkSession) as scratch:
        j = Join(docs, measure, scratch)
        return stored(j.compared(j.pairs(j.rows)), "links")


def nodes(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """doc_id and _node of each document that has words."""
    with Scratch(docs.sparkSession) as scratch:
        return stored(Join(docs, measure, scratch).profile.filter("_n > 0").select("doc_id", "_node"), "nodes")


def _residual(rows: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """Prefix rows, with their class, that may still meet one of another class within the filters."""
    known = rows.join(classes, "_node", "left").withColumn("_class", F.coalesce("_class", "_node"))
    seen = known.groupBy("_gram").agg(F.min("_class").alias("_low"), F.max("_class").alias("_high"), F.min("_n").alias("_least"), F.max("_n").alias("_most"))
    # a row's partners have sizes from percent % of its own to what its place leaves room for
    room = (F.col("_n") - F.col("_at")) * F.lit((100.0 + measure.percent) / measure.percent) - F.col("_n") + 1e-6
    fits = (F.col("_least") <= room) & (100 * F.col("_most") >= measure.percent * F.col("_n"))
    return known.join(seen.filter("_low <> _high"), "_gram").filter(fits).select("_gram", "_node", "_n", "_at", "_class")


def components(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """Per document: doc_id, n_shingles (its set's size), component_id (the least doc_id that links lead to), _class (the
    class of its node; null without words), its key _k1 and _k2, and _copies, the number of rows with this key."""
    with Scratch(docs.sparkSession) as scratch:
        j = Join(docs, measure, scratch)
        found = j.compared(j.stars(j.rows))
        classes = connected(found, scratch)
        more = j.compared(j.pairs(scratch.stored(_residual(j.rows, classes, measure), "residual"), "_class"))
        if not more.isEmpty():
            classes = connected(found.union(more), scratch)
        each = j.profile.withColumn("_node", F.when(F.col("_n") > 0, F.col("_node"))).groupBy("doc_id", "_k1", "_k2", "_n", "_node").agg(F.count(F.lit(1)).alias("_copies"))
        least = each.filter("_node is not null").groupBy("_node").agg(F.min("doc_id").alias("_least")).join(classes, "_node", "left").withColumn("_class", F.coalesce("_class", "_node"))
        named = least.groupBy("_class").agg(F.min("_least").alias("component_id"))
        by_node = least.select("_node", "_class").join(named, "_class").select("_node", "_class", "component_id")
        out = each.join(by_node, "_node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
        return stored(out.select("doc_id", F.col("_n").cast("long").alias("n_shingles"), "component_id", "_class", "_k1", "_k2", "_copies"), "components")


def one_of_each(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """``docs``, with their columns: of each class the document of the least id; of its repeated rows, one.

    Classes are of nodes, since ids may be null or repeated; a document without words is a class of its own.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2", "_copies")).alias("k")
    own = [F.when(F.col("_class").isNull(), F.col(k)).alias(f"_own{k}") for k in ("_k1", "_k2")]
    k1, k2 = fresh(docs, "_k1", "_k2")
    found = components(docs, measure).groupBy("_class", *own).agg(first)
    keep = stored(found.select(F.col("k._k1").alias(k1), F.col("k._k2").alias(k2), "k._copies"), "survivors")
    kept = keyed(docs, (k1, k2)).join(F.broadcast(keep.drop("_copies")) if small_enough(keep, KEYS_SENT) else keep, [k1, k2], "left_semi")
    if not keep.filter("_copies > 1").isEmpty():
        kept = kept.dropDuplicates([k1, k2])
    return kept.select(*docs.columns)


def op10(docs: DataFrame) -> DataFrame:
    found = components(docs, Measure(4, 85))
    return found.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("doc_id", "n_shingles", "component_id")
