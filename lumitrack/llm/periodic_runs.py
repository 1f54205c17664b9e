"""Periodic runs of words, found in the suffix tree of each text by the smaller-half traversal of Stoye and Gusfield.

A run is a stretch of consecutive words with least period q (words q apart are identical) and a length of at least
``LEAST`` words and ``TIMES`` periods that no neighbouring word extends. Texts are whole; a task handles as many of them
together as ``WORDS_AT_ONCE`` words, one suffix tree each:

1. Suffixes are sorted by doubling the length that is compared; only those still alike go on. The ranks of each length
   are kept, and give the common prefix of any two suffixes, and how far two places agree to their left.
2. Inner nodes are intervals of the sorted suffixes with their common prefix (the depth D). Of each node's children the
   largest is left out; every leaf i of the others asks whether i + D and i - D are leaves of the node too. If so, and
   the words after the two halves differ, a branching tandem repeat of two times D words is found. Leaves that are asked
   are at most n log n.
3. Every other tandem repeat is a branching one rotated to the left. Each is rotated as far as the words allow, which
   gives the run that it ends; runs of the same stretch are merged and keep the least period.

Scale: one pass without a shuffle; a text is one row, so a task's memory follows ``WORDS_AT_ONCE`` or its longest text.
Places are asked in slices of ``ASKED_AT_ONCE``.

Rows: a null or wordless text has no words and no run, and comes back as ''. Repeated rows are each answered. A null id is
carried along. Empty tables give empty results. Other columns, whatever their names, are ignored by ``runs`` and ``op12``
and carried along by ``collapsed``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lumitrack.llm.common import fresh, in_arrow

LEAST, TIMES = 6, 4
WORDS_AT_ONCE = 200_000
ASKED_AT_ONCE = 1 << 19


class SuffixTree:
    """The suffixes of several sequences of numbers, a tree for each of them.

    ``words`` holds the sequences one after the other, each followed by one place that ends it; ``text`` says which
    sequence a place belongs to.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, is_end: np.ndarray):
        n = len(words)
        self.words, self.n = words, n
        # Rank 0 of a place: its sequence, then its word; the end comes after all words.
        first = np.where(is_end, words.max(initial=0) + 1, words) + text.astype(np.int64) * (int(words.max(initial=0)) + 2)
        order = np.argsort(first, kind="stable")
        new = np.ones(n, bool)
        new[1:] = first[order[1:]] != first[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = _starts(new)
        self.levels = [rank]  # levels[k]: equal numbers where 2^k words are equal
        while True:
            # groups of suffixes still alike: sorted by the rank of what follows
            alike = ~new
            alike[:-1] |= ~new[1:]
            at = np.flatnonzero(alike)
            if not len(at):
                break
            step, members = 1 << (len(self.levels) - 1), order[at]
            group, then = rank[members], rank[np.minimum(members + step, n - 1)]
            by = np.argsort(group.astype(np.int64) * n + then, kind="stable")
            members, group, then = members[by], group[by], then[by]
            order[at] = members
            differs = np.ones(len(at), bool)
            differs[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
            new[at] = differs
            rank = rank.copy()
            first_at = at[np.maximum.accumulate(np.where(differs, np.arange(len(at)), 0))]
            rank[members] = first_at
            self.levels.append(rank)
        self.sorted, self.place = order, np.empty(n, np.int32)
        self.place[order] = np.arange(n, dtype=np.int32)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` (different places) have in common."""
        size = np.zeros(len(a), np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            size += (rank[a + size] == rank[b + size]).astype(np.int32) << k
        return size

    def agree_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` > ``a`` are the same, place by place."""
        size = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, low = self.levels[k], a - size - (1 << k)
            same = (low >= 0) & (rank[np.maximum(low, 0)] == rank[np.maximum(b - size - (1 << k), 0)])
            size += same.astype(np.int64) << k
        return size

    def tandem_repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, period) of the branching tandem repeats; some come twice."""
        depth = np.zeros(self.n + 1, np.int32)  # depth[x]: of the sorted suffixes x - 1 and x; 0 at both ends
        near = np.flatnonzero(self.levels[0][self.sorted[1:]] == self.levels[0][self.sorted[:-1]]) + 1
        depth[near] = self.common_prefix(self.sorted[near - 1], self.sorted[near])
        if not len(near):
            return
        before, after = _less_before(depth, near, True), _less_after(depth, near, True)
        end, first = _less_after(depth, near, False), depth[_less_before(depth, near, False)] < depth[near]
        # Node: its place of least x, where ``first`` holds. A child begins at each x, and one more at the node's start.
        node = before.astype(np.int64) * (int(depth.max()) + 1) + depth[near]
        nodes, number = np.unique(node, return_inverse=True)
        owner = np.concatenate([number, number[first]])
        low, high = np.concatenate([near, before[first]]), np.concatenate([end, near[first]])
        by = np.lexsort((low - high, owner))  # of each node, the largest child first
        largest = np.ones(len(by), bool)
        largest[1:] = owner[by][1:] != owner[by][:-1]
        rest = by[~largest]
        deep, left, right = (np.zeros(len(nodes), np.int64) for _ in range(3))
        deep[number], left[number], right[number] = depth[near], before, after
        sizes = (high - low)[rest]
        for some in _slices(sizes):
            which, many = rest[some], sizes[some]
            leaf = self.sorted[np.repeat(low[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            at = np.repeat(owner[which], many)
            for sign in (1, -1):
                other = leaf + sign * deep[at]
                start = np.minimum(leaf, other)
                last = start + 2 * deep[at]
                fits = (other >= 0) & (last < self.n)
                start, other, d, v, last = start[fits], other[fits], deep[at[fits]], at[fits], last[fits]
                found = (self.place[other] >= left[v]) & (self.place[other] < right[v])
                start, d, last = start[found], d[found], last[found]
                branching = self.levels[0][start + d] != self.levels[0][last]
                yield start[branching], d[branching]

    def runs(self, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all runs, by start and period."""
        found = [(np.zeros(0, np.int64),) * 3]
        for start, period in self.tandem_repeats():
            back = self.agree_before(start, start + period)
            length = back + 2 * period
            long = (length >= least) & (length >= times * period)
            found.append((start[long] - back[long], length[long], period[long]))
        start, length, period = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
        by = np.lexsort((period, length, start))
        start, length, period = start[by], length[by], period[by]
        keep = np.ones(len(by), bool)
        keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, period = start[keep], length[keep], period[keep]
        by = np.lexsort((period, start))
        return start[by], length[by], period[by]


def _starts(new: np.ndarray) -> np.ndarray:
    """For each place the last one, up to it, where ``new`` holds."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of the list that add up to about ASKED_AT_ONCE."""
    bounds = np.searchsorted(np.cumsum(sizes), np.arange(ASKED_AT_ONCE, int(sizes.sum()) + ASKED_AT_ONCE, ASKED_AT_ONCE), side="right")
    low = 0
    for high in chain(bounds.tolist(), [len(sizes)]):
        if low < (high := min(max(high, low + 1), len(sizes))):
            yield slice(low, high)
            low = high


def _less_before(depth: np.ndarray, at: np.ndarray, strictly: bool) -> np.ndarray:
    """For each place in ``at`` the nearest one before it whose depth is less (or not greater), by jumps that double."""
    to = np.arange(-1, len(depth) - 1)
    to[0] = 0
    moving = at
    while len(moving):
        ahead = depth[to[moving]]
        moving = moving[(ahead >= depth[moving]) if strictly else (ahead > depth[moving])]
        to[moving] = to[to[moving]]
    return to[at]


def _less_after(depth: np.ndarray, at: np.ndarray, strictly: bool) -> np.ndarray:
    last = len(depth) - 1
    return last - _less_before(depth[::-1], last - at[::-1], strictly)[::-1]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each sequence of numbers its runs (start, length, period)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    text, words, is_end = np.repeat(np.arange(len(texts)), sizes + 1), np.zeros(begins[-1], np.int64), np.zeros(begins[-1], bool)
    is_end[begins[1:] - 1] = True
    words[~is_end] = np.concatenate(texts)
    start, length, period = SuffixTree(words, text, is_end).runs()
    owner = text[start]
    for t, s, m, q in zip(owner.tolist(), (start - begins[owner]).tolist(), length.tolist(), period.tolist(), strict=True):
        out[t].append((s, m, q))
    return out


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: of each run only its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the most periods; of these the first, then that of the least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


Change = Callable[[int | None, int], np.ndarray | None]
Document = tuple[list[bytes], list[tuple[int, int, int]]]


def _documents(batch: pa.RecordBatch, change: Change | None) -> Iterator[list[Document]]:
    """The words (as UTF-8) and runs of the batch's texts (id, text), some texts at a time.

    ``change`` may take words by number instead, by the document's id and number of words.
    """
    some, numbers, total = [], [], 0
    known: dict[bytes, int] = {}
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        words = (text or b"").split()
        if change is not None and words and (taken := change(doc_id, len(words))) is not None:
            words = [words[i] for i in taken.tolist()]
        if some and total + len(words) > WORDS_AT_ONCE:
            yield list(zip(some, runs_of(numbers), strict=True))
            some, numbers, total, known = [], [], 0, {}
        some.append(words)
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        total += len(words)
    if some:
        yield list(zip(some, runs_of(numbers), strict=True))


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): a row per run, places and lengths in words."""
    schema = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("start", "length", "period"))])

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            at = 0
            for some in _documents(batch, None):
                rows = [(at + i, *r) for i, (_, found) in enumerate(some) for r in found]
                who, *rest = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], names=schema.names)
                at += len(some)

    return in_arrow(docs.select("doc_id", "text"), batches, schema)


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with their columns; of each run in ``text`` the first period stays, words parted by one space."""
    (name,) = fresh(docs, "_collapsed")
    schema = StructType([*docs.schema.fields, StructField(name, StringType())])
    at = docs.columns.index("text")

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            low, nothing = 0, pa.nulls(batch.num_rows)
            for some in _documents(pa.RecordBatch.from_arrays([nothing, batch.column(at)], names=["id", "text"]), None):
                made = pa.array([_joined(words, found).decode("utf-8", "surrogatepass") for words, found in some], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(low, len(some)).columns, made], names=schema.names)
                low += len(some)

    made = in_arrow(docs, batches, schema)
    return made.select(*(made[name].alias("text") if c == "text" else made[c] for c in docs.columns))


def _joined(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    if not found:
        return b" ".join(words)
    return b" ".join([words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()])


def repeating(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query contract's change: a tenth of the documents, by the id's CRC, repeat some words to their end.

    A null id has no CRC and leaves its text as it is."""
    if doc_id is None or (h := zlib.crc32(str(doc_id).encode())) % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


LONGS = ("start", "length", "period", "exponent_milli")


def op12(docs: DataFrame) -> DataFrame:
    digests = ("runs_sha256", "collapsed_sha256")
    schema = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("n_runs", *LONGS)), *(StructField(c, StringType()) for c in digests)])

    def row(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
        best = greatest(found)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
        return len(found), *four, hashlib.sha256(listed).hexdigest(), hashlib.sha256(_joined(words, found)).hexdigest()

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            rows = [row(words, found) for some in _documents(batch, repeating) for words, found in some]
            columns = zip(*rows, strict=True) if rows else ((),) * 7
            kinds = [*(pa.int64(),) * 5, *(pa.string(),) * 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return in_arrow(docs.select("doc_id", "text"), batches, schema)
