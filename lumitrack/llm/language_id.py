"""Language identification: words first, then shorter and shorter character n-grams.

Training counts words per language over labelled documents. A known word scores its smoothed log frequency in each
language; an unseen one is scored by the longest of its character n-grams that the model knows, position by position,
backing off from ``LONGEST`` characters to one, and by a uniform chance where even the letter is unknown. A document's
language is the likeliest under all its words, each counted as often as it occurs. Its score is that language's posterior
from the mean word, taken ``EVIDENCE`` times at most, so that a long text in no known language isn't certain of its best.

Training takes at most about ``SAMPLE`` documents of each language, picked by a hash (all, where there are fewer), and
keeps every word and n-gram of these. So the model, which is broadcast, doesn't grow with the corpus: a hash and a number
per language for each word and n-gram. Prediction reads every text whole.

Null texts and texts without a letter get ``und`` and score 0, and so does everything if nothing was learnt. Documents
with a null language aren't learnt from. Ties go to the language that sorts first. Repeated rows are each predicted. An
empty table gives an empty result. Columns are read by name; others, whatever their names, are carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumitrack.llm.common import cut, fresh, in_arrow

SAMPLE = 4_000
EVIDENCE = 32
LONGEST = 4
UNKNOWN = "und"
#: Words are runs of letters; digits and underscores part them.
LETTERS = re.compile(r"[^\W\d_]+")
MEMO = 100_000


def words_list(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    # the pattern also takes a few numbers that aren't digits
    return found if text.isascii() else [w for w in found if w.isascii() or any(map(str.isalpha, w))]


def hash_of(name: str) -> int:
    """What Spark's xxhash64 gives for a string, unsigned."""
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 42)


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For n from 1 to LONGEST the hash of the n-gram at every place of the words, each between its marks, one after the
    other (0 where the word ends before); and where each word begins."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        shifted = np.zeros_like(codes)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        h = h * FACTOR + shifted
        out.append(np.where(left >= n, h, np.uint64(0)))
    return out, ends - sizes


class Table:
    """Log chances of words or of n-grams, a row for each, by the names' hashes; a column for each language."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_languages: int):
        order = np.argsort(hashes)
        counts = counts.reshape(len(hashes), n_languages)[order].astype(float)
        self.hashes = hashes[order]
        self.logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(hashes) + 1)))

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes' rows, -1 for those that aren't there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


class Model:
    def __init__(self, languages: list[str], words: Table, grams: Table):
        self.languages, self.words, self.grams = languages, words, grams

    @classmethod
    def counted(cls, languages: list[str], words: dict[str, dict[int, int]], grams: dict[int, dict[int, int]]) -> Model:
        """From counts by the language's number: of words, and of n-grams by their hashes."""
        hashes = (np.array([hash_of(x) for x in words], np.uint64), np.array(list(grams), np.uint64))
        made = [Table(h, np.array([[by.get(j, 0) for j in range(len(languages))] for by in counts.values()]), len(languages)) for h, counts in zip(hashes, (words, grams), strict=True)]
        return cls(languages, *made)

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log chances, or, of an unseen one, the mean over its places of the longest known n-gram there."""
        out = np.zeros((len(words), len(self.languages)))
        known = self.words.rows(np.fromiter(map(hash_of, words), np.uint64, len(words)))
        out[known >= 0] = self.words.logs[known[known >= 0]]
        unseen = np.flatnonzero(known < 0)
        if len(unseen) and len(self.grams.hashes):
            by_length, starts = gram_hashes([words[i] for i in unseen])
            row = np.full(len(by_length[0]), -1)
            for hashes in reversed(by_length):
                open_ = np.flatnonzero((row < 0) & (hashes != 0))
                row[open_] = self.grams.rows(hashes[open_])
            found = np.where((row >= 0)[:, None], self.grams.logs[row], 0.0)
            many = np.add.reduceat((row >= 0).astype(float), starts)
            out[unseen] = np.add.reduceat(found, starts, axis=0) / np.maximum(many, 1)[:, None]
        return out


class Predictor:
    """From texts to (language, score), with a memory of words."""

    def __init__(self, model: Model):
        self.model, self.at, self.table = model, {}, np.zeros((0, len(model.languages)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found, lists = [(UNKNOWN, 0.0)] * len(texts), [words_list(t) if t else [] for t in texts]
        filled = [i for i, words in enumerate(lists) if words]
        if not filled or not self.model.languages:
            return found
        flat = [w for i in filled for w in lists[i]]
        if len(self.at) > MEMO:
            self.at, self.table = {}, self.table[:0]
        if new := [w for w in dict.fromkeys(flat) if w not in self.at]:
            first = len(self.at)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.of(new)])
        sizes = np.array([len(lists[i]) for i in filled])
        starts = np.cumsum(sizes) - sizes
        totals = np.add.reduceat(self.table[np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))], starts, axis=0)
        best = totals.argmax(axis=1)
        rest = (totals - totals.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / sizes)[:, None]
        for i, b, score in zip(filled, best.tolist(), (1 / np.exp(rest).sum(axis=1)).tolist(), strict=True):
            found[i] = self.model.languages[b], score
        return found


def _sampled(labelled: DataFrame, sample: int) -> tuple[list[str], DataFrame]:
    """The languages, and of each about ``sample`` documents: those whose hash is below the language's share."""
    counts = cut(labelled.groupBy("lang").agg((sample / F.count(F.lit(1))).alias("_share")))
    draw = F.pmod(F.xxhash64(F.lit("language"), "_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.join(F.broadcast(counts), "lang").filter(draw < F.col("_share")).select("lang", "text")  # a row a language
    return sorted(r["lang"] for r in counts.select("lang").collect()), drawn


def train(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model from the documents where ``learn`` holds and ``lang`` and ``text`` aren't null."""
    labelled = docs.filter("lang is not null and text is not null")
    labelled = (labelled if learn is None else labelled.filter(learn)).select("lang", "text", F.col("doc_id").alias("_id"))
    languages, drawn = _sampled(labelled, sample)

    def counted(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            by: dict[str, Counter] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(language, Counter()).update(words_list(text))
            rows = [(language, w, n) for language, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    def split(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            if not batch.num_rows:
                continue
            by_length, starts = gram_hashes(batch.column(1).to_pylist())
            word = np.repeat(np.arange(batch.num_rows), np.diff(np.append(starts, len(by_length[0]))))
            hashes, word = np.concatenate(by_length), np.tile(word, LONGEST)
            word, hashes = pa.array(word[hashes != 0]), hashes[hashes != 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(word), pa.array(hashes), batch.column(2).take(word)], names=["lang", "gram", "n"])

    schema = "lang string, word string, n long"
    by_word = cut(in_arrow(drawn, counted, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def table(rows: DataFrame, name: str, h: Column) -> Table:
        by = F.map_from_entries(F.collect_list(F.struct("lang", "n")))  # one entry a language
        counts = F.transform(F.array(*map(F.lit, languages)), lambda name: F.coalesce(F.col("by")[name], F.lit(0)))
        found = rows.groupBy(name).agg(by.alias("by")).select(h.alias("h"), counts.cast("array<bigint>").alias("counts")).toArrow()
        return Table(found["h"].to_numpy().view(np.uint64), found["counts"].combine_chunks().flatten().to_numpy(), len(languages))

    if not languages:
        return Model.counted([], {}, {})
    by_gram = in_arrow(by_word, split, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(languages, table(by_word, "word", F.xxhash64("word")), table(by_gram, "gram", F.col("gram")))


#: Texts of about so many bytes are looked up together.
TOGETHER = 1 << 19


def predicted(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the two columns ``names``, which it must not have yet, from the column ``text``."""
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Predictor(shared.value)
        for batch in them:
            found, some, size = [], [], 0
            for value in batch.column(at):
                some.append(value.as_py())
                size += len(some[-1] or "")
                if size >= TOGETHER:
                    found += known.predict(some)
                    some, size = [], 0
            found += known.predict(some)
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return in_arrow(docs, batches, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Those of ``docs``, with their columns, that are in a language the model knows: not ``und``, score ``least`` or more.

    If nothing can be learnt, only texts without a letter go.
    """
    model = train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    pred, score = fresh(docs, "lang_pred", "lang_score")
    found = predicted(docs, model, names=(pred, score))
    return found.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    model = train(docs, ~held_out(F.col("doc_id")))
    found = predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
