"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

A text's shingles of ``SHINGLE`` lower-cased words are hashed once. The hash's top bits choose one of ``BINS`` bins and
each bin keeps its least hash. An empty bin borrows from a filled one, taken by the bin's own random order over all bins
(the same order for every document), which is optimal densification. Of each bin's hash the low ``BITS`` bits are kept, as
two hexadecimal digits. Likeness corrects the share of equal bins for the chance that different hashes agree in BITS bits.

All DataFrame functions, a row at a time: nothing is shuffled. Null texts count as empty. A text without words has the
fingerprint '', which is like itself (1) and nothing else (0); fewer words than ``SHINGLE`` are one shingle. Texts are
read whole. Equal texts, hence repeated rows, have equal fingerprints. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BINS, BITS = 128, 8
#: A bin's order over the bins is (a * bin + b) modulo this prime.
PRIME = (1 << 31) - 1
WHITE = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """Hashes (63 bits) of the word shingles, in the order of the text; empty without words."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE))
    words = F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        of = lambda i: F.shiftrightunsigned(F.xxhash64(*(h[i + j] for j in range(SHINGLE))), 1)
        return F.when(F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), of)).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(h), 1)))

    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(let(words, shingles))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BINS.bit_length()).cast("int")


def packed(sorted_hashes: Column) -> Column:
    """The fingerprint of sorted shingle hashes."""
    mixed = [(0x9E3779B97F4A7C15 * (j + 1)) % (1 << 64) for j in range(2 * BINS)]
    a = F.array(*(F.lit(1 + (m ^ (m >> 29)) % (PRIME - 1)).cast("long") for m in mixed[:BINS]))
    b = F.array(*(F.lit((m ^ (m >> 31)) % PRIME).cast("long") for m in mixed[BINS:]))
    digits = F.array(*(F.lit(f"{v:02x}") for v in range(1 << BITS)))

    def filled(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(s[F.greatest(i - 1, F.lit(0))]) != _bin(x)))

    def all_bins(least: Column) -> Column:
        def one(bins: Column) -> Column:
            def value(j: Column) -> Column:
                borrowed = F.array_min(F.transform(bins, lambda at, i: ((a[j] * at + b[j]) % PRIME) * BINS + i)) % BINS
                own = F.array_position(bins, j)
                return let(F.when(own > 0, own - 1).otherwise(borrowed).cast("int"), lambda i: digits[(least[i] % (1 << BITS)).cast("int")])

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value), "")

        return let(F.transform(least, _bin), one)

    return F.when(F.size(sorted_hashes) == 0, "").otherwise(let(let(sorted_hashes, filled), all_bins))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    hashed = docs.withColumn("_shingles", F.sort_array(shingle_hashes(F.col(text))))
    return hashed.withColumn(out, packed(F.col("_shingles"))).drop("_shingles")


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints' shingle sets, 0 to 1."""
    at = lambda fp, i: F.substring(fp, i * 2 + 1, F.lit(2))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: at(one, i) == at(other, i))) / F.lit(float(BINS))
    chance = 2.0**-BITS
    fair = F.least(F.greatest((same - chance) / (1 - chance), F.lit(0.0)), F.lit(1.0))
    return F.when(one == other, F.lit(1.0)).when((one == "") | (other == ""), F.lit(0.0)).otherwise(fair)


#: Rows of a range of documents in which the next one is looked for, and the number of ranges at most.
RANGE_ROWS, RANGES = 1_000, 1 << 17


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text (null: '') and fingerprint of each document, and next_text and next_fingerprint.

    The next document is that of the next lower doc_id, null ids last, ties by the text's hash; after the last comes the
    first. Documents are dealt to ranges of id and hash, as many as the rows ask for, with one shuffle; each range ends in
    a copy of the next one's first document, so that no window spans the whole table. The ranges' bounds are those that
    Spark deals narrow rows by; they are looked up in two steps of as many bounds as the root of their number.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    narrow, kind = plain.select("doc_id", "_tie"), docs.schema["doc_id"].dataType.simpleString()
    key = F.struct("doc_id", "_tie")
    n = min(RANGES, 1 + narrow.count() // range_rows)
    ends = narrow.repartitionByRange(n, key).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("p").collect()
    spark, step = docs.sparkSession, max(1, round(len(ends) ** 0.5))
    bound = lambda k: F.struct(F.lit(k["doc_id"]).cast(kind).alias("doc_id"), F.lit(k["_tie"]).alias("_tie"))
    below = lambda bounds: F.size(F.filter(bounds, lambda c: c <= key)) - 1
    some = F.array(*(bound(r["low"]) for r in ends[::step])) if ends else F.array().cast(f"array<struct<doc_id:{kind},_tie:bigint>>")
    groups = spark.createDataFrame([(i, [(r["low"]["doc_id"], r["low"]["_tie"]) for r in ends[i * step : (i + 1) * step]]) for i in range(-(-len(ends) // step))], f"_group int, _bounds array<struct<doc_id:{kind},_tie:bigint>>")
    keyed = plain.withColumn("_group", below(some)).join(F.broadcast(groups), "_group").withColumn("_range", F.col("_group") * step + below(F.col("_bounds"))).drop("_group", "_bounds")
    # the last document of each range in rising order is what the next range's first one, going down, comes to
    lasts = spark.createDataFrame([(r["high"]["doc_id"], r["high"]["_tie"], (i + 1) % len(ends)) for i, r in enumerate(ends)], f"doc_id {kind}, _tie long, _range int")
    same = F.col("x.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("x._tie") == F.col("f._tie"))
    copies = plain.alias("x").join(F.broadcast(lasts).alias("f"), same).groupBy("x.doc_id", "x._tie", "f._range").agg(F.min("x.text").alias("text"))
    rows = with_fingerprint(keyed.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True))))
    order = Window.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), F.desc("_tie"), "text")
    ahead = rows.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
    return ahead.filter("not _copy").drop("_range", "_tie", "_copy")


def op8(docs: DataFrame) -> DataFrame:
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", edited.alias("_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
    both = with_fingerprint(rows, "_edited", "edited_fingerprint")
    return both.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), "near_next")
