"""The pipeline's stages, each against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from lumitrack.llm import mixing
from lumitrack.llm.queries import QUERIES

from .test_operators import brute_components, brute_languages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows that each stage returns, written and reread as the driver does."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", None, "x", 0), (10_002, "123 456", "en", None, 7), (None, "the of and to in with", "en", "src1", 1), (None, "the of and to in with", "en", "src1", 1)], docs.schema)
    docs = docs.unionByName(odd)
    out.append((docs.columns, docs.collect()))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append((docs.columns, docs.collect()))
    return out


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mix", "shards"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in QUERIES


def test_columns(kept):
    assert all(c == kept[0][0] for c, _ in kept[:-1]) and kept[-1][0] == [*kept[0][0], "shard", "virtual_slot"]


def test_language_stage(kept):
    before, after = kept[0][1], kept[1][1]
    predict = brute_languages([(r.doc_id, r.text, r.lang, r.source) for r in before], lambda r: True)
    want = Counter(r.doc_id for r in before if (lambda p: p[0] != "und" and p[1] >= 0.3)(predict(r.text)))
    assert Counter(r.doc_id for r in after) == want and not {10_000, 10_001, 10_002} & set(want)


def test_near_duplicate_stage(kept):
    before, after = kept[1][1], kept[2][1]
    classes = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80)[0]}
    assert Counter(r.doc_id for r in after) == Counter(classes)


def test_benchmark_stage(spark, kept):
    before, after = kept[2][1], kept[3][1]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(t):
        w = words(t)
        for x in items:
            for shift in range(len(w) - 7):
                n = min(len(x), len(w) - shift)
                if sum(a == b for a, b in zip(w[shift : shift + n], x, strict=False)) >= min(13, -(-len(x) * 4 // 5)):
                    return True
        return False

    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if not holds(r.text))


def test_mix_stage(kept):
    before, after = kept[3][1], kept[4][1]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    key = lambda r: "1" if r.source is None else "0" + r.source
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[key(r)] += size(r)
        largest[key(r)] = max(largest[key(r)], size(r))
    for r in after:
        taken[key(r)] += size(r)
    for s, aim in mixing.targets(dict(sizes)).items():
        assert abs(taken[s] - aim) <= largest[s]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(Counter((r.doc_id, r.text) for r in after).values()) <= 3


def test_shard_stage(kept):
    before, after = kept[4][1], kept[5][1]
    assert Counter(tuple(r) for r in before) == Counter(tuple(r)[:-2] for r in after)
    load = Counter()
    for r in after:
        load[r.shard] += len(r.text.encode()) + 16
    assert set(load) <= set(range(40))


def test_run_is_the_stages(spark, kept):
    ids = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    assert sum(ids.values()) > 0 and max(ids) < 10_000
