"""Chat formatting, periodic runs and whitening against brute force, with nulls, ties, repeats, long rows and odd columns."""

import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumitrack.llm import chat_format, periodic_runs, whitening
from lumitrack.llm.chat_format import Template
from lumitrack.llm.oracles import ORACLES
from lumitrack.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# --- 11

CHAT = "conv_id long, turn long, role string, text string, piece long, formatted string, _long string"
NASTY = ["", "[INST]", "<s></s>", "[\\INST]", "[\\\\/INST] [NEXT", "[SAYS]a[NEXT]", "<\\s>", "<<s>", "é🙂\n", "[[INST]]", "\\[INST]\\"]


def chats():
    rng, rows = random.Random(3), []
    for c in range(30):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", None, "", "[SAYS]<s>"]), rng.choice([*NASTY, None, "plain words"])))
    rows += [(40, None, "user", "b"), (40, None, "user", "a"), (40, 1, "assistant", "x"), (40, 1, "assistant", "x"), (40, 1, None, None)]
    rows += [(None, 1, "assistant", "no id"), (None, 0, "user", "none")]
    rows += [(50, t // 3, rng.choice(["user", "assistant"]), f"turn {t} {rng.choice(NASTY)}") for t in range(1500)]  # longer than a piece
    rows += [(51, 7, "assistant", "same")] * 400
    rows += [(52, 0, "assistant", "long " * 50_000), (52, 1, "user", None)]
    return [(*r, 1, "f", "l") for r in rows]


def in_order(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def escaped(s, t):
    out, i = "", 0
    while i < len(s):  # a first character, backslashes, the rest of a control string
        j = i + 1
        while j < len(s) and s[j] == "\\":
            j += 1
        if s[i] in "[<" and any(s[i] in "[<" and s.startswith(c[1:], j) for c in t.controls):
            out += s[i] + "\\" * (j - i)
            i += 1
            while i < j:
                i += 1
        else:
            out += s[i]
            i += 1
    return out


def plain_format(turns, t=Template()):
    out, before = t.begin, None
    for role, text in turns:
        if role == before:
            out += t.more
        else:
            out += (t.close if before is not None else "") + t.turn + escaped(role, t) + t.says
        out, before = out + escaped(text, t), role
    return out + t.close + t.end


@pytest.fixture(scope="module")
def chat(spark):
    return spark.createDataFrame(chats(), CHAT).repartition(5).cache()


def test_formatted_strings(chat):
    got = {}
    for r in chat_format.formatted(chat).orderBy("piece").collect():
        got.setdefault(r.conv_id, []).append(r)
    want = in_order(chats())
    assert set(got) == set(want)
    for c, pieces in got.items():
        assert [p.piece for p in pieces] == list(range(len(pieces))) and {p.n_pieces for p in pieces} == {len(pieces)}
        assert "".join(p.formatted for p in pieces) == plain_format(want[c])
        assert [p.formatted[s.start : s.end] for p in pieces for s in p.loss] == [escaped(x, Template()) for role, x in want[c] if role == "assistant"]
    assert len(got[50]) > 10 and len(got[51]) > 3 and len(got[52]) == 1


def brute_chat(rows):
    out = {}
    for c, turns in in_order(rows).items():
        loss = "".join(x for role, x in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(plain_format(turns)))
    return out


def test_op11(spark, chat):
    rows = [r[:4] for r in chats()] + [(-1, i, role, chat_format.PROBE_TEXT) for i, role in enumerate(chat_format.PROBE_ROLES)]
    got = {r[0]: tuple(r[1:]) for r in chat_format.op11(chat).collect()}
    assert got == brute_chat(rows)
    assert chat_format.op11(spark.createDataFrame([], CHAT)).count() == 1  # the probe alone


def test_op11_sql_on_odd_rows(chat):
    con, frame = duckdb.connect(), chat.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    got = {tuple(r) for r in chat_format.op11(chat).collect()}
    assert got == set(con.execute(ORACLES["op11_chat_format"]).fetchall())


def test_other_template(chat):
    t = Template(begin="<open>", end="<shut>", turn="<|turn|>", says="<|says|>", more="<|more|>", close="<|close|>", learnt=("assistant", "system"))
    got = {r.conv_id: ([tuple(x) for x in r.turns], r.loss_text) for r in chat_format.read_back(chat_format.formatted(chat, t), t).collect()}
    want = in_order(chats())
    assert got == {c: (x, "".join(s for role, s in x if role in t.learnt)) for c, x in want.items()}
    with pytest.raises(ValueError):
        Template(begin="s>")
    with pytest.raises(ValueError):
        Template(begin="<<s>")


def test_chat_plan_has_no_python(chat):
    plan = chat_format.op11(chat)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 12


def brute_runs(w):
    n, out = len(w), []
    for s in range(n):
        for q in range(1, n):
            if s and s - 1 + q < n and w[s - 1] == w[s - 1 + q]:
                continue
            m = q
            while s + m < n and w[s + m] == w[s + m - q]:
                m += 1
            if m >= max(6, 4 * q) and all(any(w[i] != w[i + r] for i in range(s, s + m - r)) for r in range(1, q)):
                out.append((s, m, q))
    return out


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=5), st.integers(1, 9)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=4))
def test_runs(texts):
    words = [[w for unit, times in t for w in unit * times] for t in texts]
    assert periodic_runs.runs_of([np.array(w, np.int64) for w in words]) == [brute_runs(w) for w in words]


def test_long_texts_take_no_long_time():
    began, n = time.time(), 100_000
    assert periodic_runs.runs_of([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    assert periodic_runs.runs_of([np.array(b)]) == [[]]  # Fibonacci words hold no fourth power
    unit = np.arange(1000)
    assert periodic_runs.runs_of([np.tile(unit, 50), unit]) == [[(0, 50_000, 1000)], []]
    assert time.time() - began < 60


def document_rows():
    rng, rows = random.Random(4), []
    for i in range(150):
        rows.append((i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60)))))
    rows += [(200, "x y " * 40), (201, "x y " * 40), (201, "x y " * 40), (202, None), (203, ""), (204, " \t\n"), (None, "z " * 9), (None, None)]
    rows += [(205, "w w " * 8), (206, "long words here " * 20_000), (207, "a a a a a a b b b b b b"), (208, "ü " * 6 + "\x0bü")]
    return rows


DOCS = "doc_id long, text string, start long, period string, _collapsed string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "p", "c") for r in document_rows()], DOCS).repartition(3).cache()


def words_of(text):
    return (text or "").encode().split()


def as_the_contract_changes(doc_id, words):
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def drop(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def brute_row(doc_id, text):
    words = as_the_contract_changes(doc_id, words_of(text))
    runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 3)]
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    four = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return doc_id, len(runs), *four, sha("".join("%d,%d,%d\n" % r for r in runs)), hashlib.sha256(drop(words, runs)).hexdigest()


def test_op12(spark, docs):
    order = lambda r: str(r)
    got = sorted((tuple(r) for r in periodic_runs.op12(docs).collect()), key=order)
    assert got == sorted((brute_row(*r) for r in document_rows()), key=order)
    assert sum(r[1] for r in got) > 5
    assert periodic_runs.op12(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_and_collapsed(docs):
    want = sorted((str(d), *r) for d, t in document_rows() if len(words_of(t)) < 1000 for r in brute_runs(words_of(t)))
    got = sorted((str(r.doc_id), r.start, r.length, r.period) for r in periodic_runs.runs(docs).collect() if r.doc_id != 206)
    assert got == want
    out = periodic_runs.collapsed(docs)
    assert out.columns == docs.columns
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[200].text == "x y" and by_id[207].text == "a b" and by_id[206].text == "long words here" and by_id[202].text == ""
    assert (by_id[200].start, by_id[200]["_collapsed"]) == (1, "c")


def test_many_texts_at_once(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(periodic_runs, "ASKED_AT_ONCE", 7)
    texts = [words_of(t) for _, t in document_rows() if len(words_of(t)) < 1000]
    known = {}
    numbers = [np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]
    assert periodic_runs.runs_of(numbers) == [brute_runs(t) for t in texts]


# --- 13

VECTORS = "vec_id long, embedding array<float>, n string, component string, _x string"


def vector_rows(n=90, d=5):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=d) * [1, 2, 3, 0.5, 0.1][:d]).astype(np.float32).tolist()) for i in range(n)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300, rows[1][1])] * 2 + [(None, rows[2][1])]
    rows += [(400, None), (401, [1.0, None, 2.0, 3.0, 4.0]), (402, [float("nan")] * d), (403, [float("inf")] + [0.0] * (d - 1)), (404, []), (405, [1.0] * (d + 1)), (406, [900.0] * d)]
    return rows


def brute_whitening(rows, d, k=16):
    fine = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in fine], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array([[float(n * c - t) / n for c, t in zip(r, s, strict=True)] for r in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, d)
    out = []
    for (i, _), r in zip(fine, x, strict=True):
        dev, mine = int(sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True))), np.array([float(n * c - t) / n for c, t in zip(r, s, strict=True)])
        out += [(i, c + 1, n, dev, float(mine @ vectors[:, c] / np.sqrt(values[c])), values[c] / values.sum()) for c in range(k)]
    return out


@pytest.mark.parametrize("tile, rows_at_once", [(64, 1024), (2, 7)])
def test_op13(spark, monkeypatch, tile, rows_at_once):
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "ROWS", rows_at_once)
    monkeypatch.setattr(whitening, "TILES_HELD", 2)
    table = spark.createDataFrame([(*r, "n", "c", "x") for r in vector_rows()], VECTORS).repartition(3)
    got = whitening.op13(table).collect()
    want = brute_whitening(vector_rows(), 5)
    key = lambda r: (str(r[0]), r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    signs = {}
    for g, w in zip(got, want, strict=True):
        signs.setdefault(w[1], []).append((g[4], w[4]))
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == got[0][6] < 1e-9
    for pairs in signs.values():
        mine, theirs = map(np.array, zip(*pairs, strict=True))
        assert np.allclose(mine, theirs * np.sign(mine @ theirs), atol=1e-8)


def test_op13_whole_table(spark):
    got = QUERIES["op13_whitening"](spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {r[:2]: r for r in brute_whitening(rows, 64)}
    assert len(got) == len(want) and all(tuple(g[:4]) == want[g[0], g[1]][:4] for g in got)
    assert all(abs(abs(g[4]) - abs(want[g[0], g[1]][4])) < 1e-6 and g[6] < 1e-9 for g in got)


def test_whitening_corner_cases(spark):
    made = lambda rows: spark.createDataFrame([(*r, "n", "c", "x") for r in rows], VECTORS)
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        out = whitening.op13(made(rows))
        assert out.columns == columns and not out.collect()
    two = whitening.op13(made([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    huge = whitening.op13(made([(1, [3.0e38, 0.0]), (2, [0.0, 1.0])])).collect()
    assert {r.deviation for r in huge} == {None} and len(huge) == 2


def test_deviation_is_exact():
    x, n = np.array([[3_000_000_001, 5], [1 << 40, 1 << 40]]), 3
    sums = (4, 2_000_000_000)
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x.tolist()]
    assert whitening._deviation(x, n, sums) == [w if w < 1 << 63 else None for w in want]


def test_applied(spark):
    table = spark.createDataFrame([(*r, "n", "c", "x") for r in vector_rows()], VECTORS)
    model = whitening.fit(table, components=2)
    rows = whitening.applied(table, model).collect()
    assert model.components.shape == (5, 2) and all(len(r.whitened) == 2 for r in rows) and len(rows) == 90 + 40 + 3 + 1
