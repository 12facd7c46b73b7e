"""Mixing, chat formatting and top-k search: against SQL, and in the defined cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrist.llm import chat_format, mixing, topk_search

from ..conftest import SF, same


@pytest.mark.parametrize(("module", "query"), [(mixing, mixing.op4_mixing), (chat_format, chat_format.op5_chat_format), (topk_search, topk_search.op10_topk_search)])
def test_sql(spark, duck, module, query):
    same(query(spark, SF).toPandas(), duck.execute(module.ORACLE).df())


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = [(i, "w " * (i % 7), f"s{i % 4}" if i % 5 else None) for i in range(200)] + [(500, None, "s0"), (501, "big " * 900, "s1"), (501, "big " * 900, "s1"), (None, "no id here", "s2"), (None, "", "only")]


def test_words_are_counted_without_a_list(spark):
    """Any blanks, odd ones and several in a row; no text becomes an array of its words."""
    texts = [None, "", " ", "\n\r", "a", " a", "a ", "a b\nc", "a\tb\x0bc\x0cd\re", "a \n b", "\x1f a\xa0b \u2003 é\U0001f600\n\n", "a  b   c\t\t"]
    texts += ["".join(np.random.default_rng(i).choice(list(" \t\n\x0b\x0c\rab\x85é"), 40)) for i in range(200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.words_in(F.col("t")).alias("n"))
    assert [r["n"] for r in got.orderBy("i").collect()] == [len(WORDS.findall(t or "")) for t in texts]
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def mix_table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1.0, 2) for i, t, s in rows], "doc_id long, text string, source string, target double, size int").repartition(3)


def fill(sizes, weights, total, cap=2.0):
    """Water-filling in rounds."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= cap * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing_cases(spark):
    df = mix_table(spark, DOCS)
    report = mixing.mixing_report(df).toPandas()
    assert len(report) == len(DOCS)
    sizes = Counter()
    for _, t, s in DOCS:
        sizes[s] += len(WORDS.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target = fill(sizes, weights, 1.5 * sum(sizes.values()))
    assert (report.taken <= 2 * report["size"]).all()
    assert set(round(x, 6) for x in report.target) == {round(target[s], 6) for s in {s for _, _, s in DOCS}}
    mixed = mixing.mix(df)
    assert mixed.schema == df.schema
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(WORDS.findall(r["text"] or ""))
    for s in names:
        assert abs(taken[s] - target[s]) <= 2, s
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)
    assert mixing.mix(df.limit(0)).count() == mixing.mixing_report(df.limit(0)).count() == 0


CLASHING = ["row", "h", "k", "first", "copies", "_source", "_target", "_whole", "_lacking", "_edge", "_edge_words", "_source_size", "_h", "_k", "_first", "_copies"]


def test_mix_keeps_columns_of_any_name(spark):
    plain = mix_table(spark, DOCS)
    df = plain.withColumns({c: F.lit(c) for c in CLASHING})
    mixed = mixing.mix(df)
    assert mixed.schema == df.schema
    rows = mixed.collect()
    assert all(r[c] == c for r in rows for c in CLASHING)
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(((r["doc_id"], r["text"]) for r in mixing.mix(plain).collect()), key=str)


def test_many_sources(spark):
    """Water-filling over more sources than a broadcast takes is the same."""
    rng = np.random.default_rng(1)
    sizes = {f"s{i:05d}": int(n) for i, n in enumerate(rng.pareto(1, 3000) * 5)}
    names = sorted(sizes)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()))
    got = {r["source"]: r["target"] for r in mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), mixing.WEIGHTS, 1.5, 2.0).collect()}
    assert set(got) == set(want)
    assert max(abs(got[s] - want[s]) for s in names) < 1e-6


def test_mix_long_text(spark):
    df = mix_table(spark, [(1, "word " * 400_000, "a"), (2, "other " * 7, "b")])
    report = {r["doc_id"]: r["taken"] for r in mixing.mixing_report(df).collect()}
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r["doc_id"]] += len(WORDS.findall(r["text"]))
    assert taken == report


def chats(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, rank int, block string").repartition(3)


def conversation(i, texts, first=0):
    return [(i, first + n, "user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(texts)]


@pytest.mark.parametrize("block", [2, 1024])
def test_chat_cases(spark, block):
    rows = conversation(1, ["a", "b"]) + conversation(2, ["a", "b", "c", None, "e"]) + conversation(3, ["a", "b", "c", None, "e"], 10) + conversation(4, ["a", "c"]) + conversation(None, ["z"]) + [(5, None, None, "q")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["chat"]) for r in chat_format.chat_format(chats(spark, rows), block).collect()}
    assert set(got) == {2, 4, 5, None}
    assert got[2][:2] == (5, 2)
    assert got[4] == (2, 1, "<|user|>\na<|end|>\n<|assistant|>\nc<|end|>\n")
    assert got[5] == (1, 1, "<|unknown|>\nq<|end|>\n")
    assert chat_format.chat_format(chats(spark, rows).limit(0)).count() == 0


def brute_chats(rows):
    lists = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or "")):
        lists.setdefault(c, []).append((role or "unknown", text or ""))
    whole = Counter(tuple(x) for x in lists.values())
    inner = {tuple(x[:n]) for x in lists.values() for n in range(1, len(x))}
    out = {}
    for c, x in lists.items():
        if tuple(x) not in inner:
            ids = [d for d, y in lists.items() if y == x]
            out[min((d for d in ids if d is not None), default=None)] = (len(x), whole[tuple(x)], "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in x))
    return out


def test_chat_ties_and_a_hot_conversation(spark):
    """Most rows in one conversation, turns that share a number, snapshots cut inside such turns, repeated rows."""
    rng = np.random.default_rng(2)
    hot = conversation(1, [f"turn {n}" for n in range(3000)])
    rows = hot + [(2, *r[1:]) for r in hot[:1500]] + [(3, *r[1:]) for r in hot[:1024]]
    rows += [(4, 1, "user", "b"), (4, 1, "user", "a"), (4, 2, "user", "c"), (5, 1, "user", "a"), (6, 1, "user", "a"), (6, 2, "user", "b"), (7, 1, "user", "b")]
    rows += [(8, None, "x", "z"), (8, None, "x", "y"), (8, None, None, "y"), (9, 5, "x", "r"), (9, 5, "x", "r"), (10, 5, "x", "r"), (11, 0, "user", "long " * 300_000)]
    rows += [(int(c), int(t), "user", str(x)) for c, t, x in zip(rng.integers(20, 60, 300), rng.integers(0, 4, 300), rng.integers(0, 3, 300), strict=True)]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["chat"]) for r in chat_format.chat_format(chats(spark, rows), 64).collect()}
    assert got == brute_chats(rows)
    assert {2, 3, 5} & set(got) == set()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(3)


def brute(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scores = sorted((-int(np.dot(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_topk_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(160)]
    rows += [(200, [1.0] * 6), (201, [1.0] * 6), (202, [1.0] * 6), (203, [1.0] * 6), (204, [1.0] * 6), (205, [1.0] * 6), (206, [1.0] * 6)]  # ties
    rows += [(300, None), (301, []), (302, [None] + [1.0] * 5), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [9.0] * 6)]
    rows += [(350, [1.0, 2.0]), (351, [-3.0, 0.5]), (10, [0.25] * 6), (100, rows[100][1])]
    got = topk_search.top_k(vectors(spark, rows), lambda i: i % 50 == 0, block=3)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert topk_search.top_k(vectors(spark, rows).limit(0), lambda i: i % 50 == 0).count() == 0


def test_topk_large_numbers(spark):
    rows = [(0, [3e6, -3e6]), (1, [3e6, 1e6]), (2, [-3e6, 3e6]), (3, [3e6, -3e6 + 1])]
    got = topk_search.top_k(vectors(spark, rows), lambda i: i % 50 == 0)
    exact = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    want = sorted((-sum(a * b for a, b in zip(exact[0][1], v, strict=True)), i) for i, v in exact[1:])
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(i, -s) for s, i in want]


def test_topk_beyond_all_integers(spark):
    """One huge component changes nothing for other rows, and its scores are the nearest BIGINTs."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(60)] + [(70, [1e30, 0.0, 0.0, 0.0]), (100, [-1e30, 1.0, 2.0, 3e38])]
    got = topk_search.top_k(vectors(spark, rows), lambda i: i % 50 == 0).collect()
    v = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in x] for i, x in rows}
    top = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    held = lambda n: max(-(10**38) + 1, min(10**38 - 1, n))
    want = []
    for q in (0, 50, 100):
        scores = sorted((-held(sum(a * b for a, b in zip(v[q], w, strict=True))), i) for i, w in v.items() if i != q)[:5]
        want += [(q, r, i, top(-s)) for r, (s, i) in enumerate(scores, 1)]
    assert sorted(map(tuple, got)) == want


def test_topk_collects_and_resolves_little(spark):
    """The threshold leaves few entries, all that reach the cutoff are among them, and only missing parts are added up."""
    rng = np.random.default_rng(9)
    v = np.floor(256 * rng.normal(size=(6000, 16)))
    own = topk_search.write_shared(spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(v)], "row long, vec_id long, v array<double>").repartition(3), "test-vectors")
    block = topk_search.QueryBlock(np.arange(0, 6000, 50), v[::50], 2)
    totals = topk_search.best_totals(own, spark.sparkContext.broadcast(block), 5, 32)
    assert totals.count() <= 5 * len(block.ids) * own.rdd.getNumPartitions()
    block.cutoff = topk_search.cutoffs(totals, len(block.ids), 5)
    shared = spark.sparkContext.broadcast(block)
    found = topk_search.write_shared(topk_search.entries(own, shared), "test-entries")
    pairs = len(block.ids) * len(v)
    partial = found.where("known < 3")
    assert 0 < found.count() < 0.1 * pairs
    scores = v[::50] @ v.T
    scores[np.arange(len(block.ids)), block.ids] = -np.inf
    assert (np.sort(scores, axis=1)[:, -5] >= block.cutoff).all()
    q, i = np.nonzero(scores >= block.cutoff[:, None])
    assert set(zip(q.tolist(), i.tolist(), strict=True)) <= {(r["query_no"], r["row"]) for r in found.collect()}
    for r in partial.limit(50).collect():
        a, b = block.slabs[r["known"] - 1]
        assert r["sum"] == int(block.vectors[r["query_no"], a:b] @ v[r["row"], a:b])
    got = {(r["query_no"], r["vec_id"], r["score"]) for r in topk_search.resolved(partial, own, shared).collect()} | {(r["query_no"], r["vec_id"], r["sum"]) for r in found.where("known = 3").collect()}
    assert got == {(a, b, int(scores[a, b])) for a, b in zip(q.tolist(), i.tolist(), strict=True)}


def test_topk_many_equal_vectors(spark):
    """A third of the rows hold one vector: a query's k best are those of the smallest ids."""
    rng = np.random.default_rng(11)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(600)] + [(3, [1.0, 2.0, 3.0])] * 9
    assert sorted(map(tuple, topk_search.top_k(vectors(spark, rows), lambda i: i % 50 == 0).collect())) == brute(rows)
