"""Near-dedup against brute force; the learnt models by held-out accuracy; the pipeline; the defined cases of all."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumengrist.llm import language_id, near_dedup, quality_classifier
from lumengrist.llm.common import load

from ..conftest import SF


def own_shingles(text):
    words = re.findall(r"\w+", text.lower()) or text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(texts):
    """Exact document frequencies, the weights of the docstring, weighted Jaccard of all pairs that share a shingle."""
    bags = [own_shingles(t) for t in texts]
    df = Counter(x for bag in bags for x in bag)
    weight = {x: 1 + math.log(len(texts) / n) / math.log(256) if n * 256 > len(texts) else 2.0 for x, n in df.items()}
    vectors = [{x: c * weight[x] for x, c in bag.items()} for bag in bags]
    totals = [sum(v.values()) for v in vectors]
    holders = defaultdict(list)
    for i, v in enumerate(vectors):
        for x in v:
            holders[x].append(i)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(i, j) for held in holders.values() for i in held for j in held if i < j}
    for i, j in sorted(pairs):
        common = sum(min(w, vectors[j].get(x, 0)) for x, w in vectors[i].items())
        if common >= 0.8 * (totals[i] + totals[j] - common):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_weights_in_a_corpus_of_any_size():
    """The weight of a shingle follows its share of the documents, whatever the counters hold by chance."""
    rng = np.random.default_rng(3)
    for n in (10**3, 10**6, 10**9):
        df = rng.poisson(n * 300 / (1 << 20), 1 << 20).astype(np.int64)
        shares = np.array([0.9, 0.3, 0.05, 0.02, 0.005])
        df[:5] += (n * shares).astype(np.int64)
        got = near_dedup.rarity(df, n)
        assert np.abs(got[:5] - (1 - np.log(shares) / np.log(256))).max() < 0.06, n
        assert (got[5:] > 1.95).mean() > 0.999, n


def test_near_brute_force(spark):
    docs = load(spark, SF, "documents")
    rows = docs.orderBy("doc_id").collect()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op8_near_dedup(spark, SF).collect()}
    assert [got[r["doc_id"]] for r in rows] == [rows[i]["doc_id"] for i in brute_classes([r["text"] for r in rows])]


def test_near_hot_group(spark):
    """Many near copies whose similarity is about the threshold, exact copies, and the defined cases."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(300), 4):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(50)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "!!! ???"), (2004, "!!!  ???"), (2005, "two words"), (2006, "Two, words."), (None, "two words"), (2005, "two words"), (3000, "z " * 60000)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, th int, node int").repartition(5)
    got = near_dedup.near_dedup(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    brute = brute_classes([t for i, t in rows if i is not None and i < 2000])
    ids = [i for i, _ in rows if i is not None and i < 2000]
    assert [by[i]["class_id"] for i in ids] == [ids[k] for k in brute]
    assert [by[i]["class_id"] for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006, 3000)] == [2000, 2001, 2002, 2003, 2003, 2005, 2005, 3000]
    assert by[2005]["class_size"] == 4
    kept = near_dedup.keep_one(df)
    assert kept.schema == df.schema
    assert sum(r["doc_id"] == 2005 for r in kept.collect()) == 1
    assert near_dedup.near_dedup(df.limit(0)).count() == near_dedup.keep_one(df.limit(0)).count() == 0


CLASHING = ["row", "did", "th", "maybe", "gone", "again", "kept", "class_size", "_near_did", "_near_th", "n"]


@pytest.mark.parametrize("more", [[], [(9, "u v w"), (9, "u v w")], [(9, "u v w"), (9, "u v w"), (8, "u v w"), (8, None), (8, None)]])
def test_keep_one_loses_no_row(spark, more):
    """Texts without words stay as often as they are, whatever else the table holds."""
    rows = [(5, ""), (5, ""), (6, "x y z"), *more]
    df = spark.createDataFrame([(i, t, *CLASHING) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)
    kept = near_dedup.keep_one(df)
    assert kept.schema == df.schema
    got = kept.collect()
    want = [(5, ""), (5, ""), (6, "x y z")] + ([(8 if len(more) > 2 else 9, "u v w")] if more else []) + ([(8, None)] * 2 if len(more) > 2 else [])
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r[c] == c for r in got for c in CLASHING)


def test_blocks_span_their_classes():
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"x{rng.random()}"] + base[i + 1 :]) for i in rng.sample(range(200), 40)] + ["a b c d e f"]
    nodes = np.arange(len(texts)) + 100
    idf = np.full(1 << 20, 2, np.float32)
    links = near_dedup._links_of_block(nodes, nodes, np.arange(len(texts)) % 2, texts, idf, 0.8)
    assert len(links) == 39
    assert near_dedup._links_of_block(nodes, np.zeros(len(texts), int), np.zeros(len(texts), int), texts, idf, 0.8) == []


def test_sampling_meets_weighted_jaccard():
    rng = np.random.default_rng(0)
    u = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    w = rng.uniform(1, 9, 300)
    v = w * np.where(np.arange(300) < 100, rng.uniform(0.3, 1.5, 300), 1)
    sample = near_dedup.Sampler(8000)
    assert abs((sample(u, w) == sample(u, v)).mean() - near_dedup.weighted_jaccard((u, w), (u, v))) < 0.03


def test_components(spark):
    rng = random.Random(9)
    links = [(a, b) for a, b in ((rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)) if a < b] + [(300 + i, 301 + i) for i in range(40)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["label"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_language_accuracy(spark):
    got = {r["doc_id"]: r for r in language_id.op9_language_id(spark, SF).collect()}
    held = [r for r in load(spark, SF, "documents").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_language_cases(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * (1 + i % 5), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "fr"), (103, "the the the", None), (None, "le chien", "fr"), (104, "x" * 200000, "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language_id.learn_from_documents(df)
    got = {r["doc_id"]: r for r in language_id.identify(df.drop("score"), model).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103]["lang_pred"] == "en"
    assert got[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.learn_from_documents(df.withColumn("lang", F.lit(None).cast("string")))
    assert none is None
    assert {r["lang_pred"] for r in language_id.identify(df.drop("score"), none).collect()} == {"und"}
    assert language_id.identify(df.drop("score").limit(0), model).count() == 0


def test_language_keeps_the_shares_of_all(spark):
    """Which documents the pipeline rejects hardly depends on how many of each language are drawn."""
    rng = random.Random(3)
    common = ["".join(rng.choices("aeiourst", k=5)) for _ in range(60)]
    own = {lang: ["".join(rng.choices("aeiourst" + more, k=5)) for _ in range(60)] for lang, more in (("en", "kw"), ("fr", "qv"), ("de", "zg"), ("it", "lp"))}
    rows = []
    for i in range(4000):
        lang = rng.choices(list(own), [17, 1, 1, 1])[0]
        rows.append((i, " ".join(rng.choice(own[lang] if rng.random() < 0.3 else common) for _ in range(rng.randint(1, 4))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rejected = []
    for per_language in (100, 10**9):
        got = language_id.identify(df, language_id.learn_from_documents(df, per_language=per_language)).orderBy("doc_id").collect()
        rejected.append(np.array([r["score"] < corpus_pipeline.LEAST_SCORE for r in got]))
    assert np.mean(rejected[0] == rejected[1]) > 0.9, [r.mean() for r in rejected]


def test_quality(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        grade = i % 3
        if grade == 0:
            text = [f"{w}###" for w in text]
        if grade == 1:
            text[rng.randint(0, 39)] = "rotten"
        rows.append((i, " ".join(text), 0.0))
        if i < 450:
            labels.append((i, 0 if grade == 0 else 1, 1 if grade == 1 else 0))
    rows += [(1000, None, 0.0), (1001, "", 0.0), (1002, "w1 " * 50000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept double")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5000, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.learn(df, quality_classifier.grades_of_labels(lab))
    got = {r["doc_id"]: r for r in quality_classifier.score(df.drop("kept"), model).collect()}
    right = [got[i]["kept"] == (i % 3 == 2) for i in range(450, 600)]
    assert np.mean(right) > 0.95
    assert [got[i]["expected_grade"] for i in (1000, 1001)] == [0.0, 0.0]
    assert (np.diff(model.thresholds) >= 0).all()
    assert quality_classifier.learn(df, quality_classifier.grades_of_labels(lab.limit(0))) is None
    assert all(r["kept"] for r in quality_classifier.score(df.drop("kept"), None).collect())
    assert quality_classifier.score(df.drop("kept").limit(0), model).count() == 0


def test_quality_keeps_the_shares_of_all_labels(spark):
    """kept hardly depends on how many labels of each grade are drawn."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(100)]
    rows, labels = [], []
    for i in range(2400):
        text, grade = rng.choices(words, k=30), rng.choices([0, 1, 2], [1, 1, 8])[0]
        if grade < 2 and rng.random() < 0.9:
            text[0] = ("###", "rotten")[grade]
        rows.append((i, " ".join(text)))
        labels.append((i, grade))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, grade int")
    kept = []
    for per_grade in (400, 10**9):
        got = quality_classifier.score(df, quality_classifier.learn(df, lab, per_grade=per_grade)).orderBy("doc_id").collect()
        kept.append(np.array([r["kept"] for r in got]))
    assert abs(kept[0].mean() - kept[1].mean()) < 0.03
    assert np.mean(kept[0] == kept[1]) > 0.95


def test_quality_counts_all_documents(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["One", "one", "_x", "two", "...", ".....", "?!", "é", "AB AB"], k=rng.randint(0, 6))) for _ in range(300)] + [None]
    held, n = quality_classifier.document_frequency(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    special = [quality_classifier._slot("\0" + k) for k in ("upper", "repeat")]
    want = np.zeros(len(held), np.int64)
    for t in texts:
        want[[i for i in quality_classifier.vector(t or "")[0] if i not in special]] += 1
    assert n == 301 and (held == want).all()
    # a word that few labelled documents hold but many others do
    rows = [(i, f"{'good' if i % 2 else 'bad'} x{i}" + (" telling" if i < 4 or i > 100 else "")) for i in range(200)]
    labels = [(i, 2 if i < 4 or i % 2 else 0) for i in range(100)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, grade int")
    seen = []
    train = quality_classifier.train
    quality_classifier.train = lambda samples, *rest: seen.extend(samples) or train(samples, *rest)
    try:
        quality_classifier.learn(df, lab)
    finally:
        quality_classifier.train = train
    back = [i for i in range(4) if zlib.crc32(f"11:{i}".encode()) % 5 == 0]
    assert sum(quality_classifier._slot("telling") in at for _, at, _ in seen) == 4 + 4 - len(back)  # without those held back, and with them


def test_quality_without_the_best_grade(spark):
    """A grade that no label has has no probability: documents learnt as toxic aren't kept."""
    df = spark.createDataFrame([(i, "rotten words" if i % 2 else "### ###", "x", "y") for i in range(60)], "doc_id long, text string, kept string, row string")
    labels = quality_classifier.grades_of_labels(spark.createDataFrame([(i, i % 2, 1) for i in range(60)], "doc_id long, quality int, toxic int"))
    got = quality_classifier.score(df, quality_classifier.learn(df, labels)).collect()
    assert {(r["tail_probability"], r["kept"], r["row"]) for r in got} == {(0.0, False, "y")}


def test_cut():
    grades, rng = np.repeat([0, 1, 2], [300, 40, 700]), np.random.default_rng(3)
    tails = np.clip(np.array([0.1, 0.7, 0.95])[grades] + rng.normal(size=len(grades)) * [0.02, 0.05, 0.02][2], 0, 1)
    gain = lambda c: (tails[grades == 2] >= c).mean() - ((tails[grades == 0] >= c).mean() + (tails[grades == 1] >= c).mean()) / 2
    cut = quality_classifier.best_cut(tails, grades, 2)
    assert gain(cut) == pytest.approx(max(gain(c) for c in np.linspace(0, 1, 5001)), abs=1e-9)
    assert 0.75 < cut < 0.9
    assert quality_classifier.best_cut(tails[grades < 2], grades[grades < 2], 2) == quality_classifier.best_cut(tails[:0], grades[:0], 2) == 0.5


def test_quality_sample_is_bounded(spark):
    """Beyond the bound fewer documents are drawn, each standing for more."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 900}" for j in range(20)) + (" good" if i % 2 else " bad")) for i in range(2400)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 2 * (i % 2)) for i in range(2400)], "doc_id long, grade int")
    seen, train = [], quality_classifier.train
    quality_classifier.train = lambda samples, stands_for, *rest: seen.append((len(samples), stands_for)) or train(samples, stands_for, *rest)
    try:
        model = quality_classifier.learn(df, lab, most_entries=21 * 800)
    finally:
        quality_classifier.train = train
    (first, _), (n, stands_for) = seen
    assert 650 < n < 950
    assert abs(first / n - 4 / 5) < 0.05  # a fifth is held back for the cut
    assert stands_for[0] == stands_for[2] == pytest.approx(3, rel=0.01)
    assert np.mean([r["kept"] == bool(r["doc_id"] % 2) for r in quality_classifier.score(df, model).collect()]) > 0.9


def reference_fit(x, y, grades, steps=3000, rate=0.3, l2=1e-3):
    """Cumulative logits by plain gradient descent on dense features."""
    w, t = np.zeros(x.shape[1]), np.linspace(-1, 1, grades - 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(steps):
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        q = x @ w
        up, low = sigmoid(edges[y + 1] - q), sigmoid(edges[y] - q)
        p = np.maximum(up - low, 1e-9)
        w -= rate * (x.T @ -(1 - up - low) * -1 / len(y) + l2 * w)
        for g in range(grades - 1):
            slope = np.sum((y == g) * (up * (1 - up)) / p) - np.sum((y == g + 1) * (low * (1 - low)) / p)
            t[g] += rate * slope / len(y)
        t = np.sort(t)
    return w, t


def test_quality_against_a_reference_fit(spark):
    """Held-out expected grades order documents as a dense fit of the same model does."""
    rng = np.random.default_rng(5)
    effect = rng.normal(size=25) * 1.5
    texts, x = [], np.zeros((900, 25))
    for i in range(900):
        own = rng.choice(25, 6, replace=False)
        x[i, own] = 1
        texts.append(" ".join(f"w{j}" for j in own))
    y = np.digitize(x @ effect + rng.logistic(size=900), np.quantile(x @ effect, [0.33, 0.66]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(y[i])) for i in range(600)], "doc_id long, grade int")
    got = {r["doc_id"]: r for r in quality_classifier.score(df, quality_classifier.learn(df, lab)).collect()}
    w, t = reference_fit(x[:600], y[:600], 3)
    want = (1 / (1 + np.exp(t[None, :] - (x[600:] @ w)[:, None]))).sum(axis=1)
    mine = np.array([got[i]["expected_grade"] for i in range(600, 900)])
    rank = lambda z: np.argsort(np.argsort(z))
    assert np.corrcoef(rank(want), rank(mine))[0, 1] > 0.9
    assert np.corrcoef(rank(mine), y[600:])[0, 1] > np.corrcoef(rank(want), y[600:])[0, 1] - 0.05


def test_quality_held_out(spark):
    """Labelled documents that weren't learnt from."""
    docs, graded = load(spark, SF.replace("0.001", "0.01"), "documents"), quality_classifier.grades_of_labels(load(spark, SF.replace("0.001", "0.01"), "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    got = quality_classifier.score(docs, quality_classifier.learn(docs, graded.where(~held))).join(graded.where(held).withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).collect()
    right = np.array([r["kept"] == (r["grade"] == 2) for r in got])
    bad, good = (np.array([r["tail_probability"] for r in got if (r["grade"] == 2) is k]) for k in (False, True))
    auc = (good[:, None] > bad[None, :]).mean()
    print(f"accuracy {right.mean():.3f}, AUC {auc:.3f}")
    assert len(got) > 100
    assert right.mean() > 0.85
    assert auc > 0.9


def test_language_weights_against_a_dense_fit(spark):
    """Which language fits is mostly what full-batch softmax regression on the same features says; the temperature is the best one."""
    rows = [(i, lang, text) for i, (lang, text) in enumerate((r["lang"], r["text"]) for r in load(spark, SF, "documents").where("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").collect())]
    df = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string")
    model = language_id.learn_from_documents(df)
    n, names = len(rows), model.languages
    grams = [Counter(language_id.ngrams(t).tolist()) for _, _, t in rows]
    learnt = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1 and re.search(r"[^\W\d_]", rows[i][2])]
    slots = {b: k for k, b in enumerate(sorted({b for i in learnt for b in grams[i]}))}
    df_ = np.zeros(len(slots))
    for i in learnt:
        df_[[slots[b] for b in grams[i]]] += 1
    idf = np.log((1 + len(learnt)) / (1 + df_)) + 1
    x = np.zeros((n, len(slots)), np.float32)
    for i, g in enumerate(grams):
        for b, c in g.items():
            if b in slots:
                x[i, slots[b]] = 20 * c / sum(g.values()) * idf[slots[b]]
    y, w = np.array([names.index(lang) if lang in names else 0 for _, lang, _ in rows]), np.zeros((len(slots), len(names)))
    for _ in range(150):
        s = x[learnt] @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(learnt)), y[learnt]] -= 1
        w -= 1.0 * x[learnt].T @ p / len(learnt)
    others = [i for i in range(n) if i not in set(learnt) and len(rows[i][2]) > 40]
    want = (x[others] @ w).argmax(axis=1)
    got = [names.index(model.predict(rows[i][2])[0]) for i in others]
    assert np.mean(want == got) > 0.95
    rng = np.random.default_rng(1)
    labels, scores = rng.integers(0, 3, 400), rng.normal(size=(400, 3)) * 3
    scores[np.arange(400), labels] += 4
    loss = lambda t: np.mean(np.log(np.exp(scores / t - (scores / t).max(axis=1, keepdims=True)).sum(axis=1)) + (scores / t).max(axis=1) - scores[np.arange(400), labels] / t)
    best = min((loss(t), t) for t in np.geomspace(0.3, 20, 2000))[1]
    assert abs(language_id.fit_temperature(scores, labels) / best - 1) < 0.02


def test_more_labels_than_are_learnt(spark):
    """Labels beyond the bound aren't learnt, and stop nothing."""
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * 3, "en" if i % 2 else "fr") for i in range(90)] + [(200 + i, "the cat sat", f"odd{i}") for i in range(60)]
    df = spark.createDataFrame([(*r, 0.5, "z") for r in rows], "doc_id long, text string, lang string, score double, said string")
    model = language_id.learn_from_documents(df, max_languages=2)
    assert model.languages == ["en", "fr"]
    got = language_id.identify(df, model).collect()
    assert {r["lang_pred"] for r in got} == {"en", "fr"}
    assert all(r["said"] == "z" and 0 < r["score"] <= 1 for r in got)
