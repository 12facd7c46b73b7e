"""The pipeline: every stage against brute force on what the one before it kept, and the defined cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumengrist.llm import language_id
from lumengrist.llm.common import load, write_shared

from ..conftest import SF
from .test_exact_and_lines import brute_lines
from .test_mixing_chat_topk import WORDS, fill
from .test_models_and_near import brute_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Four sources, two languages, junk, shared lines, exact and near copies."""
    rng = random.Random(4)
    words = {"en": "the house and river of every morning with their old friends who came from there to see".split(), "fr": "la maison et rivière de chaque matin avec leurs vieux amis qui sont venus voir les autres".split()}
    rows = []
    for i in range(240):
        lang = "fr" if i % 4 == 0 else "en"
        lines = [" ".join(rng.choice(words[lang]) + str(rng.randint(0, 9)) * (rng.random() < 0.3) for _ in range(12)) for _ in range(rng.randint(2, 6))]
        if i % 5 == 0:
            lines.insert(1, "This line stands in many documents")
        rows.append((i, "\n".join(lines), lang, f"s{i % 4}" if i % 7 else None, 0))
    for i in range(40):
        text = rows[i][1]
        if i % 2:
            text = " ".join([*text.split()[:-1], "changed"])
        rows.append((1000 + i, text.replace("\n", " "), rows[i][2], "copies", 0))
    rows += [(2000, "12345 !!! ???", "en", "s1", 0), (2001, None, "en", "s1", 0), (2002, "", "fr", None, 0), (2003, rows[3][1], "en", "s0", 0), (None, rows[9][1], "en", "s2", 0)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]


def staged(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = write_shared(stage(spark, docs, ""), f"test-{name}")
        yield name, docs, out
        docs = out


@pytest.mark.parametrize("of", ["planted", "driver"])
def test_every_stage(spark, of):
    docs = load(spark, SF, "documents") if of == "driver" else spark.createDataFrame(corpus(), SCHEMA)
    docs = docs.withColumns({c: F.lit(c) for c in ("lang_pred", "score", "row", "said", "_lang", "_said", "kept", "h")})
    got = {}
    for name, before, after in staged(spark, docs):
        if name != "packing":
            assert after.dtypes == docs.dtypes, name
            assert all(r["row"] == r["kept"][:0] + "row" and r["score"] == "score" for r in after.select("row", "kept", "score").collect())
        got[name] = [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]
    key = lambda r: (r["doc_id"], r["text"])
    # language: what has letters and a language that fits, and hardly less than all prose
    before, after = got["language_id"]
    model = language_id.learn_from_documents(docs)
    said = {(r["doc_id"], r["text"]): r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    fits = [r for r in before if said[key(r)]["lang_pred"] != "und" and said[key(r)]["score"] >= 0.5]
    assert Counter(map(key, after)) == Counter(map(key, fits))
    prose = [r for r in before if len(re.findall(r"[^\W\d_]{2,}", r["text"] or "")) >= 20]
    assert len([r for r in prose if said[key(r)]["score"] >= 0.5]) >= 0.99 * len(prose)
    assert not any(re.search(r"[^\W\d_]", r["text"] or "") is None for r in after)
    # lines
    before, after = got["line_dedup"]
    assert Counter(map(key, after)) == Counter((i, kept) for i, _, _, kept in brute_lines([(r["doc_id"], r["text"], "") for r in before]))
    assert all(r["n_chars"] == len(r["text"]) for r in after) or of == "driver"
    # near copies: the smallest id of each class
    before, after = got["near_dedup"]
    rows = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    root = brute_classes([r["text"] for r in rows])
    assert Counter(map(key, after)) == Counter(key(r) for i, r in enumerate(rows) if root[i] == i)
    # mixing
    before, after = got["mixing"]
    sizes, texts, taken, each = Counter(), defaultdict(list), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(WORDS.findall(r["text"]))
        texts[r["doc_id"]].append(r["text"])
    names = [*sorted(s for s in sizes if s is not None), *[None] * (None in sizes)]
    target = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for r in after:
        n = len(WORDS.findall(r["text"]))
        taken[r["source"]] += n
        each[r["doc_id"]] += n
        assert any(t.startswith(r["text"]) for t in texts[r["doc_id"]])
    assert all(abs(taken[s] - target[s]) <= 2 for s in names)
    assert all(each[i] <= 2 * sum(len(WORDS.findall(t)) for t in texts[i]) for i in texts)
    # packing: every id of every row lies in one piece
    before, after = got["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, have, sequences = Counter(), Counter(), defaultdict(list)
    for r in before:
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want[r["doc_id"]] += len(ids)
        for p in (p for p in after if p["doc_id"] == r["doc_id"] and p["doc_tokens"] == len(ids)):
            p.setdefault("right", False)
            p["right"] |= zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    for p in after:
        assert p["right"]
        have[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert have == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) * 2048 < 1.1 * sum(have.values()) + 4 * 2048


def test_run_is_the_stages_in_a_row(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    *_, (_, before, after) = staged(spark, docs)
    digest = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect())
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0
    assert digest(got) == digest(after)


def run_on(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).toPandas()


def test_empty(spark, tmp_path):
    assert len(run_on(spark, tmp_path, [])) == 0


def test_nulls(spark, tmp_path):
    """Null texts go first; the line of document 1 goes from document 2, whose rest is no part of the mix; of the six words of its source
    the mix takes nine, the three more from the front."""
    line = "one two three four five six"
    got = run_on(spark, tmp_path, [(None, None, None, None, None), (1, None, None, None, None), (1, line, "en", None, 3), (2, line, "en", "a", 3)])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in (line, "one two three")]
    assert set(got.doc_id) == {1}
    assert sorted(got.doc_tokens) == sorted(tokens)
    assert got.length.sum() == sum(tokens)


def test_reads_leave_no_buffers(spark, tmp_path):
    """A column chunk of 24 MB that a stage reads leaves no buffer of its size outside the heap."""
    rng = random.Random(6)
    docs = [(i, rng.randbytes(1 << 10).hex(), "en", "s0", 2 << 10) for i in range(12 << 10)]
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    direct = getattr(spark._jvm, "org.apache.spark.metrics.DirectPoolMemory$").__getattr__("MODULE$")
    before = direct.getMetricValue(None)
    assert corpus_pipeline.mixed(spark, load(spark, str(tmp_path), "documents"), "").agg(F.sum(F.length("text"))).first()[0] > 24 << 20
    assert direct.getMetricValue(None) - before < 8 << 20
