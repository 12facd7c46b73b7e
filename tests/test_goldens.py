"""Results worked out by hand, and plain-Python models of the order-dependent operators."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumengrist.functions import text as T
from lumengrist.functions.segment import Segmenter
from lumengrist.operators import codec, fingerprint, index, kwic, recommend, search
from lumengrist.plans import registry
from lumengrist.sources import rss, stores
from lumengrist.sources.shared import narrowed, write_shared


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def docs(spark, texts):
    return spark.createDataFrame([(i, "", "", t) for i, t in enumerate(texts, 1)], "doc_id long, link string, title string, content string")


@pytest.mark.parametrize(("a", "b", "d"), [("人工智能", "人工呼吸", 2), ("人工智能", "深度学习", -1), ("机器学习", "机器翻译", 2), ("kitten", "sitting", 3), ("ab", "abcde", 3)])
def test_edit_distance(spark, a, b, d):
    assert one(spark, F.levenshtein(F.lit(a), F.lit(b), 3)) == d


def test_words(spark):
    assert one(spark, T.ascii_words(F.lit("Don't stop42now É"))) == ["don", "t", "stop", "now"]
    assert one(spark, T.ascii_words(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("size", "n"), [(0, 5), (600, 5), (719, 5), (720, 6), (23999, 199), (24000, 200), (30000, 200)])
def test_keyword_count(spark, size, n):
    assert one(spark, T.keyword_count(F.lit("x" * size))) == n


def test_relaxed(spark):
    assert [one(spark, search.relaxed(F.lit(n))) for n in (1, 2, 3, 4, 5, 6, 7, 10)] == [1, 2, 2, 3, 3, 4, 5, 6]


def test_bm25(spark):
    d = docs(spark, ["a a b", "b c", ""])
    rows = index.postings(d, index.term_frequencies(index.tokens(d))).collect()
    got = {(r["term"], r["doc_id"]): round(r["weight"], 6) for r in rows}
    assert got == {("a", 1): 0.827206, ("b", 1): -0.555248, ("b", 2): -0.681229, ("c", 2): 0.681229}


def test_dictionary_and_characters(spark):
    d = index.dictionary(index.tokens(docs(spark, ["ab ab b", "ab"])))
    assert sorted(map(tuple, d.collect())) == [(1, "ab", 3), (2, "b", 1)]
    assert sorted(map(tuple, index.char_index(d).collect())) == [("a", 1), ("b", 1), ("b", 2)]


def test_page_store(spark):
    rows = spark.createDataFrame([(1, "l", "t", "c"), (2, "", "人", "é")], "doc_id long, link string, title string, content string")
    assert [(r["offset"], r["length"]) for r in stores.page_store(rows).orderBy("doc_id").collect()] == [(0, 87), (87, 89)]


def greedy(values):
    kept = []
    for i, v in enumerate(values, 1):
        if all((v ^ values[k - 1]).bit_count() > 3 for k in kept):
            kept.append(i)
    return kept


def fps(spark, values):
    return spark.createDataFrame([(i, v >> 32, v & 0xFFFFFFFF) for i, v in enumerate(values, 1)], "doc_id long, fp_hi long, fp_lo long")


@pytest.mark.parametrize(("values", "kept"), [([0x0, 0x7, 0x3F], [1, 3]), ([0x0, 0x7, 0x3F, 0xF], [1, 3]), ([0x7, 0x0, 0x3F], [1])])
def test_greedy(spark, values, kept):
    assert greedy(values) == kept
    assert sorted(r["doc_id"] for r in fingerprint.greedy_keep(fps(spark, values)).collect()) == kept


def test_greedy_random(spark):
    rng = random.Random(3)
    values = [sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)]
    assert sorted(r["doc_id"] for r in fingerprint.greedy_keep(fps(spark, values)).collect()) == greedy(values)
    pairs = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(values, 1), 2) if (a ^ b).bit_count() <= 3}
    got = fingerprint.duplicate_pairs(fps(spark, values)).collect()
    same = {i: [i] for i in range(1, len(values) + 1)}
    for r in got:
        assert r["distance"] == (values[r["doc_a"] - 1] ^ values[r["doc_b"] - 1]).bit_count()
        if not r["distance"]:
            same[r["doc_a"]].append(r["doc_b"])
    between = [(a, b) for r in got if r["distance"] for a in same[r["doc_a"]] for b in same[r["doc_b"]]]
    within = [x for held in same.values() for x in itertools.combinations(held, 2)]
    assert {tuple(sorted(x)) for x in between + within} == pairs


def test_copies_are_not_paired(spark):
    """Of 2000 equal fingerprints none is compared or paired with another but the first."""
    table = fps(spark, [5] * 2000 + [6, 15 << 40])
    assert fingerprint.duplicate_pairs(table).count() == 2000  # 1999 copies, and one pair of different fingerprints
    assert fingerprint.compared_pairs(table).first()["n"] < 60


KWIC = [
    ("x" * 40 + "KEY" + "y" * 60, ["KEY"], "..." + "x" * 25 + "KEY" + "y" * 25 + "..."),
    ("KEY" + "x" * 50 + "KEY" + "y" * 10, ["KEY"], "KEY" + "x" * 50 + "KEY" + "y" * 10),
    ("KEY" + "x" * 51 + "KEY" + "y" * 40, ["KEY"], "..." + "x" * 25 + "KEY" + "y" * 25 + "..."),
    ("AB" + "x" * 100 + "ABAB" + "y" * 100 + "CD", ["AB", "CD"], "..." + "x" * 25 + "ABAB" + "y" * 25 + "..."),
    ("aaaaa", ["aa"], "aaaaa"),
    ("key KEY", ["KEY"], "key KEY"),
    ("人" * 30 + "深度学习" + "文" * 30, ["深度学习"], "..." + "人" * 25 + "深度学习" + "文" * 25 + "..."),
    ("x" * 60, ["q"], "x" * 50 + "..."),
    ("x" * 50, ["q"], "x" * 50),
    ("", ["q"], ""),
    ("text", [], ""),
    ("a.b*c" + "z" * 60, ["."], "a.b*c" + "z" * 22 + "..."),
]


def test_kwic(spark):
    found = spark.createDataFrame([(i, 7, c) for i, (c, _, _) in enumerate(KWIC)], "query_id long, doc_id long, content string")
    words = spark.createDataFrame([(i, k) for i, (_, ks, _) in enumerate(KWIC) for k in ks], "query_id long, term string")
    got = {r["query_id"]: r["abstract"] for r in kwic.abstracts(found, words).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(KWIC)}
    assert kwic.windows(found, words).where("query_id = 4").count() == 2


def test_hybrid_score(spark):
    near = spark.createDataFrame([(1, "abcd", "abxy", 3, 2)], "query_id long, query string, term string, freq long, distance int")
    post = spark.createDataFrame([("abcd", i) for i in (1, 2, 3)] + [("abxy", i) for i in (2, 3, 4)], "term string, doc_id long")
    most = spark.createDataFrame([(15,)], "max_freq long")
    row = recommend.scored(near, post, most).first()
    assert (row["jaccard"], row["edit_sim"], row["freq_score"], row["score"]) == (0.5, 0.5, 0.5, 0.5)


def test_recall_of_empty_query(spark):
    d = spark.createDataFrame([(1, "ab", 3), (2, "b", 1)], "line_num long, term string, freq long")
    q = spark.createDataFrame([(1, "")], "query_id long, text string")
    assert recommend.recall_by_characters(q, index.char_index(d)).count() == 0
    assert recommend.recall_by_prefix(q, d).count() == 2


def test_frame(spark):
    assert bytes(one(spark, codec.encode(F.lit(0), F.lit("人工")))).hex() == "0000000000000006e4babae5b7a5"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.binary(max_size=20)), max_size=5), st.data())
def test_frames_in_any_pieces(messages, data):
    whole = b"".join(codec.HEAD.pack(k, len(v)) + v for k, v in messages) + b"\0\0\0"
    held, got, at = b"", [], 0
    while at < len(whole):
        to = data.draw(st.integers(at + 1, len(whole)))
        found, held = codec.take_frames(held + whole[at:to])
        got += found
        at = to
    assert got == messages
    assert held == b"\0\0\0"


def test_frame_limit():
    with pytest.raises(ValueError, match="bytes"):
        codec.take_frames(codec.HEAD.pack(0, 100), most=10)


def test_commands(spark):
    lines = ["  /k abc ", "/s abc", "abc", "/k", "/x", " \t", "/k  abc", "/quit", "/help"]
    rows = codec.commands(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    got = {r["line"]: (r["action"], r["type"], r["text"]) for r in rows}
    assert [got[x] for x in lines] == [("send", 0, "abc"), ("send", 1, "abc"), ("send", 1, "abc"), ("unknown", None, None), ("unknown", None, None), ("ignore", None, None), ("send", 0, " abc"), ("quit", None, None), ("help", None, None)]


def test_segmenter():
    s = Segmenter({"人工智能": 50, "人工": 20, "智能": 20, "机器": 5, "学习": 5})
    assert s.cut("人工智能 x1机器人") == ["人工智能", " ", "x1", "机器", "人"]
    assert s.cut(None) == []


def test_rss(spark):
    xml = "<rss><channel><item><title>T</title><link>l</link><content/><description>d</description></item><item><description>a &lt;b&gt;b&lt;/b&gt;</description></item><item><title>no body</title></item></channel></rss>"
    files = spark.createDataFrame([("a", xml), ("b", "<rss><x/></rss>"), ("c", "not xml <"), ("d", None)], "path string, value string")
    rows = [tuple(r) for r in rss.rss_items(files).orderBy("path", "position").collect()]
    assert rows == [("a", 0, "l", "T", ""), ("a", 1, "", "", "a b")]


def test_scan_and_stop_words(spark, tmp_path):
    (tmp_path / "one.txt").write_text("hello\nworld")
    assert [r["value"] for r in rss.scan_texts(spark, str(tmp_path)).collect()] == ["hello\nworld"]
    assert sorted(r["term"] for r in rss.read_stop_words(spark, str(tmp_path)).collect()) == ["hello", "world"]
    assert rss.read_stop_words(spark, f"{tmp_path}/none").count() == 0
    for name in ("b.txt", "a.txt", ".hidden", "_left"):
        (tmp_path / name).write_text(name)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.txt").write_text("c")
    rows = rss.scan_texts(spark, str(tmp_path)).orderBy("path").collect()
    assert [r["value"] for r in rows] == ["a.txt", "b.txt", "hello\nworld"]
    assert [r["path"].rsplit("/", 1)[1] for r in rows] == ["a.txt", "b.txt", "one.txt"]


def test_rss_from_files(spark, tmp_path):
    for name, n in (("b.xml", 1), ("a.xml", 2)):
        (tmp_path / name).write_text("<rss><channel>" + "".join(f"<item><title>{name}{i}</title><content>text &amp; {i}</content></item>" for i in range(n)) + "</channel></rss>")
    (tmp_path / "broken.xml").write_text("<rss><channel><item>")
    rows = rss.rss_items(rss.scan_texts(spark, str(tmp_path))).orderBy("path", "position").collect()
    assert [(r["title"], r["content"]) for r in rows] == [("a.xml0", "text & 0"), ("a.xml1", "text & 1"), ("b.xml0", "text & 0")]


@pytest.mark.parametrize(("x", "text"), [(2.0, "2"), (1.234567e-5, "1.23457e-05"), (1234567.0, "1.23457e+06"), (0.0001, "0.0001"), (-0.5552476, "-0.555248"), (0.0, "0"), (123456.0, "123456"), (999999.5, "1e+06"), (100.25, "100.25"), (1e100, "1e+100"), (9.9999999, "10"), (0.00012345678, "0.000123457")])
def test_numbers_as_text_streams_print_them(spark, x, text):
    assert one(spark, stores.significant(F.lit(x))) == text == f"{x:g}"


def test_offsets_stop_at_a_bad_line(spark, tmp_path):
    """Blank lines don't count; nothing after the first bad line is read, in this file or a later one."""
    (tmp_path / "1").write_text("1 0 10\n\n  2 10\t5 \n")
    (tmp_path / "2").write_text("3 15 5\n4 x 5\n5 20 5\n")
    (tmp_path / "3").write_text("6 25 5\n")
    assert sorted(map(tuple, stores.read_offsets(spark, str(tmp_path)).collect())) == [(1, 0, 10), (2, 10, 5), (3, 15, 5)]
    (tmp_path / "2").write_text("3 15 99999999999999999999\n")
    assert stores.read_offsets(spark, str(tmp_path)).count() == 2


def test_document_sets(spark, tmp_path):
    assert stores.read_document_sets(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "index").write_text("a 1 0.5 2 1e-05\nb 2 -3\n")
    assert sorted(map(tuple, stores.read_document_sets(spark, f"{tmp_path}/index").collect())) == [("a", 1), ("a", 2), ("b", 2)]
    assert sorted(map(tuple, stores.read_index(spark, f"{tmp_path}/index").collect())) == [("a", 1, 0.5), ("a", 2, 1e-05), ("b", 2, -3.0)]


def test_page_store_and_fetch(spark, tmp_path):
    """What isn't readable at its offset is left out, and nothing moves up."""
    rows = [(1, "l&amp;1", "t", "c"), (2, "", "人", "é\n</doc>\nmore"), (3, "l", "a < b", "c"), (4, "", "", "line\nline &lt;b&gt; &amp;lt;")]
    d = spark.createDataFrame(rows, "doc_id long, link string, title string, content string")
    store = stores.page_store(d)
    places = {r["doc_id"]: (r["offset"], r["length"]) for r in store.collect()}
    assert (places[1], places[2][0]) == ((0, 93), 93)
    stores.write_page_store(store, f"{tmp_path}/pages")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "pages").glob("part-*")))
    for r in store.collect():
        assert whole[r["offset"] : r["offset"] + r["length"]].decode() == r["record"]
    ranked = spark.createDataFrame([(1, r, i) for r, i in enumerate([4, 3, 2, 1, 9], 1)], "query_id long, rank int, doc_id long")
    got = stores.fetched(ranked, store.select("doc_id", "offset", "length"), stores.read_page_store(spark, f"{tmp_path}/pages")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, 4, "", "", "line\nline <b> &lt;"), (1, 4, 1, "l&1", "t", "c")]


def test_built_tables_follow_their_files(spark, tmp_path):
    for text in ("one two", "three"):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert {r["term"] for r in registry.dict_freq(spark, str(tmp_path)).collect()} == set(text.split())


def test_close_scores_keep_their_order(spark):
    """The library ranks by full precision; rounding is for comparing engines."""
    post = spark.createDataFrame([("a", 1, 1.0000001), ("a", 2, 1.0000002)], "term string, doc_id long, weight double")
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    order = lambda **o: [r["doc_id"] for r in search.search(q, post, **o).orderBy("rank").collect()]
    assert (order(), order(digits=6)) == ([2, 1], [1, 2])


def test_recommendation_prunes_only_what_is_far(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcde", k=rng.randint(1, 8))) for _ in range(300)})
    d = spark.createDataFrame([(i, w, rng.randint(1, 9)) for i, w in enumerate(words, 1)], "line_num long, term string, freq long")
    q = spark.createDataFrame([(1, "abc"), (2, ""), (3, "dedede"), (4, "zz")], "query_id long, text string")
    chars = index.sized_char_index(d)
    near = lambda recalled: sorted(map(tuple, recommend.near_terms(q, recalled, d).collect()))
    assert near(recommend.recall_near(q, d, chars)) == near(recommend.recall(q, d, chars.select("ch", "line_num"))) != []


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, link string, title string, content string")
    tf = index.term_frequencies(index.tokens(d))
    p = index.postings(d, tf)
    assert p.count() == 0
    assert index.dictionary(index.tokens(d)).count() == 0
    assert fingerprint.greedy_keep(fingerprint.fingerprints(d, fingerprint.top_terms(d, tf))).count() == 0
    assert search.search(spark.createDataFrame([(1, "a")], "query_id long, text string"), p).count() == 0


def test_counts_are_not_shuffled(spark):
    """What a document holds is counted where it is read: fingerprints and counts move no rows (F9)."""
    d = docs(spark, ["b a b", "", "É"])
    own = index.counted(d)
    assert [(r["doc_id"], r["doc_len"], [tuple(c) for c in r["counts"]]) for r in own.orderBy("doc_id").collect()] == [(1, 3, [("a", 1), ("b", 2)]), (2, 0, []), (3, 0, [])]
    assert "Exchange" not in fingerprint.counted_fingerprints(own)._jdf.queryExecution().executedPlan().toString()


def test_counts_of_odd_documents(spark):
    """Counts, top terms and fingerprints are those of the joins, also where ids repeat."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 5, 900]))) for _ in range(40)]
    d = docs(spark, texts)
    tf = index.term_frequencies(index.tokens(d))
    rows = lambda df: sorted(map(tuple, df.collect()))
    own = index.counted(d)
    assert rows(index.frequencies(own).select("doc_id", "term", "tf")) == rows(tf)
    top = fingerprint.top_terms(d, tf)
    assert rows(fingerprint.counted_top_terms(own)) == rows(top)
    assert rows(fingerprint.counted_fingerprints(own)) == rows(fingerprint.fingerprints(d, top))
    again = d.union(d.where("doc_id < 5"))
    assert rows(index.frequencies(index.counted(again)).select("doc_id", "term", "tf")) == rows(index.term_frequencies(index.tokens(again)))


def test_terms_in_pieces(spark, monkeypatch):
    """A common term's postings are dealt out in pieces, and weigh the same; the format's lines come from whole terms."""
    d = docs(spark, ["a b", "a a", "a c", "b d", "e"])
    monkeypatch.setattr(index, "PIECE", 1)
    rows = lambda df: sorted(map(tuple, df.select("term", "doc_id", "tf", "doc_len", "df", "weight").collect()))
    want = rows(index.postings(d, index.sized_frequencies(d)))
    own = index.counted(d)
    whole = index.sorted_postings(d, own)
    assert rows(index.build(d)) == rows(whole) == want
    lines = dict(map(tuple, stores.index_lines(whole).collect()))
    assert lines == {t: t + "".join(f" {i} {w:g}" for x, i, *_, w in want if x == t) for t in "abcde"}


def test_long_lines_of_an_index(spark, tmp_path, monkeypatch):
    """A long line is cut once, not copied for each of its pairs (F10)."""
    text = "a" + "".join(f" {i} 0.5" for i in range(100_000))
    (tmp_path / "index").write_text(f"{text}\nb 7 1e-05\nc\nd 1\n")
    got = stores.read_index(spark, f"{tmp_path}/index")
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("term = 'a'").agg(F.count("*"), F.sum("doc_id"), F.sum("weight")).first()[:] == (100_000, 4999950000, 50_000.0)
    assert sorted(map(tuple, got.where("term <> 'a'").collect())) == [("b", 7, 1e-05)]


def test_candidates_are_made_once(spark, monkeypatch):
    """Pairs that share several blocks come once, from groups that meet in many tasks; nothing is broadcast but block sizes (F1)."""
    monkeypatch.setattr(fingerprint, "_GROUP", 4)
    rng = random.Random(5)
    values = [rng.choice([0, 1 << 60, 7 << 30, 0xFFFF, rng.getrandbits(64)]) for _ in range(120)]
    share = lambda a, b: any((a ^ b) >> s & 0xFFFF == 0 for s in (0, 16, 32, 48))
    want = sorted((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(values, 1), 2) if share(a, b))
    assert sorted(map(tuple, fingerprint.block_candidates(fps(spark, values)).collect())) == want
    pairs = fingerprint.block_candidates(fps(spark, values))
    assert pairs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_near_pairs_are_spread(spark):
    """Keys of a small table are not broadcast or compared in one task, and no pair comes twice (F2, F8)."""
    values = [1 << b for b in range(64)] + [3, 7, 0]
    pairs = fingerprint.near_pairs(fps(spark, values).withColumnRenamed("doc_id", "id"))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, pairs.collect()))
    assert got == sorted((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(values, 1), 2) if (a ^ b).bit_count() <= 3)
    assert pairs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("many", [False, True])
def test_common_documents_from_counts(spark, monkeypatch, many):
    """What terms have in common is added up where documents are read: the same as by joins of postings, and no postings move (F4, F7, F17)."""
    if many:  # as if there were too many queries to look up in the row
        monkeypatch.setattr(recommend, "few_values", lambda *a: None)
    rng = random.Random(11)
    d = docs(spark, [" ".join(rng.choices(["the", "he", "them", "tee", "x", "yes"], k=rng.randint(0, 6))) for _ in range(60)])
    own, post = index.counted(d), index.build(d)
    near = spark.createDataFrame([(1, "the", "he"), (1, "the", "tee"), (1, "the", "none"), (2, "gone", "he"), (3, "he", "the")], "query_id long, query string, term string")
    asked = spark.createDataFrame([(1, "the"), (2, "gone"), (3, "he"), (4, "the")], "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(recommend.jaccard(near, own)) == rows(recommend.jaccard(near, post)) == rows(recommend.jaccard(near, own, post.groupBy("term").agg(F.count("*").alias("df"))))
    assert rows(recommend.recall_by_cooccurrence(asked, own)) == rows(recommend.recall_by_cooccurrence(asked, post)) != []
    if not many:
        assert "hashpartitioning(doc_id" not in plan(recommend.recall_by_cooccurrence(asked, own)) + plan(recommend.jaccard(near, own))


def test_searches_read_their_terms_only(spark):
    """Pages without the keywords, and bodies of other documents, aren't read; a task adds up only documents dealt to it (F5, F12 to F16, F18 to
    F23)."""
    post = write_shared(index.build(docs(spark, ["a b", "b c", "c d"])), "test-postings")
    words = spark.createDataFrame([(1, "b"), (1, "zz")], "query_id long, term string")
    got = search.scores(words, post)
    assert "In(term, [b,zz])" in plan(got)
    lines = [x.strip(" +-:*()0123456789") for x in plan(got).splitlines()]
    assert not any("HashAggregate" in x for x in lines[next(i for i, x in enumerate(lines) if "REPARTITION_BY_NUM" in x) :])
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]
    bodies = write_shared(docs(spark, ["one", "two", "three"]), "test-bodies")
    found = spark.createDataFrame([(1, 1, 2)], "query_id long, rank int, doc_id long")
    assert [r["content"] for r in search.fetched(found, bodies).collect()] == ["two"]
    assert "EqualTo(doc_id,2)" in plan(narrowed(bodies, "doc_id", found)).replace(", ", ",")
