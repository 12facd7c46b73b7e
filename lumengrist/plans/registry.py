"""The engine's queries, by name. Each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DIGITS, STOP_WORDS
from ..functions import text as T
from ..functions.segment import segment
from ..operators import codec, fingerprint, index, kwic, recommend
from ..operators import search as S
from ..sources import rss, stores
from ..sources.shared import application_folder, built, write_shared
from ..streaming import service
from .oracles import CJK_SEARCHES, CJK_STOP, CJK_VOCABULARY, CJK_WORDS, LINES, ORACLES, SEARCHES, SUGGEST_FOR  # noqa: F401

CJK_TEXTS = [(1, "人工智能和机器学习"), (2, "深度学习 GPT 应用"), (3, "机器翻译")]
CJK_DICTIONARY = {"人工智能": 50, "人工": 20, "机器学习": 40, "机器": 20, "学习": 30, "深度学习": 35, "翻译": 10, "机器翻译": 9, "应用": 10, "和": 100}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, link, title, content) of documents."""
    empty = F.lit("")
    return read(spark, sf_dir, "documents").select("doc_id", empty.alias("link"), empty.alias("title"), F.coalesce("text", empty).alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rss.page_documents(read(spark, sf_dir, "pages"))


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "term string")


def _from_documents(spark, sf_dir, name, build):
    return built(spark, name, f"{sf_dir}/documents.parquet", build)


def counts(spark, sf_dir):
    return _from_documents(spark, sf_dir, "counts", lambda: index.counted(documents(spark, sf_dir)))


def tf(spark, sf_dir):
    return index.frequencies(counts(spark, sf_dir))


def frequencies(spark, sf_dir):
    return _from_documents(spark, sf_dir, "frequencies", lambda: index.document_frequencies(tf(spark, sf_dir)))


def postings(spark, sf_dir):
    return _from_documents(spark, sf_dir, "postings", lambda: index.sorted_postings(documents(spark, sf_dir), counts(spark, sf_dir), frequencies(spark, sf_dir)))


def dictionary(spark, sf_dir):
    return _from_documents(spark, sf_dir, "dictionary", lambda: index.counted_dictionary(counts(spark, sf_dir)))


def char_index(spark, sf_dir):
    """With the terms' sizes."""
    return _from_documents(spark, sf_dir, "chars", lambda: index.sized_char_index(dictionary(spark, sf_dir)))


def top_terms(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return fingerprint.top_terms(docs, tf(spark, sf_dir)) if index.repeated(docs) else fingerprint.counted_top_terms(counts(spark, sf_dir))


def fps(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = lambda: fingerprint.fingerprints(docs, top_terms(spark, sf_dir)) if index.repeated(docs) else fingerprint.counted_fingerprints(counts(spark, sf_dir))
    return _from_documents(spark, sf_dir, "fingerprints", found)


def kept_documents(spark, sf_dir):
    """(doc_id, link, title, content) of what greedy removal keeps, under new consecutive ids."""
    kept = lambda: fingerprint.deduplicated(documents(spark, sf_dir), fps(spark, sf_dir))
    return _from_documents(spark, sf_dir, "kept", lambda: kept().select(F.col("new_id").alias("doc_id"), "link", "title", "content"))


def kept_postings(spark, sf_dir):
    return _from_documents(spark, sf_dir, "kept-postings", lambda: index.build(kept_documents(spark, sf_dir)))


def values(spark, rows, schema: str) -> DataFrame:
    """A few literal rows, whose size the optimizer knows."""
    literal = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    listed = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})").select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])


def searches(spark, which=None) -> DataFrame:
    return values(spark, [q for q in SEARCHES if which is None or q[0] in which], "query_id long, text string")


def asked(spark) -> DataFrame:
    return values(spark, SUGGEST_FOR, "query_id long, text string")


def _found(spark, sf_dir, which=None) -> DataFrame:
    return S.search(searches(spark, which), postings(spark, sf_dir), digits=DIGITS)


def _bodies(spark, sf_dir, which=None) -> DataFrame:
    return S.fetched(_found(spark, sf_dir, which), documents(spark, sf_dir))


def answers(queries: DataFrame, spark, sf_dir, digits: int | None = None) -> DataFrame:
    body = S.fetched(S.search(queries, postings(spark, sf_dir), digits=digits), documents(spark, sf_dir))
    snippets = kwic.abstracts(body, S.query_keywords(queries))
    return body.join(snippets, ["query_id", "doc_id"]).select("query_id", "rank", "doc_id", "score", "title", "link", "abstract")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked pages with snippets for all searches."""
    return answers(searches(spark), spark, sf_dir, DIGITS)


def text_strip_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("content"))


def page_extract(spark, sf_dir):
    return pages(spark, sf_dir)


def tokenize_ascii(spark, sf_dir):
    return index.tokens(documents(spark, sf_dir)).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def token_stopword_anti(spark, sf_dir):
    return index.tokens(documents(spark, sf_dir), stop_words=stop_words(spark)).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def cjk_filter(spark, sf_dir):
    return values(spark, CJK_WORDS, "id long, word string").where(T.is_cjk(F.col("word")))


def char_explode(spark, sf_dir):
    words = values(spark, CJK_WORDS, "id long, word string")
    return words.select("id", F.posexplode(T.characters(F.col("word"))).alias("pos", "ch")).select("id", F.col("pos").cast("long").alias("pos"), "ch")


def tokenize_cjk(spark, sf_dir):
    texts = values(spark, CJK_TEXTS, "id long, text string")
    return texts.select("id", F.posexplode(segment(F.col("text"), CJK_DICTIONARY)).alias("pos", "word"))


def _rss_files(spark, sf_dir) -> DataFrame:
    """Pages as RSS texts of one item each; every fifth has no content but a description, every seventh neither."""
    esc = F.replace(F.replace(F.replace(F.col("html"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    link = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    body = F.when(F.col("page_id") % 7 == 0, "").when(F.col("page_id") % 5 == 0, F.concat(F.lit("<description>"), esc, F.lit("</description>"))).otherwise(F.concat(F.lit("<content>"), esc, F.lit("</content>")))
    xml = F.concat(F.lit("<rss><channel><item><title>&lt;b&gt;T"), F.col("page_id").cast("string"), F.lit("</title><link>"), link, F.lit("</link>"), body, F.lit("</item></channel></rss>"))
    return read(spark, sf_dir, "pages").select(F.lpad(F.col("page_id").cast("string"), 12, "0").alias("path"), xml.alias("value"))


def rss_items(spark, sf_dir):
    return rss.rss_items(_rss_files(spark, sf_dir)).select("path", "link", "title", F.md5("content").alias("content_md5"))


def dict_freq(spark, sf_dir):
    return dictionary(spark, sf_dir).select("term", "freq")


def dict_line_num(spark, sf_dir):
    return dictionary(spark, sf_dir).select("line_num", "term")


def char_index_query(spark, sf_dir):
    return char_index(spark, sf_dir).select("ch", "line_num")


def page_offsets(spark, sf_dir):
    return stores.page_store(documents(spark, sf_dir)).select("doc_id", "offset", "length")


def index_export(spark, sf_dir):
    return stores.index_lines(_whole_postings(spark, sf_dir))


def _whole_postings(spark, sf_dir):
    return index.sorted_postings(documents(spark, sf_dir), counts(spark, sf_dir))


def index_deduplicated(spark, sf_dir):
    """The index over what greedy removal keeps, under its new ids."""
    return kept_postings(spark, sf_dir).select("term", "doc_id", "tf", F.round("weight", DIGITS).alias("weight"))


def page_fetch(spark, sf_dir):
    """The whole build and its use: kept documents, new ids, page store and offsets as files, index, search, and pages read at their
    offsets."""
    store = stores.page_store(kept_documents(spark, sf_dir))
    pages_path, offsets_path = _folder(spark, "pages"), _folder(spark, "offsets")
    store = write_shared(store, "page-store")
    stores.write_page_store(store, pages_path)
    stores.write_lines(store.select("doc_id", F.concat_ws(" ", "doc_id", "offset", "length").alias("line")), ["doc_id"], offsets_path)
    found = S.search(searches(spark), kept_postings(spark, sf_dir), digits=DIGITS)
    got = stores.fetched(found, stores.read_offsets(spark, offsets_path), stores.read_page_store(spark, pages_path))
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "link", "title", F.md5("content").alias("content_md5"))


def dict_export(spark, sf_dir):
    return stores.dictionary_lines(dictionary(spark, sf_dir))


def char_index_export(spark, sf_dir):
    return stores.char_index_lines(char_index(spark, sf_dir))


def _folder(spark, name: str) -> str:
    import uuid

    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def index_import(spark, sf_dir):
    lines = write_shared(stores.index_lines(_whole_postings(spark, sf_dir)), "index-lines")  # ranges are found by reading twice
    stores.write_lines(lines, ["term"], path := _folder(spark, "index"))
    return stores.read_index(spark, path).select("term", "doc_id", "weight")


def dict_import(spark, sf_dir):
    stores.write_lines(stores.dictionary_lines(dictionary(spark, sf_dir)), ["line_num"], path := _folder(spark, "dict"))
    return stores.read_dictionary(spark, path)


def dict_max_freq(spark, sf_dir):
    return stores.max_frequency(dictionary(spark, sf_dir))


def char_index_import(spark, sf_dir):
    stores.write_lines(stores.char_index_lines(char_index(spark, sf_dir)), ["ch"], path := _folder(spark, "chars"))
    return stores.read_char_index(spark, path)


def offsets_import(spark, sf_dir):
    lines = page_offsets(spark, sf_dir).select("doc_id", F.concat_ws(" ", "doc_id", "offset", "length").alias("line"))
    stores.write_lines(lines, ["doc_id"], path := _folder(spark, "offsets"))
    return stores.read_offsets(spark, path)


def doc_len(spark, sf_dir):
    return counts(spark, sf_dir).where("doc_len > 0").select("doc_id", "doc_len")


def corpus_stats(spark, sf_dir):
    stats = index.corpus_statistics(documents(spark, sf_dir), counts(spark, sf_dir))
    return stats.select("n_docs", F.round("avgdl", DIGITS).alias("avgdl"))


def term_idf(spark, sf_dir):
    df = frequencies(spark, sf_dir)
    n = documents(spark, sf_dir).agg(F.count("*").alias("n_docs"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(index.idf(F.col("n_docs"), F.col("df")), DIGITS).alias("idf"))


def bm25_postings(spark, sf_dir):
    return postings(spark, sf_dir).select("term", "doc_id", "tf", F.round("weight", DIGITS).alias("weight"))


def simhash_topn(spark, sf_dir):
    return top_terms(spark, sf_dir).select("doc_id", F.col("rank").cast("long").alias("rank"), "term", "tf")


def simhash_fp(spark, sf_dir):
    return fps(spark, sf_dir)


def simhash_blocks(spark, sf_dir):
    return fingerprint.blocks(fps(spark, sf_dir)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "block_val")


def dup_candidates(spark, sf_dir):
    return fingerprint.block_candidates(fps(spark, sf_dir))


def dup_pairs(spark, sf_dir):
    return fingerprint.duplicate_pairs(fps(spark, sf_dir))


def dedup_greedy(spark, sf_dir):
    return fingerprint.deduplicated(documents(spark, sf_dir), fps(spark, sf_dir)).select("new_id", "doc_id")


def query_keywords(spark, sf_dir):
    return S.query_keywords(searches(spark))


def search_scores(spark, sf_dir):
    return S.scores(S.query_keywords(searches(spark)), postings(spark, sf_dir), DIGITS)


def search_progressive(spark, sf_dir):
    return _found(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "matches", "score")


def _one(*ids):
    return lambda spark, sf_dir: _found(spark, sf_dir, ids).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "matches", "score")


def search_stopwords(spark, sf_dir):
    found = S.search(searches(spark), postings(spark, sf_dir), stop_words=stop_words(spark), digits=DIGITS)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "matches", "score")


def kwic_hits(spark, sf_dir):
    return kwic.windows(_bodies(spark, sf_dir), S.query_keywords(searches(spark))).select("query_id", "doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


def _spans(df):
    return df.select("query_id", "doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), F.col("hits").cast("long").alias("hits"))


def kwic_merged(spark, sf_dir):
    return _spans(kwic.merged(kwic.windows(_bodies(spark, sf_dir), S.query_keywords(searches(spark)))))


def kwic_best(spark, sf_dir):
    return _spans(kwic.best(kwic.merged(kwic.windows(_bodies(spark, sf_dir), S.query_keywords(searches(spark))))))


def kwic_abstract(spark, sf_dir):
    return kwic.abstracts(_bodies(spark, sf_dir), S.query_keywords(searches(spark)))


def kwic_fallback(spark, sf_dir):
    """Snippets of all documents for a keyword that none holds."""
    asked_for = spark.createDataFrame([(1, "zzzunknown")], "query_id long, term string")
    docs = documents(spark, sf_dir).select(F.lit(1).cast("long").alias("query_id"), "doc_id", "content")
    return kwic.abstracts(docs, asked_for).select("doc_id", "abstract")


def search_pages(spark, sf_dir):
    return flagship(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "title", "link", "abstract")


def search_pages_json(spark, sf_dir):
    return codec.pages_json(flagship(spark, sf_dir))


def response_parse(spark, sf_dir):
    """What a client reads from the answers: the pages of each JSON array in order."""
    return codec.parsed_pages(search_pages_json(spark, sf_dir))


def recall_char(spark, sf_dir):
    return recommend.recall_by_characters(asked(spark), char_index(spark, sf_dir).select("ch", "line_num"))


def recall_prefix(spark, sf_dir):
    return recommend.recall_by_prefix(asked(spark), dictionary(spark, sf_dir))


def recall_union(spark, sf_dir):
    return recommend.recall(asked(spark), dictionary(spark, sf_dir), char_index(spark, sf_dir).select("ch", "line_num"))


def _near(spark, sf_dir):
    recalled = lambda: recommend.recall_near(asked(spark), dictionary(spark, sf_dir), char_index(spark, sf_dir))
    return _from_documents(spark, sf_dir, "near-terms", lambda: recommend.near_terms(asked(spark), recalled(), dictionary(spark, sf_dir)))


def edit_prune(spark, sf_dir):
    return _near(spark, sf_dir).select("query_id", "term", F.col("distance").cast("long").alias("distance"))


def jaccard_docs(spark, sf_dir):
    return recommend.jaccard(_near(spark, sf_dir), counts(spark, sf_dir), frequencies(spark, sf_dir)).select("query_id", "term", F.round("jaccard", DIGITS).alias("jaccard"))


def _scored(spark, sf_dir):
    return recommend.scored(_near(spark, sf_dir), counts(spark, sf_dir), stores.max_frequency(dictionary(spark, sf_dir)), DIGITS, frequencies(spark, sf_dir))


def freq_score(spark, sf_dir):
    most = F.broadcast(stores.max_frequency(dictionary(spark, sf_dir)))
    return dictionary(spark, sf_dir).join(most).select("term", F.round(recommend.frequency_score(F.col("freq"), F.col("max_freq")), DIGITS).alias("freq_score"))


def hybrid_score(spark, sf_dir):
    return _scored(spark, sf_dir)


def recommend_topk(spark, sf_dir):
    return recommend.top_terms(_scored(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "term", "score")


def recommend_json(spark, sf_dir):
    return codec.words_json(recommend.top_terms(_scored(spark, sf_dir)))


def tlv_encode(spark, sf_dir):
    texts = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return texts.select("conv_id", "turn", F.hex(codec.encode(F.lit(1), F.coalesce("text", F.lit("")))).alias("frame"))


def _streams(spark, sf_dir):
    """A connection for each conversation: its turns as messages in a row, and five bytes of one that never ends."""
    turns = read(spark, sf_dir, "conversations")
    one = codec.encode(F.when(F.col("role") == "user", 0).otherwise(1), F.coalesce("text", F.lit("")))
    lists = turns.groupBy(F.col("conv_id").alias("conn_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.hex(one).alias("f")))).alias("t"))
    return lists.select("conn_id", F.unhex(F.concat(F.array_join("t.f", ""), F.lit("0000000100"))).alias("data"))


def tlv_decode(spark, sf_dir):
    return codec.decode(_streams(spark, sf_dir)).select("conn_id", "type", "length", F.md5("value").alias("value_md5"))


def request_dispatch(spark, sf_dir):
    return codec.requests(codec.decode(_streams(spark, sf_dir))).select("conn_id", "type", "response_type", F.md5("text").alias("text_md5"))


def client_command(spark, sf_dir):
    return codec.commands(values(spark, [(x,) for x in LINES], "line string")).select("line", "action", F.coalesce("type", F.lit(-1)).cast("long").alias("type"), F.coalesce("text", F.lit("")).alias("text"))


def stream_messages(spark, sf_dir):
    """The messages of all connections, whose bytes come in two chunks each, put together by the stateful stream."""
    whole = _streams(spark, sf_dir).withColumn("cut", F.floor(F.octet_length("data") / 2).cast("int"))
    halves = [whole.select("conn_id", F.lit(n).cast("long").alias("seq"), F.expr(e).alias("data")) for n, e in ((0, "substring(data, 1, cut)"), (1, "substring(data, cut + 1)"))]
    chunks = write_shared(halves[0].union(halves[1]), "chunks")
    source = spark.readStream.schema(chunks.schema).parquet(chunks.inputFiles()[0].rsplit("/", 1)[0])
    path, checkpoint = _folder(spark, "messages"), _folder(spark, "messages-checkpoint")
    service.messages(source).writeStream.option("checkpointLocation", checkpoint).option("path", path).format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("conn_id", "type", F.md5("value").alias("value_md5"))


def stream_search(spark, sf_dir):
    """The searches as a stream of requests, answered in batches against the index."""
    requests = write_shared(searches(spark), "requests")
    source = spark.readStream.schema(requests.schema).parquet(requests.inputFiles()[0].rsplit("/", 1)[0])
    return service.answer_all(source, lambda rows: answers(rows, spark, sf_dir, DIGITS), _folder(spark, "answers"), _folder(spark, "answers-checkpoint")).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "abstract")


def ext_cooccur_recall(spark, sf_dir):
    return recommend.recall_by_cooccurrence(asked(spark), counts(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "term", "common")


def ext_search_pages_multilang(spark, sf_dir):
    """Search over pages with words of any script: runs of letters, lower-cased."""
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}]+", " ")), " "), lambda w: w != "")
    docs = pages(spark, sf_dir)
    own = built(spark, "page-postings", f"{sf_dir}/pages.parquet", lambda: index.build(docs, words))
    return S.search(searches(spark), own, words, digits=DIGITS).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "matches", "score")


def stream_dispatch(spark, sf_dir):
    """Both kinds of request, and one that is neither, as a stream of bytes in chunks out of order: messages with state for each
    connection, answers, and replies as messages."""
    rows = [(1 + i % 2, i, kind, text) for i, (kind, text) in enumerate([(0, t) for _, t in SUGGEST_FOR] + [(4, "passed over")] + [(1, t) for _, t in SEARCHES])]
    frames = values(spark, rows, "conn_id long, at long, type long, text string").select("conn_id", "at", codec.encode(F.col("type"), F.col("text")).alias("frame"))
    whole = frames.groupBy("conn_id").agg(F.sort_array(F.collect_list(F.struct("at", F.hex("frame").alias("f")))).alias("f")).select("conn_id", F.unhex(F.array_join("f.f", "")).alias("data"))
    cut = whole.withColumn("seq", F.explode(F.expr("sequence(0L, (octet_length(data) - 1) div 7)")))
    chunks = write_shared(cut.select("conn_id", "seq", F.expr("substring(data, int(seq * 7 + 1), 7)").alias("data")).orderBy(F.desc("seq")), "chunks")
    source = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(chunks.inputFiles()[0].rsplit("/", 1)[0])
    suggest = lambda q: recommend.recommend(q, dictionary(spark, sf_dir), char_index(spark, sf_dir), counts(spark, sf_dir), stores.max_frequency(dictionary(spark, sf_dir)), digits=DIGITS, sizes=frequencies(spark, sf_dir))
    reply = lambda got: codec.replies(codec.requests(got), suggest, lambda q: answers(q, spark, sf_dir, DIGITS))
    return service.answer_all(service.messages(source), reply, _folder(spark, "replies"), _folder(spark, "replies-checkpoint")).select("conn_id", "no", F.hex("frame").alias("frame"))


def cjk_words(text):
    """Words of a CJK text that consist of CJK characters, by the dictionary at hand."""
    return F.filter(segment(text, dict.fromkeys(CJK_VOCABULARY, 10)), T.is_cjk)


def _cjk_documents(spark, sf_dir):
    """A text for each document: words of the vocabulary by its id, in threes between other characters."""
    words = F.array(*map(F.lit, CJK_VOCABULARY))
    parts = F.transform(F.expr("sequence(0, int(4 + doc_id % 11))"), lambda j: F.concat(F.element_at(words, (_pick(j) + 1).cast("int")), F.when(j % 3 == 2, F.lit("，GPT ")).otherwise("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("link"), F.lit("").alias("title"), F.array_join(parts, "").alias("content"))


def _pick(j):
    return (F.col("doc_id") * 7 + j * (1 + F.col("doc_id") % 5) + F.floor(j / 4)) % len(CJK_VOCABULARY)


def _cjk_stop_words(spark):
    return values(spark, [(w,) for w in CJK_STOP], "term string")


def _cjk_dictionary(spark, sf_dir):
    return _from_documents(spark, sf_dir, "dictionary-cjk", lambda: index.dictionary(index.tokens(_cjk_documents(spark, sf_dir), cjk_words, _cjk_stop_words(spark))))


def dict_cjk(spark, sf_dir):
    return _cjk_dictionary(spark, sf_dir)


def char_index_cjk(spark, sf_dir):
    return stores.char_index_lines(index.char_index(_cjk_dictionary(spark, sf_dir)))


def search_cjk(spark, sf_dir):
    """Search over the CJK profile of the index. Queries are cut by the same dictionary, and keep what isn't CJK, which no page has."""
    own = _from_documents(spark, sf_dir, "postings-cjk", lambda: index.build(_cjk_documents(spark, sf_dir), cjk_words))
    every = lambda text: segment(text, dict.fromkeys(CJK_VOCABULARY, 10))
    found = S.search(values(spark, CJK_SEARCHES, "query_id long, text string"), own, every, _cjk_stop_words(spark), digits=DIGITS)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "matches", "score")


QUERIES = {
    f.__name__: f
    for f in (
        text_strip_tags, page_extract, tokenize_ascii, token_stopword_anti, cjk_filter, char_explode, tokenize_cjk, rss_items, dict_freq, dict_line_num,
        page_offsets, index_export, dict_export, char_index_export, index_import, dict_import, dict_max_freq, char_index_import, offsets_import, doc_len, corpus_stats,
        term_idf, bm25_postings, simhash_topn, simhash_fp, simhash_blocks, dup_candidates, dup_pairs, dedup_greedy, query_keywords, search_scores, search_progressive,
        search_stopwords, kwic_hits, kwic_merged, kwic_best, kwic_abstract, kwic_fallback, search_pages, search_pages_json, response_parse, recall_char, recall_prefix, recall_union,
        edit_prune, jaccard_docs, freq_score, hybrid_score, recommend_topk, recommend_json, tlv_encode, tlv_decode, request_dispatch, client_command, stream_messages,
        stream_search, stream_dispatch, ext_cooccur_recall, ext_search_pages_multilang, index_deduplicated, page_fetch, dict_cjk, char_index_cjk, search_cjk,
    )
} | {"char_index": char_index_query, "search_and": _one(1), "search_60": _one(2, 4), "search_or": _one(3), "search_empty": _one(6)}
