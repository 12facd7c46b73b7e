"""Dictionaries, character index and BM25 postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import K1, B
from ..functions.text import ascii_words, characters, without_stop_words
from ..sources.shared import numbered, write_shared

#: A term that more documents hold is dealt out in pieces of about so many postings, and a task sorts about TASK of them.
PIECE, TASK = 100_000, 2_000_000


def tokens(documents: DataFrame, words=ascii_words, stop_words: DataFrame | None = None) -> DataFrame:
    """(doc_id, term), a row for each occurrence, of documents (doc_id, content)."""
    out = documents.select("doc_id", F.explode(words(F.col("content"))).alias("term"))
    return out if stop_words is None else without_stop_words(out, stop_words)


def term_frequencies(tokens_: DataFrame) -> DataFrame:
    return tokens_.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def sized_frequencies(documents: DataFrame, words=ascii_words) -> DataFrame:
    """(doc_id, doc_len, term, tf): the length comes with each document's words, so that nothing has to be joined for it."""
    found = documents.select("doc_id", words(F.col("content")).alias("words"))
    rows = found.select("doc_id", F.size("words").cast("long").alias("doc_len"), F.explode("words").alias("term"))
    return rows.groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf"))


def repeated(documents: DataFrame) -> bool:
    """Whether an id is missing or has several rows. Only ids are read."""
    return not documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()


def counted(documents: DataFrame, words=ascii_words, stop_words: DataFrame | None = None) -> DataFrame:
    """(doc_id, bytes, doc_len, counts): a row for each document with its different terms and how often each occurs, terms in byte order.

    Words are counted where a document is read, so nothing is shuffled; only rows of one id, where ids repeat, are put together.
    """
    if stop_words is not None or repeated(documents):
        tf = term_frequencies(tokens(documents, words, stop_words))
        lists = tf.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"), F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("counts"))
        sizes = documents.groupBy("doc_id").agg(F.sum(F.octet_length("content")).cast("int").alias("bytes"))
        out = sizes.join(lists, sizes["doc_id"].eqNullSafe(lists["doc_id"]), "left").select(sizes["doc_id"], "bytes", F.coalesce("doc_len", F.lit(0)).alias("doc_len"), "counts")
        return out.withColumn("counts", F.coalesce("counts", F.array().cast(lists.schema["counts"].dataType)))
    found = documents.select("doc_id", F.octet_length("content").alias("bytes"), F.sort_array(words(F.col("content"))).alias("w"))
    first = F.expr("CASE WHEN size(w) > 0 THEN filter(sequence(0, size(w) - 1), i -> i = 0 OR w[i] <> w[i - 1]) ELSE array() END")
    found = found.select("doc_id", "bytes", "w", first.alias("first"))
    counts = F.expr("transform(first, (at, k) -> struct(w[at] AS term, CAST(coalesce(get(first, k + 1), size(w)) - at AS BIGINT) AS tf))")
    return found.select("doc_id", "bytes", F.size("w").cast("long").alias("doc_len"), counts.alias("counts"))


def frequencies(counted_: DataFrame) -> DataFrame:
    """(doc_id, doc_len, term, tf)."""
    return counted_.select("doc_id", "doc_len", F.explode("counts").alias("c")).select("doc_id", "doc_len", "c.term", "c.tf")


def document_lengths(tf: DataFrame) -> DataFrame:
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))


def corpus_statistics(documents: DataFrame, lengths: DataFrame) -> DataFrame:
    """(n_docs, avgdl): one row. Documents without tokens count."""
    total = lengths.agg(F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens"))
    return documents.agg(F.count("*").alias("n_docs")).crossJoin(total).select("n_docs", F.try_divide(F.col("tokens"), F.col("n_docs")).alias("avgdl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs, df):
    return F.log2((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def postings(documents: DataFrame, tf: DataFrame) -> DataFrame:
    """(term, doc_id, tf, doc_len, df, weight). tf should be a written table. Frequencies are joined from a table of their own, so that
    adaptive execution can split a term that most documents hold, and so are lengths, if tf has none; the statistics are one row."""
    df = write_shared(document_frequencies(tf), "frequencies")
    sized = tf if "doc_len" in tf.columns else tf.join(document_lengths(tf), "doc_id")
    stats = F.broadcast(corpus_statistics(documents, tf.select(F.col("tf").alias("doc_len"))))  # one row
    return _weighted(sized.join(df, "term").join(stats))


def _weighted(rows: DataFrame) -> DataFrame:
    norm = F.col("tf") + F.lit(K1) * (F.lit(1.0) - F.lit(B) + F.lit(B) * F.col("doc_len") / F.col("avgdl"))
    weight = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * F.lit(K1 + 1.0) / norm
    return rows.select("term", "doc_id", "tf", "doc_len", "df", weight.alias("weight"))


def build(documents: DataFrame, words=ascii_words, stop_words: DataFrame | None = None) -> DataFrame:
    """Sorted postings of documents, tokenised once."""
    own = write_shared(counted(documents, words, stop_words), "counts")
    return sorted_postings(documents, own, write_shared(document_frequencies(frequencies(own)), "frequencies"))


def sorted_postings(documents: DataFrame, counted_: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf, doc_len, df, weight) of written counts, in byte order of terms within each partition, so that a query's terms prune
    pages.

    Postings move once: how many documents hold a term is counted where its postings meet. With a written table df (term, df), a term
    of more than PIECE postings is dealt out in pieces, so that no term is a single task's; without, each term's postings are in one
    partition, in id order.
    """
    spark, tf = counted_.sparkSession, frequencies(counted_)
    if df is None:
        rows, key = tf.withColumn("_df", F.lit(None).cast("long")), ["term"]
        total = counted_.agg(F.sum(F.size("counts"))).first()[0] or 0
    else:
        common = df.where(F.col("df") > PIECE).select("term", F.col("df").alias("_df"))  # all postings / PIECE rows at most
        piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_df") / PIECE)), F.lit(0))
        rows, key = tf.join(F.broadcast(common), "term", "left").withColumn("_piece", piece), ["term", "_piece"]
        total = df.agg(F.sum("df")).first()[0] or 0
    n = -(-total // TASK)
    dealt = rows.repartition(*([n] if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else []), *key)
    held = F.count("*").over(Window.partitionBy(*key).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = dealt.withColumn("df", F.coalesce("_df", held)).join(F.broadcast(corpus_statistics(documents, counted_)))  # one row
    return _weighted(out)


def dictionary(tokens_: DataFrame) -> DataFrame:
    """(line_num, term, freq): terms in byte order with their 1-based place."""
    return _in_order(tokens_.groupBy("term").agg(F.count("*").alias("freq")))


def counted_dictionary(counted_: DataFrame) -> DataFrame:
    """The same of counts."""
    return _in_order(frequencies(counted_).groupBy("term").agg(F.sum("tf").alias("freq")))


def _in_order(freq: DataFrame) -> DataFrame:
    return numbered(freq, ["term"]).select("line_num", "term", "freq")


def sized_char_index(dictionary_: DataFrame) -> DataFrame:
    """(ch, line_num, size), a row for each different character of each term; size is the term's length."""
    size = F.char_length("term").alias("size")
    return dictionary_.select("line_num", size, F.explode(F.array_distinct(characters(F.col("term")))).alias("ch")).select("ch", "line_num", "size")


def char_index(dictionary_: DataFrame) -> DataFrame:
    """(ch, line_num), a row for each different character of each term."""
    return sized_char_index(dictionary_).select("ch", "line_num")
