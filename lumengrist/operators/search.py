"""Page search: ranked, with progressively relaxed matching, for a table of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import RELAXED_PERCENT, TOP_K
from ..functions.text import ascii_words, is_blank, without_stop_words
from ..sources.shared import narrowed, write_shared


def query_keywords(queries: DataFrame, words=ascii_words, stop_words: DataFrame | None = None) -> DataFrame:
    """(query_id, term), distinct, of queries (query_id, text)."""
    out = queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).where(~is_blank(F.col("term")))
    out = out if stop_words is None else without_stop_words(out, stop_words)
    return out.distinct()


def known_counts(keywords: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, n_known): keywords that the index holds. The vocabulary is cut to the queries' terms before it is made distinct."""
    return keywords.join(narrowed(postings.select("term"), "term", keywords).distinct(), "term", "left_semi").groupBy("query_id").agg(F.count("*").alias("n_known"))


def scores(keywords: DataFrame, postings: DataFrame, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, matches, score) of all documents with a keyword. Of sorted postings only pages with the keywords are read; documents
    are dealt over all cores before anything is added up, so that no task adds up what a file has of a common term. With `digits`, scores are rounded before anything ranks them,
    so that engines which add up in another order agree."""
    hits = keywords.join(narrowed(postings.select("term", "doc_id", "weight"), "term", keywords), "term")
    total = F.sum("weight")
    spark = hits.sparkSession
    hits = hits.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "query_id", "doc_id")
    return hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("matches"), (total if digits is None else F.round(total, digits)).alias("score"))


def relaxed(n):
    """Matches that the second round asks for: 60 percent, rounded up."""
    return F.greatest(F.lit(1), F.expr("0L") + F.floor((n * RELAXED_PERCENT + 99) / 100)).cast("long")


def required_matches(scored: DataFrame, known: DataFrame, top: int = TOP_K) -> DataFrame:
    """(query_id, n_known, min_matches): matches of the first round that finds `top` documents, else 1."""
    n = known.withColumn("n60", relaxed(F.col("n_known")))
    each = scored.join(n, "query_id").groupBy("query_id", "n_known", "n60").agg(
        F.count(F.when(F.col("matches") >= F.col("n_known"), 1)).alias("all_hits"), F.count(F.when(F.col("matches") >= F.col("n60"), 1)).alias("most_hits")
    )
    least = F.when(F.col("all_hits") >= top, F.col("n_known")).when((F.col("n60") < F.col("n_known")) & (F.col("most_hits") >= top), F.col("n60")).otherwise(1)
    return each.select("query_id", "n_known", least.cast("long").alias("min_matches"))


def ranked(scored: DataFrame, required: DataFrame, top: int = TOP_K) -> DataFrame:
    """(query_id, rank, doc_id, matches, score): the best documents, by score only, ties by id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    out = scored.join(required, "query_id").where(F.col("matches") >= F.col("min_matches")).withColumn("rank", place)
    return out.where(F.col("rank") <= top).select("query_id", "rank", "doc_id", "matches", "score")


def search(queries: DataFrame, postings: DataFrame, words=ascii_words, stop_words: DataFrame | None = None, top: int = TOP_K, digits: int | None = None) -> DataFrame:
    """Queries without a known keyword have no rows."""
    keywords = query_keywords(queries, words, stop_words)
    scored = write_shared(scores(keywords, postings, digits), "scores")
    return ranked(scored, required_matches(scored, known_counts(keywords, postings), top), top)


def fetched(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds link, title and content to ranked rows: bodies are joined after the ranking only, which is written, so that its size is known and
    bodies don't move for it, and of few documents only theirs are read."""
    found = write_shared(found, "found")
    return write_shared(found.join(narrowed(documents.select("doc_id", "link", "title", "content"), "doc_id", found), "doc_id"), "bodies")
