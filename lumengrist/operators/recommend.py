"""Keyword recommendation: recall by shared characters and by prefix, then a mixed score, for a table of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import EDIT_WEIGHT, FREQUENCY_WEIGHT, JACCARD_WEIGHT, MAX_DISTANCE, SUGGESTIONS
from ..functions.text import characters
from ..sources.shared import few_values, write_shared


def recall_by_characters(queries: DataFrame, char_index: DataFrame) -> DataFrame:
    """(query_id, line_num) of terms that share a character with the query."""
    asked = queries.select("query_id", F.explode(F.array_distinct(characters(F.col("text")))).alias("ch"))
    return asked.join(char_index, "ch").select("query_id", "line_num").distinct()


def recall_by_prefix(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, line_num) of terms that begin with the query; an empty query recalls all.

    An equi-join: each term's prefixes of the lengths that are asked for meet the queries.
    """
    q = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = q.select(F.char_length("text").alias("size")).distinct()
    terms = dictionary.select("line_num", "term", F.explode(F.sequence(F.lit(0), F.char_length("term"))).alias("size"))
    prefixes = terms.join(sizes, "size").select("line_num", F.substring("term", F.lit(1), F.col("size")).alias("text"))
    return q.join(prefixes, "text").select("query_id", "line_num")


def recall(queries: DataFrame, dictionary: DataFrame, char_index: DataFrame) -> DataFrame:
    """The union of both; what both recall counts once."""
    return recall_by_characters(queries, char_index).union(recall_by_prefix(queries, dictionary)).distinct()


def recall_near(queries: DataFrame, dictionary: DataFrame, char_index: DataFrame) -> DataFrame:
    """What of recall() can be near: terms whose length differs little. char_index has the terms' `size`, so that they go before anything
    is joined by line."""
    fits = lambda size: F.abs(F.col(size) - F.char_length("text")) <= MAX_DISTANCE
    asked = queries.select("query_id", "text", F.explode(F.array_distinct(characters(F.col("text")))).alias("ch"))
    by_character = asked.join(char_index, "ch").where(fits("size")).select("query_id", "line_num")
    short = dictionary.select("line_num", "term", F.char_length("term").alias("size"))
    starts = short.select("line_num", "term", "size", F.explode(F.sequence(F.greatest(F.lit(0), F.col("size") - MAX_DISTANCE), F.col("size"))).alias("n"))
    by_prefix = starts.select("line_num", F.substring("term", F.lit(1), F.col("n")).alias("text")).join(queries.select("query_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    return by_character.union(by_prefix.select("query_id", "line_num")).distinct()


def near_terms(queries: DataFrame, recalled: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, query, term, freq, distance) of recalled terms other than the query within the distance."""
    c = recalled.join(dictionary, "line_num").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    c = c.where((F.col("term") != F.col("query")) & (F.abs(F.char_length("term") - F.char_length("query")) <= MAX_DISTANCE))
    c = c.withColumn("distance", F.levenshtein("query", "term", MAX_DISTANCE)).where("distance >= 0")
    return c.select("query_id", "query", "term", "freq", "distance")


def jaccard(candidates: DataFrame, postings: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """candidates (query_id, query, term) with jaccard, of the documents that hold query and term; 0 where either has none.

    postings (term, doc_id), or counts of documents (doc_id, counts). Of postings only those of the candidates' terms are joined, by document;
    counts move nothing: what a document has in common with a query is added up where it is read. sizes: (term, df), if known.
    """
    own = candidates.select("query_id", "query", "term").distinct()
    terms = own.select("term").union(own.select("query")).distinct()
    if "counts" in postings.columns:
        held = holding(postings, own.select("query").distinct(), "query").select("query", F.explode("counts.term").alias("term"))
        common = held.join(own, ["query", "term"])
        sizes = postings.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")) if sizes is None else sizes
        size = sizes.join(terms, "term", "left_semi").select("term", F.col("df").alias("n"))
    else:
        wanted = postings.select("term", "doc_id").join(terms, "term", "left_semi")
        size = wanted.groupBy("term").agg(F.count("*").alias("n"))
        of_query = own.select("query").distinct().join(wanted.withColumnRenamed("term", "query"), "query")
        common = own.join(wanted, "term").join(of_query, ["query", "doc_id"])
    common = common.groupBy("query_id", "query", "term").agg(F.count("*").alias("common"))
    out = own.join(size, "term", "left").join(size.select(F.col("term").alias("query"), F.col("n").alias("nq")), "query", "left").join(common, ["query_id", "query", "term"], "left")
    both = F.coalesce("common", F.lit(0))
    value = F.when(F.col("n").isNull() | F.col("nq").isNull(), F.lit(0.0)).otherwise(both / (F.col("n") + F.col("nq") - both))
    return out.select("query_id", "query", "term", value.alias("jaccard"))


def holding(counted: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """(column, doc_id, counts): a row for each document and each value of the column `column` of asked that it holds as a term. A few values
    are looked up in the row; of more, documents are found by their terms first."""
    few = few_values(asked, column)
    if few is None:
        found = counted.select("doc_id", F.explode("counts.term").alias(column)).join(asked.select(column).distinct(), column)
        return found.join(counted.select("doc_id", "counts"), "doc_id").select(column, "doc_id", "counts")
    if not few:
        return counted.select(F.lit(None).cast("string").alias(column), "doc_id", "counts").where("false")
    held = F.filter(F.array(*map(F.lit, few)), lambda x: F.array_contains(F.col("counts.term"), x))
    return counted.select(F.explode(held).alias(column), "doc_id", "counts")


def edit_similarity(distance, query, term):
    longest = F.greatest(F.char_length(query), F.char_length(term))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.lit(1.0) - distance / longest)


def frequency_score(freq, most):
    return F.log2(F.lit(1.0) + freq) / F.log2(F.lit(1.0) + most)


def scored(candidates: DataFrame, postings: DataFrame, most: DataFrame, digits: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(query_id, term, jaccard, edit_sim, freq_score, score) of near terms, which should be a written table. most: one row (max_freq).
    postings and sizes as of jaccard(). With `digits`, all are rounded."""
    j = jaccard(candidates, postings, sizes)
    c = candidates.join(j, ["query_id", "query", "term"]).join(F.broadcast(most))  # one row
    edit = edit_similarity(F.col("distance"), F.col("query"), F.col("term"))
    freq = frequency_score(F.col("freq"), F.col("max_freq"))
    total = F.lit(JACCARD_WEIGHT) * F.col("jaccard") + F.lit(EDIT_WEIGHT) * edit + F.lit(FREQUENCY_WEIGHT) * freq
    r = lambda x: x if digits is None else F.round(x, digits)
    return c.select("query_id", "term", r(F.col("jaccard")).alias("jaccard"), r(edit).alias("edit_sim"), r(freq).alias("freq_score"), r(total).alias("score"))


def top_terms(scored_: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """(query_id, rank, term, score): the best by score, ties in byte order."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "term"))
    return scored_.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "term", "score")


def recommend(queries: DataFrame, dictionary: DataFrame, char_index: DataFrame, postings: DataFrame, most: DataFrame, k: int = SUGGESTIONS, digits: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, term, score). char_index (ch, line_num, size); postings and sizes as of jaccard()."""
    near = write_shared(near_terms(queries, recall_near(queries, dictionary, char_index), dictionary), "near-terms")
    return top_terms(scored(near, postings, most, digits, sizes), k)


def recall_by_cooccurrence(queries: DataFrame, postings: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """Extension: (query_id, rank, term, common) of the terms that share most documents with the query; ties in byte order. postings as of
    jaccard()."""
    if "counts" in postings.columns:
        held = holding(postings, queries, "text").select("text", F.explode("counts.term").alias("term")).where("term <> text")
        common = held.groupBy("text", "term").agg(F.count("*").alias("common"))
        hits = queries.join(common, "text").groupBy("query_id", "term").agg(F.sum("common").alias("common"))
    else:
        docs = queries.join(postings.select(F.col("term").alias("text"), "doc_id"), "text").select("query_id", "text", "doc_id")
        hits = docs.join(postings.select("doc_id", "term"), "doc_id").where("term <> text").groupBy("query_id", "term").agg(F.count("*").alias("common"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("common"), "term"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "term", "common")
