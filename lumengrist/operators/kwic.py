"""Keyword-in-context snippets of (query_id, doc_id, content) for the queries' keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import HALF_WINDOW, PLAIN_SNIPPET

_KEY = ["query_id", "doc_id"]


def windows(found: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, doc_id, begin, end, hits): a window of 25 characters at either side of each hit. Hits go left to right without overlap;
    where they begin follows from the lengths of what lies between them, added up."""
    k = keywords.where(F.col("term") != "").select("query_id", "term")
    gaps = F.transform(F.split("content", F.concat(F.lit(r"\Q"), "term", F.lit(r"\E")), -1), F.char_length)
    hit = found.join(k, "query_id").select(*_KEY, "term", F.char_length("content").alias("size"), gaps.alias("gaps")).where(F.size("gaps") > 1)
    hit = hit.select(*_KEY, "term", "size", F.posexplode(F.expr("slice(gaps, 1, size(gaps) - 1)")).alias("i", "gap"))
    before = Window.partitionBy(*_KEY, "term").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("at", (F.sum(F.col("gap") + F.char_length("term")).over(before) - F.char_length("term")).cast("int"))
    end = F.least(F.col("size"), F.col("at") + F.char_length("term") + HALF_WINDOW)
    return hit.select(*_KEY, F.greatest(F.lit(0), F.col("at") - HALF_WINDOW).alias("begin"), end.alias("end"), F.lit(1).alias("hits"))


def merged(windows_: DataFrame) -> DataFrame:
    """Windows that overlap or touch become one; hits add up."""
    order = Window.partitionBy(*_KEY).orderBy("begin", "end")
    earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = windows_.withColumn("_new", F.when(earlier < F.col("begin"), 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*_KEY, "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("hits").alias("hits")).drop("_island")


def best(merged_: DataFrame) -> DataFrame:
    """The window with most hits, of these the longest, of these the first."""
    order = Window.partitionBy(*_KEY).orderBy(F.desc("hits"), F.desc(F.col("end") - F.col("begin")), "begin")
    return merged_.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def abstracts(found: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, doc_id, abstract). Without a hit the first 50 characters; empty without content or keywords."""
    window = best(merged(windows(found, keywords)))
    asked = keywords.select("query_id").distinct().withColumn("_asked", F.lit(True))
    out = found.select(*_KEY, "content").join(window, _KEY, "left").join(asked, "query_id", "left")
    size = F.char_length("content")
    dots = lambda where: F.when(where, "...").otherwise("")
    plain = F.concat(F.substring("content", 1, PLAIN_SNIPPET), dots(size > PLAIN_SNIPPET))
    cut = F.concat(dots(F.col("begin") > 0), F.expr("substring(content, begin + 1, end - begin)"), dots(F.col("end") < size))
    text = F.when(F.col("_asked").isNull() | (size == 0), "").when(F.col("begin").isNull(), plain).otherwise(cut)
    return out.select(*_KEY, F.coalesce(text, F.lit("")).alias("abstract"))
