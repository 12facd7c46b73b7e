"""Text directories and RSS pages as DataFrames."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_tags
from .shared import exists

log = logging.getLogger(__name__)
_SCHEMA = "channel struct<item: array<struct<title: string, link: string, content: string, description: string>>>"


def scan_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value): each file of a folder, not of those below, as one text. Unreadable files are skipped. Rows have no order of their
    own: order by path. Files whose names begin with a dot or an underscore are left out, as by all of Spark's readers."""
    files = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "false").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def rss_items(files: DataFrame) -> DataFrame:
    """(path, position, link, title, content) of every item of every channel in (path, value), without markup.

    A file that isn't XML or has no channel has no items; an item with neither content nor description is skipped, an empty content
    isn't replaced; missing titles and links are empty.
    """
    parsed = files.select("path", F.from_xml("value", F.lit(_SCHEMA), {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}).alias("x"))
    items = parsed.select("path", F.posexplode("x.channel.item").alias("position", "item")).where("item IS NOT NULL")
    body = F.coalesce("item.content", "item.description")
    clean = lambda c: strip_tags(F.coalesce(c, F.lit("")))
    return items.where(body.isNotNull()).select("path", "position", clean(F.col("item.link")).alias("link"), clean(F.col("item.title")).alias("title"), strip_tags(body).alias("content"))


def page_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, link, title, content) of pages (page_id, url, html)."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)
    return pages.select(F.col("page_id").alias("doc_id"), F.coalesce("url", F.lit("")).alias("link"), title.alias("title"), strip_tags(F.coalesce("html", F.lit(""))).alias("content"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(term): the words of a file, separated by white space; none where there is no file."""
    if not exists(spark, path):
        log.warning("no stop words at %s", path)
        return spark.sql("SELECT '' AS term WHERE false")
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("term")).where("term <> ''").distinct()
