"""The text formats of page store, offsets, inverted index, dictionary and character index: lines out, tables in."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, numbered, write_shared

log = logging.getLogger(__name__)
_END = "</doc>\n"
#: Bytes of an index's lines that are cut at once, or one line.
_BLOCK = 16 << 20
#: Where a line of a text file stands among all: file, first byte of its split, and number.
_PLACE = ("_metadata.file_path AS _file", "_metadata.file_block_start AS _start", "monotonically_increasing_id() AS _line")


def page_record(doc_id: Column, link: Column, title: Column, content: Column) -> Column:
    """One record of the page store. Values aren't escaped, as readers of the format expect."""
    tag = lambda name, value: F.concat(F.lit(f"\t<{name}>"), value, F.lit(f"</{name}>\n"))
    return F.concat(F.lit("<doc>\n"), tag("docid", doc_id.cast("string")), tag("link", link), tag("title", title), tag("content", content), F.lit("</doc>\n"))


def page_store(documents: DataFrame) -> DataFrame:
    """(doc_id, record, offset, length): records in id order with their places in bytes."""
    records = documents.select("doc_id", page_record(F.col("doc_id"), F.col("link"), F.col("title"), F.col("content")).alias("record"))
    placed = numbered(records.withColumn("length", F.octet_length("record").cast("long")), ["doc_id"], "offset", F.col("length"))
    return placed.select("doc_id", "record", "offset", "length")


def read_page_store(spark: SparkSession, path: str) -> DataFrame:
    """(offset, length, record) of the records in the files of a page store, which in path order are one."""
    rows = spark.read.option("lineSep", _END).text(path).select(F.concat("value", F.lit(_END)).alias("record"), *map(F.expr, _PLACE))
    placed = numbered(rows.withColumn("length", F.octet_length("record").cast("long")), ["_file", "_start", "_line"], "offset", F.col("length"))
    return placed.select("offset", "length", "record")


def write_page_store(store: DataFrame, path: str) -> None:
    """The records in id order, as one text file for each range of ids."""
    body = F.expr(f"left(record, char_length(record) - {len(_END)})")
    store.repartitionByRange("offset").sortWithinPartitions("offset").select(body.alias("record")).write.option("lineSep", _END).text(path)


def parsed_record(record: Column) -> Column:
    """struct<link, title, content> of a record; null where its values hold markup, so that it is no XML."""
    field = lambda name: rf"\t<{name}>([^<]*)</{name}>\n"
    pattern = r"\A<doc>\n" + "".join(map(field, ("docid", "link", "title", "content"))) + r"</doc>\n\z"

    def value(group: int) -> Column:
        x = F.regexp_extract(record, pattern, group)
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(char))
        return x

    return F.when(record.rlike(pattern), F.struct(value(2).alias("link"), value(3).alias("title"), value(4).alias("content")))


def fetched(ranked: DataFrame, offsets: DataFrame, store: DataFrame) -> DataFrame:
    """ranked (doc_id, ...) with link, title and content read at (offset, length). What isn't readable there is left out, and nothing moves up.
    The places are written, so that their size is known and records don't move for a few."""
    places = write_shared(ranked.join(offsets, "doc_id"), "places")
    at = places.join(store, ["offset", "length"]).drop("offset", "length")
    return at.withColumn("_page", parsed_record(F.col("record"))).where("_page IS NOT NULL").select(*ranked.columns, "_page.link", "_page.title", "_page.content")


def significant(weight: Column) -> Column:
    """A number as text streams print it: six significant digits without trailing zeros, with an exponent below -4 and from 6 on."""
    digits = F.format_string("%.5e", weight)
    power = F.substring_index(digits, "e", -1).cast("int")
    short = lambda x: F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1")
    bare = lambda x: F.regexp_replace(short(x), r"\.$", "")
    fixed = F.coalesce(*[F.when(power == p, bare(F.format_string(f"%.{5 - p}f", weight))) for p in range(-4, 6)])
    return F.when(power.between(-4, 5), fixed).otherwise(F.concat(bare(F.substring_index(digits, "e", 1)), F.lit("e"), F.substring_index(digits, "e", -1)))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, text, terms, lines, size = None, [], [], [], 0  # what is at hand of a term is one string for each batch

    def ended() -> int:
        terms.append(now)
        lines.append(now + "".join(text))
        return len(lines[-1])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(lines, pa.string())], ["term", "line"])

    for b in batches:
        held, ids, weights = (c.to_pylist() for c in b.columns)
        pairs = [f" {d} {w:g}" for d, w in zip(ids, weights, strict=True)]
        starts = [i for i, t in enumerate(held) if not i or t != held[i - 1]]
        for i, j in zip(starts, [*starts[1:], len(held)], strict=True):
            if held[i] != now:
                if now is not None:
                    size += ended()
                    if size > 1 << 20 or len(lines) == 10_000:
                        yield out()
                        terms, lines, size = [], [], 0
                now, text = held[i], []
            text.append("".join(pairs[i:j]))
    if now is not None:
        ended()
        yield out()


def index_lines(postings: DataFrame) -> DataFrame:
    """(term, line): `term id weight id weight ...`, ids ascending, of postings whose terms are each in one partition, in id order. Weights
    are as text streams print them (significant())."""
    return postings.select("term", "doc_id", "weight").mapInArrow(_lines, "term string, line string")


def dictionary_lines(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("line_num", F.concat_ws(" ", "term", F.col("freq").cast("string")).alias("line"))


def char_index_lines(char_index: DataFrame) -> DataFrame:
    """(ch, line): `char line line ...`, lines ascending."""
    lists = char_index.groupBy("ch").agg(F.sort_array(F.collect_set("line_num")).alias("lines"))
    return lists.select("ch", F.concat(F.col("ch"), F.lit(" "), F.array_join(F.transform("lines", lambda n: n.cast("string")), " ")).alias("line"))


def write_lines(lines: DataFrame, order: list[str], path: str, column: str = "line") -> None:
    """One text file for each range of the order; read in path order they are the whole file."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.text(path)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        ends = np.cumsum(pc.binary_length(whole.column(0)).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(whole):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BLOCK)))
            words = pc.split_pattern(whole.column(0).slice(at, to - at), " ")
            first, at = words.offsets.to_numpy()[:-1], to
            n = (words.value_lengths().to_numpy(zero_copy_only=False) - 1) // 2  # pairs of each line
            upto, values = np.cumsum(n), words.values
            for start in range(0, int(upto[-1]), 1 << 16):
                k = np.arange(start, min(start + (1 << 16), upto[-1]))
                line = np.searchsorted(upto, k, side="right")
                place = first[line] + 1 + 2 * (k - (upto - n)[line])
                yield pa.RecordBatch.from_arrays([values.take(pa.array(x)) for x in (first[line], place, place + 1)], ["term", "doc_id", "weight"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, weight). The work for a line grows with its length."""
    pairs = spark.read.text(path).mapInArrow(_pairs, "term string, doc_id string, weight string")
    return pairs.select("term", F.col("doc_id").cast("long").alias("doc_id"), F.col("weight").cast("double").alias("weight"))


def read_document_sets(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id) of an index; without one there are none, and nothing occurs together."""
    if not exists(spark, path):
        log.warning("no index at %s: similarity by common documents is off", path)
        return spark.sql("SELECT '' AS term, 0L AS doc_id WHERE false")
    return read_index(spark, path).select("term", "doc_id").distinct()


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(line_num, term, freq)."""
    lines = spark.read.text(path).select(F.split("value", " ").alias("p"))
    return numbered(lines.select(F.col("p")[0].alias("term"), F.col("p")[1].cast("long").alias("freq")), ["term"]).select("line_num", "term", "freq")


def read_char_index(spark: SparkSession, path: str) -> DataFrame:
    """(ch, line_num)."""
    lines = spark.read.text(path).select(F.split("value", " ").alias("p"))
    numbers = F.slice("p", F.lit(2), F.size("p")).cast("array<long>")
    return lines.select(F.col("p")[0].alias("ch"), F.explode(numbers).alias("line_num"))


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, offset, length) up to the first line, in path order, that isn't three numbers; blank lines don't count."""
    lines = spark.read.text(path).select("value", F.struct(*map(F.expr, _PLACE)).alias("place")).where(~F.col("value").rlike(r"\A\s*\z"))
    parts = F.split(F.regexp_replace("value", r"\A\s+|\s+\z", ""), r"\s+")
    numbers = lines.select("place", F.when(F.size(parts) == 3, F.transform(parts, lambda x: F.when(x.rlike(r"\A[+-]?[0-9]+\z"), x.try_cast("long")))).alias("n"))
    bad = numbers.where("n IS NULL OR exists(n, x -> x IS NULL)").agg(F.min("place").alias("first"))  # one row
    good = numbers.join(F.broadcast(bad)).where("first IS NULL OR place < first")
    return good.select(F.col("n")[0].alias("doc_id"), F.col("n")[1].alias("offset"), F.col("n")[2].alias("length"))


def max_frequency(dictionary: DataFrame) -> DataFrame:
    """(max_freq): one row, at least 1."""
    return dictionary.agg(F.greatest(F.lit(1), F.coalesce(F.max("freq"), F.lit(1))).cast("long").alias("max_freq"))
