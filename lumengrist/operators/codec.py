"""Messages of the service: type and length as big-endian 32-bit numbers, then the value; requests, responses, command lines."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import KEYWORD_REQUEST, KEYWORD_RESPONSE, PAGE_REQUEST, PAGE_RESPONSE
from ..sources.shared import write_shared

HEAD = struct.Struct(">II")


def encode(kind: Column, value: Column) -> Column:
    """BINARY of a message. value: STRING or BINARY."""
    raw = value.cast("binary")
    number = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    return F.concat(number(kind), number(F.octet_length(raw)), raw)


class TooLong(ValueError):
    """A longer value was announced than is allowed; frames are those before it."""

    def __init__(self, length: int, frames: list[tuple[int, bytes]]):
        super().__init__(f"a value of {length} bytes")
        self.frames = frames


def take_frames(held: bytes, most: int | None = None) -> tuple[list[tuple[int, bytes]], bytes]:
    """Complete messages at the front, and the rest. With `most`, a longer announced value is an error."""
    frames, at = [], 0
    while len(held) - at >= HEAD.size:
        kind, length = HEAD.unpack_from(held, at)
        if most is not None and length > most:
            raise TooLong(length, frames)
        if len(held) - at < HEAD.size + length:
            break
        frames.append((kind, held[at + HEAD.size : at + HEAD.size + length]))
        at += HEAD.size + length
    return frames, held[at:]


@F.udtf(returnType="type long, length long, value binary")
class DecodeFrames:
    """A row for each complete message in a BINARY; what follows the last one gives none."""

    def eval(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        for kind, value in take_frames(bytes(data or b""))[0]:
            yield kind, len(value), value


def decode(streams: DataFrame) -> DataFrame:
    """(conn_id, type, length, value) of (conn_id, data): a connection's whole bytes in one row."""
    spark = streams.sparkSession
    spark.udtf.register("decode_frames", DecodeFrames)
    return spark.sql("SELECT conn_id, f.* FROM {streams}, LATERAL decode_frames(data) f", streams=streams.select("conn_id", "data"))


def requests(messages: DataFrame) -> DataFrame:
    """(conn_id, type, text, response_type) of messages that ask for something; others are passed over."""
    known = messages.where(F.col("type").isin(KEYWORD_REQUEST, PAGE_REQUEST))
    answer = F.when(F.col("type") == KEYWORD_REQUEST, KEYWORD_RESPONSE).otherwise(PAGE_RESPONSE)
    number = ["no"] if "no" in messages.columns else []
    return known.select("conn_id", *number, "type", F.col("value").cast("string").alias("text"), answer.cast("long").alias("response_type"))


def replies(requests_: DataFrame, recommended: Callable[[DataFrame], DataFrame], searched: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(conn_id, no, frame) for requests (conn_id, no, type, text, response_type): the JSON answer of either service as a message.

    recommended and searched answer queries (query_id, text) with rows for words_json and pages_json. Equal requests are answered once;
    a request without an answer gets an empty array.
    """
    asked = requests_.select("type", "text").distinct().withColumn("query_id", F.monotonically_increasing_id())
    asked = write_shared(asked, "requests")
    of = lambda kind: asked.where(F.col("type") == kind).select("query_id", "text")
    answers = words_json(recommended(of(KEYWORD_REQUEST))).union(pages_json(searched(of(PAGE_REQUEST))))
    json = asked.join(answers, "query_id", "left").select("type", "text", F.coalesce("json", F.lit("[]")).alias("json"))
    return requests_.join(json, ["type", "text"]).select("conn_id", "no", encode(F.col("response_type"), F.col("json")).alias("frame"))


def words_json(recommended: DataFrame) -> DataFrame:
    """(query_id, json): the words in order as one JSON array."""
    lists = recommended.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return lists.select("query_id", F.to_json("t.term").alias("json"))


def pages_json(pages: DataFrame) -> DataFrame:
    """(query_id, json): ranked pages (query_id, rank, doc_id, title, link, abstract) as one JSON array, keys in byte order."""
    page = F.struct("rank", F.struct("abstract", F.col("doc_id").alias("id"), "link", "title").alias("page"))
    lists = pages.groupBy("query_id").agg(F.sort_array(F.collect_list(page)).alias("p"))
    return lists.select("query_id", F.to_json("p.page").alias("json"))


def parsed_pages(answers: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, title, link, abstract) of (query_id, json), as a client reads them."""
    pages = F.from_json("json", "array<struct<abstract: string, id: long, link: string, title: string>>")
    rows = answers.select("query_id", F.posexplode(pages).alias("at", "page"))
    return rows.select("query_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("page.id").alias("doc_id"), "page.title", "page.link", "page.abstract")


def commands(lines: DataFrame) -> DataFrame:
    """(line, action, type, text): what a typed line asks for. Blanks and tabs around it don't count; an empty one asks nothing."""
    line = F.btrim("line", F.lit(" \t"))
    key, page = line.startswith("/k ") & (F.char_length(line) > 3), line.startswith("/s ") & (F.char_length(line) > 3)
    action = (
        F.when(line == "", "ignore").when(line == "/quit", "quit").when(line == "/help", "help").when(key | page, "send").when(line.startswith("/"), "unknown").otherwise("send")
    )
    kind = F.when(action == "send", F.when(key, KEYWORD_REQUEST).otherwise(PAGE_REQUEST))
    text = F.when(action == "send", F.when(key | page, F.expr("substring(btrim(line, ' \t'), 4)")).otherwise(line))
    return lines.select("line", action.alias("action"), kind.cast("long").alias("type"), text.alias("text"))
