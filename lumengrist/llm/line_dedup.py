"""Line dedup that returns keep bitmaps instead of text. DataFrame functions only.

Lines become 128 bits of the SHA-256 of their keys with (document, position); the text isn't moved. Equal hashes count as equal lines, which
is the method; lines aren't compared again. The hashes are dealt to tasks by range and sorted by document and position inside, so each
task streams over its keys and sees a key's first document first. A key with more than an eighth of a task's mean share is split among
tasks by document; its first document comes from the counts that found it, which at most eight keys for each task can have. Later
occurrences end in a bitmap for each document: 64-bit words of dropped positions, up to the last word with a drop.

A line's bit is found by its position in that array, so a document takes time in proportion to its lines. Only documents that may have
drops meet their bitmaps in a join (a bit filter of bounded size tells); all others stay where they are.

Defined cases: null or empty text is one empty line; documents without id count as one document after all others; rows that
repeat id and text share a bitmap; rows that share an id but not a text are one document when lines are compared, each with a
bitmap of its own; a document whose lines all go keeps an empty text; very long texts and lines are taken whole; empty tables give empty
results; other columns, of any name, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, NO_ID, ascii_lower, boxed, field, flagged, load, shuffle_partitions, unboxed, write_shared


def _ident(id_: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(id_.cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, least_heavy: int = 4096) -> DataFrame:
    """Rows (did, th, n_dropped, dropped) of documents that lose lines: id, text hash, and words of 64 bits, 1 for a dropped line."""
    did, th = _ident(F.col(id_col), F.col(text_col))
    lines = docs.select(did.alias("did"), th.alias("th"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    occ = lines.select("did", "th", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    occ = write_shared(occ.select("did", "th", "pos", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("k")), "line-keys")
    limit = max(least_heavy, occ.count() // (8 * shuffle_partitions(docs.sparkSession)))
    heavy = occ.groupBy("k").agg(F.count("*").alias("n"), F.min("did").alias("first_did")).where(F.col("n") > limit)
    ranged = (
        occ.join(F.broadcast(heavy), "k", "left")  # eight rows for each task at most
        .withColumn("part", F.when(F.col("n").isNull(), 0).otherwise(F.expr(f"pmod(xxhash64(did), 1 + n div {limit})")))
        .repartitionByRange("k", "part")
    )
    stream = Window.partitionBy("k", "part").orderBy("did", "pos").rowsBetween(Window.unboundedPreceding, 0)
    first = F.coalesce("first_did", F.first("did").over(stream))
    drops = ranged.withColumn("first", first).where("did > first").select("did", "th", "pos")
    words = drops.groupBy("did", "th", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    maps = words.groupBy("did", "th").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("e"))
    gap = "array_repeat(0L, x.word - if(i = 0, -1, e[i - 1].word) - 1)"
    return maps.select("did", "th", "n_dropped", F.expr(f"flatten(transform(e, (x, i) -> concat({gap}, array(x.bits))))").alias("dropped"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as `row`, with n_lines (all lines), n_dropped and kept (text of the kept lines)."""
    did, th = _ident(F.col(id_col), F.col(text_col))
    own = flagged(boxed(docs, did=did, th=th), "th", bitmaps.select("th"))
    text = F.coalesce(field(text_col), F.lit(""))
    n_lines = F.size(_lines(text)).cast("long").alias("n_lines")
    stays = F.filter(_lines(text), lambda _, i: F.getbit(F.coalesce(F.get("dropped", (i / 64).cast("int")), F.lit(0)), i % 64) == 0)
    kept = F.when(F.col("n_dropped").isNull(), text).otherwise(F.array_join(stays, "\n"))
    alone = own.where("NOT maybe").select("row", n_lines, F.lit(0).cast("long").alias("n_dropped"), text.alias("kept"))
    met = own.where("maybe").join(bitmaps, ["did", "th"], "left")
    return alone.union(met.select("row", n_lines, F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated lines gone from text, and n_chars, where there is one, counted anew. A text without drops stays as it is."""
    bitmaps = write_shared(line_keep_bitmaps(docs, id_col, text_col, **options), "line-bitmaps")
    less = F.col("n_dropped") > 0
    new = {text_col: F.when(less, F.col("kept")).otherwise(field(text_col))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(less, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(field("n_chars"))
    return unboxed(with_bitmaps(docs, bitmaps, id_col, text_col), docs.columns, new)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = write_shared(line_keep_bitmaps(docs), "line-bitmaps")
    return with_bitmaps(docs, bitmaps).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, i AS pos, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), k AS (SELECT key, min(doc_id) AS first_id FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id > k.first_id, false) AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
