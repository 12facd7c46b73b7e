"""Exact dedup over an extendible-hash index kept on shared files. DataFrame functions only.

1. One scan writes a key row per document: 64-bit hash, SHA-256 and id; the text isn't moved. Hashes are counted; one that occurs once
   is a text of its own for certain.
2. The directory: different hashes are counted by prefix (2**max_depth counters at most). Beginning with one bucket, each bucket over
   its capacity splits in two, level by level; a level that has such a bucket doubles the directory.
3. A second scan takes only texts whose hash may occur again (a bit filter of bounded size) and groups them by hash and bytes. Equal
   bytes meet in the hash aggregate, before the shuffle already, so a hot group moves one row for each task.
4. Insertion: owner tasks get ranges of (bucket, hash) and number the different texts of one hash as a chain of entries, each with the
   id that stays and the group's size. Entries of all texts are written, and the texts of those that may collide beside them.
5. Lookup: a document goes by its hash through the directory to its bucket and chain. A chain of one link holds all documents of that
   hash, since their bytes were compared when it was made; in longer ones the document's bytes are compared with each link's text.
   Both are equi-joins that adaptive execution splits, so that a hot hash is no single task.

Defined cases: a null text is the empty text; the largest id stays, nulls counting as smaller than any id (a group with null
ids only has a null keep_id and keeps its rows); rows that repeat id and text are one document and get the same flag; texts of any
length are compared whole; an empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, flagged, load, maybe_member, write_shared


class Index(NamedTuple):
    depth: int
    directory: DataFrame  # (slot, bucket, local_depth): 2**depth slots
    chains: DataFrame  # (bucket, h, chain, links, sha, keep_id, group_size): an entry for each text
    texts: DataFrame  # (h, sha, norm): texts of entries that may share their hash


def directory(heads: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(slot, bucket, local_depth) over the hashes of heads (h). A bucket is named by its first slot at max_depth; one that is still
    overfull there keeps its overflow."""
    counts = heads.groupBy(F.expr(f"shiftrightunsigned(h, {64 - max_depth})").alias("slot")).agg(F.count("*").alias("n"))
    levels = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    levels = levels.groupBy("level", F.expr(f"shiftright(slot, {max_depth} - level)").alias("prefix")).agg(F.sum("n").alias("n"))
    levels = write_shared(levels, "dedup-levels")  # 2**(max_depth + 1) rows at most
    split = levels.where((F.col("n") > capacity) & (F.col("level") < max_depth))
    parts = split.select((F.col("level") + 1).alias("level"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    root = heads.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("prefix"))
    leaves = parts.union(root).join(split.select("level", "prefix"), ["level", "prefix"], "left_anti")
    leaves = write_shared(leaves, "dedup-buckets")
    depth = leaves.agg(F.max("level")).first()[0]
    span = F.expr(f"shiftleft(1L, {depth} - level)")
    slots = leaves.select(F.explode(F.sequence(F.col("prefix") * span, F.col("prefix") * span + span - 1)).alias("slot"), F.expr(f"shiftleft(prefix, {max_depth} - level)").alias("bucket"), F.col("level").alias("local_depth"))
    return write_shared(slots.coalesce(1), "dedup-directory")


def with_bucket(df: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    slot = F.expr(f"shiftrightunsigned(h, {64 - depth})") if depth else F.lit(0).cast("long")
    return df.withColumn("slot", slot).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")  # 2**max_depth rows at most


def build_index(texts: DataFrame, keys: DataFrame, capacity: int = 4096, max_depth: int = 14) -> Index:
    """texts: (doc_id, norm, h); keys: (doc_id, h, sha), written."""
    heads = write_shared(keys.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.first("sha").alias("sha")), "dedup-heads")
    again = write_shared(heads.where("n > 1").select("h"), "dedup-again")
    grouped = maybe_member(texts, "h", again).groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = write_shared(grouped.withColumn("sha", F.unhex(F.sha2("norm", 256))), "dedup-texts")
    alone = flagged(heads, "h", again).where("NOT maybe")  # what the same filter leaves out of the second scan
    entries = grouped.select("h", "sha", "keep_id", "group_size").union(alone.select("h", "sha", "keep_id", F.col("n").alias("group_size")))
    slots = directory(heads, capacity, max_depth)
    depth = slots.agg(F.max("local_depth")).first()[0]
    owned = with_bucket(entries, slots, depth).repartitionByRange("bucket", "h")
    link = Window.partitionBy("bucket", "h").orderBy("sha")
    every = Window.partitionBy("bucket", "h").orderBy("sha").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chains = owned.withColumn("chain", F.row_number().over(link)).withColumn("links", F.count("*").over(every))
    return Index(depth, slots, write_shared(chains.select("bucket", "h", "chain", "links", "sha", "keep_id", "group_size"), "dedup-index"), grouped.select("h", "sha", "norm"))


def look_up(texts: DataFrame, keys: DataFrame, index: Index) -> DataFrame:
    """(doc_id, keep_id, group_size, sha) of every document that the index holds."""
    single = index.chains.where("links = 1").select("bucket", "h", "sha", "keep_id", "group_size")
    found = with_bucket(keys.select("doc_id", "h"), index.directory, index.depth).join(single, ["bucket", "h"]).select("doc_id", "keep_id", "group_size", "sha")
    longer = write_shared(index.chains.where("links > 1"), "dedup-chains")
    if longer.isEmpty():  # no two texts share a hash, so there is nothing to compare
        return found
    links = longer.join(index.texts, ["h", "sha"]).select("bucket", "h", F.col("norm").alias("text"), "sha", "keep_id", "group_size")
    asking = with_bucket(maybe_member(texts, "h", longer.select("h")), index.directory, index.depth)
    same = asking.join(links, ["bucket", "h"]).where(F.col("norm") == F.col("text"))
    return found.union(same.select("doc_id", "keep_id", "group_size", "sha"))


def hashed(norm: Column, hash_bits: int) -> Column:
    """The first hash_bits of a 64-bit hash."""
    h = F.xxhash64(norm)
    return h if hash_bits >= 64 else h.bitwiseAND(F.lit(-(1 << (64 - hash_bits))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, max_depth: int = 14, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. See the module for method and defined cases."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    texts = texts.withColumn("h", hashed(F.col("norm"), hash_bits))
    keys = write_shared(texts.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-keys")
    found = look_up(texts, keys, build_index(texts, keys, capacity, max_depth))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
