"""Chat formatting after collapsing cumulative snapshots.

Logs hold a conversation again and again as it grows. Each turn's role and text become a SHA-256; hashed again with the turn's rank, and
joined by exclusive or up to a turn, they are the rolling hash of that prefix: 120 bits, order kept by the ranks. A conversation whose
whole hash is the prefix hash of a longer one is a snapshot: an anti-join takes it out. Of equal conversations the smallest id stays. What
stays is rendered. Equal hashes count as equal prefixes; the texts aren't compared again.

Texts don't move for that: rows of hashes are dealt by range of conversation and turn and numbered without a single task, and prefixes
add up over blocks of `block` turns first, so a conversation with most of the table's rows is ranked and hashed by many tasks. Only where
a conversation has one number and role twice does the text itself go along, to order these turns. At last the kept conversations' texts
meet, once (a bit filter of bounded size holds the others back); a rendered chat is one value.

Defined cases: turns go by number, nulls first, ties by role and text, and are ranked from 1, so gaps don't matter; null role is
"unknown", null text is empty; rows without conv_id are one conversation; repeated rows are turns of their own; very long texts are taken
whole; empty tables give empty results; other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import numbered
from .common import flagged, load, maybe_member, write_shared


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def ranked_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, rank, n_turns, h): the turns of each conversation in order, their texts as hashes."""
    t = _turns(turns).withColumn("k", F.xxhash64("conv_id", "turn", "role"))
    ties = write_shared(t.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "chat-ties")
    h = F.substring(F.unhex(F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("text")), 256)), 1, 16)
    small = flagged(t, "k", ties).select("conv_id", "turn", "role", F.when(F.col("maybe"), F.col("text")).alias("tie"), h.alias("h"))
    placed = write_shared(numbered(small, ["conv_id", "turn", "role", "tie"], "no").select("conv_id", "no", "h"), "chat-order")
    ends = write_shared(placed.groupBy("conv_id").agg(F.min("no").alias("first"), F.count("*").alias("n_turns")), "chat-ends").withColumnRenamed("conv_id", "_c")
    out = placed.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")))
    return out.select("conv_id", (F.col("no") - F.col("first") + 1).alias("rank"), "n_turns", "h")


def prefix_hashes(turns: DataFrame, block: int = 1024) -> DataFrame:
    """(conv_id, rank, n_turns, p1, p2): p1 and p2 are the rolling hash of the conversation up to that turn."""
    salted = F.sha2(F.concat(F.col("rank").cast("string").cast("binary"), F.lit("/").cast("binary"), F.col("h")), 256)
    bits = lambda at: F.conv(F.substring("x", at, 15), 16, 10).cast("long")
    t = ranked_hashes(turns).select("conv_id", "rank", "n_turns", F.expr(f"(rank - 1) div {block}").alias("block"), salted.alias("x"))
    t = write_shared(t.select("conv_id", "rank", "n_turns", "block", bits(1).alias("h1"), bits(16).alias("h2")), "chat-turns")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"e{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv_id", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(write_shared(sums, "chat-sums"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    return t.select("conv_id", "rank", "n_turns", *[F.col(f"e{i}").bitwiseXOR(F.bit_xor(f"h{i}").over(upto)).alias(f"p{i}") for i in (1, 2)])


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that no longer one begins with."""
    full = prefixes.where("rank = n_turns").groupBy("rank", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.where("rank < n_turns").select("rank", "p1", "p2").distinct()
    return full.join(inner, ["rank", "p1", "p2"], "left_anti").select("conv_id", F.col("rank").alias("n_turns"), "n_copies")


def chat_format(turns: DataFrame, block: int = 1024, begin: str = "<|", middle: str = "|>\n", end: str = "<|end|>\n") -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations it stands for) and the rendered chat of every maximal conversation."""
    keep = write_shared(maximal_conversations(write_shared(prefix_hashes(turns, block), "chat-prefixes")), "chat-kept")
    t = maybe_member(_turns(turns).withColumn("k", F.xxhash64("conv_id")), "k", keep.select(F.xxhash64("conv_id").alias("k")))
    kept = t.join(keep.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "n_turns", "n_copies", F.struct("turn", "role", "text").alias("t"))
    chats = kept.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = F.transform("turns", lambda t: F.concat(F.lit(begin), t["role"], F.lit(middle), t["text"], F.lit(end)))
    return chats.select("conv_id", "n_turns", "n_copies", F.array_join(parts, "").alias("chat"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(load(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS rank,
                  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS part, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, rank, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY rank)) AS h, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
f AS (SELECT rank, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE rank = n GROUP BY rank, h),
m AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.rank = f.rank AND p.h = f.h AND p.rank < p.n))
SELECT m.conv_id, m.rank AS n_turns, m.n_copies, string_agg(t.part, '' ORDER BY t.rank) AS chat
FROM m JOIN t ON m.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY m.conv_id, m.rank, m.n_copies
"""
