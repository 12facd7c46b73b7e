"""Mixing sources to target weights by capped water-filling and seeded sampling.

Targets: `share` of all sizes is dealt out by weight; a source is full at `cap` times its size, and what it can't take is dealt out
again by weight until none is above. With the sources in order of capacity by weight, the full ones come first, so one running
sum over the sources, dealt by range, finds the water level.

Sampling: target = whole repetitions of the source + a rest of less than one. A seeded hash of the id orders each source's
documents; those below a threshold are repeated once more, and the document on the threshold gives the words that still lack, so
the words taken meet the target to the word. The threshold comes from sums by hash prefix: 4096 sums for a source, again 4096
inside the prefix that crosses, and at last the few documents inside that. No source is gathered, sorted or sent to one task, and
what each document gives follows from its own row and its source's plan: texts aren't shuffled.

Defined cases: null text has size 0; null source is a source, last; a null id hashes as the empty string; documents with the same
hash (repeated ids) on the threshold share what lacks in proportion to their sizes, rounded down; a source of size 0 has target 0;
very long texts count whole and are cut between words; empty tables give empty results; other columns, of any name, are kept by mix() and
ignored by mixing_plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import numbered
from .common import BLANKS, boxed, field, load, unboxed, write_shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Plans of more sources than this are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 20_000


def words_in(text: Column) -> Column:
    """The number of WORDs: single blanks are counted in bytes. An array of all words, which regexp_count makes, is many times the text."""
    t = F.replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    odd = F.contains(t, F.lit("  "))
    for blank in BLANKS.replace(" ", "").replace("\n", ""):
        odd = odd | F.contains(t, F.lit(blank))
    t = F.rtrim(F.when(odd, F.regexp_replace(t, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")).otherwise(t))
    return (F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))).cast("long")


def seeded(doc_id: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sources (source, source_size) with target. Works on a row for each source; orders and running sums are dealt by range, so that
    millions of sources are no single task's."""
    s = numbered(sources.withColumn("last", F.col("source").isNull()), ["last", "source"], "n")
    by = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", by).withColumn("room", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("room") / F.col("weight"))
    s = write_shared(s, "mix-sources")
    order = ["ratio", "n"]
    s = numbered(numbered(s, order, "before", F.col("room")), order, "lighter", F.col("weight"))
    sums = F.broadcast(s.agg(F.sum("source_size").alias("sizes"), F.sum("weight").alias("weights")))  # one row
    s = s.join(sums).withColumn("left", F.lit(share) * F.col("sizes") - F.col("before")).withColumn("rest", F.col("weights") - F.col("lighter"))
    open_ = F.col("room") * F.col("rest") > F.col("left") * F.col("weight")  # the level stays below this source's room
    s = write_shared(s.withColumn("open", open_), "mix-levels")
    level = s.where("open").agg(F.min(F.struct(*order, "left", "rest")).alias("level"))
    s = s.join(F.broadcast(level))  # one row
    filled = F.col("level.left") * F.col("weight") / F.col("level.rest")
    return s.select("source", "source_size", F.coalesce(F.when(F.col("open"), F.least("room", filled)), "room").alias("target"))


def _crossing(parts: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """For each source of plan (source, need), the first row of parts (source, key, words) at which the running sum reaches need."""
    p = plan.select(F.col("source").alias("_source"), "need")
    w = Window.partitionBy("source").orderBy(key)
    run = parts.join(p, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("upto", F.sum("words").over(w))
    return run.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need"))).select("source", key, "words", (F.col("need") - F.col("upto") + F.col("words")).alias("need"))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sized: (source, size, h). A row for each source: source_size, target, whole, and the threshold: h below `edge` is taken once
    more, h at `edge` gives lacking / edge_words of its size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(totals, weights, share, cap).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("need", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    plan = write_shared(plan, "mix-targets")
    need, rows = plan.where("need > 0").select("source", "need"), sized
    for shift in (48, 36):
        part = F.shiftright("h", shift)
        sums = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
        cross = _crossing(sums, need, "part")
        cross = write_shared(cross.select("source", "part", "need"), "mix-crossing")
        need = cross.select("source", "need")
        c = cross.select(F.col("source").alias("_source"), "part")
        rows = rows.join(F.broadcast(c) if cross.count() <= BROADCAST_SOURCES else c, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("h", shift) == F.col("part"))).drop("_source", "part")
    last = _crossing(rows.groupBy("source", "h").agg(F.sum("size").alias("words")), need, "h")
    edge = last.select(F.col("source").alias("_source"), F.col("h").alias("edge"), F.col("need").alias("lacking"), F.col("words").alias("edge_words"))
    return write_shared(plan.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", "target", "whole", F.coalesce("edge", F.lit(-1)).alias("edge"), "lacking", "edge_words"), "mix-plan")


def with_plan(df: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Adds _target, _source_size, _whole, _edge, _lacking, _edge_words. The plan is broadcast only while it has few sources."""
    p = plan.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "whole", "edge", "lacking", "edge_words")])
    few = plan.count() <= BROADCAST_SOURCES
    return df.join(F.broadcast(p) if few else p, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")


def _more(size: str, h: str) -> Column:
    """Words taken above the whole repetitions, from SQL expressions of size and hash."""
    part = f"(cast({size} AS decimal(19,0)) * cast(_lacking AS decimal(19,0))) div cast(_edge_words AS decimal(19,0))"
    return F.expr(f"CASE WHEN {h} < _edge THEN {size} WHEN {h} = _edge THEN {part} ELSE 0L END")


def sized_documents(docs: DataFrame, seed: int, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), seeded(F.col(id_col), seed).alias("h"))


def mixing_report(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """For each document what the mix takes of it: doc_id, size, source_size, target (its source's), taken."""
    sized = write_shared(sized_documents(docs, seed), "mix-sizes")
    out = with_plan(sized, mixing_plan(sized, weights, share, cap), "source")
    taken = F.col("_whole") * F.col("size") + _more("size", "h")
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: docs' columns, a row for each repetition. A document on the threshold gives its first words once."""
    sized = write_shared(sized_documents(docs, seed), "mix-sizes")
    out = with_plan(boxed(docs, h=seeded(F.col("doc_id"), seed), source=F.col("source")), mixing_plan(sized, weights, share, cap), "source")
    cut = (F.col("h") == F.col("_edge")) & (F.col("_lacking") < F.col("_edge_words"))
    n = F.when(cut, _more(f"bigint(regexp_count(coalesce(row.text, ''), r'{WORD}'))", "h")).otherwise(F.lit(0)).cast("int")
    copies = (F.col("_whole") + F.when(F.col("h") < F.col("_edge"), 1).when(F.col("h") == F.col("_edge"), 1).otherwise(0)).cast("int")
    out = out.withColumn("first", n).withColumn("copies", copies - F.when(cut & (F.col("first") == 0), 1).otherwise(0))
    out = out.where("copies > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    part = (F.col("first") > 0) & (F.col("k") == F.col("copies"))
    words = F.slice(F.regexp_extract_all(field("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.greatest(F.col("first"), F.lit(1)))
    text = F.when(part, F.array_join(words, "")).otherwise(field("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(part, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(field("n_chars"))
    return unboxed(out, docs.columns, new)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS room,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s),
r AS (SELECT *, total - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT lft, rest FROM r WHERE room * rest > lft * weight ORDER BY room / weight, source NULLS LAST LIMIT 1),
t AS (SELECT r.source, r.source_size, CASE WHEN r.room * r.rest > r.lft * r.weight THEN least(r.room, l.lft * r.weight / l.rest) ELSE r.room END AS target FROM r LEFT JOIN l ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
n AS (SELECT *, greatest(0, round(target)::BIGINT - whole * source_size) AS need FROM p),
c AS (SELECT d.*, n.source_size, n.target, n.whole, n.need, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS peers FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN upto <= need THEN size WHEN upto - peers >= need THEN 0 ELSE floor(size * (need - (upto - peers)) / peers) END)::BIGINT AS taken
FROM c
"""
