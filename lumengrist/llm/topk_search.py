"""Exact top-k search by inner product: three-phase uniform threshold over slabs of dimensions.

A vector's score is the sum of its partial scores in `slabs` slabs of dimensions; each slab is one list of the algorithm.
Queries go in blocks of at most `block` rows, broadcast one block at a time; candidates stay where they are, in Arrow batches.

1. Each task takes the `depth` best partial scores of each list and query, adds up the whole scores of these vectors only, and gives its
   k best. The k-th best of all is a safe cutoff: k vectors reach it. It is broadcast, a number for each query.
2. A vector that reaches the cutoff has a part of at least cutoff / slabs, the uniform threshold. Tasks collect the entries that reach
   that, merged by vector: which parts are known, and their sum. Those with all parts known are done.
3. For the others, only the missing parts are added up, exactly, where entries and vectors meet by row. What reaches the cutoff goes
   to the final k best.

Of equal vectors only those with the k + 1 smallest ids can be among a query's k best, so further ones don't become candidates.

All arithmetic is on integers. Vectors whose scores could pass 2**53 (components above sqrt(2**53 / dims)) are compared in Python's own
integers instead, all parts at once; such scores are compared up to 38 digits and given as the nearest BIGINT.

Defined cases: vectors that are null, empty, or hold null or non-finite components (also after scaling), and rows without vec_id, take
no part; vectors are compared with those of the same length only; rows that repeat a vec_id are candidates each, and a query that
repeats whole counts once; fewer than k candidates give all there are; long vectors are taken whole; empty tables give no rows; other
columns, of any name, are ignored.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import application_folder
from .common import load, write_shared

_FOUND = "query_id long, rank int, vec_id long, score long"
_MOST = 10**38 - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<double>, dims): floor(scale * x) of complete, finite vectors. From 2**53 on a double has no fraction."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * float(scale))
    whole = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    floor = F.transform("x", lambda c: F.expr("0D") + F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(whole).select("vec_id", floor.alias("v"), F.size("x").alias("dims"))


def widest(dims: int) -> float:
    """The largest component with which no sum of dims products passes 2**53."""
    return float(int((2.0**53 / dims) ** 0.5))


class QueryBlock:
    """The queries of one block, of one length; worked through in parts of `rows` queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, slabs: int, rows: int = 512):
        self.ids, self.vectors, self.dims, self.rows = ids, vectors, vectors.shape[1], rows
        bounds = np.linspace(0, self.dims, min(slabs, self.dims) + 1).astype(int)
        self.slabs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        self.cutoff = np.full(len(ids), -np.inf)

    def parts(self, lo: int, candidates: np.ndarray) -> list[np.ndarray]:
        """Partial scores (query x candidate) for each slab, of the queries from lo on."""
        q = self.vectors[lo : lo + self.rows]
        return [q[:, a:b] @ candidates[:, a:b].T for a, b in self.slabs]


def _chunks(batches, dims: int, rows: int = 4096):
    """(rows, ids, vectors) of a few thousand candidates (row, vec_id, v) at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            c = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), c


def best_totals(candidates: DataFrame, shared, k: int, depth: int) -> DataFrame:
    """(query_no, total): each task's k best whole scores among the heads of its lists."""

    def run(batches):
        block: QueryBlock = shared.value
        n, best = len(block.ids), None
        for rows, ids, c in _chunks(batches, block.dims):
            if best is None:
                best = [[np.full((n, depth), -np.inf), np.full((n, depth), -np.inf), np.full((n, depth), -1)] for _ in block.slabs]
            for lo in range(0, n, block.rows):
                parts, hi = block.parts(lo, c), lo + block.rows
                own = block.ids[lo:hi, None] == ids[None, :]
                total = np.where(own, -np.inf, sum(parts))
                for held, part in zip(best, parts, strict=True):
                    every = np.concatenate([held[0][lo:hi], np.where(own, -np.inf, part)], axis=1)
                    at = np.argpartition(every, -depth, axis=1)[:, -depth:]
                    sums, who = np.concatenate([held[1][lo:hi], total], axis=1), np.concatenate([held[2][lo:hi], np.broadcast_to(rows, own.shape)], axis=1)
                    for column, x in zip(held, (every, sums, who), strict=True):
                        column[lo:hi] = np.take_along_axis(x, at, axis=1)
        if best is not None:
            total, who = np.concatenate([b[1] for b in best], axis=1), np.concatenate([b[2] for b in best], axis=1)
            order = np.argsort(who, axis=1, kind="stable")
            total, who = np.take_along_axis(total, order, axis=1), np.take_along_axis(who, order, axis=1)
            total[:, 1:][who[:, 1:] == who[:, :-1]] = -np.inf  # a vector at the head of several lists counts once
            top = -np.sort(-total, axis=1)[:, :k]
            q, j = np.nonzero(np.isfinite(top))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(top[q, j])], ["query_no", "total"])

    return candidates.mapInArrow(run, "query_no int, total double")


def cutoffs(totals: DataFrame, queries: int, k: int) -> np.ndarray:
    """The k-th best whole score that is known of each query; none where fewer are."""
    w = Window.partitionBy("query_no").orderBy(F.desc("total"))
    rows = totals.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query_no").agg(F.min("total").alias("least"), F.count("*").alias("n"))
    out = np.full(queries, -np.inf)
    for r in rows.where(F.col("n") == k).collect():  # a row for each query of the block
        out[r["query_no"]] = r["least"]
    return out


_ENTRIES = "query_no int, row long, vec_id long, known int, sum long"


def entries(candidates: DataFrame, shared) -> DataFrame:
    """(query_no, row, vec_id, known, sum) of vectors with parts of at least the uniform threshold: bits of these lists, and their sum.
    Where all parts are known, only what reaches the cutoff."""

    def run(batches):
        block: QueryBlock = shared.value
        least, full = np.floor(block.cutoff / len(block.slabs))[:, None], (1 << len(block.slabs)) - 1
        for rows, ids, c in _chunks(batches, block.dims):
            out = []
            for lo in range(0, len(block.ids), block.rows):
                hi = lo + block.rows
                own = block.ids[lo:hi, None] == ids[None, :]
                known, total = np.zeros(own.shape, np.int32), np.zeros(own.shape)
                for s, part in enumerate(block.parts(lo, c)):
                    reached = (part >= least[lo:hi]) & ~own
                    known |= reached.astype(np.int32) << s
                    total += np.where(reached, part, 0)
                known[(known == full) & (total < block.cutoff[lo:hi, None])] = 0
                q, j = np.nonzero(known)
                out.append(((q + lo).astype(np.int32), rows[j], ids[j], known[q, j], total[q, j].astype(np.int64)))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_no", "row", "vec_id", "known", "sum"])

    return candidates.mapInArrow(run, _ENTRIES)


def resolved(partial: DataFrame, candidates: DataFrame, shared) -> DataFrame:
    """(query_no, vec_id, score) of entries that lack parts, where these bring them to the cutoff. A row's entries are as many as the
    block has queries at most."""
    asked = partial.groupBy("row").agg(F.collect_list(F.struct("query_no", "known", "sum")).alias("asked"))

    def run(batches):
        block: QueryBlock = shared.value
        for batch in batches:
            out = [[], [], []]
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                v, own = batch.column(1)[i].values.to_numpy(zero_copy_only=False), batch.column(2)[i].values
                q, known, total = (x.to_numpy(zero_copy_only=False) for x in own.flatten())
                total = total.astype(np.float64)
                for s, (a, b) in enumerate(block.slabs):
                    lacking = np.flatnonzero(known >> s & 1 == 0)
                    total[lacking] += block.vectors[q[lacking], a:b] @ v[a:b]
                good = total >= block.cutoff[q]
                for column, x in zip(out, (q[good], np.full(int(good.sum()), vec_id), total[good].astype(np.int64)), strict=True):
                    column.append(x)
            columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int32, np.int64, np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_no", "vec_id", "score"])

    return asked.join(candidates, "row").select("vec_id", "v", "asked").mapInArrow(run, "query_no int, vec_id long, score long")


def wide_scores(candidates: DataFrame, shared, k: int) -> DataFrame:
    """(query_no, vec_id, score decimal): each task's k best, in Python's integers."""

    def run(batches):
        block: QueryBlock = shared.value
        big = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
        queries, best = big(block.vectors), {}
        for _, ids, c in _chunks(batches, block.dims, 256):
            scores = queries @ big(c).T
            for q in range(len(queries)):
                new = [(-max(-_MOST, min(_MOST, s)), i) for s, i in zip(scores[q].tolist(), ids.tolist(), strict=True) if i != block.ids[q]]
                best[q] = sorted([*best.get(q, []), *new])[:k]
        out = [(q, i, Decimal(-s)) for q, own in best.items() for s, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.decimal128(38, 0)))], ["query_no", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_no int, vec_id long, score decimal(38,0)")


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, slabs: int = 2, depth: int = 32, block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query (a condition on vec_id) the k best others. See the module."""
    spark = vectors.sparkSession
    grouped = write_shared(quantised(vectors, id_col, vector_col, scale).groupBy("vec_id", "v", "dims").agg(F.count("*").alias("n")), "topk-grouped")
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    own = grouped.withColumn("r", first).where(F.col("r") <= k + 1).select("vec_id", "v", "dims", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    most = F.array_max(F.transform("v", F.abs))
    own = write_shared(own.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "dims", most.alias("most")), "topk-vectors")
    asked = write_shared(grouped.where(is_query(F.col("vec_id"))).select("vec_id", "v", "dims", most.alias("most"), F.xxhash64("vec_id", "v").alias("place")), "topk-queries")
    path = f"{application_folder(spark)}/topk-found-{uuid.uuid4().hex}"
    spark.createDataFrame([], _FOUND).write.parquet(path)
    highest = {r["dims"]: r["most"] for r in own.groupBy("dims").agg(F.max("most").alias("most")).collect()}  # a row for each length
    for dims, count in sorted((r["dims"], r["count"]) for r in asked.groupBy("dims").count().collect()):
        limit, blocks = widest(dims), -(-count // block)
        candidates = own.where(F.col("dims") == dims).select("row", "vec_id", "v", "most")
        usual, wide = candidates.where(F.col("most") <= limit).drop("most"), candidates.where(F.col("most") > limit).drop("most")
        for part in range(blocks):
            rows = asked.where((F.col("dims") == dims) & (F.pmod("place", F.lit(blocks)) == part)).orderBy("vec_id", "place").toPandas()  # about `block` rows
            found = []
            for kind, q in (("usual", rows[rows["most"] <= limit]), ("wide", rows[rows["most"] > limit])):
                if not len(q):
                    continue
                b = QueryBlock(q["vec_id"].to_numpy(np.int64), np.array(q["v"].tolist(), float).reshape(len(q), dims), slabs)
                names = F.broadcast(spark.createDataFrame([(i, int(x)) for i, x in enumerate(b.ids)], "query_no int, query_id long"))  # the block's queries
                got = []
                if kind == "usual":
                    totals = write_shared(best_totals(usual, spark.sparkContext.broadcast(b), k, depth), "topk-heads")
                    b.cutoff = cutoffs(totals, len(q), k)
                    shared = spark.sparkContext.broadcast(b)
                    full = (1 << len(b.slabs)) - 1
                    collected = write_shared(entries(usual, shared), "topk-entries")
                    got += [collected.where(F.col("known") == full).select("query_no", "vec_id", F.col("sum").alias("score")), resolved(collected.where(F.col("known") < full), usual, shared)]
                if kind == "wide" or highest.get(dims, 0) > limit:
                    got.append(wide_scores(wide if kind == "usual" else candidates.drop("most"), spark.sparkContext.broadcast(b), k))
                found += [g.withColumn("score", F.col("score").cast("decimal(38,0)")).join(names, "query_no").select("query_id", F.lit(f"{kind}").alias("kind"), "query_no", "vec_id", "score") for g in got]
            every = found[0]
            for more in found[1:]:
                every = every.union(more)
            place = F.row_number().over(Window.partitionBy("kind", "query_no").orderBy(F.desc("score"), "vec_id"))
            nearest = F.greatest(F.lit(Decimal(-(1 << 63))), F.least(F.lit(Decimal((1 << 63) - 1)), F.col("score"))).cast("long")
            ranked = every.withColumn("rank", place).where(F.col("rank") <= k)
            ranked.select("query_id", "rank", "vec_id", nearest.alias("score")).write.mode("append").parquet(path)
    return spark.read.schema(_FOUND).parquet(path)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
