"""Token ids of documents in ascending id order, as rANS blocks on shared files (records: rans.py), and their reader.

A folder holds all that a later job needs:

    blocks/  one row for each checkpoint: (shard, block, first, n_tokens, first_doc, doc_start, ends, doc_ids, lengths, coded)
    table/   (token, n): occurrences of each id, from which the frequency table follows
    shards/  (shard, start): ids of all shards before

1. Tokenise where the rows are; the ids, smaller than the text, go to shared files once, and with them one row of each task with its
   counts of ids. One aggregate adds these up; the table has as many rows as the vocabulary, no more.
2. Deal documents to shards by range of (id, checksum) and sort them. Each task codes its shard as a stream of blocks of `block_tokens`
   ids, cut where they are full, also inside documents: no block or record grows with a document. A row names the documents in it, how
   much of the first came before, and whether the last one ends.
3. Read: every row decodes by itself and its checksums are held, so row groups of a few MB are dealt to tasks. Documents that lie in
   several rows are put together from the parts' checksums.

A shard has about `shard_tokens` ids; at more than `max_shards` shards they grow instead.

Defined cases: null text is empty (one end id); null ids come first; equal ids are ordered by checksum and length of their ids, so
rows that repeat wholly are interchangeable; very long texts are tokenised whole and lie in many rows; empty tables make empty files;
other columns, of any name, are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import application_folder
from .common import load, write_shared
from .rans import Table, decode_record, encode_block, joined_crc
from .tokens import encoded

_IDS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary())])
_BLOCKS = "shard int, block int, first long, n_tokens long, first_doc long, doc_start long, ends boolean, doc_ids array<bigint>, lengths array<bigint>, coded binary"
_LONGS = pa.list_(pa.int64())
_ROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *[(n, pa.int64()) for n in ("first", "n_tokens", "first_doc", "doc_start")], ("ends", pa.bool_()), ("doc_ids", _LONGS), ("lengths", _LONGS), ("coded", pa.binary())])
_PARTS = "shard int, doc_no long, doc_id long, start long, n_tokens long, ids_crc32 long, whole boolean"


def tokenise(docs: DataFrame, id_col: str, text_col: str, path: str | None, end_id: int, chunk: int = 8 << 20) -> DataFrame:
    """Rows (doc_id, tie, n_tokens, wide, ids): ids as little-endian unsigned 16-bit integers where they allow it, else 32-bit (`wide`),
    tie their CRC-32. The last row of each task has its counts of ids, and nothing else."""

    def run(batches):
        rows, held, counts = [], 0, np.zeros(0, np.int64)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _IDS.types, strict=True)], schema=_IDS)

        for doc_id, raw in encoded(batches, path, end_id):
            a = np.frombuffer(raw, "<u4")
            wide = bool(a.max() > 0xFFFF)
            rows.append((doc_id, zlib.crc32(raw), len(a), wide, raw if wide else a.astype("<u2").tobytes(), None))
            held += len(a)
            if held > chunk // 2:
                counts = _added(counts, rows)
                yield batch()
                rows, held = [], 0
        counts = _added(counts, rows)
        rows.append((None, None, None, None, None, counts.tobytes()))
        yield batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, tie long, n_tokens long, wide boolean, ids binary, counts binary")


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b.astype(np.int64), a
    a[: len(b)] += b
    return a


def _added(counts: np.ndarray, rows: list[tuple]) -> np.ndarray:
    for kind in (False, True):
        if own := [r[4] for r in rows if r[3] is kind]:
            counts = _summed(counts, np.bincount(np.frombuffer(b"".join(own), "<u4" if kind else "<u2")))
    return counts


def count_tokens(tokens: DataFrame) -> DataFrame:
    """(token, n) over all rows, from the tasks' counts."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                counts = _summed(counts, np.frombuffer(raw.as_buffer(), np.int64).copy())
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["token", "n"])

    return tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def read_counts(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("token long, n long").parquet(f"{path}/table").toPandas()  # the vocabulary
    counts = np.zeros(int(rows["token"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["token"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


class _Shard:
    """A shard's stream of documents, in blocks."""

    def __init__(self, number: int, table: Table, block_tokens: int):
        self.number, self.table, self.size = number, table, block_tokens
        self.parts: list[tuple[int, int, int, np.ndarray, bool]] = []  # document's number, id, tokens before, tokens, whether it ends
        self.held = self.block = self.start = self.docs = 0

    def add(self, doc_id: int, ids: np.ndarray):
        at = 0
        while at < len(ids):
            part = ids[at : at + self.size - self.held]
            self.parts.append((self.docs, doc_id, at, part, at + len(part) == len(ids)))
            at += len(part)
            self.held += len(part)
            if self.held == self.size:
                yield self.rows()
        self.docs += 1

    def rows(self) -> pa.RecordBatch:
        tokens, ends = np.concatenate([p[3] for p in self.parts]), np.cumsum([len(p[3]) for p in self.parts])
        records = encode_block(tokens, self.table)
        bounds = [first for first, _ in records[1:]] + [len(tokens)]
        out = []
        for (lo, coded), hi in zip(records, bounds, strict=True):
            a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left"))
            own = self.parts[a : b + 1]
            begins = ends[a : b + 1] - [len(p[3]) for p in own]
            lengths = np.minimum(ends[a : b + 1], hi) - np.maximum(begins, lo)
            doc_start = own[0][2] + max(0, lo - int(begins[0]))
            out.append((self.number, self.block, self.start + lo, hi - lo, own[0][0], doc_start, own[-1][4] and int(ends[b]) == hi, [p[1] for p in own], lengths.tolist(), coded))
        self.start += len(tokens)
        self.block += 1
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ROW.types, strict=True)], schema=_ROW)


def write_token_files(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 2,
    block_tokens: int = 1 << 20, shard_tokens: int = 1 << 22, max_shards: int = 20_000,
) -> str:
    """Writes the folder `path` (by default one among this application's tables) and returns it."""
    spark = docs.sparkSession
    path = path or f"{application_folder(spark)}/token-files-{uuid.uuid4().hex}"
    tokens = write_shared(tokenise(docs, id_col, text_col, tokenizer_path, end_id), "token-ids", compression="zstd")
    count_tokens(tokens).coalesce(1).sortWithinPartitions("token").write.parquet(f"{path}/table")
    counts = read_counts(spark, path)
    shards = max(1, min(max_shards, int(counts.sum()) // shard_tokens))
    shared = spark.sparkContext.broadcast(counts)  # a number for each id of the vocabulary

    def run(batches):
        shard = _Shard(TaskContext.get().partitionId(), Table(shared.value), block_tokens)
        for batch in batches:
            for doc_id, raw, wide in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                yield from shard.add(doc_id, np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2"))
        if shard.held:
            yield shard.rows()

    ordered = tokens.where("counts IS NULL").repartitionByRange(shards, "doc_id", "tie", "n_tokens").sortWithinPartitions("doc_id", "tie", "n_tokens")
    ordered.select("doc_id", "ids", "wide").mapInArrow(run, _BLOCKS).write.option("parquet.block.size", 8 << 20).option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # max_shards rows at most
    sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start")).write.parquet(f"{path}/shards")
    return path


def read_parts(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """What each row of the files holds of each document: shard, doc_no, doc_id, start (ids of all before), n_tokens, ids_crc32, whether
    that is the whole document; with ids=True also the ids, array<int>."""
    starts = {r["shard"]: r["start"] for r in spark.read.schema("shard int, start long").parquet(f"{path}/shards").collect()}  # max_shards rows at most
    shared = spark.sparkContext.broadcast((read_counts(spark, path), starts))

    def run(batches):
        counts, starts = shared.value
        table = Table(counts)
        for batch in batches:
            for shard, first, doc, before, ends, doc_ids, lengths, coded in zip(*[batch.column(i).to_pylist() for i in range(7)], batch.column(7), strict=True):
                tokens = decode_record(coded.as_py(), table).astype("<u4")
                at = np.cumsum(lengths)
                parts = np.split(tokens, at[:-1])
                whole = np.ones(len(parts), bool)
                whole[-1] = ends
                whole[0] &= before == 0
                columns = [
                    pa.array(np.full(len(parts), shard, np.int32)), pa.array(np.arange(doc, doc + len(parts))), pa.array(doc_ids, pa.int64()),
                    pa.array(starts[shard] + first + at - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(whole),
                ]
                if ids:
                    columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*(c.split()[0] for c in _PARTS.split(", ")), *["ids"] * ids])

    rows = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").select("shard", "first", "first_doc", "doc_start", "ends", "doc_ids", "lengths", "coded")
    return rows.mapInArrow(run, _PARTS + (", ids array<int>" if ids else ""))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    parts = write_shared(read_parts(spark, path), "token-parts")
    lists = parts.where("NOT whole").groupBy("shard", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32"))).alias("parts"))  # three numbers for each row of the files that the document is in

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                crc, n = 0, 0
                for p in own:
                    crc, n = joined_crc(crc, p["ids_crc32"], 4 * p["n_tokens"]), n + p["n_tokens"]
                out.append((doc_id, own[0]["start"], n, crc))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = "doc_id", "start", "n_tokens", "ids_crc32"
    return parts.where("whole").select(*columns).union(lists.select("doc_id", "parts").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_token_files(load(spark, sf_dir, "documents")))
