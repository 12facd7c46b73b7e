"""Near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Document frequencies of all shingles (five words, lower-cased) are counted over all documents in 2**df_bits hashed counters. What a
   counter has by chance, the same share of documents in a corpus of any size, is taken off, so the weights don't change as it grows.
2. Weight of a shingle = its count times a damped inverse document frequency (see rarity). Each of bands * rows samples of a document comes from
   improved consistent weighted sampling: two documents draw the same with the probability of their weighted Jaccard similarity.
   The samples of a band make its key.
3. Documents of the same words are one node, whatever their number. Nodes that share a band key are candidates.
4. Candidates are compared by their whole texts. First each key's bucket names a leader: the node that meets most others in its
   buckets, as the original of many near copies does. All members are compared with it, and links join classes (labels spread over
   links, then jump). Where a bucket still holds several classes, all its members of different classes are compared, block by block, as
   products of matrices; so no link between candidates is lost, no pairs are made as rows, and no group grows with a bucket: blocks are
   bounded in nodes and bytes, and each gives the links that span its classes, not all.
5. Every document gets its class: the smallest id in it, and its size.

Defined cases: a text of fewer than five words is one shingle; a text without letters or digits is compared by its blank-separated
parts; null, empty and blank texts are alone; very long texts are compared whole. The document with the smallest id stays (null ids last,
ties by content); rows that repeat id and text have the same flag, and of those in a class keep_one keeps one. Empty tables give empty
results; other columns, of any name, are kept by keep_one and ignored otherwise.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, boxed, flagged, load, maybe_member, shuffle_partitions, unboxed, write_shared
from .workers import give_back

WORDS = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
_K = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_32, _29 = np.uint64(32), np.uint64(29)
#: What fewer than this share of all documents hold is rare.
RARE = 1 / 256


class _Words(dict):
    """Word -> its place in `hashes`, an array of 64-bit hashes; forgets all between texts when full."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.hashes = limit, np.zeros(2 * limit, np.uint64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[at] = xxhash.xxh3_64_intdigest(word)
        return at


_WORDS = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    words = WORDS.findall((text or "").lower()) or (text or "").split()
    if len(_WORDS) > _WORDS.limit:
        _WORDS.clear()
    at = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    return _WORDS.hashes[at]


def shingles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of a text's word hashes, ascending, and their counts."""
    if len(h) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())][: len(h)], np.uint64), np.ones(min(1, len(h)), np.int64)
    n = len(h) - SHINGLE + 1
    s = h[:n].copy()
    for i in range(1, SHINGLE):
        s = s * _K + h[i : i + n]
    s ^= s >> _29
    s *= _MIX
    s ^= s >> _32
    return np.unique(s, return_counts=True)


def weights(u: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[u >> np.uint64(64 - int(len(idf)).bit_length() + 1)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of (ascending shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    every = a[1].sum() + b[1].sum() - common
    return float(common / every) if every else 0.0


class Sampler:
    """Improved consistent weighted sampling, k samples at once, in single precision."""

    def __init__(self, k: int, seed: int = 1):
        self.seeds = np.random.default_rng(seed).integers(0, 1 << 32, k, dtype=np.uint32)[None, :]

    def __call__(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """k sample hashes of a weighted set; u isn't empty."""
        best = picked = None
        for at in range(0, len(u), 1024):
            part = u[at : at + 1024]
            a = ((part ^ (part >> _32)).astype(np.uint32)[:, None] ^ self.seeds) * np.uint32(0x9E3779B1)
            a ^= a >> np.uint32(15)
            a *= np.uint32(0x85EBCA77)
            a ^= a >> np.uint32(13)
            b = a * np.uint32(0xC2B2AE3D)
            b ^= b >> np.uint32(14)
            beta = ((b * np.uint32(0x27D4EB2F)) >> np.uint32(8)).astype(np.float32) * np.float32(2**-24)
            low, half, unit = np.uint32(0xFFFF), np.float32(0.5), np.float32(2**-16)
            r = -np.log(((a >> np.uint32(16)).astype(np.float32) + half) * unit * (((a & low).astype(np.float32) + half) * unit))
            c = -np.log(((b >> np.uint32(16)).astype(np.float32) + half) * unit * (((b & low).astype(np.float32) + half) * unit))
            t = np.floor(np.log(w[at : at + 1024]).astype(np.float32)[:, None] / r + beta)
            value = np.log(c) - r * (t - beta + np.float32(1))
            j = value.argmin(axis=0)
            k = np.arange(len(j))
            low_, new = value[j, k], part[j] * _K + t[j, k].astype(np.int64).astype(np.uint64) * _MIX
            if best is None:
                best, picked = low_, new
            else:
                better = low_ < best
                best, picked = np.where(better, low_, best), np.where(better, new, picked)
        return picked


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    s = samples.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for i in range(s.shape[1]):
        key = (key ^ s[:, i]) * _K
        key ^= key >> _29
    return key.view(np.int64)


_CELL = 4096


def rarity(df: np.ndarray, n: int) -> np.ndarray:
    """1 + ln(1 / share) / ln(1 / RARE) of each counter, share being that of all documents, RARE at least: from 1 for what all documents
    hold to 2 for what few do.

    The share that a counter has by chance, from rare shingles that fall into it, is the median over the counters, whatever n. The
    floor keeps what is left of chance out of the weights, and the divisor damps them: undamped, the few shingles that an edit makes
    would weigh several times those of a text with thousands of copies, and large groups of near copies would fall apart.
    """
    share = df / max(n, 1)
    chance = float(np.median(share))
    own = np.clip((share - chance) / max(1 - chance, 1e-9), RARE, 1)
    return (1 - np.log(own) / -np.log(RARE)).astype(np.float32)


def idf_table(texts: DataFrame, df_bits: int) -> np.ndarray:
    """The rarity of each hashed counter, over all rows (text): 2**df_bits numbers."""
    shift, last = np.uint64(64 - df_bits), (1 << df_bits) // _CELL

    def count(batches):
        df, n = np.zeros(1 << df_bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[shingles(word_hashes(text.as_py()))[0] >> shift] += 1  # a counter once for each document
                n += 1
        _WORDS.clear()  # the worker lives on, for tasks that need the memory
        cells = df.reshape(-1, _CELL)
        seen = np.flatnonzero(cells.any(axis=1)).tolist()
        rows = [(i, zlib.compress(cells[i].tobytes(), 1)) for i in seen] + [(last, zlib.compress(np.full(_CELL, n).tobytes(), 1))]
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[at : at + 64]], pa.int32()), pa.array([r[1] for r in rows[at : at + 64]], pa.binary())], ["cell", "counts"])
        give_back()

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(zlib.decompress(raw.as_buffer()), np.int64)
                held[cell] = held[cell] + new if cell in held else new
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], ["cell", "counts"])

    schema = "cell int, counts binary"
    spark = texts.sparkSession
    rows = texts.select("text").mapInArrow(count, schema).repartition(shuffle_partitions(spark), "cell").mapInArrow(add, schema).collect()  # 2**df_bits counters
    df, n = np.zeros(1 << df_bits, np.int64), 0
    for r in rows:
        counts = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        if r["cell"] == last:
            n = int(counts[0])
        else:
            df[r["cell"] * _CELL : (r["cell"] + 1) * _CELL] = counts
    return rarity(df, n)


_SIGNED = "did long, th long, hi long, lo long, size long, total double, bands array<bigint>"


def signatures(texts: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """texts (did, th, text) with the 128-bit hash of their words, size, total weight and band keys; a task gives the keys of equal texts
    once. No hash: no words."""

    def run(batches):
        sample, table, seen = Sampler(bands * rows), idf.value, set()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(2):
                h = word_hashes(text.as_py())
                size = 8 * len(h)
                if not len(h):
                    row = (None, None, size, None, None)
                else:
                    d = xxhash.xxh3_128_intdigest(h.tobytes())
                    hi, lo = (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)
                    if d in seen:
                        row = (hi, lo, size, None, None)
                    else:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(d)
                        u, n = shingles(h)
                        w = weights(u, n, table)
                        row = (hi, lo, size, float(w.sum()), band_keys(sample(u, w), bands))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["did", "th", "hi", "lo", "size", "total", "bands"])
        _WORDS.clear()
        give_back()

    return texts.select("did", "th", "text").mapInArrow(run, _SIGNED)


def similar(pairs: DataFrame, texts: DataFrame, idf, threshold: float, block: int = 64) -> DataFrame:
    """Rows (a, b), a < b, of written pairs (x, node) whose texts (node, text) reach the threshold. Leaders x with many members have these
    in blocks; a leader's text goes once to each block, and a task streams over its blocks, leader first."""
    sizes = pairs.groupBy("x").agg(F.count("*").alias("n")).select("x", F.expr(f"(n + {block - 1}) div {block}").alias("blocks"))
    sizes = write_shared(sizes, "near-leaders")
    members = pairs.join(sizes, "x").select("x", F.expr("pmod(xxhash64(node), blocks)").alias("part"), "node", F.lit(1).alias("side"))
    leaders = sizes.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), F.col("x").alias("node"), F.lit(0).alias("side"))
    rows = members.union(leaders).join(texts, "node").select("x", "part", "side", "node", "text")

    def run(batches):
        table, leader = idf.value, None
        for batch in batches:
            out = []
            for x, side, node, text in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], batch.column(4), strict=True):
                u, n = shingles(word_hashes(text.as_py()))
                own = u, weights(u, n, table)
                if not side:
                    leader = own
                elif weighted_jaccard(leader, own) >= threshold:
                    out.append((min(x, node), max(x, node)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("x", "part").sortWithinPartitions("x", "part", "side").mapInArrow(run, "a long, b long")


def _counted_features(text, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence features of a text, (shingle, how often before) hashed, and their weights: the common weight of two texts is the sum
    over the features that both have."""
    u, n = shingles(word_hashes(text))
    again = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(u, n) + again.astype(np.uint64) * _MIX, np.repeat(idf[u >> np.uint64(64 - int(len(idf)).bit_length() + 1)], n)


def _links_of_block(nodes: np.ndarray, labels: np.ndarray, sides: np.ndarray, texts: list[str], idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Of the links between side 0 and side 1, or within side 0 where there is no side 1, those that join the most classes: no more
    than there are classes."""
    found = [_counted_features(t, idf) for t in texts]
    sizes = np.array([w.sum() for _, w in found], np.float64)
    every, at = np.unique(np.concatenate([f for f, _ in found]), return_inverse=True)
    rows = np.repeat(np.arange(len(found)), [len(f) for f, _ in found])
    weight = np.zeros(len(every))
    weight[at] = np.concatenate([w for _, w in found])
    shared = np.bincount(at, minlength=len(every)) > 1
    place = np.cumsum(shared) - 1
    use = shared[at]
    rows, at, weight = rows[use], place[at[use]], weight[shared]
    left = np.flatnonzero(sides == 0)
    right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
    common = np.zeros((len(left), len(right)), np.float64)
    line = np.full(len(found), -1)
    for lo in range(0, len(weight), 4096):
        now = (at >= lo) & (at < lo + 4096)
        parts = []
        for side in (left, right):
            line[:] = -1
            line[side] = np.arange(len(side))
            own = now & (line[rows] >= 0)
            m = np.zeros((len(side), min(4096, len(weight) - lo)))
            m[line[rows[own]], at[own] - lo] = 1
            parts.append(m)
        common += (parts[0] * weight[lo : lo + 4096]) @ parts[1].T
    ratio = common / (sizes[left][:, None] + sizes[right][None, :] - common)
    good = (ratio >= threshold) & (labels[left][:, None] != labels[right][None, :])
    root, out = {x: x for x in labels.tolist()}, []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(left)):
        for j in np.flatnonzero(good[i]).tolist():
            p, q = find(int(labels[left[i]])), find(int(labels[right[j]]))
            if p != q:
                root[q] = p
                x, y = int(nodes[left[i]]), int(nodes[right[j]])
                out.append((min(x, y), max(x, y)))
    return out


def links_in_blocks(open_: DataFrame, texts: DataFrame, idf, threshold: float, block: int = 256, block_bytes: int = 2 << 20) -> DataFrame:
    """Links (a, b) that join all nodes of different classes which share a bucket and are similar; open_: (key, node, label, size), written.

    A bucket is cut into blocks of about `block` nodes or `block_bytes`, and each pair of blocks is compared at once, by a product of matrices
    in one group. No pairs are made as rows: a node is sent as often as its bucket has blocks, and no group holds more than two blocks.
    """
    sized = open_.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sized = write_shared(sized.select("key", F.expr(f"cast(greatest((n + {block - 1}) div {block}, bytes div {block_bytes} + 1) AS int)").alias("blocks")), "near-open")
    own = open_.join(sized, "key").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) AS int)"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = other.select("key", "node", "label", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when((F.col("own") <= F.col("other")), 0).otherwise(1).alias("side"))
    full = pair.join(texts, "node").select("key", "x", "y", "node", "label", "side", "text")

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        sides, x, y = column("side"), table.column("x")[0].as_py(), table.column("y")[0].as_py()
        links = [] if x != y and len(set(sides.tolist())) < 2 or table.num_rows < 2 else _links_of_block(column("node"), column("label"), sides, table.column("text").to_pylist(), idf.value, threshold)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return full.groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in links (a, b): the least node of each connected component."""
    both = write_shared(links.union(links.select("b", "a")).distinct(), "near-edges")
    labels = write_shared(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "other").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = write_shared(new.join(jump, "next").select("node", "was", F.least("next", "far").alias("label")), "near-labels")
        labels = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            return labels


def classes(entries: DataFrame, nodes: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(node, label) of nodes with links. entries (key, node, n): band keys that n nodes share; nodes (node, total, size). What is joined
    by key is written before, so that adaptive execution can split a hot one."""
    met = entries.groupBy("node").agg(F.sum("n").alias("met"))
    own = write_shared(entries.select("key", "node").join(met.join(nodes, "node"), "node"), "near-entries")
    leader = own.groupBy("key").agg(F.max(F.struct("met", "node", "total")).alias("m")).select("key", F.col("m.node").alias("x"), F.col("m.total").alias("other"))
    leader = write_shared(leader, "near-leader")
    fits = F.least("total", "other") >= (threshold - 1e-3) * F.greatest("total", "other")
    pairs = own.join(leader, "key").where((F.col("node") != F.col("x")) & fits).select("x", "node").distinct()
    links = write_shared(similar(write_shared(pairs, "near-pairs"), texts, idf, threshold), "near-links")
    labels = components(links)
    own = write_shared(own.select("key", "node", "size").join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label")), "near-entries")
    apart = write_shared(own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "near-apart")
    open_ = write_shared(own.join(apart, "key", "left_semi"), "near-undecided")
    more = write_shared(links_in_blocks(open_, texts, idf, threshold), "near-links")
    return components(links.union(more)) if not more.isEmpty() else labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 12, rows: int = 4, threshold: float = THRESHOLD, df_bits: int = 20) -> DataFrame:
    """did (the id, 2**63-1 for null), th (xxhash64 of the text), doc_id, class_id, class_size and kept of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(source, df_bits))
    signed = write_shared(signatures(source, idf, bands, rows), "near-signatures")
    first = F.min(F.struct("did", "th"))
    nodes = signed.where("hi IS NOT NULL").groupBy("hi", "lo").agg(first.alias("rep"), F.count("*").alias("copies"), F.max("total").alias("total"), F.max("size").alias("size"))
    nodes = write_shared(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    keys = signed.where("bands IS NOT NULL").select("hi", "lo", F.explode("bands").alias("key")).join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).select("key", "node").distinct()
    keys = write_shared(keys, "near-keys")
    shared = write_shared(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    entries = write_shared(keys.join(shared, "key"), "near-entries")
    wanted = entries.select("node").distinct().join(nodes, "node").select("node", F.col("rep.did").alias("did"), F.col("rep.th").alias("th"))
    wanted = write_shared(wanted, "near-wanted")
    texts = maybe_member(source, "th", wanted.select("th")).join(wanted, ["did", "th"]).select("node", "text").dropDuplicates(["node"])
    texts = write_shared(texts, "near-texts", compression="zstd")
    labels = classes(entries, nodes.select("node", "total", "size"), texts, idf, threshold)
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = labelled.groupBy("label").agg(F.min("rep").alias("keep"), F.sum("copies").alias("class_size"))
    members = write_shared(labelled.join(groups, "label").select("hi", "lo", "keep", "class_size"), "near-classes")
    out = signed.select("did", "th", "hi", "lo").join(members, ["hi", "lo"], "left")
    real = lambda c: F.when(c != NO_ID, c)
    kept = F.coalesce((F.col("keep.did") == F.col("did")) & (F.col("keep.th") == F.col("th")), F.lit(True))
    return out.select("did", "th", real(F.col("did")).alias("doc_id"), real(F.coalesce("keep.did", "did")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class. Only documents that may be touched meet their marks in a join."""
    found = write_shared(near_dedup(docs, id_col, text_col, **options), "near-result")
    again = F.count_if(F.col("kept") & (F.col("class_size") > 1)) > 1
    marks = found.groupBy("did", "th").agg(F.bool_or(~F.col("kept")).alias("gone"), again.alias("again")).where("gone OR again")
    marks = write_shared(marks, "near-marks")
    did, th = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    own = flagged(boxed(docs, did=did, th=th), "th", marks.select("th"))
    met = own.where("maybe").join(marks, ["did", "th"], "left")
    out = own.where("NOT maybe").select("row").union(met.where("gone IS NULL").select("row"))
    if not marks.where("again AND NOT gone").isEmpty():  # rows that repeat id and text: one stays
        out = out.union(met.where("again AND NOT gone").groupBy("did", "th").agg(F.first("row").alias("row")).select("row"))
    return unboxed(out, docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
