"""Exact dedup and line dedup: against SQL and brute force, and in the defined cases."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumengrist.llm import exact_dedup as E
from lumengrist.llm import line_dedup as L

from ..conftest import SF, same

CASES = [
    (1, "Hello World\nsecond LINE here\nshort", "x"),
    (2, "hello world\nSECOND line here\nshort", "y"),
    (3, None, None),
    (4, "", "z"),
    (5, "É ist Nicht é\n\tthis line is shared  \nthis line is shared", None),
    (6, "é ist nicht é\nThis Line Is Shared\n", "q"),
    (7, "a b\n" * 3000 + "this line is shared", "q"),
    (7, "a b\n" * 3000 + "this line is shared", "q"),
    (None, "hello world\nsecond line here\nshort", "n"),
    (None, "only without an id\nonly without an id", "n"),
]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def table(spark, rows):
    """With columns named as those inside the operators."""
    df = spark.createDataFrame([(i, t, k, 1, 2, "sha") for i, t, k in rows], "doc_id long, text string, kind string, h long, pos long, sha string")
    return df.repartition(3)


@pytest.mark.parametrize(("module", "query"), [(E, E.op1_exact_dedup), (L, L.op7_line_dedup)])
def test_sql(spark, duck, module, query):
    same(query(spark, SF).toPandas(), duck.execute(module.ORACLE).df())


def expected(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    want = []
    for i, t, _ in rows:
        keep = max((x for x in groups[lower(t)] if x is not None), default=None)
        want.append((i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_exact_cases(spark, bits):
    """With hashes of few bits different texts share one, and only their bytes tell them apart."""
    got = [tuple(r) for r in E.exact_dedup(table(spark, CASES), capacity=2, max_depth=6, hash_bits=bits).collect()]
    assert sorted(got, key=str) == expected(CASES)


def test_very_long_texts(spark):
    long = "very long text " * 200_000
    rows = [(1, long + "a", ""), (2, long.upper() + "A", ""), (3, long + "b", "")]
    assert sorted((tuple(r) for r in E.exact_dedup(table(spark, rows)).collect()), key=str) == expected(rows)


def indexed(spark, rows, **options):
    texts = table(spark, rows).select("doc_id", E.ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    texts = texts.withColumn("h", E.hashed(F.col("norm"), options.pop("hash_bits", 64)))
    keys = E.write_shared(texts.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "test-keys")
    return texts, keys, E.build_index(texts, keys, **options)


def test_answers_come_from_the_index(spark):
    """Without one bucket, exactly its documents have no answer; a chain holds every text of its hash."""
    rows = [(i, f"text {i // 2}", "") for i in range(200)]
    texts, keys, index = indexed(spark, rows, capacity=8, max_depth=6)
    assert index.depth > 2
    assert index.directory.count() == 2**index.depth
    bucket = index.chains.first()["bucket"]
    own = {r["doc_id"] for r in E.with_bucket(keys, index.directory, index.depth).where(f"bucket = {bucket}").collect()}
    left = E.look_up(texts, keys, index._replace(chains=index.chains.where(f"bucket <> {bucket}")))
    assert {r["doc_id"] for r in left.collect()} == set(range(200)) - own != set(range(200))
    texts, keys, index = indexed(spark, rows, hash_bits=3, capacity=8, max_depth=6)
    chains = index.chains.collect()
    assert len(chains) == 100
    assert max(r["chain"] for r in chains) == max(r["links"] for r in chains) > 8
    assert E.look_up(texts, keys, index).count() == 200


def split_by_hand(counts, capacity, max_depth):
    """Inserts and splits bucket by bucket: {first slot at max_depth: local depth}."""
    held = lambda first, depth: sum(n for slot, n in counts.items() if slot >> (max_depth - depth) == first >> (max_depth - depth))
    buckets, todo = {}, [(0, 0)]
    while todo:
        first, depth = todo.pop()
        if depth < max_depth and held(first, depth) > capacity:
            todo += [(first, depth + 1), (first + (1 << (max_depth - depth - 1)), depth + 1)]
        else:
            buckets[first] = depth
    return buckets


@pytest.mark.parametrize("counts", [{0: 3, 1: 3, 200: 1}, {}, {5: 1000}, {i: 1 for i in range(256)}, {i: i % 5 for i in range(0, 256, 3)}])
def test_directory(spark, counts):
    rows = [((slot << 56) - (1 << 64 if slot >= 128 else 0) + i,) for slot, n in counts.items() for i in range(n)]
    slots = E.directory(spark.createDataFrame(rows, "h long"), 3, 8).collect()
    depth = max(r["local_depth"] for r in slots)
    assert sorted(r["slot"] for r in slots) == list(range(2**depth))
    assert {r["bucket"]: r["local_depth"] for r in slots} == split_by_hand(counts, 3, 8)
    assert all(r["bucket"] <= r["slot"] << (8 - depth) < r["bucket"] + (1 << (8 - r["local_depth"])) for r in slots)


def brute_lines(rows):
    docs = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    ident = lambda i: float("inf") if i is None else i
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                docs[key(line)].add(ident(i))
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs[key(x)]) < 2 or ident(i) == min(docs[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lines_of(spark, rows, **options):
    df = table(spark, rows)
    got = L.with_bitmaps(df, L.write_shared(L.line_keep_bitmaps(df, **options), "test-bitmaps")).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted(map(tuple, got), key=str)


def test_line_cases(spark):
    assert lines_of(spark, CASES) == sorted(brute_lines(CASES), key=str)


def test_hot_line(spark):
    """A line above its share of all is split among tasks by document."""
    rows = [(i, f"the one line of all\nown line number {i:04d}\nthe one line of all", "") for i in range(4000)]
    assert lines_of(spark, rows, least_heavy=1) == sorted(brute_lines(rows), key=str)


CLASHING = ["row", "did", "th", "maybe", "n_lines", "n_dropped", "kept", "dropped", "_did", "_th", "_n", "_dropped", "_kept", "_n_dropped", "pos", "k", "a`b.c"]


def test_drop_lines_keeps_columns(spark):
    df = table(spark, CASES).withColumns({c: F.lit(c) for c in CLASHING})
    out = L.drop_lines(df)
    assert out.schema == df.schema
    rows = out.collect()
    assert len(rows) == len(CASES)
    assert all(r[c] == c for r in rows for c in CLASHING)
    want = {(i, kept) for i, _, _, kept in brute_lines(CASES)}
    assert {(r["doc_id"], r["text"] or "") for r in rows} == want


def test_long_document(spark):
    """Very many lines, most of them dropped, and gaps between the words of the bitmap."""
    line = lambda n: f"line of number {n:06d}"
    rows = [(1, "\n".join(line(n) for n in range(30_000) if n % 1000 < 3), "")]
    rows += [(2, "\n".join(line(n) if n % 1000 < 3 else f"own {n:09d}" for n in range(30_000)), ""), (3, "\n".join(line(0) for _ in range(20_000)), ""), (4, "x" * 3_000_000 + "\n" + line(1), "")]
    assert lines_of(spark, rows) == sorted(brute_lines(rows), key=str)


def test_empty(spark):
    df = table(spark, CASES).limit(0)
    assert E.exact_dedup(df).count() == 0
    assert L.drop_lines(df).count() == 0
