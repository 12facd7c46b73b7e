"""Token files and packing: exact round trips through the tokenizers library."""

import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from lumengrist.llm import packing, rans, token_files
from lumengrist.llm.tokens import Encoder

ROWS = [(5, "The cat.\n\nThe  cat!"), (1, None), (3, ""), (2, "word " * 6000), (2, "word " * 6000), (None, "null id"), (9, "é中<|endoftext|>\t\xa0x"), (4, "a b c")]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), limit=50)


_PARTS = ["a", "Be", " ", "  ", "\n", "\t", "\r", "'s", "'", "1", "22", ".", "!?", "é", "\xa0", " ", "\x1d", "<|endoftext|>", "中", " the", "\x85", "​", "word,", "%", "\x01", "###", "Ω", "ª", "²", "_"]


def test_encoder_equals_library(encoder, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(_PARTS, [1, 3, 9, *[1] * (len(_PARTS) - 3)], k=rng.randint(0, 14))) for _ in range(4000)]
    for at in range(0, len(texts), 500):  # the cache of 50 words is renewed on the way
        for text, raw in zip(texts[at : at + 500], encoder.encode_all(pa.array(texts[at : at + 500])), strict=True):
            assert raw == library(text).tobytes(), repr(text)
            assert encoder.encode(text) == raw
    assert len(encoder.words) < 2000


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_encoder_any_text(text):
    assert next(_SHARED.encode_all(pa.array([text]))) == np.array(_SHARED.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_SHARED = Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_added_tokens_by_default(library):
    texts = ["a <|endoftext|> b", "a b", "x<|endoftext|><|endoftext|>\ny", "<|endoftext", "|>"]
    assert 50256 in library(texts[0])
    for text, raw in zip(texts, _SHARED.encode_all(pa.array(texts)), strict=True):
        assert raw == library(text).tobytes(), repr(text)


def test_other_vocabularies_go_through_the_library(tmp_path, spark):
    """A vocabulary that doesn't cut at white space is not looked up by words."""
    from tokenizers import models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a b": 0, "c": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    t.save(path := str(tmp_path / "t.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode_all(pa.array(["a b,c", "c", "", "a,b"]))] == [[0, 1], [1], [], [2, 2]]
    got = packing.pack_documents(frame(spark, [(1, "a b,c"), (2, None)]), tokenizer_path=path, end_id=3).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {(1, 3), (2, 1)}


def test_queries_encode_by_default(spark, tmp_path, library):
    rows = [(1, "a <|endoftext|> b", "en", "s", 17), (2, "a b", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {i: zlib.crc32(np.append(library(t), 2).astype("<u4").tobytes()) for i, t, *_ in rows}
    assert {r["doc_id"]: r["ids_crc32"] for r in token_files.op2_token_files(spark, str(tmp_path)).collect()} == want
    tokens = {i: len(library(t)) + 1 for i, t, *_ in rows}
    for got in (packing.op3_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert {r["doc_id"]: r["doc_tokens"] for r in got.collect()} == tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.integers(1, 64), st.integers(1, 9))
def test_blocks_round_trip(tokens, lanes, interval):
    tokens = np.array(tokens, np.uint32)
    table = rans.Table(np.bincount(tokens, minlength=301))
    records = rans.encode_block(tokens, table, lanes, interval)
    ends = [first for first, _ in records[1:]] + [len(tokens)]
    for (first, raw), end in reversed(list(zip(records, ends, strict=True))):  # each by itself
        assert (rans.decode_record(raw, table) == tokens[first:end]).all()
    assert records[0][0] == 0


def test_damage_is_seen():
    table, other = rans.Table(np.bincount([1, 2, 3])), rans.Table(np.bincount([1, 2, 2, 3]))
    (_, good), = rans.encode_block(np.array([1, 2, 3], np.uint32), table)
    with pytest.raises(ValueError, match="another table"):
        rans.decode_record(good, other)
    for at in range(len(good)):
        raw = bytearray(good)
        raw[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            rans.decode_record(bytes(raw), table)


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_joined_crc(a, b):
    assert rans.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, 1, "x", 2) for i, t in rows], "doc_id long, text string, ids int, tie int, counts string, shard int").repartition(3)


def wanted(rows, library):
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(library(t), 2).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


@pytest.mark.parametrize(("block", "shard"), [(1 << 20, 1 << 22), (700, 2000), (100, 9000)])
def test_token_files(spark, library, tmp_path, block, shard):
    """Documents longer than blocks, several shards, and the ids themselves."""
    path = token_files.write_token_files(frame(spark, ROWS), f"{tmp_path}/f", block_tokens=block, shard_tokens=shard)
    want = wanted(ROWS, library)
    assert sorted(map(tuple, token_files.read_documents(spark, path).collect()), key=lambda r: r[1]) == want
    parts = sorted(token_files.read_parts(spark, path, ids=True).collect(), key=lambda r: r["start"])
    every = np.concatenate([np.append(library(t), 2) for _, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))])
    assert np.concatenate([p["ids"] for p in parts]).tolist() == every.tolist()


def test_files_are_read_in_a_fresh_session(spark, library, tmp_path):
    path = token_files.write_token_files(frame(spark, ROWS), f"{tmp_path}/f", block_tokens=1000)
    code = f"""
import tempfile
from pyspark.sql import SparkSession
from lumengrist.llm import token_files
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
print("ROWS", sorted((tuple(r) for r in token_files.read_documents(spark, {path!r}).collect()), key=lambda r: r[1]))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], timeout=300)
    assert f"ROWS {wanted(ROWS, library)}" in said.stdout, said.stderr[-2000:]


def test_empty(spark):
    path = token_files.write_token_files(frame(spark, ROWS).limit(0))
    assert token_files.read_documents(spark, path).count() == 0
    assert packing.pack_documents(frame(spark, ROWS).limit(0)).count() == 0


def test_packing(spark, library):
    got = packing.pack_documents(frame(spark, ROWS), capacity=256).toPandas()
    tokens = {i: np.append(library(t), 1).astype("<u4") for i, t in ROWS if i is not None}
    for i, ids in tokens.items():
        pieces = got[got.doc_id == i].sort_values("start")
        assert pieces.length.sum() == len(ids) * sum(r[0] == i for r in ROWS)
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            assert p.doc_tokens == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all()
        assert s.length.sum() <= 256
    assert got.doc_id.isna().sum() == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=40), st.integers(2, 128))
def test_pack(lengths, capacity):
    pieces, n = packing.pack(lengths, capacity)
    covered = [[] for _ in lengths]
    used = [[] for _ in range(n)]
    for d, start, length, s, offset in pieces:
        assert length > 0
        covered[d].append((start, length))
        used[s].append((offset, length))
    for length, own in zip(lengths, covered, strict=True):
        at = 0
        for start, size in sorted(own):
            assert start == at
            at += size
        assert at == length
    for own in used:
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    full = sum(x // capacity for x in lengths)
    assert n == full + -(-sum(x % capacity for x in lengths) // capacity)  # no more sequences than the tokens need


def test_costs_are_even():
    rng = random.Random(2)
    pieces, n = packing.pack([rng.randint(20, 500) for _ in range(2000)], 2048)
    cost = [0.0] * n
    for _, _, length, s, _ in pieces:
        cost[s] += length + length**2 / 2048
    assert max(cost) < 1.25 * sum(cost) / n
