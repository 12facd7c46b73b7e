"""Connections as streams: chunks out of order and over batches, limits, and both kinds of request."""

from pyspark.sql import functions as F

from lumengrist.operators import codec
from lumengrist.streaming import service


def frame(kind, value):
    return codec.HEAD.pack(kind, len(value)) + value


def run(spark, tmp_path, batches, **options):
    """batches: lists of (conn_id, seq, data), each a batch of its own."""
    got = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "conn_id long, seq long, data binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("conn_id long, seq long, data binary").parquet(f"{tmp_path}/in")
        query = service.messages(source, **options).writeStream.option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").format("parquet").trigger(availableNow=True).start()
        query.awaitTermination()
        got.append(sorted((r["conn_id"], r["no"], r["type"], bytes(r["value"])) for r in spark.read.schema("conn_id long, no long, type long, value binary").parquet(f"{tmp_path}/out").collect()))
    return got


def test_order_over_batches(spark, tmp_path):
    whole = frame(0, b"one") + frame(1, b"") + frame(7, b"three") + b"\0"
    parts = [whole[i : i + 9] for i in range(0, len(whole), 9)]
    first = [(1, s, parts[s]) for s in range(len(parts) - 1, 0, -1)] + [(2, 0, frame(1, b"other"))]
    got = run(spark, tmp_path, [first, [(1, 0, parts[0])]])
    assert got[0] == [(2, 0, 1, b"other")]
    assert got[1] == [(1, 0, 0, b"one"), (1, 1, 1, b""), (1, 2, 7, b"three"), (2, 0, 1, b"other")]


def test_limits(spark, tmp_path):
    """A connection that announces too much, or has too much waiting, is closed; others go on."""
    batches = [
        [(1, 0, frame(1, b"fine") + codec.HEAD.pack(1, 1 << 32 - 1)), (2, 5, b"x" * 60), (3, 0, frame(1, b"a"))],
        [(1, 1, frame(1, b"late")), (2, 0, frame(1, b"late")), (3, 1, frame(1, b"b"))],
    ]
    got = run(spark, tmp_path, batches, most=50)
    assert got[1] == [(1, 0, 1, b"fine"), (3, 0, 1, b"a"), (3, 1, 1, b"b")]


def test_replies(spark):
    rows = [(1, 0, 0, "wo", 2), (1, 1, 1, "wo", 3), (2, 0, 1, "none", 3), (2, 1, 0, "wo", 2)]
    requests = spark.createDataFrame(rows, "conn_id long, no long, type long, text string, response_type long")
    words = lambda q: q.where("text = 'wo'").select("query_id", F.lit(1).alias("rank"), F.lit("word").alias("term"))
    pages = lambda q: q.where("text = 'wo'").select("query_id", F.lit(1).alias("rank"), F.lit(5).alias("doc_id"), F.lit("t").alias("title"), F.lit("l").alias("link"), F.lit("a").alias("abstract"))
    got = {(r["conn_id"], r["no"]): codec.take_frames(bytes(r["frame"])) for r in codec.replies(requests, words, pages).collect()}
    word, page = (2, b'["word"]'), (3, b'[{"abstract":"a","id":5,"link":"l","title":"t"}]')
    assert got == {(1, 0): ([word], b""), (1, 1): ([page], b""), (2, 0): ([(3, b"[]")], b""), (2, 1): ([word], b"")}
