"""The service as streams: bytes to messages with state for each connection, and requests answered against the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.codec import TooLong, take_frames


#: The longest value that a connection may announce, and the most bytes that may wait for an earlier chunk.
MOST_BYTES = 16 << 20


def messages(chunks: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(conn_id, no, type, value) of a stream of (conn_id, seq, data): seq counts a connection's chunks from 0, no its messages.

    Chunks are taken in order of seq, over all batches: one that comes early waits for those before it. What is left of a message waits
    for the next chunk. A connection that announces a longer value than `most`, or has more waiting, is closed: nothing more is read from it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, following, no, closed, seqs, data = state.get if state.exists else (b"", 0, 0, False, [], [])
        waiting = dict(zip(seqs, data, strict=True))
        for rows in frames:
            waiting.update((int(s), bytes(d)) for s, d in zip(rows["seq"], rows["data"], strict=True) if s >= following)
        found, held = [], bytes(held)
        while not closed and following in waiting:
            held += waiting.pop(following)
            following += 1
            try:
                new, held = take_frames(held, most)
            except TooLong as e:
                new, closed = e.frames, True
            found += new
        closed = closed or sum(map(len, waiting.values())) > most
        if closed:
            held, waiting = b"", {}
        state.update((held, following, no + len(found), closed, list(waiting), list(waiting.values())))
        yield pd.DataFrame({"conn_id": [key[0]] * len(found), "no": range(no, no + len(found)), "type": [k for k, _ in found], "value": [v for _, v in found]})

    held = "held binary, following long, no long, closed boolean, seqs array<bigint>, data array<binary>"
    return chunks.groupBy("conn_id").applyInPandasWithState(run, "conn_id long, no long, type long, value binary", held, "append", GroupStateTimeout.NoTimeout)


def answer_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """Starts a query that answers each batch of a request stream: the ranking needs whole groups, so it is a batch query against the
    static index. Returns a writer ready to start()."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(answer(rows), number)

    return requests.writeStream.foreachBatch(batch)


def answer_all(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """Runs a request stream over all that is there now, and reads the answers back. Answers of one batch are one folder, so a batch
    that is run again replaces its own."""
    spark = requests.sparkSession
    query = answer_stream(requests, answer, lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).drop("batch")
