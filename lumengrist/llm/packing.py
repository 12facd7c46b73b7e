"""Cost-balanced packing of documents into sequences.

Attention over a document of n tokens costs about `linear * n + quadratic * n**2`. Documents of a full sequence or more fill
sequences of their own; what remains of each is placed by descending cost into the lowest-cost sequence that has room for it.
The sequences are as few as the tokens need, so some pieces at the end find room only in parts: these are cut and fill the gaps,
cheapest sequence first. Each task packs its rows in windows of `window` tokens as they come from the tokenizer: no shuffle, and
at most one sequence's worth of padding for each window.

Defined cases: a null text is empty (one end id); a null or repeated doc_id is kept as it is, each row being a document;
a very long text fills sequences of its own and is cut where they are full; empty tables give no pieces; other columns, of any name, are
ignored. Ties go by doc_id, nulls first, then by content. Sequence ids are unique,
not consecutive: task number and count in the task.
"""

from __future__ import annotations

import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .tokens import encoded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class _Rooms:
    """Sequences by room left; gives the cheapest one that has at least so much room."""

    def __init__(self, capacity: int, count: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.best = [(np.inf, -1, -1)] * (2 * self.size)
        self.heaps[capacity] = [(0.0, s) for s in range(count)]
        self._renew(capacity)

    def _renew(self, room: int) -> None:
        heap, i, best = self.heaps[room], room + self.size, self.best
        best[i] = (*heap[0], room) if heap else (np.inf, -1, -1)
        while i > 1:
            i >>= 1
            new = min(best[2 * i], best[2 * i + 1])
            if new == best[i]:
                return
            best[i] = new

    def take(self, least: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room), removed; None if no sequence has the room."""
        found, lo, hi, best = (np.inf, -1, -1), least + self.size, 2 * self.size, self.best
        while lo < hi:
            if lo & 1:
                found = min(found, best[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                found = min(found, best[hi])
            lo >>= 1
            hi >>= 1
        if found[1] < 0:
            return None
        heappop(self.heaps[found[2]])
        self._renew(found[2])
        return found

    def put(self, cost: float, sequence: int, room: int) -> None:
        if room:
            heappush(self.heaps[room], (cost, sequence))
            self._renew(room)


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents with these token counts, and the number of sequences."""
    pieces, rests, n = [], [], 0
    for d, length in enumerate(lengths):
        for start in range(0, length - capacity + 1, capacity):
            pieces.append((d, start, capacity, n, 0))
            n += 1
        if length % capacity:
            rests.append((length % capacity, d))
    cost = lambda m: linear * m + quadratic * m * m
    count = -(-sum(m for m, _ in rests) // capacity)
    rooms, left = _Rooms(capacity, count), []
    for m, d in sorted(rests, key=lambda x: -x[0]):
        if (got := rooms.take(m)) is None:
            left.append((m, d))
            continue
        before, s, room = got
        pieces.append((d, lengths[d] - m, m, n + s, capacity - room))
        rooms.put(before + cost(m), s, room - m)
    gaps = [(c, s, room) for room, heap in enumerate(rooms.heaps) for c, s in heap]
    heapify(gaps)
    for m, d in left:
        while m:
            before, s, room = heappop(gaps)
            part = min(m, room)
            pieces.append((d, lengths[d] - m, part, n + s, capacity - room))
            m -= part
            if room > part:
                heappush(gaps, (before + cost(part), s, room - part))
    return pieces, n + count


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 1, capacity: int = 2048, window: int = 4 << 20, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """One row per piece: SCHEMA. See the module for method and defined cases."""

    def run(batches):
        task, made = TaskContext.get().partitionId() << 36, 0

        def packed(held):
            nonlocal made
            held.sort(key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1])))
            pieces, n = pack([len(ids) // 4 for _, ids in held], capacity, linear, quadratic)
            columns = [[held[d][0] for d, *_ in pieces], [p[1] for p in pieces], [p[2] for p in pieces]]
            columns.append([zlib.crc32(held[d][1][4 * start : 4 * (start + length)]) for d, start, length, *_ in pieces])
            columns += [[len(held[p[0]][1]) // 4 for p in pieces], [task + made + p[3] for p in pieces], [p[4] for p in pieces]]
            made += n
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

        held, tokens = [], 0
        for doc in encoded(batches, tokenizer_path, end_id):
            held.append(doc)
            tokens += len(doc[1]) // 4
            if tokens >= window:
                yield packed(held)
                held, tokens = [], 0
        if held:
            yield packed(held)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
