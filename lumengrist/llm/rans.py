"""Token ids in blocks of a static range asymmetric numeral system (rANS), and back.

One table of symbol frequencies, of sum 2**BITS, is shared by all blocks. A block is coded by itself: token i belongs to lane
i mod `lanes`, each lane has a 64-bit state, and all lanes move together, so numpy codes a whole step at once. States leave 32-bit
words to one stream. Every `interval` steps there is a checkpoint: the states, and the part of the stream up to the next one. A
checkpoint's record decodes by itself, with the table and nothing else.

Record (little-endian): b"LGR2"; u32 lanes, tokens, words, CRC-32 of the table, CRC-32 of the tokens (as u32); u64 states; u32 words;
u32 CRC-32 of all before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 18
_LOW = np.uint64(1 << 31)
_B, _32, _MASK = np.uint64(BITS), np.uint64(32), np.uint64((1 << 32) - 1)
_HEAD = struct.Struct("<4sIIIII")


class Table:
    """Frequencies scaled to 2**BITS; every symbol that occurs keeps at least 1."""

    def __init__(self, counts: np.ndarray):
        total, whole = int(counts.sum()), 1 << BITS
        seen = counts > 0
        if int(seen.sum()) > whole:
            raise ValueError("more symbols than the table has room for")
        freq = np.where(seen, np.maximum(1, counts.astype(np.float64) * whole / max(total, 1)), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        excess, at = int(freq.sum()) - whole, 0
        while total and excess:
            i = order[at % len(order)]
            if excess < 0:
                freq[i] -= excess
                break
            step = min(excess, max(0, int(freq[i]) // 2))
            freq[i] -= step
            excess -= step
            at += 1
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(tokens: np.ndarray, table: Table, max_lanes: int = 2048, interval: int = 128) -> list[tuple[int, bytes]]:
    """(first token, record) of each checkpoint of one block."""
    n = len(tokens)
    lanes = max(1, min(max_lanes, n // 128))
    steps = -(-n // lanes)
    freq, start = table.freq[tokens], table.start[tokens]
    states, words, records = np.full(lanes, _LOW, np.uint64), [], []
    full = np.uint64(63 - BITS)
    for t in range(steps - 1, -1, -1):
        lo, hi = t * lanes, min(n, (t + 1) * lanes)
        f, x = freq[lo:hi], states[: hi - lo]
        big = x >= (f << full)
        words.append((x[big] & _MASK).astype("<u4"))
        x = np.where(big, x >> _32, x)
        q = x // f
        states[: hi - lo] = (q << _B) + (x - q * f) + start[lo:hi]
        if t % interval == 0:
            part, stream = tokens[lo : lo + interval * lanes].astype("<u4"), np.concatenate(words[::-1])
            body = b"".join([_HEAD.pack(b"LGR2", lanes, len(part), len(stream), table.crc, zlib.crc32(part)), states.astype("<u8").tobytes(), stream.tobytes()])
            records.append((lo, body + struct.pack("<I", zlib.crc32(body))))
            words = []
    return records[::-1]


def decode_record(raw: bytes, table: Table) -> np.ndarray:
    """The tokens from one checkpoint to the next."""
    if len(raw) < _HEAD.size + 4 or zlib.crc32(memoryview(raw)[:-4]) != struct.unpack_from("<I", raw, len(raw) - 4)[0]:
        raise ValueError("a record is damaged")
    magic, lanes, n, words, of_table, crc = _HEAD.unpack_from(raw)
    if magic != b"LGR2" or of_table != table.crc:
        raise ValueError("no record of token ids, or of another table")
    states = np.frombuffer(raw, "<u8", lanes, _HEAD.size).astype(np.uint64)
    stream = np.frombuffer(raw, "<u4", words, _HEAD.size + 8 * lanes).astype(np.uint64)
    out, at, low = np.empty(n, np.uint32), 0, np.uint64((1 << BITS) - 1)
    for begin in range(0, n, lanes):
        x = states[: min(lanes, n - begin)]
        slot = x & low
        s = table.symbol[slot]
        out[begin : begin + len(s)] = s
        x = table.freq[s] * (x >> _B) + slot - table.start[s]
        small = x < _LOW
        m = int(np.count_nonzero(small))
        if m:
            x[small] = (x[small] << _32) | stream[at : at + m]
            at += m
        states[: len(x)] = x
    if zlib.crc32(out.astype("<u4")) != crc:
        raise ValueError("a record's tokens are damaged")
    return out


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, in its bit order (highest power in the lowest bit)."""
    out = 0
    for power in range(31, -1, -1):
        if a >> power & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings in a row, from theirs and the second's size."""
    shift, square, power = 1 << 31, 1 << 23, size  # 1, and x**8
    while power:
        if power & 1:
            shift = _times(shift, square)
        square = _times(square, square)
        power >>= 1
    return _times(shift, first) ^ second
