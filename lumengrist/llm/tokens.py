"""Token ids by the tokenizers library, with a cache of words.

The ids are those of the library's plain call with add_special_tokens=False; strings of the vocabulary's added tokens become these tokens,
as is the library's default.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workers import give_back

VOCABULARY = "byte_bpe_50k.json"
#: For RE2, in which \\s is ASCII: white space other than blank and line break, or any at an end or beside another; the separator used
#: below; or no text.
_UNEVEN = "[\\t\\x01\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|\\A[ \\n]|[ \\n]\\z|[ \\n][ \\n]|\\A\\z"
#: A letter, and ASCII marks but the apostrophe (which begins contractions) up to the end of a word.
_MARKED = "([A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}\\x{391}-\\x{3a1}\\x{3a3}-\\x{3c9}\\x{410}-\\x{44f}])([!-&(-/:-@\\[-`{-~]+)([ \\n]|\\z)"


class Encoder:
    """Encodes texts as the library does, much faster where words repeat.

    The byte-level pattern never joins characters across the start of a white-space run, nor a letter with a mark after it, and what
    precedes a piece doesn't change how it is cut. So a text with nothing but single blanks and line breaks between its words has the
    ids of its words in a row; marks that end a word are pieces of their own. Each new piece goes through the library. The last
    `limit` pieces or more, twice that at most, are kept as two Arrow arrays, so that a chunk's pieces are looked up at once.

    All other texts, and all texts of vocabularies with another pre-tokenizer, go through the library whole.
    """

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = t = Tokenizer.from_file(path)
        cuts = t.pre_tokenizer
        if hasattr(t.model, "_resize_cache"):
            t.model._resize_cache(0)  # the library sees each word once, so its own cache only costs
        self.by_words = (
            t.normalizer is None and isinstance(cuts, ByteLevel) and cuts.use_regex and not cuts.add_prefix_space and isinstance(t.model, BPE) and t.truncation is None and t.padding is None
        ) and not t.model.continuing_subword_prefix and not t.model.end_of_word_suffix and not t.model.dropout
        added = [re.escape(x.content) for x in t.get_added_tokens_decoder().values()]
        self.uneven = "|".join([_UNEVEN, *added])
        self.limit = limit
        self.words, self.ids, self.old = pa.array([], pa.string()), pa.array([], pa.binary()), 0
        self.line = self._whole(["\n"])[0] if self.by_words else b""
        self.line_id = int(np.frombuffer(self.line, "<u4")[-1]) if self.line else -1

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space but a blank at the front: joined by line breaks, encoded, and cut at these."""
        if len(self.line) != 4:
            return self._whole(pieces)
        got = []
        groups = [pieces[i : i + 128] for i in range(0, len(pieces), 128)]
        for group, e in zip(groups, self.library.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts, raw = np.flatnonzero(ids == self.line_id).tolist(), ids.tobytes()
            if len(cuts) != len(group) - 1:
                got += self._whole(group)
            else:
                got += [raw[4 * a + 4 : 4 * b] for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
        return got

    def _learn(self, words: pa.Array) -> pa.Array:
        """Ids of words as they come out of the cut: after a line break, marks after their word, or after a blank."""
        line = pc.starts_with(words, "\n")
        joined = pc.or_(line, pc.starts_with(words, "\x01"))
        pieces = pc.if_else(joined, pc.utf8_replace_slice(words, 0, 1, ""), pc.binary_join_element_wise(" ", words, ""))
        ids = pa.array(self._new(pieces.to_pylist()), pa.binary())
        return pc.binary_join_element_wise(pc.if_else(line, pa.scalar(self.line, pa.binary()), pa.scalar(b"", pa.binary())), ids, b"")

    def _lookup(self, words: pa.Array) -> pa.Array:
        """The ids of different words, as binary values."""
        at = pc.index_in(words, value_set=self.words)
        lacking = pc.is_null(at)
        new = words.filter(lacking)
        if len(new):
            ids = self._learn(new)
            seen = len(self.words)
            short = pc.less_equal(pc.binary_length(new), 64)
            place = np.flatnonzero(lacking.to_numpy(zero_copy_only=False))
            where = at.fill_null(0).to_numpy().copy()
            where[place] = np.arange(seen, seen + len(new))
            out = pa.concat_arrays([self.ids, ids]).take(pa.array(where))
            self.words, self.ids = pa.concat_arrays([self.words, new.filter(short)]), pa.concat_arrays([self.ids, ids.filter(short)])
            if len(self.words) - self.old > self.limit:  # what came before the last `limit` goes
                self.words, self.ids = (pa.concat_arrays([x.slice(self.old)]) for x in (self.words, self.ids))
                self.old = len(self.words)
            return out
        return self.ids.take(at)

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self._whole([text])[0]

    def _bulk(self, texts: pa.Array) -> tuple[list[int], pa.Buffer]:
        """The ids of texts with single blanks and line breaks only, all in a row, and where each text's end. Nothing else is held when
        it returns."""
        marked = pc.replace_substring_regex(texts, _MARKED, "\\1 \x01\\2\\3")
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("", marked, "\n"), "\n", " \n"), " ")
        del marked
        words = pc.dictionary_encode(cut.flatten())
        listed = words.dictionary
        full = pc.greater(pc.binary_length(listed), 0)  # the empty one stands before each text's added line break
        where = (np.cumsum(full.to_numpy(zero_copy_only=False)) - 1).astype(np.int32)
        ids = pa.concat_arrays([self._lookup(listed.filter(full)), pa.array([b""], pa.binary())])
        where[~full.to_numpy(zero_copy_only=False)] = len(ids) - 1
        every = ids.take(pa.array(where[words.indices.to_numpy()]))
        _, offsets, data = every.buffers()
        at = np.frombuffer(offsets, "<i4")[every.offset : every.offset + len(every) + 1] if len(every) else np.zeros(1, "<i4")
        ends = at[np.frombuffer(cut.buffers()[1], "<i4")[cut.offset : cut.offset + len(cut) + 1] - (cut.offset and cut.offsets[0].as_py())].tolist() if len(cut) else [0]
        return ends, data

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text."""
        if not self.by_words:
            yield from self._whole(texts.to_pylist())
            return
        even = pc.and_(pc.invert(pc.match_substring_regex(texts, self.uneven)), pc.less(pc.binary_length(texts), 1 << 26))  # Arrow's offsets have 31 bits
        ends, data = self._bulk(texts.filter(even))
        skip, i = len(self.line), 0
        for ok, text in zip(even.to_pylist(), texts, strict=True):
            if ok:
                yield data[ends[i] + skip : ends[i + 1]].to_pybytes()
                i += 1
            else:
                yield self.encode(text.as_py())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker; workers live on from task to task."""
    return Encoder(path)


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoded(batches: Iterator[pa.RecordBatch], path: str | None, end_id: int, chunk: int = 4 << 20) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids with the end id) of rows (doc_id, text), about `chunk` bytes of text at a time."""
    enc, end = encoder(vocabulary_path(path)), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chunk)))
            for doc_id, raw in zip(ids[at:to], enc.encode_all(texts.slice(at, to - at)), strict=True):
                yield doc_id, raw + end
            pa.default_memory_pool().release_unused()
            at = to
    give_back()
