"""Word segmentation of CJK text over a supplied dictionary: the most probable path through all dictionary words.

The result depends on the dictionary and so differs from other segmenters. Characters that no word covers stand alone; runs of
other characters are kept together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile(r"[一-鿿]+|[^一-鿿\s]+|\s+")


class Segmenter:
    def __init__(self, frequencies: dict[str, int]):
        self.total = math.log(sum(frequencies.values()) or 1)
        self.score = {w: math.log(max(n, 1)) - self.total for w, n in frequencies.items() if w}
        self.longest = max(map(len, self.score), default=1)

    def cut(self, text: str | None) -> list[str]:
        words: list[str] = []
        for run in _RUN.findall(text or ""):
            words += self._path(run) if "一" <= run[0] <= "鿿" else [run]
        return words

    def _path(self, run: str) -> list[str]:
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i] = max(
                (self.score.get(run[i:j], -self.total - 1) + best[j][0], j) for j in range(i + 1, min(n, i + self.longest) + 1) if j == i + 1 or run[i:j] in self.score
            )
        words, i = [], 0
        while i < n:
            words.append(run[i : best[i][1]])
            i = best[i][1]
        return words


def segment(text: Column, frequencies: dict[str, int] | Iterable[str]) -> Column:
    """array<string> of the words of a text, in Arrow batches."""
    table = dict(frequencies) if isinstance(frequencies, dict) else dict.fromkeys(frequencies, 1)

    @F.pandas_udf("array<string>")
    def cut(texts):
        segmenter = Segmenter(table)
        return texts.map(segmenter.cut)

    return cut(text)
