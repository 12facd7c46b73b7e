"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features gives a document's latent quality; ordered thresholds cut it into grades:
P(grade <= g) = logistic(threshold_g - quality). The expected grade orders documents, the tail probability P(grade >= g) selects them.

Features of a text: presence of each lower-cased word (a single bad word counts as much in a long text as in a short one), weighed
by rarity over all documents, and the shares of marks, upper-case words and immediate repetitions among all tokens, all hashed to 2**18
weights. Rare grades count more, by the root of their rarity. Weights are learnt coordinate by
coordinate with L1 and L2 penalties (follow-the-regularised-leader), thresholds by gradient steps that keep their order, on about
`per_grade` labelled documents of each grade, chosen by hash. A drawn document counts for all those it was drawn from, so that the
shares of the grades are those of all labels, however many are drawn.

A fifth of the sample is held back from a first fit, to place the cut for selection (the second fit takes all): documents are kept whose tail probability reaches the value that best
separates the held-back ones (share kept of those of `keep_grade` or more, less the mean share kept of each lower grade). With few labels of
a grade, or one that is rare, half is no good cut.

The sample is bounded twice: by `per_grade` documents of each grade, and by `most_entries` features in all (12 bytes each), beyond which
fewer documents of all grades are taken, by the same hash.

Defined cases: a text that is null or has no token gets grade 0 and tail probability 0; labels without rating, or whose document is
missing, aren't used; without any usable label the scores are null and all documents are kept; grades that no label has have probability
0, so nothing is kept if keep_grade is one; rows that repeat an id count each; very long texts are read whole; empty tables give empty
results; other columns, of any name, are kept by score().
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, field, load, write_shared

TOKENS = re.compile(r"\w+|[^\w\s]+")
BITS = 18
_MASK = (1 << BITS) - 1
_UPPER, _REPEAT, _SHARE = "\0upper", "\0repeat", 10.0


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & _MASK


def features(text: str) -> tuple[set[str], dict[str, float]]:
    """Words present, and shares of tokens by kind; both empty without tokens."""
    raw = TOKENS.findall(text)
    if not raw:
        return set(), {}
    kinds: dict[str, float] = {}
    present = set()
    for token, n in Counter(raw).items():
        if token[0] == "_" or token[0].isalnum():
            present.add(token.lower())
            if len(token) > 1 and token.isupper():
                kinds[_UPPER] = kinds.get(_UPPER, 0) + n
        else:
            kinds["\0" + token[:4]] = kinds.get("\0" + token[:4], 0) + n
    kinds[_REPEAT] = sum(map(str.__eq__, raw, raw[1:]))
    return present, {k: _SHARE * v / len(raw) for k, v in kinds.items() if v}


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    present, kinds = features(text)
    x: dict[int, float] = {}
    for word in present:
        x[_slot(word)] = 1.0
    for kind, value in kinds.items():
        x[_slot(kind)] = x.get(_slot(kind), 0.0) + value
    at = np.fromiter(x, np.int64, len(x))
    order = np.argsort(at)
    return at[order], np.fromiter(x.values(), float, len(x))[order]


def sample_features(rows: DataFrame) -> DataFrame:
    """(doc_id, grade, at, x) of rows (doc_id, grade, text): slots as unsigned 32-bit integers, values as doubles."""

    def run(batches):
        for batch in batches:
            found = [vector(text.as_py() or "") for text in batch.column(2)]
            columns = [pa.array([at.astype("<u4").tobytes() for at, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "grade", "at", "x"])

    out = "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", grade " + rows.schema["grade"].dataType.simpleString() + ", at binary, x binary"
    return rows.mapInArrow(run, out)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each slot, over all rows (text), and the number of rows."""

    def run(batches):
        held, rows, known = np.zeros(1 << BITS, np.int64), 0, {}
        for batch in batches:
            slots = []
            for text in batch.column(0):
                if len(known) > 300_000:
                    known.clear()
                here = set()
                for token in set(TOKENS.findall(text.as_py() or "")):
                    slot = known.get(token)
                    if slot is None:
                        word = token[0] == "_" or token[0].isalnum()
                        slot = known[token] = _slot(token.lower() if word else "\0" + token[:4])
                    here.add(slot)
                slots.extend(here)
                if len(slots) > 1 << 20:
                    held += np.bincount(slots, minlength=1 << BITS)
                    slots = []
            held += np.bincount(np.array(slots, np.int64), minlength=1 << BITS)
            rows += batch.num_rows
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(held[seen], rows), pa.int64())], ["slot", "n"])

    counted = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)  # slot -1, the rows, comes last
    return out[:-1], int(out[-1])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_cut(tails: np.ndarray, grades: np.ndarray, keep_grade: int) -> float:
    """The cut that best separates keep_grade and more from each lower grade; of equally good ones the middle of the widest gap; half
    where either side has no document."""
    sides = [np.sort(tails[grades >= keep_grade])] + [np.sort(tails[grades == g]) for g in np.unique(grades[grades < keep_grade])]
    if len(sides) < 2 or not len(sides[0]):
        return 0.5
    edges = np.unique(np.concatenate([[0.0], tails, [1.0]]))
    cuts, gaps = (edges[1:] + edges[:-1]) / 2, np.diff(edges)
    kept = [1 - np.searchsorted(s, cuts) / len(s) for s in sides]
    gain = np.round(kept[0] - np.mean(kept[1:], axis=0), 9)
    return float(cuts[np.lexsort((gaps, gain))[-1]])


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, cut: float = 0.5):
        self.weights, self.thresholds, self.cut, self.known = weights, thresholds, cut, {}

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "cut": self.cut, "known": {}}

    def quality(self, text: str) -> float | None:
        present, kinds = features(text)
        if not present and not kinds:
            return None
        known, total = self.known, 0.0
        if len(known) > 300_000:
            known.clear()
        for word in present:
            w = known.get(word)
            if w is None:
                w = known[word] = float(self.weights[_slot(word)])
            total += w
        return total + sum(float(self.weights[_slot(k)]) * v for k, v in kinds.items())

    def tails(self, text: str) -> list[float]:
        """P(grade >= g) for g = 1, 2, ..."""
        q = self.quality(text)
        return [0.0] * len(self.thresholds) if q is None else [1 / (1 + math.exp(max(-40.0, min(40.0, t - q)))) for t in self.thresholds.tolist()]


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], stands_for: np.ndarray, epochs: int, alpha: float, l1: float, l2: float, step: float, seed: int) -> Model:
    """stands_for: how many labelled documents a sample of each grade counts for."""
    z, n, grades = np.zeros(1 << BITS), np.zeros(1 << BITS), len(stands_for)
    full = np.bincount([y for y, *_ in samples], minlength=grades) * stands_for
    even = stands_for * len(samples) / full.sum()  # 1 on average, so that steps are of one size for all samples
    share = np.cumsum(full)[:-1] / full.sum()
    thresholds = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    thresholds += np.arange(grades - 1) * 1e-2

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((1 + np.sqrt(n[at])) / alpha + l2))

    weight = even * np.sqrt(full.sum() / grades / np.maximum(1, full))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in rng.permutation(len(samples)):
            y, at, x = samples[i]
            w = weights(at)
            q = float(x @ w)
            upper = _logistic(thresholds[y] - q) if y < grades - 1 else 1.0
            lower = _logistic(thresholds[y - 1] - q) if y else 0.0
            p = max(upper - lower, 1e-9)
            g = (1 - upper - lower) * weight[y] * x
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            rate = step / (1 + epoch) * even[y]
            if y < grades - 1:
                thresholds[y] += rate * min(10.0, upper * (1 - upper) / p)
            if y:
                thresholds[y - 1] -= rate * min(10.0, lower * (1 - lower) / p)
            np.maximum.accumulate(thresholds, out=thresholds)
    return Model(weights(slice(None)), thresholds)


def learn(docs: DataFrame, graded: DataFrame, per_grade: int = 4000, most_entries: int = 16 << 20, min_documents: int = 5, epochs: int = 10, alpha: float = 1.0, l1: float = 4.0, l2: float = 0.05, step: float = 0.02, seed: int = 11, keep_grade: int = 2) -> Model | None:
    """docs (doc_id, text), graded (doc_id, grade 0, 1, ...). None without labels. The cut of the model is for keep_grade."""
    graded = graded.where("grade IS NOT NULL AND doc_id IS NOT NULL")
    sizes = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}  # a row for each grade
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share, stands_for = F.lit(0.0), np.ones(max(sizes) + 1)
    for grade, count in sizes.items():
        share = F.when(F.col("grade") == grade, min(1.0, per_grade / count)).otherwise(share)
        stands_for[grade] = max(1.0, count / per_grade)
    drawn = graded.where(draw < share).select(F.col("doc_id").alias("_id"), "grade")  # about per_grade rows for each grade

    rows = sample_features(docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "grade", "text"))
    rows = write_shared(rows, "quality-sample")
    total = rows.agg(F.sum(F.octet_length("at") / 4)).first()[0] or 0
    if total > most_entries:
        rows = rows.where(draw < share * (most_entries / total))
        stands_for = stands_for * (total / most_entries)
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["grade"], r["at"], r["x"]))  # most_entries features at most
    samples = [(r["grade"], np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["x"], float)) for r in rows]
    if not samples:
        return None
    back = np.array([zlib.crc32(f"{seed}:{r['doc_id']}".encode()) % 5 == 0 for r in rows])
    if back.all():
        back[:] = False
    held, n = document_frequency(docs)
    scale = np.where(held >= min_documents, np.log(n / np.maximum(held, 1)) / max(math.log(n), 1e-9), 0.0)
    scale[[_slot("\0" + k) for k in ("upper", "repeat")]] = 1.0
    samples = [(y, at[scale[at] > 0], (x * scale[at])[scale[at] > 0]) for y, at, x in samples]  # what few hold can only be learnt by heart
    cut = 0.5
    if 1 <= keep_grade < len(stands_for):
        first = train([s for s, held_back in zip(samples, back, strict=True) if not held_back], stands_for, epochs, alpha, l1, l2, step, seed)
        own = [(y, x @ first.weights[at]) for (y, at, x), held_back in zip(samples, back, strict=True) if held_back]
        cut = best_cut(_logistic(np.array([q for _, q in own]) - first.thresholds[keep_grade - 1]), np.array([y for y, _ in own], int), keep_grade)
    model = train(samples, stands_for, epochs, alpha, l1, l2, step, seed)
    return Model(model.weights * scale, model.thresholds, cut)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep_grade: int = 2, keep_at: float | None = None) -> DataFrame:
    """docs with expected_grade, tail_probability (of keep_grade or more) and kept, in place of columns of these names. keep_at: by
    default the model's cut."""
    own = [field(c).alias(c) for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]
    if model is None:
        nothing = F.lit(None).cast("double")
        return boxed(docs).select(*own, nothing.alias("expected_grade"), nothing.alias("tail_probability"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("grade double, tail double")
    def grade(texts):
        import pandas as pd

        tails = [shared.value.tails(t or "") for t in texts]
        return pd.DataFrame({"grade": [sum(t) for t in tails], "tail": [1.0 if keep_grade < 1 else t[keep_grade - 1] if keep_grade <= len(t) else 0.0 for t in tails]})

    scored = boxed(docs, g=grade(text_col))
    return scored.select(*own, F.col("g.grade").alias("expected_grade"), F.col("g.tail").alias("tail_probability"), (F.col("g.tail") >= (model.cut if keep_at is None else keep_at)).alias("kept"))


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """quality and toxic as one rating: 0 low quality, 1 good but toxic, 2 good and clean."""
    clean = F.coalesce(F.col("toxic"), F.lit(0)) == 0
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") > 0, F.when(clean, 2).otherwise(1)).alias("grade"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, grades_of_labels(load(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", "expected_grade", "tail_probability", "kept")
