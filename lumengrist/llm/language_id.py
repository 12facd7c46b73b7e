"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of one to three characters of the lower-cased text, hashed to 2**16 buckets; value = share of the text's n-grams
times the bucket's inverse document frequency, counted over all documents one may learn from. The weights are learnt by
follow-the-regularised-leader with L1 and L2 penalties, coordinate by coordinate, on about `per_language` documents of each language
(chosen by hash); a fifth of these are held back to fit a temperature that divides the scores. The logarithm of how many documents a
drawn one stands for is then added for each language, so that scores follow the shares of all documents one may learn from, however
many are drawn. A prediction uses the text only.

Defined cases: a text that is null or has no letter is `und` with score 0, as is everything while nothing can be learnt; documents
without id are never learnt from and not held out; repeated rows count each; very long texts are read whole; empty tables give empty
results; other columns, of any name, are kept. The `max_languages` labels that most documents have are learnt, ties by name; documents of
others aren't learnt from and get one of the learnt labels like any other text. That bounds the fit's arrays (65537 x 8 bytes a language).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, field, load

BUCKETS = 1 << 16
#: Brings a text's values to about unit length.
SCALE = 20.0
_SHIFT = np.uint32(16)
_K = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]


def ngrams(text: str) -> np.ndarray:
    """The buckets of all n-grams of one text, one for each occurrence."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    one = c * _K[0]
    two = (one[:-1] ^ (c[1:] * _K[1])) * _K[2]
    three = (two[:-1] ^ (c[2:] * _K[3])) * _K[4]
    return np.concatenate([one >> _SHIFT, two >> _SHIFT, three >> _SHIFT]).astype(np.int32)


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, over all rows (text), and the number of rows."""

    def run(batches):
        held, flag, n = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, bool), 0
        for batch in batches:
            for text in batch.column(0):
                flag[ngrams(text.as_py() or "")] = True
                held += flag
                flag[:] = False
                n += 1
        held[BUCKETS] = n
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(held[seen], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:BUCKETS], int(out[BUCKETS])


def sample_features(rows: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, part, buckets, shares) of labelled rows (lang, part, text); for bounded samples."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for lang, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                at, n = np.unique(ngrams(text.as_py()), return_counts=True)
                for column, value in zip(out, (lang, part, at.astype("<u2").tobytes(), (n / n.sum()).astype("<f4").tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "part", "at", "share"])

    got = rows.select("lang", "part", "text").mapInArrow(run, "lang string, part int, at binary, share binary").collect()
    return [(r["lang"], r["part"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["share"], "<f4")) for r in got]


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """FTRL-proximal for the softmax loss. samples: (class, coordinates, values). Returns weights, a row for each coordinate; the last is the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            y, at, x = samples[i]
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least negative log-likelihood, by golden-section search over its logarithm."""

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    lo, hi, ratio = -1.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.temperature = languages, temperature
        self.bias = weights[BUCKETS]
        self.by_bucket = np.ascontiguousarray((weights[:BUCKETS] * (SCALE * idf[:, None])).T.astype(np.float32))

    def predict(self, text: str) -> tuple[str, float]:
        at = ngrams(text)
        s = (np.array([row[at].sum(dtype=np.float64) for row in self.by_bucket]) / len(at) + self.bias) / self.temperature
        p = np.exp(s - s.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3


def learn(labelled: DataFrame, per_language: int = 1000, max_languages: int = 200, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, seed: int = 7) -> Model | None:
    """labelled: (doc_id, text, lang) of documents one may learn from. None if there are none."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    common = labelled.select("lang", "text").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    sizes = {r["lang"]: r["count"] for r in common.collect()}
    if not sizes:
        return None
    df, n = document_frequency(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1
    languages = sorted(sizes)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    shares = labelled.sparkSession.createDataFrame([(lang, min(1.0, per_language / count)) for lang, count in sizes.items()], "_lang string, share double")
    part = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string")), F.lit(5)).cast("int")
    drawn = sorted(sample_features(labelled.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(draw < F.col("share")).withColumn("part", part)), key=lambda s: (s[0], s[1], s[2].tobytes(), s[3].tobytes()))
    ready = [(languages.index(lang), part, np.append(at, BUCKETS), np.append(SCALE * share * idf[at], 1.0)) for lang, part, at, share in drawn]
    weights = train([(y, at, x) for y, part, at, x in ready if part] or [(y, at, x) for y, _, at, x in ready], len(languages), epochs, alpha, beta, l1, l2, seed)
    held = [(y, x @ weights[at]) for y, part, at, x in ready if not part]
    temperature = fit_temperature(np.array([s for _, s in held]), np.array([y for y, _ in held])) if held and len(languages) > 1 else 1.0
    weights[BUCKETS] += temperature * np.log([max(1.0, sizes[lang] / per_language) for lang in languages])  # from the sample's shares to those of all
    return Model(languages, weights, idf, temperature)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, in place of any of these names. Rows go through one task each in Arrow batches, in place."""
    own = [field(c).alias(c) for c in docs.columns if c not in (lang, score)]
    if model is None:
        return boxed(docs).select(*own, F.lit("und").alias(lang), F.lit(0.0).alias(score))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        model = shared.value
        return pd.DataFrame([model.predict(t) if t is not None else ("und", 0.0) for t in texts], columns=["lang", "score"])

    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    return boxed(docs, said=predict(lettered)).select(*own, F.col("said.lang").alias(lang), F.col("said.score").alias(score))


def learn_from_documents(docs: DataFrame, **options) -> Model | None:
    """Learns from the documents whose fold isn't 1."""
    return learn(docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id")) != 1), **options)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    said = identify(docs.select("doc_id", "text"), learn_from_documents(docs))
    return said.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
