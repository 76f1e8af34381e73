"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams of the lower-cased text, N-gram lengths 1 to 3, with log term frequency, smoothed
inverse document frequency over all training documents, and length 1. The weights are learned by follow-the-regularised-leader
with elastic-net penalties on a bounded sample; a temperature is then fitted on a part of it that the weights haven't seen.
"""

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import held_out, texts, whole

BITS = 16
STEPS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
SAMPLE_DOCS, LEAST, EPOCHS = 6_000, 50, 3
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def n_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of a text and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.zeros(1 << BITS, np.int64)
    run = np.zeros(len(codes), np.uint32)
    for k, step in enumerate(STEPS[: len(codes)]):
        run = (run[: len(codes) - k] + codes[k:] + np.uint32(1)) * step
        run ^= run >> np.uint32(15)
        found += np.bincount(run >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(found)
    return at, found[at]


class Model:
    """idf by feature; weights and bias by language; temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.weights, self.bias, self.temperature = np.zeros((len(idf), len(languages))), np.zeros(len(languages)), 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, tf = n_grams(text)
        x = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(x @ x)
        return at, x / norm if norm else x

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.features(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def fit(self, rows: list, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = EPOCHS) -> "Model":
        """rows: (features, values, language's place) in a fixed order. Every tenth is kept for the temperature."""
        learn, check = [r for i, r in enumerate(rows) if i % 10], [r for i, r in enumerate(rows) if not i % 10]
        z, n = np.zeros((len(self.idf) + 1, len(self.languages))), np.zeros((len(self.idf) + 1, len(self.languages)))
        for _ in range(epochs):
            for at, x, y in learn or check:
                at, x = np.append(at, len(self.idf)), np.append(x, 1.0)  # the last weight is the bias
                zi, ni = z[at], n[at]
                w = -np.sign(zi) * np.maximum(0, np.abs(zi) - l1) / ((beta + np.sqrt(ni)) / alpha + l2)
                error = softmax(x @ w)
                error[y] -= 1
                g = x[:, None] * error
                grown = ni + g * g
                z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
                n[at] = grown
        w = -np.sign(z) * np.maximum(0, np.abs(z) - l1) / ((beta + np.sqrt(n)) / alpha + l2)
        self.weights, self.bias = w[:-1], w[-1]
        self._calibrate(check)
        return self

    def _calibrate(self, rows: list) -> None:
        """The temperature of least log loss, by golden section on its logarithm."""
        if not rows:
            return
        logits, y = np.array([self.logits(at, x) for at, x, _ in rows]), np.array([r[2] for r in rows])

        def loss(log_t):
            s = logits / np.exp(log_t)
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

        low, high, cut = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - cut * (high - low), low + cut * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of docs each feature occurs, and their number. Each task sends its sums, of a fixed size."""

    def run(batches):
        seen = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for text in texts(batch.column("text")):
                seen[n_grams(text)[0]] += 1
                seen[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen), dtype=np.int32)), pa.array(seen)], ["i", "n"])

    sums = docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[sums["i"].to_numpy()] = sums["n"].to_numpy()
    return out[:-1], int(out[-1])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """docs: (doc_id, text, lang) to learn from; rows without text or lang are left out.

    Document frequencies and the list of languages cover all of docs. The weights are fitted on a seeded sample of about
    sample_docs documents (a documented bound), as many of each language, LEAST or more, or all that there are; of rows that
    share a doc_id the one with the least text counts there.
    """
    docs = docs.where("text is not null and lang is not null")
    languages = [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    df, n = document_frequency(docs)
    model = Model(languages, np.log((1 + n) / (1 + df)) + 1)
    each = max(LEAST, sample_docs // max(1, len(languages)))
    key = F.xxhash64(F.lit(11), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    order = Window.partitionBy("lang").orderBy(key, "doc_id")  # each task lets its first ones by language through
    chosen = docs.select("doc_id", "lang").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= each).select(F.col("doc_id").alias("chosen"), F.col("lang").alias("spoken"))
    sample = docs.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("lang") == F.col("spoken")))
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("one")).select("doc_id", "one.text", "one.lang")
    place = {x: i for i, x in enumerate(languages)}

    def featured(batches):
        for batch in batches:
            rows = [model.features(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in rows], pa.list_(pa.float32()))],
                ["doc_id", "lang", "at", "x"],
            )

    found = sample.mapInArrow(featured, "doc_id long, lang string, at array<int>, x array<float>").toArrow()
    rows = zip(found["doc_id"].to_pylist(), found["at"], found["x"], found["lang"].to_pylist())
    ordered = sorted(((zlib.crc32(f"{i}".encode()), i or 0, a, x, y) for i, a, x, y in rows), key=lambda r: r[:2])
    return model.fit([(a.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(np.float64), place[y]) for _, _, a, x, y in ordered])


@whole
def predict(docs: DataFrame, modulus: int = 4, remainder: int = 2, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and lang of rows whose crc32(doc_id) mod modulus isn't remainder; a prediction reads the text alone.
    Null texts, those without a letter, and all texts where there is nothing to learn from are `und` with score 0. Very long
    texts are read whole. Repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    docs = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where("not held_out").select("doc_id", "text", "lang"), sample_docs))

    def run(batches):
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
