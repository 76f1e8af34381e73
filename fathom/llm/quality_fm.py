"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: its distinct hashed words (log frequency, length 1 together), and one-hot buckets of
structure statistics and of its metadata. Its score is the logistic of w0 + <w, x> + the sum of all pairwise interactions
<v_i, v_j> x_i x_j, which the sum-of-squares identity gives in time linear in x: half of the sum over the factors of
(sum v x)^2 - sum (v x)^2.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import binary_texts, held_out, in_slices, whole
from fathom.llm.wordhash import IS_SPACE, Words, words

BITS, FACTORS = 16, 8
WORDS = 1 << BITS
BUCKETS = 24
STATISTICS = ("words", "word length", "distinct words", "letters", "capitals", "digits", "marks", "line length", "repeated neighbours", "longest word", "characters")
WIDTH = WORDS + BUCKETS * len(STATISTICS)
SAMPLE_LABELS, EPOCHS, STEPS, BATCH = 8_000, 6, 24_000, 64
THRESHOLD = 0.7
SLICE_BYTES = 1 << 20
UPPER, LOWER, DIGIT, WIDE, BREAK = (np.zeros(256, np.int64) for _ in range(5))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = WIDE[128:] = BREAK[10] = 1
MARK = 1 - UPPER - LOWER - DIGIT - WIDE - IS_SPACE


def _log_bucket(x: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.log2(1 + x)).astype(np.int64)


def _share_bucket(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Finer towards 0; the last bucket is for nothing to share."""
    share = part / np.maximum(1, whole)
    return np.where(whole > 0, np.minimum(BUCKETS - 2, np.sqrt(share) * (BUCKETS - 1)).astype(np.int64), BUCKETS - 1)


def features(found: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, feature, value) of each text: bounds[i]:bounds[i + 1] are text i's. n_chars: -1 where it is null."""
    w: Words = words(found)
    n, owner = len(found), w.owner()
    h = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    pair, tf = np.unique(owner << BITS | h, return_counts=True)
    of, at = pair >> BITS, pair & (WORDS - 1)
    x = 1 + np.log(tf)
    x /= np.sqrt(np.bincount(of, x * x, n))[of]
    raw = np.frombuffer(b" ".join(found) + b" ", np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in found])
    per_text = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag[raw])])[offsets])
    upper, lower, digit, wide, marks, breaks = (per_text(k) for k in (UPPER, LOWER, DIGIT, WIDE, MARK, BREAK))
    letters = upper + lower + wide
    solid = letters + digit + marks
    n_words, lengths = np.diff(w.bounds), w.end - w.start
    same = np.bincount(owner[1:], (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1]), n) if len(owner) else np.zeros(n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, lengths)
    statistics = [
        _log_bucket(n_words), np.minimum(BUCKETS - 1, solid // np.maximum(1, n_words)), _share_bucket(np.bincount(of, minlength=n), n_words), _share_bucket(letters, solid), _share_bucket(upper, letters), _share_bucket(digit, solid),
        _share_bucket(marks, solid), _log_bucket(n_words / (1 + breaks)), _share_bucket(same, n_words), _log_bucket(longest), np.where(n_chars < 0, BUCKETS - 1, _log_bucket(np.maximum(0, n_chars))),
    ]
    m = len(STATISTICS)
    fixed = WORDS + np.arange(m) * BUCKETS + np.stack(statistics, axis=1)
    everything = np.concatenate([of, np.repeat(np.arange(n), m)])
    order = np.argsort(everything, kind="stable")
    at, x = np.concatenate([at, fixed.ravel()])[order], np.concatenate([x, np.full(n * m, 0.5)])[order]
    return np.searchsorted(everything[order], np.arange(n + 1)), at, x


class Machine:
    def __init__(self, seed: int = 5):
        self.bias, self.w = 0.0, np.zeros(WIDTH)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (WIDTH, FACTORS))

    def logits(self, bounds, at, x) -> np.ndarray:
        sums = lambda y: np.add.reduceat(y, bounds[:-1], axis=0)  # no text is without features
        vx = self.v[at] * x[:, None]
        return self.bias + sums(self.w[at] * x) + 0.5 * (sums(vx) ** 2 - sums(vx * vx)).sum(axis=1)

    def score(self, bounds, at, x) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(bounds, at, x), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int | None = None, rate: float = 0.1, decay: float = 1e-4) -> "Machine":
        """rows: (features, values, label) in a fixed order, taken in small batches with AdaGrad steps. Few rows are gone
        through more often, until STEPS examples have been seen."""
        if not rows:
            return self
        epochs = epochs or max(EPOCHS, min(80, -(-STEPS // len(rows))))
        share = np.clip(np.mean([y for _, _, y in rows]), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        w2, v2 = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6)
        for _ in range(epochs):
            for first in range(0, len(rows), BATCH):
                some = rows[first : first + BATCH]
                sizes = [len(a) for a, _, _ in some]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                at, x = np.concatenate([a for a, _, _ in some]), np.concatenate([v for _, v, _ in some])
                error = self.score(bounds, at, x) - np.array([y for _, _, y in some])
                e = np.repeat(error, sizes)
                total = np.add.reduceat(self.v[at] * x[:, None], bounds[:-1], axis=0)
                used, where = np.unique(at, return_inverse=True)
                by = lambda y: np.bincount(where, y, len(used))
                g = by(e * x) + decay * self.w[used]
                w2[used] += g * g
                self.w[used] -= rate * g / np.sqrt(w2[used])
                each = (np.repeat(total, sizes, axis=0) - self.v[at] * x[:, None]) * (e * x)[:, None]
                g = np.stack([by(each[:, k]) for k in range(FACTORS)], axis=1) + decay * self.v[used]
                v2[used] += g * g
                self.v[used] -= rate / 4 * g / np.sqrt(v2[used])
                self.bias -= rate / 10 * float(error.mean())
        return self


def _features_of(batch, first: int, last: int, found: list[bytes]):
    n_chars = np.array([-1 if x is None else x for x in batch.column("n_chars")[first:last].to_pylist()], np.int64)
    return features(found[first:last], n_chars)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, sample_labels: int = SAMPLE_LABELS) -> Machine:
    """Learns labels.quality of rows whose crc32(doc_id) mod modulus isn't remainder, from a uniform sample of at most
    sample_labels labelled documents (a documented bound). A doc_id labelled twice counts as its higher label; of rows
    that share a doc_id the one with the least text counts."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(5), "doc_id")).limit(sample_labels)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "n_chars", "label")).alias("one")).select("doc_id", "one.*")

    def run(batches):
        for batch in batches:
            found = binary_texts(batch.column("text"))
            for a, b in in_slices(found, SLICE_BYTES):
                bounds, at, x = _features_of(batch, a, b, found)
                cut = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("label")[a:b], pa.ListArray.from_arrays(cut, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(x.astype(np.float32)))],
                    ["doc_id", "label", "at", "x"],
                )

    got = rows.mapInArrow(run, "doc_id long, label int, at array<int>, x array<float>").toArrow()
    ordered = sorted(zip([zlib.crc32(str(i).encode()) for i in got["doc_id"].to_pylist()], got["doc_id"].to_pylist(), got["at"], got["x"], got["label"].to_pylist()), key=lambda r: r[:2])
    return Machine().fit([(a.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(np.float64), y) for _, _, a, x, y in ordered])


@whole
def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = THRESHOLD, sample_labels: int = SAMPLE_LABELS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A score reads the text and n_chars, never labels, lang, source or doc_id. Null and empty texts are scored by their
    statistics alone, very long ones whole. With nothing to learn from every score is 0.5. Repeated rows each give a row; an empty table gives
    none; other columns are not read.
    """
    docs = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, modulus, remainder, sample_labels))

    def run(batches):
        for batch in batches:
            found = binary_texts(batch.column("text"))
            for a, b in in_slices(found, SLICE_BYTES):
                p = machine.value.score(*_features_of(batch, a, b, found))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("held_out")[a:b], pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    fold = held_out(F.col("doc_id"), modulus, remainder).alias("held_out")
    return docs.select("doc_id", fold, "text", "n_chars").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


@whole
def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose score is threshold or more. Null and empty texts are judged by their
    statistics, repeated rows each; an empty table gives no rows."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")), labels))

    def run(batches):
        for batch in batches:
            found = binary_texts(batch.column("text"))
            keep = [machine.value.score(*_features_of(batch, a, b, found)) >= threshold for a, b in in_slices(found, SLICE_BYTES)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
