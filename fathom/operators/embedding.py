"""Embedding texts: a pluggable encoder run batch by batch, and runs that go on where they were cut short.

An encoder is a function that a task calls once, for a function from texts to a matrix of one row each. The default needs no
model: words and their character trigrams are hashed to signs.
"""

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.retrieval import dot
from fathom.session import spread
from fathom.sources.tables import read_manifest, write_manifest

Encoder = Callable[[], Callable[[list[str]], np.ndarray]]

DIM, AT_ONCE, SHARD_ROWS, WAVES = 64, 128, 2048, 8
WORD = re.compile(r"\w+")
CACHED_WORDS, WORDS_AT_ONCE = 200_000, 32_768


class Rows:
    """Vectors by key, made when they are first asked for. About CACHED_WORDS are kept."""

    def __init__(self, dim: int):
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, dim), np.float32)

    def places(self, keys: list[str], make: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        """Each key's row of `table`, until the next call."""
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        if new:
            n = len(self.known)
            made = make(new)
            if n + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:n], np.zeros((max(n, 1024) + len(new), self.table.shape[1]), np.float32)])
            self.table[n : n + len(new)] = made
            self.known.update(zip(new, range(n, n + len(new))))
        return np.array([self.known[k] for k in keys], np.int64)

    def of(self, keys: list[str], make: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        at = self.places(keys, make)
        return self.table[at]


def _parts(sizes: list[int]) -> list[list[int]]:
    """The places in turn, in parts of WORDS_AT_ONCE or one place."""
    out, held = [[]], 0
    for i, n in enumerate(sizes):
        if out[-1] and held + n > WORDS_AT_ONCE:
            out.append([])
            held = 0
        out[-1].append(i)
        held += n
    return [x for x in out if x]


def hashed(dim: int = DIM, seed: int = 0, trigram_weight: float = 0.5) -> Encoder:
    """Signed feature hashing: each word, and each of its character trigrams at trigram_weight, is a vector of dim random signs
    by its hash; a text is their sum, a word that occurs n times counting 1 + ln n times. No vocabulary, no shared state: any
    task maps a text to the same vector."""

    def signs(features: list[str]) -> np.ndarray:
        raw = b"".join(xxhash.xxh64_digest(f, seed * 1000 + i) for f in features for i in range(-(-dim // 64)))
        return np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(features), -1)[:, :dim].astype(np.float32) * 2 - 1

    def encoder():
        words, trigrams = Rows(dim), Rows(dim)

        def of_words(new: list[str]) -> np.ndarray:
            parts = [[f"\0{w}\0"[i : i + 3] for i in range(len(w))] for w in new]
            vectors = trigrams.of([p for own in parts for p in own], signs)
            return signs(new) + trigram_weight * np.add.reduceat(vectors, np.cumsum([0, *map(len, parts[:-1])]), axis=0)  # whole numbers: exact in any order

        def encode(texts: list[str]) -> np.ndarray:
            """A text's words are added in their order, those of all texts side by side."""
            out = np.zeros((len(texts), dim), np.float32)
            counts = [Counter(WORD.findall(text.lower())) for text in texts]
            for some in _parts([len(c) for c in counts]):
                order = sorted(some, key=lambda i: -len(counts[i]))
                lengths = np.array([len(counts[i]) for i in order])
                at = words.places([w for i in order for w in counts[i]], of_words)
                weight = 1 + np.log(np.array([n for i in order for n in counts[i].values()], float))
                first, sums = np.cumsum(lengths) - lengths, np.zeros((len(order), dim), np.float32)
                for j in range(lengths.max(initial=0)):
                    n = int(np.searchsorted(-lengths, -j, side="left"))  # texts with more than j words
                    here = first[:n] + j
                    sums[:n] += weight[here, None] * words.table[at[here]]
                out[order] = sums
            return out

        return encode

    return encoder


def embed(docs: DataFrame, encoder: Encoder | None = None, dim: int = DIM, prefix: str = "", at_once: int = AT_ONCE) -> DataFrame:
    """docs: (id, text, others) -> (id, vector, others): vectors of dim floats and of length 1.

    Each text gets the prefix, which some models want for queries. Null is the empty text; a text of which the encoder makes
    nothing has the zero vector. Whole texts are encoded, at_once at a time.
    """
    encoder = encoder or hashed(dim)

    def of(encode, some: list[str]) -> np.ndarray:
        v = np.asarray(encode(some), np.float32)
        if v.shape != (len(some), dim):
            raise ValueError(f"the encoder made {v.shape} of {len(some)} texts, not {(len(some), dim)}")
        return v

    def run(batches):
        encode = encoder()
        for batch in batches:
            found = [prefix + (x or "") for x in batch.column("text").to_pylist()]
            v = np.concatenate([np.zeros((0, dim), np.float32), *[of(encode, found[a : a + at_once]) for a in range(0, len(found), at_once)]])
            length = np.linalg.norm(v.astype(float), axis=1, keepdims=True)
            v = np.divide(v, length, out=np.zeros(v.shape), where=length > 0).astype(np.float32)
            at = batch.schema.get_field_index("text")
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))
            yield batch.set_column(at, "vector", vectors)

    schema = ", ".join(f"`{'vector' if c == 'text' else c}` {'array<float>' if c == 'text' else t}" for c, t in docs.dtypes)
    return spread(docs).mapInArrow(run, schema)


def shard_of(id_: Column, wave: Column, shards: int) -> Column:
    return wave * F.lit(shards) + F.pmod(F.xxhash64(id_), F.lit(shards))


def write_resumed(docs: DataFrame, path: str, encoder: Encoder | None = None, name: str = "hashed", dim: int = DIM, shard_rows: int = SHARD_ROWS, waves: int = WAVES) -> dict:
    """docs: (id, text), id a number -> a table of (id, vector, shard) under path; {"encoded": rows, "kept": rows}.

    The table is written in waves, ranges of id that a scan of files in that order reads apart, each cut by hash in shards of
    about shard_rows. After a wave its shards' rows, dimension and mean length are appended to a manifest. A run that finds
    waves in the manifest, as many rows as there are ids and in the right shape, doesn't encode these again: what has been
    written isn't read. A wave that was cut short, or whose rows have changed in number, is written anew. The plan (bounds,
    encoder's name, dimension) is fixed by the first run; one that differs is an error.
    """
    spark = docs.sparkSession
    plan = read_manifest(spark, f"{path}/plan")
    if plan is None:
        n = docs.count()
        share = [i / waves for i in range(1, waves)]
        bounds = docs.agg(F.percentile_approx("id", F.array(*map(F.lit, share)), 10_000)).first()[0] if share and n else []
        plan = {"bounds": sorted(set(bounds or [])), "shards": max(1, -(-n // (shard_rows * waves))), "encoder": name, "dim": dim}
        write_manifest(spark, plan, f"{path}/plan")
    if (plan["encoder"], plan["dim"]) != (name, dim):
        raise ValueError(f"{path} was begun with {plan['encoder']}, {plan['dim']} dimensions")
    wave = F.lit(0)
    for bound in plan["bounds"]:
        wave = wave + F.coalesce((F.col("id") > bound).cast("int"), F.lit(0))
    wanted = {r[0]: r[1] for r in docs.select(wave.alias("wave")).groupBy("wave").count().collect()}
    done = manifest(spark, path)
    kept = {} if done is None else {r["wave"]: r["n"] for r in done.groupBy("wave").agg(F.sum("rows").alias("n"), F.min(F.col("dim") == dim).alias("ok")).where("ok").collect()}
    out = {"encoded": 0, "kept": 0}
    for w, n in sorted(wanted.items()):
        if kept.get(w) == n:
            out["kept"] += n
            continue
        low, high = ([None, *plan["bounds"]][w], [*plan["bounds"], None][w])
        rows = docs.select("id", "text")
        rows = rows if low is None else rows.where(F.col("id") > low)
        rows = rows if high is None else rows.where((F.col("id") <= high) | F.col("id").isNull() if w == 0 else F.col("id") <= high)
        shards = embed(rows, encoder, dim).withColumn("shard", shard_of(F.col("id"), F.lit(w), plan["shards"]))
        shards.write.mode("overwrite").parquet(f"{path}/vectors/wave={w}")
        written = spark.read.parquet(f"{path}/vectors/wave={w}")
        length = F.sqrt(dot(F.col("vector"), F.col("vector")))
        sums = written.groupBy("shard").agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("dim"), F.round(F.avg(length), 6).alias("length"))
        sums.withColumn("wave", F.lit(w)).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/of={w}")
        out["encoded"] += n
    return out


def manifest(spark, path: str) -> DataFrame | None:
    """(shard, rows, dim, length, wave) of what has been written whole; None where nothing has."""
    try:
        return spark.read.parquet(f"{path}/manifest").drop("of")
    except AnalysisException:
        return None


def load(spark, path: str) -> DataFrame:
    """(id, vector, shard) of all waves in the manifest."""
    waves = [r[0] for r in spark.read.parquet(f"{path}/manifest").select("wave").distinct().collect()]
    return spark.read.parquet(f"{path}/vectors").where(F.col("wave").isin(waves)).select("id", "vector", "shard")
