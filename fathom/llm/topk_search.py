"""Exact top-k inner product search by columnar branch-and-bound.

Rows are kept in blocks stored dimension by dimension. A block of queries meets a block of rows in one task, which adds up
inner products a few dimensions at a time. What the remaining dimensions can still add is at most the product of the two
remaining norms; rows that can't reach a query's k-th best score so far any more are dropped, and the survivors are moved
together before the next dimensions are read. The sums of a pair of blocks are of doubles that hold integers: where none can
leave 53 bits they are exact; elsewhere they only choose survivors, which are then scored in integers of any length.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import materialise, whole
from fathom.llm.vectors import matrix, usable

QUERY_BLOCK, ROW_BLOCK, DIMENSIONS = 512, 4096, 8
CELL_BLOCKS = 16
SMALL = 1 << 31
LONGEST = (1 << 63) - 1


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """(block, ids, columns, width, wide): up to size vectors a row, dimension by dimension. Each task packs its own.

    Vectors of components under SMALL are kept as little-endian int32 of floor(256 x); the others apart (wide), as doubles x.
    """

    def packed(held: list, wide: bool):
        width = max(x.shape[1] for _, x in held)
        x = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in held])
        ids = pa.concat_arrays([n for n, _ in held])
        columns = np.ascontiguousarray(x.T).astype("<f8" if wide else "<i4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([columns], pa.binary()), pa.array([width], pa.int32()), pa.array([wide])], ["ids", "columns", "width", "wide"])

    def run(batches):
        held: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            x = matrix(batch.column("vector"))
            with np.errstate(over="ignore"):
                small = np.floor(256 * x)
            fits = (np.abs(small) < SMALL).all(axis=1)
            for wide, own, values in ((False, fits, small), (True, ~fits, x)):
                at = np.flatnonzero(own)
                for a in range(0, len(at), size):
                    held[wide].append((batch.column("id").cast(pa.int64()).take(pa.array(at[a : a + size])), values[at[a : a + size]]))
                    if sum(len(n) for n, _ in held[wide]) >= size:
                        yield packed(held[wide], wide)
                        held[wide] = []
        for wide, rest in held.items():
            if rest:
                yield packed(rest, wide)

    return materialise(vectors.mapInArrow(run, "ids array<long>, columns binary, width int, wide boolean").withColumn("block", F.monotonically_increasing_id()), name)


class Block:
    """A block's integers, as doubles times 2**shift, which of a wide block are 1 at most, and in full."""

    def __init__(self, columns: bytes, width: int, wide: bool):
        self.raw, self.wide, self.shift = np.frombuffer(columns, "<f8" if wide else "<i4").reshape(width, -1), wide, 0
        self.columns = self.raw.astype(float)
        if wide:
            self.shift = math.frexp(float(np.abs(self.raw).max(initial=0.0)))[1] + 8
            near = np.abs(self.raw) < 1 << 45  # doubles beyond are integers
            self.columns = np.where(near, np.ldexp(np.floor(256 * np.where(near, self.raw, 0)), -self.shift), np.ldexp(self.raw, 8 - self.shift))
        self.top = float(np.abs(self.columns).max(initial=0.0))

    def integers(self, i: int) -> list[int]:
        """floor(256 x) of the components of vector i."""
        return [256 * int(x) if abs(x) >= 1 << 53 else math.floor(256 * x) for x in self.raw[:, i].tolist()] if self.wide else self.raw[:, i].tolist()


def best_of(queries: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray, error: float, step: int = DIMENSIONS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of rows that may be among its k best: all that score its k-th best here, and floor,
    or more, but for an error of up to `error` times both norms.

    queries, rows: dimension by dimension. floor: each query's k-th best score elsewhere.
    """
    width = max(len(queries), len(rows))
    q = np.zeros((width, queries.shape[1]))
    q[: len(queries)] = queries
    x = np.zeros((width, rows.shape[1]))
    x[: len(rows)] = rows
    left = lambda v: np.sqrt(np.concatenate([np.cumsum((v**2)[::-1], axis=0)[::-1], np.zeros((1, v.shape[1]))])) * (1 + 1e-9)
    q_left, x_left = left(q), left(x)
    out = []
    for i in range(q.shape[1]):
        alive = np.arange(x.shape[1])
        score, columns, floor_i = np.zeros(len(alive)), x, floor[i]
        blur, rounding = (part * q_left[0, i] * x_left[0][alive] for part in (error, max(error, 2.0**-50)))
        for a in range(0, width, step):
            b = min(width, a + step)
            score += q[a:b, i] @ columns[a:b]
            slack = q_left[b, i] * x_left[b][alive] + (rounding if b < width else blur)
            if len(score) > k:
                floor_i = max(floor_i, np.partition(score - slack, len(score) - k)[len(score) - k])
            keep = score + slack >= floor_i
            if keep.sum() < 0.7 * len(keep):
                alive, score, blur, rounding = alive[keep], score[keep], blur[keep], rounding[keep]
                columns = x[:, alive]  # survivors are moved together
            if not len(alive):
                break
        keep = score + blur >= floor_i
        out.append((alive[keep], score[keep]))
    return out


def first_k(held: list[tuple[int, float, int | None, bool]], k: int) -> list:
    """(-score, id or infinity, id, own): the k best, ties to the smaller id, those without an id last."""
    return sorted(held, key=lambda x: x[:2])[:k]


def sortable(score: int) -> bytes | None:
    """For a score beyond the range of a long: bytes in the order of such scores."""
    return None if -LONGEST < score < LONGEST else (score + (1 << 2199)).to_bytes(275, "big")


@whole
def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """vectors, queries: (id, vector). For each query its k rows of the highest integer inner product of floor(256 * x).

    query_id, rank (from 1), vec_id, score. Ties go to the smaller id, rows without an id coming last. A query is a row of
    vectors, and its own row, one of its id and score, is no candidate; other rows of its id are. With fewer candidates all are
    returned. Vectors that are null, empty or hold null or non-finite components
    take no part, nor do queries without an id: their results could not be told apart. Rows are ranked by exact scores,
    however large; one that no long can hold is shown as the nearest long. Shorter vectors are as if filled with zeros.
    Repeated rows are candidates each; repeated queries are answered each. An empty table gives no rows. Other columns are not
    read.
    """
    rows = blocks(vectors.select("id", "vector").where(usable(F.col("vector"))), row_block, "rows")
    asked = blocks(queries.select("id", "vector").where(usable(F.col("vector")) & F.col("id").isNotNull()), query_block, "queries")
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "columns", "width", "wide")])
    numbers = [r[0] for r in asked.select("q_block").collect()]  # one for 512 queries
    cells = max(1, -(-rows.count() // CELL_BLOCKS))
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells))).drop("block").withColumn("q_block", F.explode(F.lit(numbers).cast("array<bigint>")))
    copied = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>")))
    pairs = dealt.join(copied, ["q_block", "cell"])  # a cell: the rows of some CELL_BLOCKS blocks and one block of queries

    more = k + 1  # the query's own row is among the best, or it isn't missed

    def run(batches):
        best: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                ids, q, x = r["ids"], Block(r["q_columns"], r["q_width"], r["q_wide"]), Block(r["columns"], r["width"], r["wide"])
                q_ids, held = best.setdefault(r["q_block"], (r["q_ids"], [[] for _ in r["q_ids"]]))
                width = max(r["width"], r["q_width"])
                exact = not (q.wide or x.wide) and width * q.top * x.top < 1 << 53
                floor = np.array([scaled(-h[more - 1][0], q.shift + x.shift) if len(h) >= more else -math.inf for h in held])
                for i, (places, scores) in enumerate(best_of(q.columns, x.columns, more, floor, 0.0 if exact else width * 2.0**-50)):
                    whole_q = None if exact else q.integers(i)
                    told = [int(s) for s in scores.tolist()] if exact else [sum(a * b for a, b in zip(whole_q, x.integers(j))) for j in places.tolist()]
                    new = [(-s, math.inf if ids[j] is None else ids[j], ids[j], ids[j] == q_ids[i] and s == sum(a * a for a in q.integers(i))) for j, s in zip(places.tolist(), told, strict=True)]
                    held[i] = first_k(held[i] + new, more)
        for block, (q_ids, held) in best.items():
            found = [(i, q, n, s, own) for i, (q, h) in enumerate(zip(q_ids, held)) for s, _, n, own in h]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()),
                 pa.array([max(-LONGEST - 1, min(LONGEST, -x[3])) for x in found], pa.int64()), pa.array([sortable(-x[3]) for x in found], pa.binary()), pa.array([x[4] for x in found], pa.bool_())],
                ["q_block", "place", "query_id", "vec_id", "score", "beyond", "own"],
            )

    few = pairs.mapInArrow(run, "q_block long, place int, query_id long, vec_id long, score long, beyond binary, own boolean")
    each = Window.partitionBy("q_block", "place")
    ranked = few.withColumn("place_all", F.row_number().over(each.orderBy(F.desc("score"), F.desc("beyond"), F.col("vec_id").asc_nulls_last()))).where(F.col("place_all") <= more)
    ranked = ranked.withColumn("own_place", F.coalesce(F.min(F.when(F.col("own"), F.col("place_all"))).over(each), F.lit(more + 1)))
    others = ranked.where(F.col("place_all") != F.col("own_place")).withColumn("rank", F.col("place_all") - (F.col("place_all") > F.col("own_place")).cast("int"))
    return others.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(score: int, shift: int) -> float:
    """score / 2**shift, or a little less where a double can't hold it."""
    if abs(score) < 1 << 53 and not shift:
        return float(score)
    cut = max(0, score.bit_length() - 50)
    try:
        return math.ldexp(score >> cut, cut - shift)  # >> rounds down
    except OverflowError:
        return math.copysign(math.inf, score)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
