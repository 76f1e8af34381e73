"""Approximate vector search by navigable small-world graphs: one layered graph a partition of the vectors, kept as a table.

An index row is a vector: (part, place, id, vector, links), links being its neighbours' places in its part, layer by layer from
0. A part's graph is built and walked by one task; parts are of a bounded number of rows, and all of them are asked, so that
every vector can be found. The index is an ordinary table: written once, it is searched by any session.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.retrieval import _best_cells, top

#: Links of a vector in the layers above 0 (twice as many in layer 0), and vectors looked at to choose them.
LINKS, EF_BUILD, EF_SEARCH, PART_ROWS = 16, 64, 64, 16_384
#: Vectors by which an upper layer hands a walk on to the next.
HANDED = 8


def build(vectors: DataFrame, links: int = LINKS, ef: int = EF_BUILD, part_rows: int = PART_ROWS, seed: int = 42) -> DataFrame:
    """vectors: (id, vector), of length 1 -> the index's rows. Rows whose vector is null are left out.

    Vectors are dealt to parts of about part_rows by a hash of id and vector, which is the one shuffle; equal vectors are
    spread over all parts.
    """
    rows = vectors.where("vector is not null").select("id", F.col("vector").cast("array<float>").alias("vector"))
    parts = max(1, -(-rows.count() // part_rows))
    part = F.pmod(F.xxhash64(F.lit(seed), "id", "vector"), F.lit(parts)).cast("int")
    schema = f"part int, place int, id {vectors.schema['id'].dataType.simpleString()}, vector array<float>, links array<array<int>>"
    return rows.withColumn("part", part).groupBy("part").applyInArrow(lambda rows: _graph(links, ef, seed, rows), schema)


def search(index: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH, block: int = 4096) -> DataFrame:
    """queries: (qid, vector), of length 1 -> (qid, id, score, rank): the best that a walk with a beam of ef finds in each part.

    Queries are sent to each part in blocks; a part is sent once a block. A null query finds nothing.
    """
    asked = queries.where("vector is not null").select("qid", F.col("vector").cast("array<float>").alias("vector"))
    n_q = max(1, -(-asked.count() // block))
    blocks = asked.select(F.col("qid").alias("asked_qid"), F.col("vector").alias("asked_vector"), F.pmod(F.xxhash64("qid"), F.lit(n_q)).alias("q_block"))
    left = blocks.join(F.broadcast(index.select(F.col("part").alias("asked_part")).distinct()))  # one row for each part_rows vectors
    right = index.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<bigint>")))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {index.schema['id'].dataType.simpleString()}, score double"
    found = left.groupBy("asked_part", "q_block").cogroup(right.groupBy("part", "q_block")).applyInArrow(lambda asked, rows: _walk_part(k, max(k, ef), asked, rows), schema)
    return top(found, k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _nearest_earlier(x: np.ndarray, ef: int, block: int = 512) -> list[np.ndarray]:
    """For each row its ef nearest among the rows before it, best first."""
    out = []
    for a in range(0, len(x), block):
        rows = x[a : a + block]
        s = rows @ x[: a + len(rows)].T
        s[np.arange(s.shape[1])[None, :] >= (a + np.arange(len(rows)))[:, None]] = -np.inf
        few = np.argpartition(-s, ef - 1, axis=1)[:, :ef] if s.shape[1] > ef else np.tile(np.arange(s.shape[1]), (len(rows), 1))
        own = np.take_along_axis(s, few, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        few, own = np.take_along_axis(few, order, 1), np.take_along_axis(own, order, 1)
        out += [f[v > -np.inf] for f, v in zip(few, own, strict=True)]
    return out


def _diverse(x: np.ndarray, i: int, near: np.ndarray, limit: int) -> np.ndarray:
    """Up to limit of near, best first: those nearer to i than to any that is taken, and then the best of the others."""
    if len(near) <= limit:
        return near
    c = x[near]
    own, among = c @ x[i], c @ c.T
    kept, closest = [], np.full(len(near), -np.inf, np.float32)
    for j in range(len(near)):
        if own[j] > closest[j]:
            kept.append(j)
            if len(kept) == limit:
                break
            np.maximum(closest, among[j], out=closest)
    if len(kept) < limit:
        rest = np.setdiff1d(np.arange(len(near)), kept)
        kept += rest[: limit - len(kept)].tolist()
    return near[kept]


def _layer(x: np.ndarray, links: int, cap: int, ef: int) -> list[np.ndarray]:
    """Neighbours of each row of a layer, rows standing in the order in which they join it: the first ones to come are linked
    over long distances, the later ones nearby. Every row can be reached from the first."""
    own = [_diverse(x, i, near, links) for i, near in enumerate(_nearest_earlier(x, ef))]
    back: list[list[int]] = [[] for _ in own]
    for i, near in enumerate(own):
        for j in near.tolist():
            back[j].append(i)
    out = []
    for i, near in enumerate(own):
        both = np.concatenate([near, np.array(back[i], np.int64)]).astype(np.int64)
        if len(both) > cap:
            both = _diverse(x, i, both[np.argsort(-(x[both] @ x[i]), kind="stable")], cap)
        out.append(both)
    reached, ahead = np.zeros(len(x), bool), [0] if len(x) else []
    reached[ahead] = True
    for i in range(len(x)):
        if not reached[i]:  # its links to it were all pruned: the nearest before it, which has been reached, gets one again
            out[own[i][0]] = np.append(out[own[i][0]], i)
            reached[i] = True
            ahead.append(i)
        while ahead:
            new = out[ahead.pop()]
            new = new[~reached[new]]
            reached[new] = True
            ahead += new.tolist()
    return out


def _graph(links: int, ef: int, seed: int, rows: pa.Table) -> pa.Table:
    rows = rows.take(pc.sort_indices(rows["id"], null_placement="at_start"))  # as Spark orders them
    x, n = _matrix(rows["vector"]), rows.num_rows
    rng = np.random.default_rng([seed, n])
    height = np.floor(-np.log(1 - rng.random(n)) / np.log(links)).astype(int)
    joined = rng.permutation(n)
    out: list[list[list[int]]] = [[] for _ in range(n)]
    for layer in range(int(height.max(initial=0)) + 1):
        members = joined[height[joined] >= layer]
        for place, near in zip(members.tolist(), _layer(x[members], links, links * (2 if layer == 0 else 1), ef), strict=True):
            out[place].append(members[near].tolist())
    return pa.table(
        {
            "part": rows["part"],
            "place": pa.array(np.arange(n), pa.int32()),
            "id": rows["id"],
            "vector": rows["vector"],
            "links": pa.array(out, pa.list_(pa.list_(pa.int32()))),
        }
    )


def _walk(x: np.ndarray, near: np.ndarray, q: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ef best that each query meets: again and again the best of its beam that hasn't been looked at
    hands over its neighbours, until none is left. All queries walk in step. near is padded by the place of x's last row."""
    none, at = len(x) - 1, np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(x)), bool)
    seen[:, none] = True
    beam = np.full((len(q), ef), none)
    score = np.full((len(q), ef), -np.inf, np.float32)
    fresh = np.zeros((len(q), ef), bool)
    width = min(ef, entries.shape[1])
    beam[:, :width] = entries[:, :width]
    score[:, :width] = np.einsum("qd,qwd->qw", q, x[beam[:, :width]])
    score[beam == none] = -np.inf
    fresh[:, :width] = beam[:, :width] != none
    seen[at, beam] = True
    while True:
        open_ = np.where(fresh, score, -np.inf)
        best = open_.argmax(1)
        rows = np.flatnonzero(open_[at[:, 0], best] > -np.inf)
        if not len(rows):
            return beam, score
        fresh[rows, best[rows]] = False
        met = near[beam[rows, best[rows]]]
        new = ~seen[rows[:, None], met]
        seen[rows[:, None], met] = True
        s = np.where(new, np.einsum("qd,qwd->qw", q[rows], x[met]), -np.inf)
        all_s = np.concatenate([score[rows], s], 1)
        kept = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        beam[rows] = np.take_along_axis(np.concatenate([beam[rows], met], 1), kept, 1)
        score[rows] = np.take_along_axis(all_s, kept, 1)
        fresh[rows] = np.take_along_axis(np.concatenate([fresh[rows], new], 1), kept, 1)


def _walk_part(k: int, ef: int, asked: pa.Table, rows: pa.Table, slab: int = 256) -> pa.Table:
    out = [pa.table({"qid": asked["asked_qid"].slice(0, 0), "id": rows["id"].slice(0, 0), "score": pa.array([], pa.float64())})]
    if not asked.num_rows or not rows.num_rows:
        return out[0]
    rows = rows.sort_by("place")
    n, links = rows.num_rows, rows["links"].to_pylist()
    x = _matrix(rows["vector"])
    x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])  # for places without a neighbour
    layers = []
    for layer in range(max(map(len, links))):
        own = [(i, v[layer]) for i, v in enumerate(links) if len(v) > layer]
        near = np.full((n + 1, max(1, max(len(v) for _, v in own))), n)
        for i, v in own:
            near[i, : len(v)] = v
        layers.append(near)
    start = next(i for i, v in enumerate(links) if len(v) == len(layers))
    q = _matrix(asked["asked_vector"])
    for a in range(0, len(q), slab):
        some = q[a : a + slab]
        entries = np.full((len(some), 1), start)
        for near in reversed(layers[1:]):
            entries, _ = _walk(x, near, some, entries, HANDED)
        beam, score = _walk(x, layers[0], some, entries, ef)
        order = np.argsort(beam, axis=1)  # ids ascend with places: ties go to the smaller id
        beam = np.take_along_axis(beam, order, 1)
        exact = np.round(np.einsum("qd,qwd->qw", some.astype(float), x[beam].astype(float)), 6) + 0.0
        i, j = _best_cells(np.where(beam == n, -np.inf, exact), k)
        out.append(pa.table({"qid": asked["asked_qid"].take(pa.array(i + a)), "id": rows["id"].take(pa.array(beam[i, j])), "score": pa.array(exact[i, j])}))
    return pa.concat_tables(out)
