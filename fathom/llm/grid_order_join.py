"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so a cosine of c or more means a distance of eps = sqrt(2 - 2c) or less. Equal vectors
are one class. Along the leading principal dimensions space is cut in cells of side eps, and classes are sorted by their
cells in lexicographic order: the epsilon grid order. That sequence is cut in intervals of about SHIPPED bytes, each with its
box along the leading principal dimensions. Only pairs of intervals whose boxes are no further apart than eps are fetched;
each is divided in halves again and again, parts whose boxes are further apart are skipped, and what is left is compared.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import materialise, whole
from fathom.llm.components import components
from fathom.llm.vectors import matrix, usable

SHIPPED, LEAF = 1 << 20, 128
GRID_DIMENSIONS, BOX_DIMENSIONS = 6, 12
BROADCAST, COPIES = 64 << 20, 4
#: Intervals that one of a cell's tasks compares with all its others.
SHARE = 256


def principal(vectors: DataFrame, width: int, n: int) -> np.ndarray:
    """The n leading principal directions, (width, n). Each task sends its sums, a matrix of width by width; no sample."""

    def run(batches):
        square, total, count = np.zeros((width, width)), np.zeros(width), 0
        for batch in batches:
            x = unit(matrix(batch.column("vector"), width))
            square, total, count = square + x.T @ x, total + x.sum(0), count + len(x)
        rows = np.concatenate([square.ravel(), total, [count]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows)], ["i", "s"])

    sums = vectors.select("vector").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()["s"].to_numpy()
    count = max(1.0, sums[-1])
    mean = sums[-1 - width : -1] / count
    _, directions = np.linalg.eigh(sums[: width * width].reshape(width, width) / count - np.outer(mean, mean))
    return np.ascontiguousarray(directions[:, ::-1][:, :n])


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)  # so that no square is too large or too small
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def intervals(classes: DataFrame, directions: np.ndarray, eps: float, size: int) -> DataFrame:
    """(interval, low, high, cids, copies, points): the sequence intervals, each with its box along the principal directions.

    points: the vectors as they came, as floats if the column has floats.
    """
    width = len(directions)
    grid = min(GRID_DIMENSIONS, directions.shape[1])
    kind = point_type(classes)

    def place(batches):
        for batch in batches:
            raw = matrix(batch.column("vector"), width)
            along = unit(raw) @ directions
            cell = np.floor(along[:, :grid] / eps).astype(np.int64)
            points = raw.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("copies"), pa.array(cell.tolist(), pa.list_(pa.int64())), pa.array(along[:, -1]), pa.array([r.tobytes() for r in points], pa.binary())],
                ["cid", "copies", "cell", "along", "point"],
            )

    def cut(batches):
        cids, copies, points = [], [], []

        def done():
            along = coordinates(b"".join(points), kind, directions)[1]
            return pa.RecordBatch.from_arrays(
                [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (along.min(0), along.max(0))] + [pa.array([cids], pa.list_(pa.int64())), pa.array([copies], pa.list_(pa.int64())), pa.array([b"".join(points)], pa.binary())],
                ["low", "high", "cids", "copies", "points"],
            )

        for batch in batches:
            for i, n, p in zip(*(batch.column(k).to_pylist() for k in ("cid", "copies", "point"))):
                cids.append(i)
                copies.append(n)
                points.append(p)
                if len(cids) >= size:
                    yield done()
                    cids, copies, points = [], [], []
        if cids:
            yield done()

    placed = classes.select("cid", "copies", "vector").mapInArrow(place, "cid long, copies long, cell array<long>, along double, point binary")
    ordered = materialise(placed, "placed").repartitionByRange("cell", "along").sortWithinPartitions("cell", "along", "cid")
    cut_ = ordered.select("cid", "copies", "point").mapInArrow(cut, "low array<double>, high array<double>, cids array<long>, copies array<long>, points binary")
    return materialise(cut_.withColumn("interval", F.monotonically_increasing_id()), "intervals")


def point_type(classes: DataFrame) -> str:
    return "<f4" if dict(classes.dtypes)["vector"] == "array<float>" else "<f8"


def coordinates(points: bytes, kind: str, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors scaled to length 1, and where they lie along the principal directions."""
    x = unit(np.frombuffer(points, kind).reshape(-1, len(directions)).astype(np.float64))
    return x, x @ directions


def near_pairs(cut: DataFrame, eps: float, share: int = SHARE) -> DataFrame:
    """(left, right): each pair of intervals whose boxes are no further apart than eps, once, and each with itself.

    They meet in the cells of a coarse grid over two directions, in the first cell that both touch; boxes alone are shuffled. A
    cell, of which there are few, may hold all boxes: its right ones are dealt into shares of about `share`, its left ones meet
    each, so that there are as many tasks as the intervals are worth.
    """
    side = max(eps, 0.1)
    shares = max(1, -(-cut.count() // share))
    two = cut.select("interval", "low", "high")
    at = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k + 1)), F.lit(0.0))
    cells = lambda name, more: [F.floor((at(F.col("low"), k) - more) / side).alias(f"{name}_from{k}") for k in (0, 1)] + [F.floor((at(F.col("high"), k) + more) / side).alias(f"{name}_to{k}") for k in (0, 1)]

    def spread(name: str, more: float) -> DataFrame:
        rows = two.select(F.col("interval").alias(name), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"), *cells(name, more))
        for k in (0, 1):
            rows = rows.withColumn(f"cell{k}", F.explode(F.sequence(f"{name}_from{k}", f"{name}_to{k}")))
        return rows

    left = spread("left", eps).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    right = spread("right", 0.0).withColumn("share", F.pmod(F.xxhash64("right"), F.lit(shares)))
    met = left.join(right, ["cell0", "cell1", "share"]).where("left <= right")
    for k in (0, 1):
        met = met.where(F.col(f"cell{k}") == F.greatest(f"left_from{k}", f"right_from{k}"))
    apart = lambda low, high: F.zip_with(low, high, lambda x, y: x - y)
    gaps = F.zip_with(apart("left_low", "right_high"), apart("right_low", "left_high"), lambda x, y: F.pow(F.greatest(F.lit(0.0), x, y), F.lit(2)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) <= eps * eps * (1 + 1e-9)
    swap = F.pmod(F.xxhash64("left", "right"), F.lit(2)) == 0  # so that no interval is the left one of all its pairs
    return met.where(near).select(F.when(swap, F.col("left")).otherwise(F.col("right")).alias("left"), F.when(swap, F.col("right")).otherwise(F.col("left")).alias("right"))


def linked(p: np.ndarray, q: np.ndarray, p_box: np.ndarray, q_box: np.ndarray, least: float, eps: float, same: bool, leaf: int = LEAF):
    """Pairs (i, j) of rows of p and q with an inner product of least or more; i < j where both are the same.

    p_box, q_box: the rows along the leading principal directions. The longer sequence is halved until both are short.
    """
    todo = [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:
            continue
        gap = np.maximum(0, np.maximum(p_box[a:b].min(0) - q_box[c:d].max(0), q_box[c:d].min(0) - p_box[a:b].max(0)))
        if gap @ gap > eps * eps * (1 + 1e-9):
            continue
        if max(b - a, d - c) <= leaf:
            i, j = np.nonzero(p[a:b] @ q[c:d].T >= least)
            i, j = i + a, j + c
            yield (i[i < j], j[i < j]) if same else (i, j)
        elif same and (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
        else:
            todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]


def connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the parts of i and j, pair by pair. label: for each member the least member of its part; changed in place."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def links(cut: DataFrame, pairs: DataFrame, kind: str, directions: np.ndarray, cosine: float, eps: float) -> DataFrame:
    """(cid, n, other): how many other vectors a class is linked with in one pair of intervals, and, where it has any, the
    least class that it is then connected with. A pair of intervals sends at most two rows a member, however many links it has.

    The intervals, of about SHIPPED bytes each, go to every executor while they are under BROADCAST bytes together; else a pair
    fetches its left one, then its right one, in COPIES shares, so that an interval of many pairs isn't one task's.
    """
    side = lambda name, short: cut.select(F.col("interval").alias(name), *[F.col(k).alias(f"{short}_{k}") for k in ("cids", "copies", "points")])
    small = cut.agg(F.coalesce(F.sum(F.length("points")), F.lit(0))).first()[0] <= BROADCAST

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same = r["left"] == r["right"]
                p, p_box = coordinates(r["l_points"], kind, directions)
                q, q_box = (p, p_box) if same else coordinates(r["r_points"], kind, directions)
                ids = np.array(r["l_cids"] + ([] if same else r["r_cids"]))
                copies = np.array(r["l_copies"] + ([] if same else r["r_copies"]))
                shift = 0 if same else len(p)
                n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for i, j in linked(p, q, p_box, q_box, cosine, eps, same):
                    j = j + shift
                    n += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                    connect(label, i, j)
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(n[used]), pa.array(ids[label[used]])], ["cid", "n", "other"])

    if small:
        tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work a row: kept apart
        met = pairs.repartition(tasks, "left", "right").join(F.broadcast(side("left", "l")), "left").join(F.broadcast(side("right", "r")), "right")
    else:
        met = pairs
        for name, short, other in (("left", "l", "right"), ("right", "r", "left")):
            copied = side(name, short).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)).cast("array<bigint>")))
            met = met.withColumn("share", F.pmod(F.xxhash64(other), F.lit(COPIES))).join(copied, [name, "share"]).drop("share")
    return met.mapInArrow(run, "cid long, n long, other long")


@whole
def groups(vectors: DataFrame, cosine: float = 0.95, interval: int | None = None) -> DataFrame:
    """vectors: (vec_id, embedding). One row each: vec_id, n_links, component_id, kept.

    Null, zero and empty vectors and those with null or non-finite components link with nothing and are kept, as are rows
    without a vec_id. Repeated vectors are linked with each other. Shorter vectors are as if filled with zeros. An empty
    table gives no rows. Other columns are not read. Every pair is decided by its cosine in double precision.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    given = dict(vectors.dtypes)["embedding"]
    vector = F.col("embedding").cast(given if given == "array<float>" else "array<double>")
    fit = F.coalesce(usable(F.col("embedding")) & F.exists(vector, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select("vec_id", F.when(fit, vector).alias("vector"))
    key = F.sha2(F.array_join(F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")), ",").cast("binary"), 256)
    rows = materialise(rows.withColumn("key", key), "vectors")
    real, others = rows.where("vector is not null"), rows.where("vector is null")
    classes = materialise(real.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    width = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    directions = principal(classes, width, min(BOX_DIMENSIONS, width))
    kind, reach = point_type(classes), max(eps, 1e-6) + 1e-9
    size = interval or max(LEAF, SHIPPED // (width * int(kind[-1])))
    cut = intervals(classes, directions, reach, size)
    found = materialise(links(cut, near_pairs(cut, reach), kind, directions, cosine, reach), "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    parts = materialise(components(found.select(F.col("cid").alias("a"), F.col("other").alias("b"))), "parts")
    named = classes.select("key", "cid", "least", "copies").join(parts, classes.cid == parts.node, "left").withColumn("part", F.coalesce("component", "cid")).join(counts, "cid", "left")
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    lookup = named.join(least, "part").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = real.select("vec_id", "key").join(lookup, "key").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return found.unionByName(others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
