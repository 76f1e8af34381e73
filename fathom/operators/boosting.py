"""Second-order boosting: trees of a fixed depth by sums of gradients and hessians over histograms.

Rows are binned once. Models of several samples of the rows, such as those of folds, grow together: a pass serves all.

Up to a depth of two a tree is one pass: each task adds up gradient and hessian by the bins of two features, for each pair of
features, from which the driver, which gets one row a task, has the sums of both levels. No path knows more than two features, so
the sum of all trees so far is a table for each pair too, and a row's margin costs the same however many trees there are.

Deeper trees, or those of too many pairs, take a pass a level: each task adds up gradient and hessian by node, feature and bin,
Spark sums them, the driver, which gets one row a node, feature and bin, picks the splits, and margins are carried along every
few trees.
"""

import uuid
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.order import quantiles_of_sets
from fathom.session import materialise, spread, table_dir

ROUNDS, DEPTH, RATE, PENALTY, FLOOR, SHARE, BINS = 120, 2, 0.06, 3.0, 5.0, 0.8, 64
#: Trees after which rows are written with their margins.
CARRIED = 10
#: Rows of a block of the binned rows, cells of all pairs and models that a task sends at most, and tasks that send them.
BLOCK, CELLS, TASKS = 16_384, 1 << 18, 64


class Tree:
    """Nodes in heap order: 2 i + 1 and 2 i + 2 stand below i. feature is -1 for a leaf; rows whose feature is <= cut go left."""

    def __init__(self, feature: list[int], cut: list[float], value: list[float], gain: list[float]):
        self.feature, self.cut, self.value, self.gain = feature, cut, value, gain

    @staticmethod
    def of_depth(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree([-1] * n, [0.0] * n, [0.0] * n, [0.0] * n)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) + _reached(self.feature, self.cut, self.value, x.T)


def drawn(key: np.ndarray, number: int, share: float, seed: int) -> np.ndarray:
    """A seeded sample of rows for tree `number`: the same in every task and run."""
    z = key.astype(np.uint64) + np.uint64((number * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / np.float64(2**64) < share


def columns_of(number: int, width: int, share: float, seed: int) -> list[int]:
    """The features that tree `number` may use."""
    return sorted(np.random.default_rng([seed, number]).choice(width, max(1, int(share * width)), replace=False).tolist())


def best_split(g: np.ndarray, h: np.ndarray, penalty: float, floor: float) -> tuple[float, int, int] | None:
    """g, h: (features, bins) of one node -> (gain, feature, bin): what goes left ends with that bin. Of equal gains the first
    feature's first bin; None where nothing gains, or either side's hessian would be below the floor."""
    G, H = g[0].sum(), h[0].sum()
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gr, hr = G - gl, H - hl
    gain = np.round((gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - G * G / (H + penalty)) / 2, 9)
    gain[(hl < floor) | (hr < floor)] = -np.inf
    if not gain.size or gain.max() <= 1e-6:
        return None
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most bins - 1 ascending values of each feature, at even shares of its rows."""
    return quantiles_of_sets(rows, features, F.lit(1).cast("long"), 1, even(bins))[0]


def even(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def fit(rows: DataFrame, features: list[str], label: str, key: str, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, penalty: float = PENALTY, floor: float = FLOOR, share: float = SHARE, bins: int = BINS, seed: int = 42) -> list[Tree]:
    """rows: features without nulls, a label of 0 or 1, and a long key for sampling -> trees; a row's log odds are the sum of their
    margins. Leaves are penalised by `penalty` (L2), and no side of a split has less hessian than `floor`. Each tree sees a
    `share` of the rows and of the features."""
    return fit_together(rows, features, label, key, F.lit(1), [[0.0] * len(features)], rounds, depth, rate, penalty, floor, share, bins, seed)[0]


def fit_together(rows: DataFrame, features: list[str], label: str, key: str, seen: Column, fills: list[list[float]], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, penalty: float = PENALTY, floor: float = FLOOR, share: float = SHARE, bins: int = BINS, seed: int = 42) -> list[list[Tree]]:
    """One model as of `fit` for each element of fills, what the features' nulls are to it. It sees the rows whose `seen` has its
    bit, at most 60 of which there are."""
    if bins > 256 or len(fills) > 60:
        raise ValueError(f"{bins} bins, {len(fills)} models: at most 256 and 60")
    models, width = range(len(fills)), len(features)
    given = rows.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"), F.col(key).cast("long").alias("key"), seen.cast("long").alias("seen"))
    values = [F.col("x")[f].alias(f"x{f}") for f in range(width)]
    cuts = quantiles_of_sets(given.select("seen", *values), [f"x{f}" for f in range(width)], F.col("seen"), len(fills), even(bins), fills)
    grow = lambda own, sums_of: _next_trees(cuts, own, depth, rate, penalty, floor, sums_of)
    widths = [max(len(own[f]) for own in cuts) + 1 for f in range(width)]
    if depth <= 2 and _offsets(range(width), widths)[-1] * len(fills) <= CELLS:
        return _grown_by_pairs(given, grow, cuts, fills, rounds, widths, bins, share, seed)
    table = materialise(_binned(spread(given), cuts, fills), "binned")
    trees: list[list[Tree]] = [[] for _ in models]
    codes: list[list[list[int]]] = [[] for _ in models]  # of each tree, the bins with which left sides end
    carried = 0
    for number in range(rounds):
        if number - carried == CARRIED:
            table = materialise(_with_margins(table, _packed(trees, codes, carried), width), "margins")
            carried = number
        own, earlier = columns_of(number, width, share, seed), _packed(trees, codes, carried)
        grown = grow(own, lambda growing, _: _histograms(table, earlier, growing, own, width, bins, number, share, seed))
        for k, (tree, ends) in enumerate(zip(*grown)):
            trees[k].append(tree)
            codes[k].append(ends)
    return trees


#: What trees of all models, (feature, code), are so far, and the level that is sought -> {(model, node): (g, h)}.
Sums = Callable[[list[tuple], int], dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]


def _next_trees(cuts: list[list[list[float]]], own: list[int], depth: int, rate: float, penalty: float, floor: float, sums_of: Sums) -> tuple[list[Tree], list[list[int]]]:
    """A tree for each model, of the features of own, and the bins with which its left sides end."""
    models = range(len(cuts))
    leaf = lambda g, h: -rate * float(g.sum()) / (float(h.sum()) + penalty)
    new, open_ = [Tree.of_depth(depth) for _ in models], [[0] for _ in models]
    ends = [[0] * len(new[0].feature) for _ in models]
    for level in range(depth):
        sums = sums_of([(t.feature, e) for t, e in zip(new, ends)], level)
        for k in models:
            following = []
            for i in (i for i in open_[k] if (k, i) in sums):
                g, h = sums[k, i]
                if i == 0:
                    new[k].value[0] = leaf(g[0], h[0])
                if found := best_split(g, h, penalty, floor):
                    gain, f, b = found
                    new[k].feature[i], new[k].cut[i], new[k].gain[i], ends[k][i] = own[f], cuts[k][own[f]][b], gain, b
                    new[k].value[2 * i + 1], new[k].value[2 * i + 2] = leaf(g[f, : b + 1], h[f, : b + 1]), leaf(g[f, b + 1 :], h[f, b + 1 :])
                    following += [2 * i + 1, 2 * i + 2]
            open_[k] = following
        if not any(open_):
            break
    return new, ends


def _pairs(own) -> list[tuple[int, int]]:
    """The pairs of own's features; of a single one itself twice."""
    return list(combinations(own, 2)) or [(f, f) for f in own]


def _offsets(own, widths: list[int]) -> list[int]:
    """Where the cells of each of own's pairs begin, and their number."""
    return [0, *np.cumsum([widths[i] * widths[j] for i, j in _pairs(own)]).tolist()]


def _add_to_tables(tables: dict[tuple, np.ndarray], tree: Tree, ends: list[int], widths: list[int]) -> None:
    """tables: by (feature,) or a pair of features what all trees add to the margin for their bins. Each side of a tree of depth
    two or less knows at most two features."""
    feature, value = tree.feature, tree.value
    for side, other in ((1, 2), (2, 1)) if feature[0] >= 0 else ((0, 0),):
        key = tuple(sorted({max(feature[0], 0), *(f for f in feature[side : side + 1] if f >= 0)}))
        grid = np.zeros((len(widths), *(widths[f] for f in key)), np.uint8)
        for f, bins in zip(key, np.indices(grid.shape[1:])):
            grid[f] = bins
        own = list(value)
        for i in (other, 2 * other + 1, 2 * other + 2) if other else ():
            own[i : i + 1] = [0.0] * len(own[i : i + 1])
        tables[key] = tables.get(key, 0.0) + np.zeros(grid.shape[1:]) + _reached(feature, ends, own, grid)


def _blocks(given: DataFrame, cuts: list[list[list[float]]], fills: list[list[float]], tasks: int) -> RDD:
    """(models, bins, y, key) of up to BLOCK rows that the same models see, written to the folder of tables; bins: a byte for each
    of these models, feature and row. Few kinds of rows by the models that see them are expected."""
    width = len(cuts[0])

    def block(seen: int, x: np.ndarray, null: np.ndarray, y: np.ndarray, key: np.ndarray):
        own = [k for k in range(len(cuts)) if seen >> k & 1]
        bins = [np.searchsorted(cuts[k][f], np.where(null[:, f], fills[k][f], x[:, f]), side="left") for k in own for f in range(width)]
        return pa.RecordBatch.from_arrays([pa.array([seen]), *(pa.array([v.tobytes()], pa.binary()) for v in (np.stack(bins).astype(np.uint8), y, key))], ["seen", "bins", "y", "key"])

    def run(batches):
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, seen = batch.column("x").flatten(), batch.column("seen").to_numpy()
            x, null = (v.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for v in (flat, flat.is_null()))
            y, key = batch.column("y").to_numpy().astype(np.int8), batch.column("key").to_numpy()
            for one in np.unique(seen[seen != 0]).tolist():
                use = np.flatnonzero(seen == one)
                parts = held.setdefault(one, [])
                parts.append((x[use], null[use], y[use], key[use]))
                if sum(len(part[2]) for part in parts) >= BLOCK:
                    yield block(one, *(np.concatenate(v) for v in zip(*held.pop(one))))
        for one, parts in held.items():
            yield block(one, *(np.concatenate(v) for v in zip(*parts)))

    def unpacked(r):
        own = [k for k in range(len(cuts)) if r["seen"] >> k & 1]
        return own, np.frombuffer(r["bins"], np.uint8).reshape(len(own), width, -1), np.frombuffer(r["y"], np.int8), np.frombuffer(r["key"], np.int64)

    context, path = given.sparkSession.sparkContext, f"{table_dir(given.sparkSession)}/blocks-{uuid.uuid4().hex}"
    dealt = given.mapInArrow(run, "seen long, bins binary, y binary, key binary").repartition(tasks)  # by turns: tasks of the same size
    dealt.rdd.map(unpacked).saveAsPickleFile(path, 1)
    return context.pickleFile(path, tasks).coalesce(tasks)


def _pair_sums(blocks: RDD, tables: list[dict], own: list[int], widths: list[int], number: int, share: float, seed: int) -> np.ndarray:
    """(models, 2, cells): gradients and hessians of all rows that tree `number` sees, by the bins of each pair of own's features."""
    offsets = _offsets(own, widths)
    pairs = list(zip(_pairs(own), offsets, offsets[1:]))

    def run(some):
        sums = np.zeros((len(tables), 2, offsets[-1]))
        for models, bins, y, key in some:
            kept = drawn(key, number, share, seed)
            for k, b in zip(models, bins.astype(np.int64)):
                cells = {(f, j): b[f] * widths[j] + b[j] for f, j in {p for p, _, _ in pairs} | {p for p in tables[k] if len(p) == 2}}
                margin = np.zeros(len(y))
                for p, values in tables[k].items():
                    margin += values.ravel().take(b[p[0]] if len(p) == 1 else cells[p])
                p = 1 / (1 + np.exp(-margin))
                for n, v in enumerate(((p - y) * kept, p * (1 - p) * kept)):
                    for pair, first, last in pairs:
                        sums[k, n, first:last] += np.bincount(cells[pair], v, last - first)
        return [sums]

    return sum(blocks.mapPartitions(run).collect(), np.zeros((len(tables), 2, offsets[-1])))


def _grown_by_pairs(given: DataFrame, grow: Callable, cuts: list[list[list[float]]], fills: list[list[float]], rounds: int, widths: list[int], bins: int, share: float, seed: int) -> list[list[Tree]]:
    """All trees of all models, of a depth of two or less."""
    models = range(len(cuts))
    tasks = min(TASKS, given.sparkSession.sparkContext.defaultParallelism)
    blocks = _blocks(spread(given), cuts, fills, tasks)
    trees: list[list[Tree]] = [[] for _ in models]
    tables: list[dict[tuple, np.ndarray]] = [{} for _ in models]
    for number in range(rounds):
        own = columns_of(number, len(widths), share, seed)
        sums = _pair_sums(blocks, tables, own, widths, number, share, seed)
        offsets = _offsets(own, widths)
        joint = [{(i, j): sums[k, :, a:b].reshape(2, widths[i], widths[j]) for (i, j), a, b in zip(_pairs(own), offsets, offsets[1:])} for k in models]

        def by_bin(k: int, f: int, root: int, side: slice) -> np.ndarray:
            """(2, bins): sums by the bin of f over the rows whose bin of root is within side."""
            out = np.zeros((2, bins))
            i, j = next(p for p in joint[k] if f in p and root in p)
            held = joint[k][i, j] if root == i else joint[k][i, j].transpose(0, 2, 1)
            kept = slice(None) if root != f else side
            by = held[:, side].sum(axis=1) if root != f else held.sum(axis=2)[:, side]
            out[:, : widths[f]][:, kept] = by
            return out

        def sums_of(growing: list[tuple], level: int):
            out = {}
            for k, (feature, code) in enumerate(growing):
                root, cut = feature[0], code[0] + 1
                for i, side in ((1, slice(cut)), (2, slice(cut, None))) if level else ((0, slice(None)),):
                    if not level or root >= 0:
                        g, h = np.stack([by_bin(k, f, root if level else f, side) for f in own], axis=1)
                        if h.any():
                            out[k, i] = g, h
            return out

        for k, (tree, ends) in enumerate(zip(*grow(own, sums_of))):
            trees[k].append(tree)
            _add_to_tables(tables[k], tree, ends, widths)
    return trees


def _packed(trees: list[list[Tree]], codes: list[list[list[int]]], since: int) -> list[list[tuple]]:
    return [[(t.feature, c, t.value) for t, c in zip(own[since:], ends[since:])] for own, ends in zip(trees, codes)]


def _reached(feature: list[int], code: list[int], value, bins: np.ndarray, at: int = 0):
    """What value has for the node at which each row ends. bins: (features, rows)."""
    if feature[at] < 0:
        return value[at]
    return np.where(bins[feature[at]] > code[at], _reached(feature, code, value, bins, 2 * at + 2), _reached(feature, code, value, bins, 2 * at + 1))


def _sum_of(trees: list[tuple], bins: np.ndarray) -> np.ndarray:
    return sum((_reached(*t, bins) for t in trees), np.zeros(bins.shape[1]))


def _unpacked(column: pa.Array, kind, rows: int) -> np.ndarray:
    """(width, rows) of a binary column of equally long values."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    flat = np.frombuffer(data, np.uint8)[offsets[column.offset] : offsets[column.offset + rows]]
    return np.ascontiguousarray(flat.view(kind).reshape(rows, -1).T)


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row."""
    rows = np.ascontiguousarray(rows)
    n = rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(n)), pa.py_buffer(rows.tobytes())])


def _binned(given: DataFrame, cuts: list[list[list[float]]], fills: list[list[float]]) -> DataFrame:
    """bins: a byte for each model and feature; margins: a double for each model."""

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            null = batch.column("x").flatten().is_null().to_numpy(zero_copy_only=False).reshape(x.shape)
            bins = [np.searchsorted(c, np.where(null[:, f], fill, x[:, f]), side="left") for own, fills_ in zip(cuts, fills) for f, (c, fill) in enumerate(zip(own, fills_))]
            yield pa.RecordBatch.from_arrays([_bytes_of(np.stack(bins, axis=1).astype(np.uint8)), _bytes_of(np.zeros((len(x), len(cuts)))), *(batch.column(c) for c in ("y", "key", "seen"))], ["bins", "margins", "y", "key", "seen"])

    return given.mapInArrow(run, "bins binary, margins binary, y double, key long, seen long")


def _with_margins(table: DataFrame, trees: list[list[tuple]], width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bins, margins = _unpacked(batch.column("bins"), np.uint8, batch.num_rows), _unpacked(batch.column("margins"), float, batch.num_rows)
                added = [_sum_of(own, bins[k * width : (k + 1) * width]) for k, own in enumerate(trees)]
                yield batch.set_column(batch.schema.get_field_index("margins"), "margins", _bytes_of((margins + np.stack(added)).T))

    return table.mapInArrow(run, table.schema)


def _histograms(table: DataFrame, trees: list[list[tuple]], growing: list[tuple], own: list[int], features: int, width: int, number: int, share: float, seed: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Gradients and hessians of the nodes in which the growing trees, (feature, code) of each model, end so far: {(model, node):
    (g, h)}, each (features of own, bins)."""
    size, models = len(growing[0][0]), len(growing)
    cells = size * len(own) * width

    def run(batches):
        g, h = np.zeros((models, cells)), np.zeros((models, cells))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margins = _unpacked(batch.column("bins"), np.uint8, batch.num_rows), _unpacked(batch.column("margins"), float, batch.num_rows)
            y, seen, kept = batch.column("y").to_numpy(), batch.column("seen").to_numpy(), drawn(batch.column("key").to_numpy(), number, share, seed)
            for k, (feature, code) in enumerate(growing):
                use = np.flatnonzero(kept & ((seen >> k) & 1 == 1))
                b = bins[k * features : (k + 1) * features, use]
                p = 1 / (1 + np.exp(-(margins[k, use] + _sum_of(trees[k], b))))
                at = np.zeros(len(use), np.int64) + _reached(feature, code, range(size), b)
                for j, f in enumerate(own):
                    cell = (at * len(own) + j) * width + b[f]
                    g[k] += np.bincount(cell, p - y[use], cells)
                    h[k] += np.bincount(cell, p * (1 - p), cells)
        used = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(g.ravel()[used]), pa.array(h.ravel()[used])], ["cell", "g", "h"])

    sums = table.mapInArrow(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    g, h = np.zeros(models * cells), np.zeros(models * cells)
    g[sums["cell"].to_numpy()], h[sums["cell"].to_numpy()] = sums["g"].to_numpy(), sums["h"].to_numpy()
    g, h = (v.reshape(models, size, len(own), width) for v in (g, h))
    return {(k, i): (g[k, i], h[k, i]) for k in range(models) for i in range(size) if h[k, i].any()}


def predict(rows: DataFrame, trees: list[Tree], features: list[str], name: str = "p") -> DataFrame:
    """rows with the probability of label 1."""
    packed = rows.withColumn("_x", F.array(*[F.col(c).cast("double") for c in features]))

    def run(batches):
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1)
            p = 1 / (1 + np.exp(-sum((t.margin(x) for t in trees), np.zeros(len(x)))))
            yield batch.set_column(batch.schema.get_field_index("_x"), name, pa.array(p))

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"{name} double"])
    return packed.mapInArrow(run, schema)
