"""Places and running sums over whole tables, without sorting a table, or a large group, in one task."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import materialise

WITHIN = (1 << 33) - 1
#: Cells into which values are cut before those at many shares are sought.
CELLS = 1024
#: Quantiles at which values are cut into cells before their median is sought.
GRID = sorted({i / 64 for i in range(1, 64)} | {i / 2000 for i in range(980, 1021)})


def running_sums(df: DataFrame, order: list, columns: dict[str, Column]) -> DataFrame:
    """df, and for each name the sum of its column over all rows before, in the given order (which should have no ties).

    Rows are range-partitioned and written; a row's sum is that of the ranges before it, of which there are a few thousand at
    most, and of the rows before it in its own range.
    """
    named = df.withColumns({f"_{name}": c for name, c in columns.items()})
    ranges = materialise(named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    ranges = ranges.withColumn("_range", F.shiftright("_id", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("_range").agg(*[F.sum(f"_{name}").alias(f"_all_{name}") for name in columns])
    offsets = sums.select("_range", *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_up_{name}") for name in columns])
    own = Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumns({f"_own_{name}": F.coalesce(F.sum(f"_{name}").over(own), F.lit(0)) for name in columns}).join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *[(F.col(f"_up_{name}") + F.col(f"_own_{name}")).alias(name) for name in columns])


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """df and each row's place, from 0, in the given order. No window is needed: a row's place in its range comes with its id."""
    ranges = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    ranges = ranges.withColumn("_range", F.shiftright("_id", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_up"))
    return ranges.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_up") + F.col("_id").bitwiseAND(F.lit(WITHIN))).alias(name))


def positions_by(df: DataFrame, by: str, order: list, name: str = "position") -> DataFrame:
    """df with each row's place, from 0, within its group, and the group's size n. Groups of any size are cut over tasks."""
    placed = positions(df, [F.col(by).asc_nulls_first(), *order], "_place")
    groups = placed.groupBy(by).agg(F.min("_place").alias("_first"), F.count("*").alias("n")).withColumnRenamed(by, "_by")
    return placed.join(groups, F.col(by).eqNullSafe(F.col("_by"))).select(*df.columns, (F.col("_place") - F.col("_first")).alias(name), "n")


def quantiles(df: DataFrame, by: str, value: str, wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """(by, n, one column a name): exact quantiles of the non-null values of each group, interpolated, or of the nearest rank
    (half to even). Only the values at the ranks in question are gathered."""
    placed = positions_by(df.select(by, value).where(F.col(value).isNotNull()), by, [value])
    at = {name: (F.col("n") - 1) * F.lit(q) for name, q in wanted.items()}
    low = {name: F.bround(x, 0) if nearest else F.floor(x) for name, x in at.items()}
    high = low if nearest else {name: F.ceil(x) for name, x in at.items()}
    asked = reduce(lambda a, b: a | b, [F.col("position") == x for x in [*low.values(), *high.values()]])
    value_at = lambda x: F.max(F.when(F.col("position") == x, F.col(value)))
    found = placed.where(asked).groupBy(by, "n").agg(*[value_at(low[k]).alias(f"_low_{k}") for k in wanted], *[value_at(high[k]).alias(f"_high_{k}") for k in wanted])
    share = {name: x - F.floor(x) for name, x in at.items()}
    return found.select(by, "n", *[(F.col(f"_low_{k}") if nearest else F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * share[k]).alias(k) for k in wanted])


def medians_by_fold(rows: DataFrame, features: list[str], fold: str | None = None, folds: int = 1) -> list[dict[str, float | None]]:
    """For each fold k the exact medians of the features over the rows of all other folds; without `fold`, over all rows."""
    outside = [F.when(F.col(fold) != k, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(folds)] if fold else [F.lit(1).cast("long")]
    return medians_of_sets(rows, features, reduce(lambda a, b: a.bitwiseOR(b), outside), folds)


def medians_of_sets(rows: DataFrame, features: list[str], sets: Column, n_sets: int) -> list[dict[str, float | None]]:
    """For each of up to 63 sets of rows the exact medians of the features. sets: a long whose bit k is set in the rows of set k.

    A sketch of all values cuts each feature into cells, narrow ones in the middle; a second pass counts each set's rows in each
    cell; a third ranks the distinct values of the cells that hold a median, alone. However the sketch errs the medians are exact:
    it settles no more than how many rows these cells have.
    """
    named = rows.select(sets.alias("sets"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(features)]).where("sets <> 0")
    sketches = [F.percentile_approx(F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")), GRID) for i in range(len(features))]
    cuts = [np.unique(np.array(x or [], float)) for x in named.agg(*sketches).first()]

    def cells_of(batch):
        """(feature, bits, values, cells) of the values that are there; NaN is in the last cell."""
        bits = batch.column("sets").to_numpy(zero_copy_only=False)
        for i, own in enumerate(cuts):
            column = batch.column(f"v{i}")
            there = column.is_valid().to_numpy(zero_copy_only=False)
            values = column.fill_null(0.0).to_numpy(zero_copy_only=False)[there]
            yield i, bits[there], values, np.searchsorted(own, values)

    def count(batches):
        n = np.zeros((n_sets, len(features), len(GRID) + 1), np.int64)
        for batch in batches:
            for i, bits, _, cells in cells_of(batch):
                for k in range(n_sets):
                    n[k, i] += np.bincount(cells[bits >> k & 1 == 1], minlength=n.shape[2])
        at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*at, n[at])], ["k", "f", "cell", "n"])

    n = np.zeros((n_sets, len(features), len(GRID) + 1), np.int64)
    for r in named.mapInArrow(count, "k long, f long, cell long, n long").groupBy("k", "f", "cell").agg(F.sum("n").alias("n")).collect():
        n[r["k"], r["f"], r["cell"]] = r["n"]
    wanted: dict[tuple[int, int], list[int]] = {}  # (feature, cell) -> sets
    ranks = []
    for k, i in np.ndindex(n_sets, len(features)):
        upto = n[k, i].cumsum()
        if upto[-1]:
            low, high = int(upto[-1] - 1) // 2, int(upto[-1]) // 2
            first, last = (int(np.searchsorted(upto, x, "right")) for x in (low, high))
            before = int(upto[first] - n[k, i, first])
            ranks.append((k, i, low - before, high - before))
            for cell in {first, last}:
                wanted.setdefault((i, cell), []).append(k)
    out: list[dict[str, float | None]] = [dict.fromkeys(features) for _ in range(n_sets)]
    if not ranks:
        return out

    def pick(batches):
        for batch in batches:
            for i, bits, values, cells in cells_of(batch):
                for cell, ks in ((c, ks) for (f, c), ks in wanted.items() if f == i):
                    own = cells == cell
                    for k in ks:
                        v, times = np.unique(values[own][bits[own] >> k & 1 == 1], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(np.full(len(v), i)), pa.array(v), pa.array(times)], ["k", "f", "v", "n"])

    values = named.mapInArrow(pick, "k long, f long, v double, n long").groupBy("k", "f", "v").agg(F.sum("n").alias("n"))
    placed = materialise(running_sums(values, ["k", "f", "v"], {"below": F.col("n")}), "ranks")
    asked = rows.sparkSession.createDataFrame(ranks, "k long, f long, low long, high long")
    begun = placed.groupBy("k", "f").agg(F.min("below").alias("_first")).join(F.broadcast(asked), ["k", "f"])  # a row a set and feature
    place = F.col("below") - F.col("_first")
    middle = ((place <= F.col("low")) & (F.col("low") < place + F.col("n"))) | ((place <= F.col("high")) & (F.col("high") < place + F.col("n")))
    for r in placed.join(F.broadcast(begun), ["k", "f"]).where(middle).groupBy("k", "f").agg(F.avg("v").alias("v")).collect():
        out[r["k"]][features[r["f"]]] = r["v"]
    return out


def quantiles_of_sets(rows: DataFrame, features: list[str], sets: Column, n_sets: int, shares: list[float], fills: list[list[float]] | None = None) -> list[list[list[float]]]:
    """For each of up to 63 sets of rows, as of medians_of_sets, and each feature the different exact values at the shares: the
    least value that at least such a share of the set's rows doesn't exceed. Nulls are to set k what fills[k] says, or left out.
    NaN is above all values, and is none.

    As with medians, cells by a sketch are counted, and the distinct values of those that hold a share are ranked, for all sets and
    features together.
    """
    named = rows.select(sets.alias("sets"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(features)]).where("sets <> 0")
    grid = [i / CELLS for i in range(1, CELLS)]
    sketches = [F.percentile_approx(F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")), grid) for i in range(len(features))]
    cuts = [np.unique(np.array(x or [], float)) for x in named.agg(*sketches).first()]
    size = (n_sets, len(features), CELLS + 1)  # the last place is that of nulls

    def values_of(batch):
        """(feature, bits, values, cells) of the values that are there, and the bits of the nulls."""
        bits = batch.column("sets").to_numpy(zero_copy_only=False)
        for i, own in enumerate(cuts):
            column = batch.column(f"v{i}")
            there = column.is_valid().to_numpy(zero_copy_only=False)
            values = column.fill_null(0.0).to_numpy(zero_copy_only=False)[there]
            yield i, bits[there], values, np.searchsorted(own, values), bits[~there]

    def count(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            for i, bits, _, cells, null in values_of(batch):
                for k in range(n_sets):
                    n[k, i, :-1] += np.bincount(cells[bits >> k & 1 == 1], minlength=CELLS)
                    n[k, i, -1] += np.count_nonzero(null >> k & 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["at", "n"])

    found = named.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(size, np.int64)
    n.ravel()[found["at"].to_numpy()] = found["n"].to_numpy()
    n, nulls = n[:, :, :-1], n[:, :, -1] * (fills is not None)
    filled = [(k, i, float(fills[k][i]), int(nulls[k, i])) for k, i in np.argwhere(nulls).tolist()]
    for k, i, fill, many in filled:
        n[k, i, np.searchsorted(cuts[i], fill)] += many
    upto = n.cumsum(axis=2)
    ranks = np.maximum(1, np.ceil(np.multiply.outer(upto[:, :, -1], shares) - 1e-9)).astype(np.int64)  # from 1
    cell = np.array([[np.searchsorted(upto[k, i], ranks[k, i]) for i in range(len(features))] for k in range(n_sets)])
    wanted = np.zeros((len(features), CELLS + 1), bool)
    for k, i in np.argwhere(upto[:, :, -1]).tolist():
        wanted[i, cell[k, i]] = True
    kept = (n * wanted[:, :-1]).reshape(n_sets, -1)  # rows of the cells whose values are ranked
    before = kept.cumsum(axis=1) - kept

    def pick(batches):
        for batch in batches:
            for i, bits, values, cells, _ in values_of(batch):
                use = wanted[i, cells]
                for own in np.unique(bits[use]).tolist():
                    v, times = np.unique(values[use & (bits == own)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i)), pa.array(np.full(len(v), own)), pa.array(v), pa.array(times)], ["f", "bits", "v", "n"])

    added = [(i, 1 << k, fill, many) for k, i, fill, many in filled if wanted[i, np.searchsorted(cuts[i], fill)]]
    schema = "f long, bits long, v double, n long"
    values = named.mapInArrow(pick, schema).unionByName(rows.sparkSession.createDataFrame(added, schema))
    times = [F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(n_sets)]
    placed = running_sums(values.groupBy("f", "v").agg(*times), ["f", "v"], {f"below{k}": F.col(f"n{k}") for k in range(n_sets)})
    asked = []  # by set, places in the running sum, from 1
    for k in range(n_sets):
        asked.append(np.unique([before[k, i * CELLS + c] + r - (upto[k, i, c] - n[k, i, c]) for i in range(len(features)) if upto[k, i, -1] for r, c in zip(ranks[k, i], cell[k, i])]).astype(np.int64))

    def answer(batches):
        for batch in batches:
            v, f = batch.column("v"), batch.column("f")
            for k, places in enumerate(asked):
                below, many = (batch.column(f"{c}{k}").to_numpy(zero_copy_only=False) for c in ("below", "n"))
                hit = np.flatnonzero(np.searchsorted(places, below, "right") < np.searchsorted(places, below + many, "right"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k)), f.take(pa.array(hit)), v.take(pa.array(hit))], ["k", "f", "v"])

    out: list[list[list[float]]] = [[[] for _ in features] for _ in range(n_sets)]
    for r in placed.mapInArrow(answer, "k long, f long, v double").orderBy("k", "f", "v").collect():
        if r["v"] == r["v"]:
            out[r["k"]][r["f"]].append(r["v"])
    return out
