"""Boosting, saved models, medians by ranges and the keyed table against plain restatements."""

import math
import os
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import boosting, ml, order
from fathom.sources import keyed


@pytest.fixture(scope="module")
def stays(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, b, c = (float(v) for v in rng.normal(size=3))
        y = int(rng.random() < 1 / (1 + math.exp(-(2 * a * (b > 0) - c))))
        rows.append((i, i // 3, y, a, None if i % 13 == 0 else b, round(c, 1), 7.0))
    return spark.createDataFrame(rows, "id long, subject long, y int, a double, b double, c double, d double")


def plain_trees(x, y, key, cuts, rounds, depth, rate, penalty, floor, share, seed):
    """Row by row and split by split, with no histograms."""
    margin, out = [0.0] * len(x), []
    for number in range(rounds):
        own = boosting.columns_of(number, len(cuts), share, seed)
        kept = [i for i in range(len(x)) if boosting.drawn(np.array([key[i]]), number, share, seed)[0]]
        g = {i: 1 / (1 + math.exp(-margin[i])) - y[i] for i in kept}
        h = {i: (g[i] + y[i]) * (1 - g[i] - y[i]) for i in kept}
        leaf = lambda rows: -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + penalty)
        quality = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + penalty)
        tree = boosting.Tree.of_depth(depth)
        tree.value[0] = leaf(kept)
        at = {0: kept}
        for _ in range(depth):
            following = {}
            for node, rows in at.items():
                best = None
                for f in own:
                    for cut in cuts[f]:
                        left, right = [i for i in rows if x[i][f] <= cut], [i for i in rows if x[i][f] > cut]
                        if sum(h[i] for i in left) < floor or sum(h[i] for i in right) < floor:
                            continue
                        gain = round((quality(left) + quality(right) - quality(rows)) / 2, 9)
                        if gain > 1e-6 and (best is None or gain > best[0]):
                            best = gain, f, cut, left, right
                if best:
                    tree.gain[node], tree.feature[node], tree.cut[node] = best[:3]
                    following[2 * node + 1], following[2 * node + 2] = best[3], best[4]
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = leaf(best[3]), leaf(best[4])
            at = following
        out.append(tree)
        margin = [m + v for m, v in zip(margin, tree.margin(np.array(x)))]
    return out, margin


@pytest.mark.parametrize(("rounds", "depth", "share"), [(5, 2, 0.8), (23, 1, 0.8), (3, 3, 1.0)])
def test_trees_are_those_of_a_plain_restatement(spark, stays, rounds, depth, share):
    features = ["a", "b", "c", "d"]
    rows = stays.fillna({"b": 0.25}).repartition(5)
    trees = boosting.fit(rows, features, "y", "id", rounds, depth, share=share, bins=16)
    data = sorted(rows.collect(), key=lambda r: r.id)
    x = [[r[c] for c in features] for r in data]
    cuts = boosting.cut_points(rows, features, 16)
    wanted, margin = plain_trees(x, [r.y for r in data], [r.id for r in data], cuts, rounds, depth, boosting.RATE, boosting.PENALTY, boosting.FLOOR, share, 42)
    for got, w in zip(trees, wanted, strict=True):
        assert got.feature == w.feature and got.cut == w.cut
        assert got.value == pytest.approx(w.value) and got.gain == pytest.approx(w.gain, abs=2e-9)
    assert any(f >= 0 for t in trees for f in t.feature) and all(3 not in t.feature for t in trees)  # d never varies
    p = {r.id: r.p for r in boosting.predict(rows, trees, features).collect()}
    assert all(p[r.id] == pytest.approx(1 / (1 + math.exp(-m))) for r, m in zip(data, margin))


def test_no_split_below_the_hessian_floor():
    g, h = np.array([[-3.0, 2.0, 2.0]]), np.array([[4.0, 3.0, 3.0]])
    assert boosting.best_split(g, h, 3.0, 5.0) is None
    gain, f, b = boosting.best_split(g, h, 3.0, 4.0)
    assert (f, b) == (0, 0) and gain == pytest.approx((9 / 7 + 16 / 9 - 1 / 13) / 2)


@pytest.mark.parametrize("kind", ["logistic", "calibrated", "boosted"])
def test_saved_models_serve_in_another_session(spark, stays, tmp_path, kind):
    features = ["a", "b", "c"]
    fit = {"logistic": lambda: ml.fit_logistic(stays, features, "y"), "calibrated": lambda: ml.fit_calibrated(stays, features, "y", "subject"), "boosted": lambda: ml.fit_boosted(stays, features, "y", "id", 6)}
    model = fit[kind]()
    ml.save_model(spark, model, str(tmp_path / "model"), selected="by hand")
    other = spark.newSession()
    loaded, told = ml.load_model(other, str(tmp_path / "model"))
    assert told["features"] == features and told["selected"] == "by hand"
    one, two = ({r.id: r.p for r in m(stays).collect()} for m in (model, loaded))
    assert one == pytest.approx(two) and len(set(one.values())) > 20 and ml.top_features(loaded, features) == ml.top_features(model, features)
    cohort = stays.select(F.col("id").alias("stay_id"), (F.col("subject") + 10_000).alias("subject_id"), F.col("id").alias("seq"), "c", "a", F.lit(1).alias("unknown"), "b")
    wanted = spark.createDataFrame([(" 7 ",), ("10005",), ("nobody",), (None,), ("7",)], "id string")
    got = {r.id: (r.matched_on, r.probability, r.band, r.model) for r in ml.predict_risk(wanted, cohort, (loaded, told)).collect()}
    assert got[" 7 "][:2] == got["7"][:2] == ("stay_id", round(one[7], 4)) and got["7"][3] == kind
    assert got["10005"][:2] == ("subject_id", round(one[17], 4))  # stays 15 to 17 are that subject's
    assert got["nobody"] == got[None] == (None, None, None, None)
    assert {r.probability for r in ml.predict_risk(wanted, cohort.drop("c"), (loaded, told)).collect()} != {None}  # a pinned column that is not there
    assert ml.load_model(spark, str(tmp_path / "none")) is None
    assert {tuple(r)[1:] for r in ml.predict_risk(wanted, cohort, None).collect()} == {(None,) * 4}


def test_medians_of_all_features_and_folds_together(spark, stays):
    features = ["a", "b", "c", "d"]
    rows = stays.withColumn("fold", (F.col("id") % 3).cast("int")).withColumn("e", F.lit(None).cast("double"))
    data = rows.collect()
    for k, got in enumerate(order.medians_by_fold(rows, [*features, "e"], "fold", 3)):
        assert got == pytest.approx({c: statistics.median([r[c] for r in data if r[c] is not None and r.fold != k]) for c in features} | {"e": None})
    assert order.medians_by_fold(rows, features)[0] == pytest.approx({c: statistics.median([r[c] for r in data if r[c] is not None]) for c in features})
    assert order.medians_by_fold(rows.limit(0), features) == [dict.fromkeys(features)]


# The keyed table


def bytes_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_an_upsert_writes_what_it_touches(spark, tmp_path):
    path = str(tmp_path)
    old = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("old "), "id").alias("text"), (F.col("id") * 1.5).alias("v"))
    keyed.create(old, path, "k", 32)
    before = bytes_of(path)
    new = spark.createDataFrame([(5, "n", 1.0, 1), (5, "newer", 2.0, 2), (30_000, "added", 3.0, 1)], "k long, text string, v double, seq long")
    told = keyed.upsert(new, path, ["v"])
    assert told["version"] == 1 and len(told["buckets"]) == 2 and bytes_of(path) - before < before / 8
    got = {r.k: (r.text, r.v) for r in keyed.read(spark.newSession(), path).collect()}
    assert len(got) == 20_001 and got[5] == ("old 5", 2.0) and got[30_000] == ("added", 3.0) and got[6] == ("old 6", 9.0)
    assert {r.k: (r.text, r.v) for r in keyed.read(spark, path, 0).collect()}[5] == ("old 5", 7.5)  # the old version is still there


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    keyed.create(spark.createDataFrame([(i, i) for i in range(50)], "k long, v long"), path, "k", 4)
    broken = spark.range(3).select(F.col("id").alias("k"), F.raise_error(F.lit("lost")).cast("long").alias("v"), F.lit(1).alias("seq"))
    with pytest.raises(Exception, match="lost"):
        keyed.upsert(broken, path, ["v"])
    assert keyed.pointer(spark, path)["version"] == 0 and sorted((r.k, r.v) for r in keyed.read(spark, path).collect()) == [(i, i) for i in range(50)]
    with pytest.raises(ValueError, match="new rows have"):
        keyed.upsert(spark.range(1).select(F.col("id").alias("k")), path, ["v"])
    none = spark.createDataFrame([], "k long, v long, seq long")
    assert keyed.upsert(none, path, ["v"]) == {"version": 0, "buckets": []}
    with pytest.raises(Exception):
        keyed._point(spark, path, {"version": 0})  # another write was first
