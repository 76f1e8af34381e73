"""What the findings of round 4 showed, each in small."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import boosting, ml, order
from fathom.plans import QUERIES, model_queries
from fathom.plans.registry import read


def test_overlap_is_told_of_every_question(spark, sf):
    asked = {r[0] for r in read(spark, sf, "benchmark").select("item_id").collect()} & {r[0] for r in read(spark, sf, "embeddings").select("vec_id").collect()}
    assert {r.qid for r in QUERIES["overlap_at_10"](spark, sf).collect()} == asked and any(q % 20 for q in asked)


def test_values_at_shares_are_exact_for_all_sets_together(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = [(int(bits), float(a), None if i % 9 == 0 else float(b), float(i % 3), None) for i, (bits, a, b) in enumerate(zip(rng.integers(0, 8, 3000), rng.normal(size=3000), rng.integers(0, 40, 3000)))]
    data += [(7, float("nan"), float("inf"), 1.0, None), (3, float("nan"), float("-inf"), 1.0, None)]
    rows = spark.createDataFrame(data, "bits long, a double, b double, c double, d double").repartition(5)
    fills, shares = [[0.0, 4.5, 0.0, 0.0], [0.0, -7.0, 0.0, 1.0], [0.0, 17.0, 0.0, 0.0]], [i / 16 for i in range(1, 16)]
    monkeypatch.setattr(order, "CELLS", 64)
    for told, nulls in ((order.quantiles_of_sets(rows, ["a", "b", "c", "d"], F.col("bits"), 3, shares, fills), True), (order.quantiles_of_sets(rows, ["a", "b", "c", "d"], F.col("bits"), 3, shares), False)):
        for k, f in np.ndindex(3, 4):
            v = sorted((fills[k][f] if r[f + 1] is None else r[f + 1] for r in data if r[0] >> k & 1 and (nulls or r[f + 1] is not None)), key=lambda x: (x != x, x))
            assert told[k][f] == sorted({x for x in (v[math.ceil(len(v) * s) - 1] for s in shares if v) if x == x})
    assert order.quantiles_of_sets(rows.limit(0), ["a"], F.col("bits"), 1, shares) == [[[]]]


def test_a_tree_of_all_folds_is_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    rows = spark.createDataFrame([(i, int(rng.random() < 1 / (1 + math.exp(-2 * a * (b > 0) + c))), float(a), float(b), float(round(c)), i % 3) for i, (a, b, c) in enumerate(x)], "id long, y int, a double, b double, c double, fold int")
    passes, real, fit = [], boosting._pair_sums, lambda: boosting.fit_together(rows, ["a", "b", "c"], "y", "id", ml.seen_bits([F.col("fold") != k for k in range(3)]), [[0.0] * 3] * 3, 12)
    monkeypatch.setattr(boosting, "_histograms", lambda *a: pytest.fail("a pass of a level"))
    monkeypatch.setattr(boosting, "_pair_sums", lambda *a: passes.append(1) or real(*a))
    by_pairs = fit()
    assert len(passes) == 12 and any(t.feature[1] >= 0 or t.feature[2] >= 0 for t in by_pairs[0])
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "CELLS", 0)
    for one, two in zip(by_pairs, fit(), strict=True):  # as by passes of levels
        assert [(t.feature, t.cut) for t in one] == [(t.feature, t.cut) for t in two]
        assert all(a.value == pytest.approx(b.value) and a.gain == pytest.approx(b.gain, abs=2e-9) for a, b in zip(one, two))


def test_trees_of_one_feature_or_no_rows(spark):
    rows = spark.createDataFrame([(i, int(i % 50 > 20 + i % 7), float(i % 50)) for i in range(400)], "id long, y int, a double")
    trees = boosting.fit(rows, ["a"], "y", "id", 4)
    assert trees[0].feature[0] == 0 and 20 <= trees[0].cut[0] <= 27 and trees[0].value[1] < trees[0].value[2]
    empty = boosting.fit(rows.limit(0), ["a"], "y", "id", 2)
    assert [t.feature for t in empty] == [[-1] * 7] * 2 and [t.value for t in empty] == [[0.0] * 7] * 2


def test_both_kinds_of_folds_are_fitted_at_the_same_time(spark, sf, monkeypatch):
    meet = threading.Barrier(2)

    def of(area):
        def run(rows, fit, name):
            meet.wait(30)
            return rows.limit(1).select(F.lit(area).alias("auc"))

        return run

    monkeypatch.setattr(model_queries, "by_groups", of(0.75))
    monkeypatch.setattr(model_queries, "ungrouped", of(1.0), raising=False)
    assert [tuple(r) for r in model_queries.inflation(spark, sf).collect()] == [(0.75, 1.0, 0.25)]


def test_three_kinds_of_models_share_their_folds(spark, sf, monkeypatch):
    class Model:
        def __init__(self, p):
            self.p = p

        def __call__(self, rows):
            return rows.withColumn("p", F.least(F.lit(0.9), F.col("quantity") / 100 + self.p))

        def importance(self):
            return [1.0, 2.0, 3.0, 4.0, 5.0]

    dealt, asked, real = [], [], ml.medians_by_fold
    for name, p in (("logistic", 0.0), ("calibrated", 0.4), ("boosted", 0.1)):
        monkeypatch.setattr(model_queries, name, lambda train, medians=None, p=p: asked.append(medians) or Model(p))
    monkeypatch.setattr(ml, "medians_by_fold", lambda *a: dealt.append(a) or real(*a))
    got = model_queries.model_info(spark, sf).first()
    assert len(dealt) == 1 and sum(m is not None for m in asked) == 15 and len(asked) == 16
    assert got.model == "calibrated" and got.n == 1500 and got.top_features[0].feature == "acuity"
