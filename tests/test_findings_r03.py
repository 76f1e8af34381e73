"""What the findings of round 3 showed, each in small."""

import statistics
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import automaton, boosting, embedding, evaluation, ml, order, retrieval
from fathom.operators.order import medians_by_fold
from fathom.plans import model_queries
from fathom.streaming.run_state import RunState


@pytest.mark.parametrize(("raw", "kind", "wanted"), [("noñó yes", "yesno", "YES"), ("noñ", "yesno", "NO"), ("ñyes, no", "yesno", "YES"), ("nob_no", "yesno", ""), ("ñB.", "mcq", "B"), ("bB", "mcq", "")])
def test_words_end_at_ascii_edges(spark, raw, kind, wanted):
    choices = F.create_map(F.lit("A"), F.lit("alpha"), F.lit("B"), F.lit("beta"))
    row = spark.createDataFrame([(raw, kind)], "raw string, kind string").select(T.normalize_answer(F.col("raw"), F.col("kind"), choices).alias("a"), T.screen_identifiers(F.lit("ñ123-45-6789ñ")).alias("i"), T.heuristic_route(F.lit("ñtriageñ"), F.lit(False)).alias("r")).first()
    assert row.a == wanted and row.i == ["ssn"] and row.r == "needs_patient_context"


def test_common_words_are_weighed_a_few_pairs_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    asked = pa.table({"asked_qid": np.repeat(np.arange(300), 6), "asked_n": rng.integers(0, 8, 1800), "qf": rng.integers(1, 3, 1800)})
    postings = pa.table({"id": np.repeat(np.arange(40), 8), "n": np.tile(np.arange(8), 40), "w": rng.random(320).round(3)})
    score = np.zeros((300, 40))
    weights = postings["w"].to_numpy().reshape(40, 8)
    for q, n, qf in zip(*(asked[c].to_pylist() for c in asked.column_names)):
        score[q] += qf * weights[:, n]
    most, real = [], np.bincount
    monkeypatch.setattr(retrieval, "PAIRS", 1000)
    monkeypatch.setattr(np, "bincount", lambda x, *a: most.append(len(x)) or real(x, *a))
    got = {(r["qid"], r["id"]): r["score"] for r in retrieval._best_postings(asked, postings, 40).to_pylist()}
    assert max(most) <= 1000 + 1800 and len(got) == 300 * 40
    assert all(got[q, d] == pytest.approx(score[q, d], abs=2e-6) for q, d in got)


def test_occurrences_are_made_for_a_few_texts_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(["one two"] * 1000), pa.array([[]] * 1000, automaton._ARROW)], ["plain", "found"])
    out = list(automaton._matcher("plain", [("two", "x")], True)(iter([batch])))
    assert [b.num_rows for b in out] == [256, 256, 256, 232] and all(len(x) == 1 for b in out for x in b.column("found").to_pylist())


def test_trees_of_all_folds_grow_in_the_same_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.random() < 0.3 + 0.4 * (a > 0)), float(a), None if i % 7 == 0 else float(b), i % 3) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    dealt = spark.createDataFrame(rows, "id long, y int, a double, b double, fold int")
    medians, passes, real = medians_by_fold(dealt, ["a", "b"], "fold", 3), [], boosting._histograms
    monkeypatch.setattr(boosting, "_histograms", lambda *a: passes.append(1) or real(*a))
    together = ml.fit_boosted_folds(dealt, [0, 1, 2], medians, ["a", "b"], "y", "id", 12)
    assert len(passes) <= 24
    for k, model in enumerate(together):
        alone = ml.fit_boosted(dealt.where(F.col("fold") != k), ["a", "b"], "y", "id", 12, medians=medians[k])
        assert [t.feature for t in model.trees] == [t.feature for t in alone.trees] and [t.cut for t in model.trees] == [t.cut for t in alone.trees]
        assert all(one.value == pytest.approx(two.value) for one, two in zip(model.trees, alone.trees))


def test_the_encoder_adds_words_of_many_texts_side_by_side(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["an", "heart", "ñu", "x", "rate2", "of", "b_cd"], n)) for n in (0, 1, 5, 40, 7, 90)] + ["", "!?"]
    signs = lambda f: np.unpackbits(np.frombuffer(xxhash.xxh64_digest(f, 0), np.uint8)).astype(np.float32) * 2 - 1
    wanted = np.zeros((len(texts), 64), np.float32)
    for row, text in zip(wanted, texts):
        for w, n in Counter(embedding.WORD.findall(text)).items():
            row += (1 + np.log(n)) * (signs(w) + 0.5 * sum(signs(f"\0{w}\0"[i : i + 3]) for i in range(len(w))))
    calls, real = [], xxhash.xxh64_digest
    monkeypatch.setattr(xxhash, "xxh64_digest", lambda *a: calls.append(a) or real(*a))
    encode = embedding.hashed(64)()
    assert (encode(texts) == wanted).all() and len(calls) == len(set(calls))  # each word and trigram is hashed once
    monkeypatch.setattr(embedding, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(embedding, "CACHED_WORDS", 2)
    assert (embedding.hashed(64)()(texts) == wanted).all()


def test_served_folds_share_one_pass_for_their_medians(spark, sf, monkeypatch):
    passes = []
    monkeypatch.setattr(ml, "medians_by_fold", lambda *a: pytest.fail("a fold's own pass"))
    monkeypatch.setattr(model_queries, "medians_by_fold", lambda *a: passes.append(a) or medians_by_fold(*a))
    monkeypatch.setattr(model_queries, "logistic", lambda train, medians=None: ml.Prepared(train, model_queries.FEATURES, "admitted", medians) and (lambda rows: rows.withColumn("p", F.lit(0.5))))
    assert model_queries.predict_serve(spark, sf).count() == 1500 and len(passes) == 1


def test_medians_rank_the_middle_alone(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = [(k, float(a), None if k == 1 else float(b), -1.5 if i % 3 else float(c)) for i, (k, (a, b, c)) in enumerate(zip(np.repeat([0, 0, 1, 2], 2000).tolist(), rng.normal(size=(8000, 3)) * [1, 9, 1e9]))]
    data += [(0, float("inf"), float("nan"), None), (2, float("-inf"), float("nan"), 0.0), (None, 5.0, 5.0, 5.0)]
    rows = spark.createDataFrame(data, "fold int, a double, b double, c double").repartition(5)
    written, real = [], order.materialise
    monkeypatch.setattr(order, "materialise", lambda df, name: (lambda out: written.append(out.count()) or out)(real(df, name)))
    got = order.medians_by_fold(rows, ["a", "b", "c"], "fold", 3)
    assert sum(written) < len(data) / 8  # all values of all features were, twice over
    high = lambda v: float("inf") if v != v else v
    for k in range(3):
        assert got[k] == {c: statistics.median(high(r[i]) for r in data if r[i] is not None and r[0] not in (None, k)) for i, c in enumerate("abc", 1)}


def test_calibrated_folds_share_their_medians_and_their_inner_folds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, i // 2, int(rng.random() < 0.3 + 0.4 * (a > 0)), float(a), None if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(rng.normal(size=(360, 2)))]
    own = spark.createDataFrame(rows, "id long, subject long, y int, a double, b double")
    dealt = own.join(ml.grouped_folds(own, "subject", 3), "subject").cache()
    calls, wide, many, real = [], [], ml.medians_of_sets, ml.materialise
    monkeypatch.setattr(ml, "medians_of_sets", lambda *a: calls.append(a) or many(*a))
    monkeypatch.setattr(ml, "materialise", lambda df, name: wide.append("a" in df.columns) or real(df, name))
    together = ml.fit_calibrated_folds(dealt, [0, 1, 2], ["a", "b"], "y", "subject")
    assert len(calls) == 1 and sum(wide) == 1
    for k, model in enumerate(together):
        alone = ml.fit_calibrated(dealt.where(F.col("fold") != k).drop("fold"), ["a", "b"], "y", "subject")
        assert len(model.parts) == len(alone.parts) == 3
        for (one, *line), (two, *other) in zip(model.parts, alone.parts):
            assert one.medians == two.medians and one.weights == pytest.approx(two.weights, rel=1e-6) and line == pytest.approx(other, rel=1e-4)


def test_measures_of_a_model_rank_its_scores_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    score = rng.random(5000)
    rows = spark.createDataFrame([(float(s), int(rng.random() < s)) for s in score], "p double, y int")
    calls, real = [], evaluation._by_score
    monkeypatch.setattr(evaluation, "_by_score", lambda r: calls.append(r) or real(r))
    got = ml.metrics(rows, "y", "m", 200).first()
    assert len(calls) == 1 and got.low < got.auc < got.high
    named = rows.withColumnsRenamed({"p": "score", "y": "label"})
    assert got.auc == pytest.approx(evaluation.roc_auc(named).first().auc) and got.average_precision == pytest.approx(evaluation.average_precision(named).first().average_precision)
    found = evaluation.steps(named).cache()
    monkeypatch.setattr(evaluation, "_by_score", real)
    one = evaluation.interval_of_steps(found, 200)
    monkeypatch.setattr(evaluation, "TASKS", 1)
    assert evaluation.interval_of_steps(found, 200).first() == one.first()  # however blocks are dealt over tasks


def test_a_block_of_scores_is_resampled_side_by_side(monkeypatch):
    rng = np.random.default_rng(3)
    n, seen, real = rng.integers(1, 4, 60), [], evaluation.draw
    pos = rng.binomial(n, 0.4)
    monkeypatch.setattr(evaluation, "draw", lambda *a: (lambda d: seen.append(d) or d)(real(*a)))
    monkeypatch.setattr(evaluation, "DRAWN", 1000)
    got = evaluation.resample(np.random.default_rng(1), n, pos, 50)
    drawn = np.concatenate(seen, 1)  # by cell: a score's negatives, then its positives, where there are any
    cells = [(i, label) for i in range(60) for label, c in enumerate((n[i] - pos[i], pos[i])) if c]
    for r in range(50):
        of = {0: [], 1: []}
        for (i, label), times in zip(cells, drawn[:, r].tolist(), strict=True):
            of[label] += [i] * times
        a, b = np.array(of[1])[:, None], np.array(of[0])
        assert tuple(got[:, r]) == (len(of[1]), len(of[0]), (a > b).sum() + (a == b).sum() / 2)
    single = real(np.random.default_rng(7), np.ones(500, int), 400)
    shares = np.bincount(single.ravel(), minlength=6)[:6] / single.size
    assert shares == pytest.approx(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120]), abs=0.004) and single.max() < 12


class Held:
    """A state variable, or the timers, in memory; each call is counted."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*a):
            self.calls.append(name)
            if name in ("update", "clear"):
                self.value = a[0] if a else None
            elif name == "exists":
                return self.value is not None
            elif name == "appendList":
                self.value = (self.value or []) + a[0]
            elif name in ("updateValue", "registerTimer"):
                self.value = (self.value or {}) | {a[0]: a[-1]}
            elif name == "deleteTimer":
                del self.value[a[0]]
            elif name == "iterator":
                return iter((self.value or {}).items())
            else:
                return iter(list(self.value or [])) if name == "listTimers" else self.value

        return call


def test_runs_within_a_batch_need_no_state():
    calls, state = [], RunState(1000)
    state.trace, state.fields, state.times, state.handle = (Held(calls) for _ in range(4))

    def feed(first, n, every):
        rows = [(i * 10, i, f"n{i}", {"k": str(i), f"own{i}": None} if i % 2 else None, i % every == every - 1) for i in range(first, first + n)]
        frame = pd.DataFrame(rows[::-1], columns=["millis", "event_id", "node", "fields", "ends"])
        at = len(calls)
        parts = [frame.iloc[: n // 2], frame.iloc[n // 2 :]] if n > 1 else [frame]
        out = [r for x in state.handleInputRows((7,), iter(parts), None) for r in x.itertuples(index=False)]
        return out, len(calls) - at

    out, made = feed(0, 103, 5)
    assert [tuple(r) for r in out] == [(7, a * 10, 5, ">".join(f"n{i}" for i in range(a, a + 5)), {"k": str(max(i for i in range(a, a + 5) if i % 2))} | {f"own{i}": None for i in range(a, a + 5) if i % 2}, "done") for a in range(0, 100, 5)]
    assert made <= 6  # a call an event and seven a run were
    out, _ = feed(103, 2, 5)
    assert [tuple(r) for r in out] == [(7, 1000, 5, "n100>n101>n102>n103>n104", {"k": "103", "own101": None, "own103": None}, "done")]
    assert not any(x.value for x in (state.trace, state.fields, state.times, state.handle))
    feed(105, 1, 5)
    assert list(state.handle.value) == [2050]
    out, _ = feed(300, 1, 9)
    assert [tuple(r) for r in out] == [(7, 1050, 1, "n105", {"k": "105", "own105": None}, "pending")] and list(state.handle.value) == [4000]
    out = [r for x in state.handleExpiredTimer((7,), None, None) for r in x.itertuples(index=False)]
    assert [tuple(r) for r in out] == [(7, 3000, 1, "n300", {}, "pending")] and not any(x.value for x in (state.trace, state.fields, state.times))
