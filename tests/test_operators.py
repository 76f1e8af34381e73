"""Invariants and decision tables on small fixtures."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.functions import numbers as N
from fathom.functions import text as T
from fathom.operators import agent, cohort, corpus, evaluation, graph, ml, order, retrieval
from fathom.plans import QUERIES
from fathom.sources import sse, tables


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("piperacillin/tazobactam", ["piperacillin/tazobactam"]), ("a beta-blocker is not x", ["beta-blocker", "not"]), (None, []), ("", [])],
)
def test_tokenize(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.tokenize(F.col("t"))).first()[0] == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("SSN 123-45-6789", ["ssn"]), ("MRN: A12345", ["mrn"]), ("call 555-123-4567", ["phone"]), ("write a.b@example.org", ["email"]), ("DOB: 01/02/1990", ["dob"]),
        ("metformin 500 mg twice daily", []), ("65-year-old with chest pain", []), ("BP 120/80 on 2024-01-01", []), (None, []),
    ],
)
def test_identifiers(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(T.screen_identifiers(F.col("t"))).first()[0] == wanted


def test_sentences_keep_lower_case_after_a_stop(spark):
    assert one(spark, T.split_sentences(F.col("t")), t="Give 500 mg. of the drug. Then wait.") == ["Give 500 mg. of the drug.", "Then wait."]


@pytest.mark.parametrize(("score", "attempt", "wanted"), [(0.9, 1, "final"), (0.75, 1, "final"), (0.3, 1, "reformulate"), (0.3, 3, "escalate"), (None, 99, "escalate")])
def test_decision(spark, score, attempt, wanted):
    df = spark.createDataFrame([(score, attempt)], "s double, a int")
    assert df.select(agent.decision(F.col("s"), F.col("a"))).first()[0] == wanted


@pytest.mark.parametrize(("v", "wanted"), [("7/10", 7.0), ("Denies", 0.0), ("unable", None), (None, None), ("99", 10.0)])
def test_pain(spark, v, wanted):
    assert spark.createDataFrame([(v,)], "v string").select(N.coerce_pain(F.col("v"))).first()[0] == wanted


def test_wilson_without_cases(spark):
    low, high = N.wilson(F.col("h"), F.col("n"))
    assert tuple(spark.createDataFrame([(0, 0)], "h int, n int").select(low, high).first()) == (0.0, 0.0)


LONG = "Give oxygen to keep the saturation above ninety percent. Reassess the patient every ten minutes. " * 120


def chunks(spark, *texts, **sizes):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("") for c in ("title", "source", "url")})
    parents, children = corpus.chunk_documents(docs, **sizes)
    return parents.collect(), children.collect()


def test_chunks_are_bounded_linked_and_stable(spark):
    parents, children = chunks(spark, LONG, "other. " + LONG)
    assert children and all(0 < c.token_count <= 512 for c in children)
    assert {c.parent_id for c in children} <= {p.parent_id for p in parents}
    assert len({c.chunk_id for c in children}) == len(children)
    assert {c.chunk_id for c in chunks(spark, LONG, "other. " + LONG)[1]} == {c.chunk_id for c in children}


def test_blank_documents_have_no_chunks(spark):
    assert chunks(spark, "", " \n\n ", None) == ([], [])


def test_wall_of_text_is_cut_by_words(spark):
    _, children = chunks(spark, "word " * 5000)
    assert all(c.token_count <= 512 for c in children) and sum(len(c.text.split()) for c in children) == 5000


def packed(units, limit, overlap):
    """The packing rule as a loop."""
    size = lambda u: math.floor(len(u.split()) * 1.35)
    out, cur = [], []
    for u in units:
        if size(u) > limit:
            if cur:
                out.append(cur)
            words, n = u.split(), int(limit / 1.35)
            out += [[" ".join(words[i : i + n])] for i in range(0, len(words), n)]
            cur = []
        elif cur and sum(map(size, cur)) + size(u) > limit:
            out.append(cur)
            tail = []
            for v in reversed(cur):
                if sum(map(size, tail)) + size(v) > overlap:
                    break
                tail.insert(0, v)
            cur = [*tail, u]
        else:
            cur = [*cur, u]
    return out + [cur] if cur else out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=25), st.integers(8, 40), st.integers(0, 12))
def test_pack_is_the_rule(spark, sizes, limit, overlap):
    units = [" ".join(["w"] * n) for n in sizes]
    df = spark.createDataFrame([(units,)], "u array<string>")
    assert df.select(corpus.pack(F.col("u"), limit, overlap)).first()[0] == packed(units, limit, overlap)


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 120))
def test_quotas_share_equally(spark, available, limit):
    got = {r.source: r.quota for r in corpus.quotas(spark.createDataFrame(list(available.items()), "source string, n long"), limit).collect()}
    assert sum(got.values()) == min(limit, sum(available.values()))
    assert all(0 <= got[s] <= n for s, n in available.items())
    short = [got[s] for s, n in available.items() if got[s] < n]
    assert not short or max(got.values()) - min(short) <= 1


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid long, id string, rank int")


def test_fusion_prefers_agreement(spark):
    fused = retrieval.reciprocal_rank_fusion({"dense": hits(spark, [(1, "a", 0), (1, "b", 1)]), "bm25": hits(spark, [(1, "b", 0), (1, "c", 1)])}, {"dense": 1.0, "bm25": 1.0}).orderBy("rank").collect()
    assert fused[0].id == "b" and set(fused[0].components) == {"dense", "bm25"}


def test_fusion_needs_weights(spark):
    with pytest.raises(ValueError):
        retrieval.reciprocal_rank_fusion({"dense": hits(spark, [])}, {})


def test_deduplicate_keeps_first_and_rank(spark):
    rows = spark.createDataFrame([(1, "c1", "p1", 0), (1, "c2", "p1", 1), (1, "c3", "p2", 2), (1, "c4", "", 3), (1, "c5", None, 4)], "qid long, id string, parent string, rank int")
    assert [(r.id, r.rank) for r in retrieval.deduplicate(rows).orderBy("rank").collect()] == [("c1", 0), ("c3", 2), ("c4", 3), ("c5", 4)]


def test_mmr_leaves_near_copies(spark):
    rows = spark.createDataFrame([(1, "a", 0, ["x", "y", "z"]), (1, "b", 1, ["x", "y", "z", "w"]), (1, "c", 2, ["q"])], "qid long, id string, rank int, item array<string>")
    assert [r.id for r in retrieval.mmr(rows, k=2, trade=0.5).orderBy("rank").collect()] == ["a", "c"]
    assert [r.id for r in retrieval.mmr(rows, k=5).orderBy("rank").collect()] == ["a", "b", "c"]


def test_faithfulness_bounds(spark):
    f = evaluation.lexical_faithfulness(F.col("a"), F.array("c"))
    assert one(spark, f, a="Aspirin reduces heart attack risk strongly.", c="aspirin reduces heart attack risk strongly") == 1.0
    assert one(spark, f, a="Unicorns cure baldness every single time.", c="aspirin reduces risk") == 0.0
    assert one(spark, f, a="", c="aspirin") == 0.0


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "score double, label long")
    assert evaluation.roc_auc(rows).first().auc == pytest.approx(0.875)


def test_traversal_is_a_prefix_of_breadth_first(spark):
    edges = spark.createDataFrame([("s", "treats", f"n{i:02}", 50 - i, "k") for i in range(40)] + [("n00", "treats", "far", 1, "k")], "src string, rel string, dst string, weight long, chunk_id string")
    paths = graph.traverse(spark.createDataFrame([(1, "s", 1)], "qid long, key string, place int"), edges).orderBy("ordinal").collect()
    assert [p.nodes[-1] for p in paths] == [f"n{i:02}" for i in range(25)]


def test_groups_stay_in_one_fold(spark):
    rows = spark.createDataFrame([(g, i) for g in range(17) for i in range(g % 5 + 1)], "subject long, id long")
    folds = ml.grouped_folds(rows, "subject").collect()
    assert len({r.subject for r in folds}) == len(folds) == 17 and {r.fold for r in folds} == set(range(5))


def test_identifier_columns_raise(spark):
    with pytest.raises(ValueError):
        cohort.assert_no_identifiers(spark.range(1).withColumnRenamed("id", "patient_name"))


def test_no_leaky_or_race_features(spark):
    stays = spark.createDataFrame([(1, "F", "x", 3.0)], "stay_id long, gender string, race string, los_hours double")
    names = cohort.build_features(stays, ["stay_id"], support=1).columns
    assert "gender_F" in names and not {"los_hours"} & set(names) and not [c for c in names if "race" in c]


def test_upsert_updates_only_what_is_asked(spark):
    old = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t2")], "k long, title string, text string")
    new = spark.createDataFrame([(1, "A", "n1", 1), (1, "AA", "n2", 2), (3, "c", "t3", 1)], "k long, title string, text string, seq long")
    assert sorted(map(tuple, cohort.upsert(old, new, "k", ["text"]).collect())) == [(1, "a", "n2"), (2, "b", "t2"), (3, "c", "t3")]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"minConceptGroup": {"minConcept": [{"name": "Aspirin", "rxcui": "1"}, {"name": "aspirin", "rxcui": "2"}, {"name": "", "rxcui": "3"}]}}')
    assert [tuple(r) for r in tables.read_concepts(spark, str(tmp_path / "c.json")).collect()] == [("aspirin", "2")]
    log = str(tmp_path / "log")
    tables.append_log(spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string"), log)
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    assert [r.n for r in tables.read_log(spark, log, "n long, s string", "n", 5).collect()] == [2, 1]
    tables.write_manifest(spark, {"n": 1}, str(tmp_path / "m"))
    assert tables.read_manifest(spark, str(tmp_path / "m")) == {"n": 1} and tables.read_manifest(spark, str(tmp_path / "none")) is None
    shards = spark.range(10).withColumn("shard", F.col("id") % 3)
    tables.write_missing_shards(shards.where("shard < 2"), "shard", str(tmp_path / "s"))
    tables.write_missing_shards(shards, "shard", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert tables.read_csv(spark, str(tmp_path / "t.csv"), "a int, b string").first().a == 1
    tables.save_index({"v": spark.range(3)}, str(tmp_path / "i"))
    assert tables.load_index(spark, ["v"], str(tmp_path / "i"))["v"].count() == 3


def test_frames_with_broken_data_are_skipped(spark):
    stream = sse.frames(spark.createDataFrame([("start", '{"a": 1}'), ("bad", "{x")], "event string, data string"))
    assert [(r.event, r.data.a) for r in sse.parse(stream, "a int").collect()] == [("start", 1)]


def exact_hits(spark, sf, k):
    """(qid, ids) of each twentieth vector against all, by brute force."""
    rows = sorted((r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    return {int(i): [int(j) for j in ids[np.lexsort((ids, -np.round(x @ v, 6)))[:k]]] for i, v in rows if i % 20 == 0}


def test_vector_searches_ask_each_twentieth_row(spark, sf):
    wanted = exact_hits(spark, sf, 10)
    got = {}
    for r in QUERIES["ann_topk"](spark, sf).collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got.keys() == wanted.keys() and all(len(ids) == len(set(ids)) == 10 for ids in got.values())
    assert sum(len({*got[q]} & {*wanted[q]}) for q in wanted) >= 0.9 * 10 * len(wanted)
    assert {r.qid for r in QUERIES["mmr_vectors"](spark, sf).select("qid").distinct().collect()} == wanted.keys()


def test_far_vectors_are_still_found(spark, tmp_path):
    rows = [(i, [1.0, 0.0] if i == 0 else [-1.0, 0.0]) for i in range(13)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["ann_topk"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in got] == [(0, 0, 1.0), *((0, i, -1.0) for i in range(1, 10))]


@pytest.mark.parametrize("block", [4096, 7])
def test_dense_by_blocks_is_exact(spark, sf, block):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).where("id < 60")
    wanted = retrieval.top(vectors.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q")).crossJoin(vectors).select("qid", "id", F.round(retrieval.dot(F.col("q"), F.col("vector")), 6).alias("score")), 5)
    got = retrieval.dense(vectors, vectors.where("id % 20 = 0").withColumnRenamed("id", "qid"), 5, block)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_saved_index_is_searched_as_it_is(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text").limit(5)
    tables.save_index({"terms": retrieval.term_index(docs)}, str(tmp_path))
    found = retrieval.search_index(tables.load_index(spark, ["terms"], str(tmp_path))["terms"], asked, 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.bm25(docs, asked, 7).collect())) and found.count()
    assert retrieval.bm25(docs.where("false"), asked).count() == 0


def test_fused_hits_keep_their_retrievers_scores(spark):
    scored = lambda rows: spark.createDataFrame(rows, "qid long, id string, score double, rank int")
    fused = retrieval.reciprocal_rank_fusion({"dense": scored([(1, "a", 0.91236, 0), (1, "b", 0.5, 1)]), "bm25": scored([(1, "b", 7.25, 0)])}, {"dense": 1.0, "bm25": 0.8}).collect()
    assert {r.id: r.components for r in fused} == {"a": {"dense": 0.9124}, "b": {"dense": 0.5, "bm25": 7.25}}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=40), st.integers(1, 6))
def test_dealing_is_greedy(sizes, folds):
    load, wanted = [0] * folds, []
    for size in sorted(sizes, reverse=True):
        k = load.index(min(load))
        load[k] += size
        wanted.append((size, k))
    got = []
    for size, (first, turn) in sorted(ml.deal([(s, sizes.count(s)) for s in set(sizes)], folds).items(), reverse=True):
        n = sizes.count(size)
        got += [(size, first[i] if i < len(first) else turn[(i - len(first)) % len(turn)]) for i in range(n)]
    assert got == wanted


def test_folds_are_no_more_than_groups(spark):
    rows = spark.createDataFrame([(g, i) for g in range(3) for i in range(4)], "subject long, id long")
    assert sorted(r.fold for r in ml.grouped_folds(rows, "subject").collect()) == [0, 1, 2]


@pytest.fixture(scope="module")
def patients(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(240):
        a, b = rng.normal(size=2)
        rows.append((i, i // 3, int(rng.random() < 1 / (1 + math.exp(-(1.5 * a - 0.5)))), float(a), None if i % 11 == 0 else float(b)))
    return spark.createDataFrame(rows, "id long, subject long, y int, a double, b double")


def test_logistic_regression_is_the_penalised_balanced_fit(patients):
    """Against Newton's method on the same objective: median imputation, standardised features, balanced classes, C = 0.3."""
    rows = patients.collect()
    middle = np.median([r.b for r in rows if r.b is not None])
    x = np.array([[r.a, middle if r.b is None else r.b] for r in rows])
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    y = np.array([r.y for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    design, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(3)
    penalty = np.diag([1 / 0.3, 1 / 0.3, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + penalty, design.T @ (weight * (p - y)) + penalty @ w)
    p = 1 / (1 + np.exp(-design @ w))
    got = {r.id: r.p for r in ml.fit_logistic(patients, ["a", "b"], "y")(patients).collect()}
    assert all(got[r.id] == pytest.approx(q, abs=2e-3) for r, q in zip(rows, p))


def test_models_by_folds_are_measured_and_selected(spark, patients):
    fit = lambda train: ml.fit_logistic(train, ["a", "b"], "y")
    folds = ml.grouped_folds(patients, "subject")
    out = ml.out_of_fold(patients, folds, "subject", fit)
    assert sorted(r.id for r in out.select("id").collect()) == list(range(240))
    row = ml.metrics(out, "y", "logistic").first()
    p, y = (np.array(x) for x in zip(*[(r.p, r.y) for r in out.select("p", "y").collect()]))
    pairs = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
    assert row.auc == pytest.approx(pairs.mean()) and row.brier == pytest.approx(((p - y) ** 2).mean()) and row.n == 240
    assert row.low < row.auc < row.high and row.slope > 0 and row.observed == pytest.approx(y.mean())
    results = spark.createDataFrame([("b", 0.2), ("a", 0.2), ("c", 0.3)], "model string, brier double")
    assert ml.select_model(results).first().model == "a"
    best = ml.top_features(fit(patients), ["a", "b"])
    assert best[0][0] == "a" and best[0][1] > best[1][1] > 0
    info = ml.model_info(results, best).first()
    assert info.model == "a" and info.top_features[0].feature == "a"


def test_calibration_slope_is_that_of_the_fit(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(4000):
        m = rng.normal() * 2
        rows.append((float(1 / (1 + math.exp(-m))), int(rng.random() < 1 / (1 + math.exp(-m / 2)))))
    assert ml.calibration_slope(spark.createDataFrame(rows, "score double, label long")) == pytest.approx(0.5, abs=0.08)
    assert ml.calibration_slope(spark.createDataFrame([(0.5, 1)], "score double, label long")) is None


def test_bootstrap_interval_is_that_of_resampling(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.4).astype(int)
    s = np.round(rng.normal(size=300) + y, 2)
    areas = []
    for _ in range(1500):
        at = rng.integers(0, 300, 300)
        a, b = s[at][y[at] == 1], s[at][y[at] == 0]
        areas.append(((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2))
    got = evaluation.auc_bootstrap(spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "score double, label long")).first()
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(areas, [2.5, 97.5])), abs=0.012)


def test_places_and_sums_by_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[int(rng.random() < 0.3)], int(x), i) for i, x in enumerate(rng.permutation(200))]
    df = spark.createDataFrame(rows, "g string, x long, i long").repartition(5)
    assert {r.x: r.position for r in order.positions(df, ["x"]).collect()} == {x: x for x in range(200)}
    assert {r.x: r.below for r in order.running_sums(df, ["x"], {"below": F.col("x")}).collect()} == {x: x * (x - 1) // 2 for x in range(200)}
    got = {r.g: (r.n, r.m, r.q) for r in order.quantiles(df, "g", "x", {"m": 0.5, "q": 0.95}).collect()}
    for g in "ab":
        values = [x for k, x, _ in rows if k == g]
        assert got[g] == (len(values), pytest.approx(np.median(values)), pytest.approx(np.percentile(values, 95)))


def test_every_stay_is_served(spark, sf):
    wanted = sorted(r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect())
    assert sorted(r.id for r in QUERIES["predict_serve"](spark, sf).select("id").collect()) == wanted
