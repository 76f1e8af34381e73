"""Near-duplicates, top-k search, the grid join, components and the pipeline against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import grid_order_join, minhash_forest, quality_fm, source_mix, topk_search
from fathom.llm import components as parts
from fathom.llm.common import WORD
from fathom.llm.components import components, joined
from fathom.llm.queries import QUERIES


def least_labels(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked_docs(rows, k, percent=80):
    sets = {r.doc_id: shingles(r.text, k) for r in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    links = set()
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.add((j, i))
    return sets, least_labels(sets, links)


def copies(n_groups=12, size=14, seed=5):
    """Groups of edited copies: some within reach of their neighbours only, some of all."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    shared = [rng.choice(words) for _ in range(60)]
    out = []
    for g in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))] + (shared if g % 2 else [])
        current = base
        for i in range(size):
            current = list(current if g % 3 else base)
            for _ in range(rng.randint(0, 3 + g % 4)):
                current[rng.randrange(len(current))] = rng.choice(words)
            out.append(" ".join(current))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("region", "group_shingles"), [(512, 2_000_000), (4, 900)])
def test_forest_finds_all_links(spark, region, group_shingles):
    df = spark.createDataFrame(copies(), "doc_id long, text string")
    sets, label = linked_docs(df.collect(), 4)
    got = {r.doc_id: r for r in minhash_forest.groups(df, 4, region=region, group_shingles=group_shingles).collect()}
    assert {i: r.component_id for i, r in got.items()} == label
    assert all(r.n_shingles == len(sets[i]) and r.kept == (label[i] == i) for i, r in got.items())


def test_forest_misses_no_pair_of_a_large_region(spark):
    """All classes share one tree's first hashes; the pairs meet nowhere else and differ in that tree's next hash."""
    rng = np.random.default_rng(7)
    first = rng.integers(0, 1 << 32, (300, minhash_forest.TREES, minhash_forest.DEPTH), dtype=np.uint32)
    first[:, 0, : minhash_forest.BASE] = 1
    second = first[:20].copy()
    second[:, 1:, 0] += 1
    second[:, 0, minhash_forest.BASE] += 1
    rows = [(i, bytearray(x.astype(">u4").tobytes())) for i, x in enumerate([*first, *second])]
    df = spark.createDataFrame(rows, "cid long, signature binary")
    assert {tuple(r) for r in minhash_forest.candidates(df, region=4).collect()} == {(i, 300 + i) for i in range(20)}


@pytest.mark.parametrize("limit", [3, 8, 50])
def test_blocks_of_a_sorted_order_follow_its_common_prefixes(limit):
    """No block is larger than the limit or, but for the last, smaller than half of it; and no cut in its reach is better."""
    rng = np.random.default_rng(limit)
    hashes = rng.integers(0, 3, (200, 3)).astype(">u4")
    rows = np.array(sorted(hashes.tolist()), ">u4").view(np.uint8).reshape(200, 12)
    at = [0, *minhash_forest.cuts(rows, limit), 200]
    shared = lambda i: next((k for k in range(3) if (rows[i - 1, 4 * k : 4 * k + 4] != rows[i, 4 * k : 4 * k + 4]).any()), 3)
    for a, b in zip(at, at[1:]):
        assert b - a <= limit
        if b < 200:
            reach = range(a + limit // 2 + 1, a + limit + 1)
            assert b in reach and shared(b) == min(map(shared, reach))


def test_prefix_neighbours_are_the_links_of_each_sorted_order(spark):
    """Small regions: exactly the likely pairs that share a tree's first hashes are connected, as by brute force; a block deals
    with neighbours alone."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, (12, minhash_forest.TREES, minhash_forest.DEPTH), dtype=np.uint32)
    sigs = np.repeat(base, 10, axis=0)
    changed = rng.random(sigs.shape) < rng.choice([0.05, 0.2, 0.35, 0.6], (120, 1, 1))
    sigs[changed] = rng.integers(0, 1 << 32, changed.sum(), dtype=np.uint32)
    same = (sigs[:, None].astype(">u4").view(np.uint8).reshape(120, 1, -1, 4)[..., 3] == sigs[None].astype(">u4").view(np.uint8).reshape(1, 120, -1, 4)[..., 3]).sum(-1) >= minhash_forest.LIKELY * minhash_forest.HASHES
    met = (sigs[:, None, :, : minhash_forest.BASE] == sigs[None, :, :, : minhash_forest.BASE]).all(-1).any(-1)
    links = [(i, j) for j in range(120) for i in range(j) if same[i, j] and met[i, j]]
    wanted = least_labels(range(120), links)
    df = spark.createDataFrame([(i, bytearray(x.astype(">u4").tobytes())) for i, x in enumerate(sigs)], "cid long, signature binary")
    for region in (512, 1):
        got = [tuple(r) for r in minhash_forest.candidates(df, region=region).collect()]
        assert least_labels(range(120), got) == wanted and {p for p in got if not same[p]} == set()


def test_forest_recall_in_a_dense_region_at_default_settings(spark):
    """6,000 classes in one region of every tree, beyond a block; 200 pairs that agree in 0.8 of their other hashes on average, and
    which the sorted orders' blocks mostly part: all are found that agree in LIKELY of all positions."""
    rng = np.random.default_rng(11)
    n, pairs = 6000, 200
    sigs = rng.integers(0, 1 << 32, (n, minhash_forest.TREES, minhash_forest.DEPTH), dtype=np.uint32)
    sigs[:, :, : minhash_forest.BASE] = 7
    sigs[:, :, minhash_forest.BASE + 1 :] = rng.integers(0, 1 << 32, (n, minhash_forest.TREES, minhash_forest.DEPTH - minhash_forest.BASE - 1), dtype=np.uint32)
    sigs[n - pairs :] = sigs[:pairs]
    changed = rng.random((pairs, minhash_forest.TREES, minhash_forest.DEPTH)) < 0.2
    changed[:, :, : minhash_forest.BASE] = False
    sigs[n - pairs :][changed] = rng.integers(0, 1 << 32, changed.sum(), dtype=np.uint32)
    sigs[:, 1:, 0] = np.arange(n)[:, None]  # apart in all trees but the first
    sigs[n - pairs :, 1:, 0] = np.arange(pairs)[:, None] + (np.arange(1, minhash_forest.TREES) % 5 == 0) * n
    df = spark.createDataFrame([(i, bytearray(x.astype(">u4").tobytes())) for i, x in enumerate(sigs)], "cid long, signature binary")
    got = {tuple(r) for r in minhash_forest.candidates(df).collect()}
    low = sigs.astype(">u4").view(np.uint8).reshape(n, -1, 4)[..., 3]
    likely = {(i, n - pairs + i) for i in range(pairs) if (low[i] == low[n - pairs + i]).sum() >= minhash_forest.LIKELY * minhash_forest.HASHES}
    assert len(likely) > 150 and likely <= got


def test_forest_on_odd_rows(spark, odd_docs, no_docs):
    got = minhash_forest.groups(odd_docs, 4).collect()
    assert len(got) == odd_docs.count() and minhash_forest.groups(no_docs, 4).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for i in (1, 2, 3) for r in by[i]] == [(0, i, True) for i in (1, 2, 3)]
    assert {(r.component_id, r.kept) for r in by[4]} == {(4, True)} and by[5][0].component_id == 4 and by[10][0].component_id == 4
    assert by[None][0].component_id is None and by[None][0].kept
    kept = minhash_forest.one_of_each(odd_docs, 4)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd_docs.columns and ids[4] == 1 and not ids[5] and ids[1] == ids[None] == 1


def test_parts_of_a_group_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 40, dtype=np.uint64)
        sets = []
        for _ in range(12):
            s = base.copy()
            s[rng.integers(0, 40, rng.integers(0, 9))] = rng.integers(0, 1 << 60, dtype=np.uint64)
            sets.append(np.unique(s))
        label = np.arange(12) // 2 if rng.random() < 0.5 else np.arange(12)
        links = [(i, j) for j in range(12) for i in range(j) if label[i] == label[j] or 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        wanted = least_labels(range(12), links)
        part = minhash_forest.linked_parts(sets, label, 80)
        assert all((part[i] == part[j]) == (wanted[i] == wanted[j]) for i in range(12) for j in range(12))


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    links = chain + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300 + i) for i in range(1, 50)]
    rng.shuffle(links)
    wanted = {n: c for n, c in least_labels({x for p in links for x in p}, links).items()}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in wanted.items() if n in got} and set(got) >= {n for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [-1, 400_000])
def test_components_with_minima_sent_or_shuffled(spark, monkeypatch, limit):
    """Stars, a long path in shuffled order, a cycle, a dense part, repeated links and a node's link with itself alone."""
    monkeypatch.setattr(parts, "joined", lambda large, small, on, how, rows: joined(large, small, on, how, rows, limit))
    rng = random.Random(6)
    path = rng.sample(range(1000, 2000), 90)
    links = [*zip(path, path[1:]), *[(i, (i + 1) % 20) for i in range(20)], *[(i, j) for i in range(30, 38) for j in range(30, i)], *[(90, 50 + i) for i in range(20)], *[(-5, 80)] * 3]
    rng.shuffle(links)
    wanted = least_labels({x for p in links for x in p}, links)
    got = [tuple(r) for r in components(spark.createDataFrame([*links, (7000, 7000)], "a long, b long")).collect()]
    assert len(got) == len(wanted) and dict(got) == wanted


def test_forest_finds_all_links_by_shuffled_joins(spark, monkeypatch):
    """As on tables beyond what is sent to executors."""
    shuffled = lambda large, small, on, how, rows: joined(large, small, on, how, rows, -1)
    monkeypatch.setattr(parts, "joined", shuffled)
    monkeypatch.setattr(minhash_forest, "joined", shuffled)
    df = spark.createDataFrame(copies(8, 10), "doc_id long, text string")
    sets, label = linked_docs(df.collect(), 4)
    got = minhash_forest.groups(df, 4, region=4, group_shingles=600).collect()
    assert len(got) == len(label) and {r.doc_id: r.component_id for r in got} == label


def test_forest_starts_few_tasks(spark):
    """Where small partitions aren't joined, each shuffle costs a task a partition: with 7 they were 1,179 tasks when known labels
    were looked for again and a round of components shuffled six times."""
    df = spark.createDataFrame(copies(), "doc_id long, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    tracker = spark.sparkContext.statusTracker()
    earlier = set(tracker.getJobIdsForGroup())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert minhash_forest.groups(df, 4, group_shingles=900).count() == df.count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    jobs = [tracker.getJobInfo(i) for i in set(tracker.getJobIdsForGroup()) - earlier]
    stages = [tracker.getStageInfo(i) for i in {i for job in jobs if job for i in job.stageIds}]
    assert 100 < sum(stage.numCompletedTasks for stage in stages if stage) < 750


def vectors(seed=1, n=260, width=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    for i in range(0, n, 3):
        x[i] = x[(i * 7) % 30] + rng.normal(size=width) * rng.choice([0.02, 0.2, 0.3])
    x[40:60] = x[3]
    x[61] = 5 * x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * width), (903, [float("nan")] * width), (904, [None] + [1.0] * (width - 1)), (905, [float("inf")] * width), (None, rows[3][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize(("kind", "interval", "broadcast"), [("double", None, 64 << 20), ("double", 8, 0), ("float", 8, 64 << 20)])
def test_grid_join_is_exact(spark, monkeypatch, kind, interval, broadcast):
    monkeypatch.setattr(grid_order_join, "BROADCAST", broadcast)
    rows = [(i, v and [x if x is None else float(np.dtype(kind).type(x)) for x in v]) for i, v in vectors()]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as key", "2 as copies", "'c' as cell")
    good = [(i, np.array(v)) for i, v in rows if i is not None and (i < 900)]
    x = np.array([v for _, v in good])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= 0.95
    ids = [i for i, _ in good]
    label = least_labels(set(ids), [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i < j])
    wanted = Counter((ids[i], int(near[i].sum()) - 1, label[ids[i]], label[ids[i]] == ids[i]) for i in range(len(ids))) + Counter((i, 0, i, True) for i in range(900, 906)) + Counter([(None, 0, None, True)])
    assert Counter(map(tuple, grid_order_join.groups(df, 0.95, interval).collect())) == wanted
    if interval is None:
        assert grid_order_join.groups(df.where("false")).count() == 0


@pytest.mark.parametrize("share", [1, 3, 256])
def test_boxes_meet_once_whatever_their_shares(spark, share):
    rng = np.random.default_rng(9)
    low = rng.uniform(-1, 1, (25, 3))
    high = low + rng.uniform(0, 0.6, (25, 3))
    eps = 0.3
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    wanted = Counter((i, j) for j in range(25) for i in range(j + 1) if (gap[i, j] ** 2).sum() <= eps * eps)
    cut = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(low, high))], "interval long, low array<double>, high array<double>")
    assert Counter(tuple(sorted(r)) for r in grid_order_join.near_pairs(cut, eps, share).collect()) == wanted


def brute_top(rows, asked, k=5):
    """(query_id, rank, vec_id, score), by integers of any length."""
    good = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    wanted = Counter()
    for own, (q, v) in enumerate(good):
        if q is not None and asked(q):
            best = sorted(((-sum(a * b for a, b in zip(v, u)), i is None, i or 0) for at, (i, u) in enumerate(good) if at != own))[:k]
            wanted.update((q, n + 1, None if none else i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, none, i) in enumerate(best))
    return wanted


def test_top_k_is_exact(spark):
    rows = vectors(7)
    rows += [(13, rows[0][1]), (26, [-x for x in rows[26][1]]), (39, rows[39][1]), (39, rows[39][1])]  # ids that several rows have
    df = spark.createDataFrame(rows, "id long, vector array<double>").selectExpr("*", "1 as block", "2 as width", "3 as cell")
    wanted = brute_top(rows, lambda q: q % 13 == 0)
    asked = df.where("id % 13 = 0")
    for sizes in ((512, 4096), (4, 16)):
        assert Counter(map(tuple, topk_search.top_k(df, asked, 5, *sizes).collect())) == wanted
    few = df.where("id < 3")
    assert topk_search.top_k(few, few, 5).count() == 6 and topk_search.top_k(df.where("false"), asked).count() == 0


def test_top_k_of_large_components_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 8)]) for i in range(30)]
    rows += [(100, [70_000.0] * 8), (101, [70_000.0] * 8), (102, [float(1 << 40)] * 8), (103, [float(1 << 40)] * 7 + [float(1 << 40) + 0.5]), (104, [1e300, -1e300, 1e290, 0.003] * 2), (105, [-1e308] * 8), (106, [5e-324] * 8), (None, [70_000.0] * 8)]
    rows += [(200 + i, [2.0**24 / 256 + (j == i) for j in range(8)]) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for sizes in ((512, 4096), (4, 8)):
        assert Counter(map(tuple, topk_search.top_k(df, df, 5, *sizes).collect())) == brute_top(rows, lambda q: True)


def test_one_query_an_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], sf)
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    assert all(d.columns == docs.columns for d in kept[:-1])
    classified, unique, clean, mixed = kept[1:5]
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    assert classified.join(good, "doc_id").count() >= 0.97 * good.count()
    _, label = linked_docs(classified.collect(), 5)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, c in label.items() if i == c)
    assert clean.count() == unique.count()
    from fathom.llm.secret_scan import base_spans

    assert not any(base_spans(r.text) for r in clean.collect())
    assert sorted(r.decoded_sha256 for r in kept[5].collect()) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in mixed.collect())
    assert corpus_pipeline.run(spark, sf).count() == mixed.count()


def test_stages_and_pipeline_on_an_empty_table(spark, no_docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, no_docs, str(tmp_path))
        assert out.count() == 0 and (out.columns == no_docs.columns or i == len(corpus_pipeline.STAGES) - 1)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, odd_docs, sf):
    """Nulls in every column, empty, blank and very long texts, repeated rows and extra columns go through each stage, and each
    does to them what its operator says."""
    stages, labels = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/labels.parquet")
    rows = lambda df: Counter(map(tuple, df.collect()))
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    good = stages["quality classifier"](spark, odd_docs, sf)
    accepted = Counter((r.doc_id, r.n_tokens) for r in quality_fm.score(odd_docs, labels).where("predicted = 1").withColumn("n_tokens", F.lit(0)).collect())
    assert Counter((r.doc_id, 0) for r in good.collect()) == accepted and not rows(good) - rows(odd_docs)

    single = stages["MinHash near-dedup"](spark, odd_docs, sf)
    judged = minhash_forest.groups(odd_docs, 5).collect()
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in judged if r.kept} and not rows(single) - rows(odd_docs)
    assert max(Counter(r.doc_id for r in single.collect()).values()) == 1

    safe = stages["secret scans"](spark, odd_docs, sf)
    found = texts(safe)
    assert sum(found.values()) == odd_docs.count() and found[4, next(t for i, t in found if i == 4)] == 2
    (clean,) = [t for i, t in found if i == 9]
    assert clean == '[SECRET]" [SECRET] [SECRET]' and found[1, None] == found[2, ""] == found[3, " \n\t "] == 1
    assert {r.n_chars for r in safe.where("doc_id = 9").collect()} == {len(clean)}

    mixed = stages["mixing sources to target weights"](spark, odd_docs, sf)
    taken = Counter()
    for r in source_mix.mix(odd_docs).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(re.findall(WORD, r.text or ""))
    assert got == +taken and all(r.n_chars == len(r.text) or r.doc_id == 4 for r in mixed.where("n_chars is not null").collect())

    told = stages["byte-level BPE encoding and decoding"](spark, odd_docs, sf)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.doc_id, r.decoded_sha256) for r in told.collect()) == Counter((r.doc_id, digest(r.text)) for r in odd_docs.collect())
    for name in list(stages)[:-1]:
        assert stages[name](spark, odd_docs.limit(0), sf).columns == odd_docs.columns and stages[name](spark, odd_docs.limit(0), sf).count() == 0


def test_an_operator_leaves_its_result_alone_and_the_settings_as_they_were(spark, odd_docs, tmp_path):
    from pathlib import Path
    from urllib.parse import urlparse

    from fathom.llm.common import BATCH_BYTES
    from fathom.session import own_dir

    folder = Path(urlparse(own_dir(spark)).path)
    before, size = {p.name for p in folder.iterdir()} if folder.exists() else set(), spark.conf.get(BATCH_BYTES)
    out = minhash_forest.groups(odd_docs, 4)
    left = {p.name for p in folder.iterdir()} - before
    assert len(left) == 1 and next(iter(left)).startswith("groups-") and out.count() == odd_docs.count() and spark.conf.get(BATCH_BYTES) == size
