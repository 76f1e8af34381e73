"""Graph index, embeddings, extraction, deep traversal and blocks against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import agent, ann_graph, cohort, embedding, extraction, graph, retrieval
from fathom.plans import QUERIES
from fathom.plans.search_queries import vectors_and_queries
from fathom.sources import tables


def recall(found, exact, least):
    """The share of exact hits' places that found fills with vectors no farther than the last exact one."""
    kth = {r.qid: r.score for r in exact.groupBy("qid").agg(F.min("score").alias("score")).collect()}
    n = exact.groupBy("qid").count().agg(F.sum("count")).first()[0]
    good = sum(r.score >= kth[r.qid] - 1e-6 for r in found.collect())
    assert good / n >= least
    return good / n


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_rows(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")


def test_saved_graph_index_is_searched_by_another_session(spark, sf, tmp_path):
    vectors, asked = vectors_and_queries(spark, sf)
    tables.save_index({"graph": ann_graph.build(vectors, part_rows=200)}, str(tmp_path))
    other = spark.newSession()
    index = tables.load_index(other, ["graph"], str(tmp_path))["graph"]
    assert index.count() == vectors.count() and index.select("part").distinct().count() > 1  # every row, several graphs
    asked_there = vectors_and_queries(other, sf)[1]
    recall(ann_graph.search(index, asked_there, 10), retrieval.dense(vectors, asked, 10), 0.9)


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_graph_index_recall(spark, kind):
    """At the default settings: no structure; tight clusters far from each other; a third of all vectors nearly equal."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    if kind == "clusters":
        x = rng.normal(size=(30, 32))[np.arange(3000) % 30] * 5 + rng.normal(size=(3000, 32)) * 0.1
    if kind == "copies":
        x[:1000] = x[0] + rng.normal(size=(1000, 32)) * 1e-3
    vectors = vector_rows(spark, unit(x)).cache()
    asked = vectors.where("id % 50 = 0").withColumnRenamed("id", "qid")
    for part_rows in (700, 16_384):
        found = ann_graph.search(ann_graph.build(vectors, part_rows=part_rows), asked, 10)
        assert {r.n for r in found.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {10}
        recall(found, retrieval.dense(vectors, asked, 10), 0.9)


def test_graph_index_on_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, None), (3, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    index = ann_graph.build(vectors)
    got = ann_graph.search(index, spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "qid long, vector array<double>"), 3)
    assert sorted((r.qid, r.id or -1, r.score, r["rank"]) for r in got.collect()) == [(9, -1, 0.0, 2), (9, 1, 1.0, 0), (9, 1, 1.0, 1)]
    assert ann_graph.search(ann_graph.build(vectors.limit(0)), vectors.withColumnRenamed("id", "qid"), 3).count() == 0


def test_every_node_of_a_graph_can_be_reached():
    rng = np.random.default_rng(1)
    x = unit(np.concatenate([rng.normal(size=(300, 8)), np.ones((400, 8)) + rng.normal(size=(400, 8)) * 1e-4])).astype(np.float32)
    near = ann_graph._layer(x, 4, 8, 16)
    seen, ahead = {0}, [0]
    while ahead:
        for j in near[ahead.pop()].tolist():
            if j not in seen:
                seen.add(j)
                ahead.append(j)
    assert len(seen) == 700


# Extraction


def extracted(spark, texts, extractor):
    chunks = spark.createDataFrame([(f"c{i}", t, i) for i, t in enumerate(texts)], "chunk_id string, text string, seq long")
    return extraction.extract(chunks, extractor)


def scripted():
    """An extractor that answers by text, and fails for texts among which there is `bad`."""
    said = {
        "entities": [{"name": " Asthma ", "type": "condition"}, {"name": "x" * 91, "type": "symptom"}, {"name": "", "type": "symptom"}, "junk", {"name": "Drug", "type": "medication"}],
        "relations": [{"source": "drug", "relation": "treats", "target": "Asthma"}, {"source": "Drug", "relation": "cures", "target": "asthma"}, {"source": "", "relation": "treats", "target": "asthma"}, {"source": "Steam", "relation": "references", "target": "asthma"}, None],
    }

    def begin():
        def f(texts):
            if "bad" in texts:
                raise RuntimeError("no answer")
            return [said if t == "good" else {"entities": None} for t in texts]

        return f

    return begin


def test_extraction_keeps_failures_and_order(spark):
    out = extracted(spark, ["good", "bad", "", None, "good"], scripted()).cache()
    assert [(r.chunk_id, r.error) for r in out.orderBy("seq").collect()] == [("c0", None), ("c1", "no answer"), ("c2", None), ("c3", None), ("c4", None)]
    assert extraction.counts(out).first().asDict() == {"chunks": 5, "failed": 1, "entities": 4, "accepted": 4, "rejected": 4}
    assert graph.extraction_counts(extraction.relations(out)).first().asDict() == {"accepted": 4, "rejected": 4}
    nodes, edges = extraction.build(out)
    assert {(r.key, r.label, r.node_type): r.chunk_ids for r in nodes.collect()} == {
        ("asthma", "Asthma", "condition"): ["c0", "c0", "c0", "c4", "c4", "c4"],
        ("drug", "Drug", "medication"): ["c0", "c0", "c4", "c4"],
        ("steam", "Steam", "condition"): ["c0", "c4"],
    }
    assert {tuple(r) for r in edges.collect()} == {("drug", "treats", "asthma", 2, "c0"), ("steam", "references", "asthma", 2, "c0")}
    assert extraction.counts(extracted(spark, [], scripted())).first()["chunks"] == 0


def linked_names(text, names):
    """Plain restatement of the dictionary's triples."""
    plain = " ".join((text or "").lower().split())
    found = []
    for name in names:
        for m in re.finditer(f"(?={re.escape(name)})", plain):
            a, b = m.start(), m.start() + len(name)
            if not (a and plain[a - 1].isalnum()) and not (b < len(plain) and plain[b].isalnum()):
                found.append((a, b, name))
    taken = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not taken or x[0] >= taken[-1][1]:
            taken.append(x)
    relations = []
    for a, b in zip(taken, taken[1:]):
        between = plain[a[1] : b[0]]
        if not re.search("[.!?] ", between):
            cue = extraction.CUE.search(between)
            relations.append((a[2], extraction.CUES[cue[1]] if cue else "references", b[2]))
    return [x[2] for x in taken], relations


@pytest.mark.parametrize("automaton_names", [200_000, 2])
def test_dictionary_against_brute_force(spark, automaton_names):
    names = ["iron", "iron deficiency", "deficiency anemia", "anemia", "c-reactive protein", "él", "b12"]
    texts = ["Iron deficiency anemia. Iron  treats\nanemia", "iron. anemia", "ironic anemias, B12! b12 interacts with IRON?", "él iron él", None, "", "c-reactive protein is a symptom of anemia of iron", "anemia.iron"] + ["iron anemia " * 50]
    chunks = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "chunk_id long, text string, seq long")
    table = spark.createDataFrame([(n.upper() if n != "él" else n, "condition") for n in names] + [("Iron", "a type"), (" ", "x"), (None, "y")], "name string, type string")
    got = extraction.by_dictionary(chunks, table, automaton_names).collect()
    assert {r.chunk_id: ([e["name"] for e in r.entities], [tuple(x) for x in r.relations]) for r in got} == {i: linked_names(t, names) for i, t in enumerate(texts)}
    assert {e["type"] for r in got for e in r.entities if e["name"] == "iron"} == {"a type"}


def test_graph_of_documents(spark, sf):
    """Documents to nodes and edges, against a plain restatement; what is counted is what the graph's own counts say."""
    from fathom.plans import index_queries

    docs, found = spark.read.parquet(f"{sf}/documents.parquet").collect(), index_queries.extracted(spark, sf)
    names = {" ".join(r.name.lower().split()) for r in index_queries.names_in_benchmark(spark, sf).collect()}
    seen, weights, first = defaultdict(list), Counter(), {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        entities, relations = linked_names(r.text, names)
        for name in entities + [x for a, _, b in relations for x in (a, b)]:
            seen[name].append(r.doc_id)
        for a, rel, b in relations:
            if a != b:
                weights[a, rel, b] += 1
                first.setdefault((a, rel, b), r.doc_id)
    nodes, edges = extraction.build(found)
    assert seen and {r.key: r.chunk_ids for r in nodes.collect()} == {k: v[: graph.PER_NODE * 2] for k, v in seen.items()}
    assert {(r.src, r.rel, r.dst): (r.weight, r.chunk_id) for r in edges.collect()} == {k: (n, first[k]) for k, n in weights.items()}
    counted = extraction.counts(found).first()
    assert graph.extraction_counts(extraction.relations(found)).first().asDict() == {"accepted": counted.accepted, "rejected": counted.rejected}


# Embedding


def test_embedding_is_the_same_everywhere_and_of_length_one(spark):
    texts = ["the fever rose", "The fever rose!", "a fever that rose and rose", None, "", "完全に別の文", "x" * 100_000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id long, text string, source string")
    one, many = (embedding.embed(docs.repartition(n)).orderBy("id").collect() for n in (1, 5))
    assert one == many and one[0].vector == one[1].vector and one[3].vector == [0.0] * embedding.DIM == one[4].vector
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 for i, r in enumerate(one) if i not in (3, 4)) and one[0].source == "s"
    near, far = (sum(a * b for a, b in zip(one[0].vector, one[i].vector)) for i in (2, 5))
    assert near > 0.5 > abs(far)
    assert embedding.embed(docs, dim=100).first().vector != embedding.embed(docs, prefix="query: ", dim=100).first().vector
    with pytest.raises(Exception, match="the encoder made"):
        embedding.embed(docs, lambda: lambda texts: np.zeros((len(texts), 3)), dim=4).collect()


def test_embedding_run_goes_on_where_it_was_killed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} {i % 7}") for i in range(300)] + [(None, "without an id")], "id long, text string").cache()
    path = str(tmp_path / "vectors")

    def failing(limit, run):
        """Marks each text that it encodes, in a folder of its run (tasks of a dying one may go on a while), and dies at one of them."""
        folder = str(tmp_path / run)
        (tmp_path / run).mkdir()

        def encoder():
            encode = embedding.hashed()()

            def f(texts):
                import uuid

                if limit is not None and any(f"number {limit} " in t for t in texts):
                    raise RuntimeError("killed")
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                    out.write(str(len(texts)))
                return encode(texts)

            return f

        return encoder

    written = lambda run: sum(int(p.read_text()) for p in (tmp_path / run).iterdir())
    with pytest.raises(Exception, match="killed"):
        embedding.write_resumed(docs, path, failing(200, "first"), shard_rows=10, waves=4)
    kept = embedding.load(spark, path).count()
    assert 0 < kept < 301
    report = embedding.write_resumed(docs, path, failing(None, "second"), shard_rows=10, waves=4)
    assert report == {"encoded": 301 - kept, "kept": kept} and written("second") == 301 - kept
    whole = {r.id: r.vector for r in embedding.embed(docs).collect()}
    assert {r.id: r.vector for r in embedding.load(spark, path).collect()} == whole and embedding.load(spark, path).count() == 301
    assert embedding.write_resumed(docs, path, failing(None, "third"), shard_rows=10, waves=4) == {"encoded": 0, "kept": 301} and written("third") == 0
    shape = embedding.manifest(spark, path).agg(F.sum("rows"), F.min("dim"), F.max("dim"), F.min("length"), F.max("rows")).first()
    assert tuple(shape)[:3] == (301, embedding.DIM, embedding.DIM) and shape[3] > 0.999 and shape[4] < 40
    with pytest.raises(ValueError, match="was begun with"):
        embedding.write_resumed(docs, path, name="another")
    more = docs.unionByName(spark.createDataFrame([(1000, "a late one")], docs.schema))
    again = embedding.write_resumed(more, path, shard_rows=10, waves=4)
    assert 0 < again["encoded"] < 302 and embedding.load(spark, path).count() == 302


def test_blocks_are_whole_passages_of_the_texts_own_vectors(spark, sf):
    rows = QUERIES["fusion_blocks_text"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first = {}
    for r in sorted(docs.values(), key=lambda r: -r.doc_id):
        if r.source and r.source[-1] in "02468":
            first[r.source] = r.text
    by = defaultdict(list)
    for r in rows:
        own, parent = docs[r.id].text or "", first.get(r.parent_id)
        assert r.matched_text == own and r.text == (parent or own) and r.expanded == bool(parent and parent != own)
        by[r.qid].append(r.position)
    assert rows and all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 12 for x in by.values())
    empty = retrieval.fusion_blocks({"bm25": spark.createDataFrame([], "qid long, id long, score double, rank int")}, *(spark.createDataFrame([], s) for s in ("id long, parent string, text string", "id long, parent_id string, text string", "parent_id string, text string")), {"bm25": 1.0})
    assert empty.count() == 0


# Traversal


def walked(seeds, edges, hops, cap):
    """The plain breadth-first search, seed by seed."""
    out, met = defaultdict(list), defaultdict(set)
    for qid, keys in seeds.items():
        for key in keys:
            level = [([key], [])]
            for hop in range(1, hops + 1):
                following = []
                for nodes, rels in level:
                    for weight, dst, rel in sorted(((w, d, r) for s, r, d, w in edges if s == nodes[-1]), key=lambda x: (-x[0], x[1], x[2])):
                        if dst in nodes or len(met[qid]) >= cap:
                            continue
                        met[qid].add(dst)
                        path = (nodes + [dst], rels + [rel])
                        following.append(path)
                        out[qid].append((*path, weight / (hop + 1)))
                level = following
    return out


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
@pytest.mark.parametrize("cap", [3, 7, 25])
def test_traversal_of_any_depth(spark, hops, cap):
    import random

    rng = random.Random(hops * 100 + cap)
    names = [f"n{i}" for i in range(9)]
    edges = sorted({(rng.choice(names), rng.choice(graph.EDGE_TYPES[:2]), rng.choice(names)) for _ in range(26)})
    edges = [(a, r, b, rng.randint(1, 3)) for a, r, b in edges if a != b]
    seeds = {1: ["n0", "n3"], 2: ["n5"], 3: ["n0", "n3"], 4: ["none"]}
    table = spark.createDataFrame([(q, k, i) for q, keys in seeds.items() for i, k in enumerate(keys)], "qid long, key string, place int")
    got = graph.traverse(table, spark.createDataFrame(edges, "src string, rel string, dst string, weight long"), cap, hops)
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.qid, r.ordinal)):
        found[r.qid].append((r.nodes, r.rels, r.score))
    assert found == {q: x for q, x in walked(seeds, edges, hops, cap).items() if x}


# The answer loop and one-hot columns


def test_a_pass_drafts_once(spark):
    """A draft that is different each time: what is shown is what was judged, and nothing is drafted twice."""
    drafts = spark.sparkContext.accumulator(0)

    def draft(df):
        def f(batches):
            import uuid

            for rows in batches:
                drafts.add(len(rows))
                yield rows.assign(answer=[uuid.uuid4().hex for _ in range(len(rows))])

        return df.mapInPandas(f, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, answer string")

    judge = lambda df: df.withColumn("judged", F.col("answer")).withColumn("groundedness", F.when((F.col("run_id") == 0) | ((F.col("run_id") == 1) & (F.col("attempt") == 2)), 0.9).otherwise(0.1))
    runs = spark.createDataFrame([(i, "q") for i in range(4)], "run_id long, query string")
    done = agent.run_loop(runs, draft, judge)
    first, second = ({r.run_id: (r.answer, r.attempts, r.outcome) for r in done.collect()} for _ in range(2))
    assert first == second and {i: x[1:] for i, x in first.items()} == {0: (1, "final"), 1: (2, "final"), 2: (3, "escalate"), 3: (3, "escalate")}
    assert drafts.value == 1 + 2 + 3 + 3


def test_one_hot_of_many_categories(spark):
    rows = spark.createDataFrame([(i, f"c{i % 7}" if i % 5 else None) for i in range(70)], "id long, c string")
    wide = {tuple(r) for r in cohort.long_one_hot(rows, "id", "c", 8).collect()}
    assert wide == {tuple(r) for r in cohort.long_one_hot(rows, "id", "c", 8, page=2).collect()} and len(wide) == 70 * 8
    assert {(i, c) for i, c, flag in wide if flag} == {tuple(r) for r in cohort.sparse_one_hot(rows, "id", "c", 8).collect()}
