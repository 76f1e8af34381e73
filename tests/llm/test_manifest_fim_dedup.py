"""Merkle manifest, fill-in-the-middle and exact dedup against plain restatements."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.llm import exact_dedup, fill_in_middle, merkle_manifest
from fathom.llm.common import attach

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def leaf_of(r, n_chars):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r.doc_id, r.source, r.lang, n_chars, r.text)))


def proofs_of(leaves):
    """The root, and each leaf's siblings (before, after) level by level, of a plain binary tree."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 2 * 2 : i // 2 * 2 + 2]
            paths[k].append((run[0], "") if i % 2 else ("", "".join(run[1:])))
        level, at = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)], [i // 2 for i in at]
    return level[0], paths


def manifest_of(rows):
    trees = defaultdict(list)
    for r in rows:
        changed = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
        trees[r.lang].append(((r.doc_id is not None, r.doc_id or 0), leaf_of(r, r.n_chars), leaf_of(r, r.n_chars + 1) if changed else leaf_of(r, r.n_chars), r.doc_id))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    inner = {n: (sorted(trees[n]), *proofs_of([x[1] for x in sorted(trees[n])])) for n in names}
    root, upper = proofs_of([inner[n][1] for n in names])
    for name, above in zip(names, upper, strict=True):
        leaves, subroot, paths = inner[name]
        for (_, leaf, tampered, doc_id), path in zip(leaves, paths, strict=True):
            folded = tampered
            for before, after in path + above:
                folded = sha(before + folded + after)
            yield doc_id, leaf, subroot, root, sha("".join(a + b for a, b in path + above)), folded, folded == root


def test_manifest(spark, odd_docs, no_docs):
    got = merkle_manifest.digests(odd_docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(manifest_of(odd_docs.collect()))
    assert merkle_manifest.digests(no_docs).count() == 0
    one = odd_docs.where("doc_id = 2")
    assert [tuple(r) for r in merkle_manifest.digests(one).collect()] == list(manifest_of(one.collect()))


def test_manifest_of_many_runs_and_trees(spark, monkeypatch):
    """Runs of 4 leaves, merged 3 at a time: several rounds, trees within a run, over many runs, and one leaf wide."""
    monkeypatch.setattr(merkle_manifest, "RUN", 4)
    monkeypatch.setattr(merkle_manifest, "FAN", 3)
    rng = random.Random(1)
    langs = [None, "", "en", "é", "日本", *(f"l{i}" for i in range(40))]
    rows = [(i, f"t{i}", rng.choice(langs) if i % 3 else "en", "s", i) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert Counter(map(tuple, merkle_manifest.digests(docs).collect())) == Counter(manifest_of(docs.collect()))
    proof = merkle_manifest.manifest(docs).where("doc_id = 7").first()
    folded = proof.leaf
    for before, after in zip(proof.before, proof.after, strict=True):
        folded = sha(before + folded + after)
    assert folded == proof.root


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.randoms(use_true_random=False))
def test_fragments_merge_in_any_order_and_grouping(n, rng):
    """The monoid: however leaves are dealt to fragments and these are united, one node is left, the plain tree's root."""
    leaves = [sha(str(i)) for i in range(n)]
    fragments = [{} for _ in range(rng.randint(1, 6))]
    for i, h in enumerate(leaves):
        rng.choice(fragments)[0, i] = h
    for f in fragments:
        merkle_manifest.collapse(f, n)
    while len(fragments) > 1:
        a, b = fragments.pop(rng.randrange(len(fragments))), fragments.pop(rng.randrange(len(fragments)))
        both = a | b
        merkle_manifest.collapse(both, n)
        fragments.append(both)
    assert fragments[0] == {(len(merkle_manifest.widths(n)) - 1, 0): proofs_of(leaves)[0]}


def test_other_arities(monkeypatch):
    monkeypatch.setattr(merkle_manifest, "ARITY", 3)
    nodes = {(0, i): sha(str(i)) for i in range(7)}
    merkle_manifest.collapse(nodes, 7)
    one, two, three = sha("".join(map(sha, "012"))), sha("".join(map(sha, "345"))), sha(sha("6"))
    assert nodes == {(2, 0): sha(one + two + three)}


# Fill-in-the-middle


def fim_of(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def in_duckdb(rows, sql):
    with duckdb.connect() as con:
        con.register("batch", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
        return con.sql(sql).fetchall()


UNITS = st.sampled_from(["a", "Zz", "word", " ", "\n", "\x00", "é", "日本", "<P>", "<S", "<", ">", "M>", "1", "\U0001f600", "%", "_"]) | st.text(st.characters(codec="utf-8"), max_size=4)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(0, 1 << 40), st.none() | st.lists(UNITS, max_size=12).map("".join)), max_size=6), st.integers(1, 5))
def test_fill_in_middle_is_exact_however_texts_are_pieced(rows, piece):
    wanted = Counter(fim_of(*r) for r in rows)
    for size in (piece, fill_in_middle.PIECE):
        made = fill_in_middle.transform_sql(piece=size)
        assert Counter(in_duckdb(rows, f"SELECT * EXCLUDE (text) FROM ({made})")) == wanted
        restored = in_duckdb(rows, f"SELECT text, restored FROM ({fill_in_middle.RESTORE.format(source=made)})")
        assert all(a == b for a, b in restored)


def test_fill_in_middle(spark, odd_docs, no_docs):
    marked = odd_docs.where("doc_id = 1").withColumns({"doc_id": F.lit(12), "text": F.lit("a <P> b")})
    docs = odd_docs.unionByName(marked)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = Counter((*x[:5], sha(x[5]), sha(r[1] or "")) for r in rows for x in [fim_of(*r)])
    assert Counter(map(tuple, fill_in_middle.digests(docs).collect())) == wanted
    made = fill_in_middle.transform(docs)
    assert Counter(map(tuple, made.collect())) == Counter(fim_of(*r) for r in rows)
    assert Counter(map(tuple, fill_in_middle.restore(made).collect())) == Counter((i, t or "") for i, t in rows)
    assert fill_in_middle.digests(no_docs).count() == 0
    assert {r.form for r in fill_in_middle.transform(docs, plain=100).collect()} == {"plain"}


def test_fill_in_middle_of_several_megabytes(spark):
    """One run of letters, and letters and signs by turns, over many pieces."""
    texts = ["x" * 3_000_000, "ab, é " * 500_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fill_in_middle.digests(rows, plain=0).collect()}
    assert [(got[i].n, got[i].prefix_chars, got[i].restored_sha256) for i in (0, 1)] == [(fim_of(i, t)[1], _cut(i, t), sha(t)) for i, t in enumerate(texts)]


def _cut(doc_id, text):
    units, h = re.findall("[A-Za-z]+|[^A-Za-z]", text), sha(f"1:{doc_id}")
    return len("".join(units[: min(int(h[8 * i : 8 * i + 8], 16) % (len(units) + 1) for i in range(2))]))


# Exact dedup


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(spark, odd_docs, no_docs):
    more = odd_docs.where("doc_id in (10, 8)").withColumns({"doc_id": F.col("doc_id") + 100, "text": F.concat(F.lit("É"), "text")})
    docs = odd_docs.unionByName(more).unionByName(more.withColumns({"doc_id": F.col("doc_id") + 100, "text": F.regexp_replace("text", "É", "é")}))
    got = exact_dedup.groups(docs, text_sha256=F.sha2(exact_dedup.normalised(F.col("text")), 256)).collect()
    rows = docs.collect()
    by_text = defaultdict(list)
    for r in rows:
        by_text[lowered(r.text)].append(r.doc_id)
    last = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in by_text.items()}
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((r.doc_id, last[t], len(by_text[t]), sha(t)) for r in rows for t in [lowered(r.text)])
    kept = [r for r in got if r.kept]
    assert len(kept) == len(by_text) and all(r.doc_id == r.keep_id for r in kept)
    assert sum(r.doc_id == 4 for r in kept) <= 1  # of two equal rows one stays
    assert exact_dedup.groups(no_docs).count() == 0 and exact_dedup.distinct_documents(no_docs).count() == 0
    stay = exact_dedup.distinct_documents(docs)
    assert stay.columns == docs.columns
    assert Counter((r.doc_id, lowered(r.text)) for r in stay.collect()) == Counter((i, t) for t, i in last.items())


def test_prefixes_and_lengths_alone_prove_nothing(spark):
    """Same length, same first characters, other texts; and one text that differs within the prefix in its case alone."""
    long = "x" * 1000
    rows = [(1, long + "a", None, None, None), (2, long + "b", None, None, None), (3, long.upper() + "A", None, None, None), (4, long + "ab", None, None, None), (5, None, None, None, None), (6, "", None, None, None)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True), 5: (6, 2, False), 6: (6, 2, True)}


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_a_sieve_misses_no_key(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "BITS", bits)
    keys = spark.range(0, 5000, 7).select((F.col("id") * 1_000_003 - 17).alias("k"))
    rows = spark.range(5000).select((F.col("id") * 1_000_003 - 17).alias("k"))
    got = {r.k: r.hit for r in exact_dedup.sieved(rows, "k", keys, "hit").collect()}
    wanted = {r.k for r in keys.collect()}
    assert all(got[k] for k in wanted)
    assert bits == 64 or sum(got.values()) == len(wanted)


def test_rows_meet_their_groups_hot_or_not(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 600, "hot").otherwise((F.col("id") % 90).cast("string")).alias("key"))
    groups = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("key <> '7'")
    plain = {(r.id, r.n) for r in rows.join(groups, "key", "left").collect()}
    for limit in (1, 3, 20, 1000):
        got = attach(rows, groups, "key", "n", limit)
        assert {(r.id, r.n) for r in got.collect()} == plain and got.count() == 1000
