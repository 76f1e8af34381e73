"""Queries over what is built from texts and vectors first: graph index, embeddings, extracted graph; deep traversal; blocks."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import ann_graph, embedding, extraction, graph, retrieval
from fathom.plans.registry import ORACLES, query, read, sql_tokens
from fathom.plans.search_queries import BM25_SQL, DEDUP_SQL, DENSE_SQL, RRF_SQL, WEIGHTS, dense_hits, docs_and_queries, mmr_sql, passages, sparse_hits, vectors_and_queries
from fathom.session import materialise, table_dir
from fathom.sources import keyed


@query()
def graph_ann_topk(spark, sf_dir):
    """The 10 nearest of each twentieth vector, by a walk through the layered graph of each part."""
    vectors, asked = vectors_and_queries(spark, sf_dir)
    return ann_graph.search(materialise(ann_graph.build(vectors), "ann-graph"), asked, k=10)


@query()
def embed_documents(spark, sf_dir):
    """Every document's own vector, as text."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return embedding.embed(docs).select("id", F.array_join(F.transform("vector", lambda x: F.format_number(x, 5)), ",").alias("vector"))


def own_dense_hits(spark, sf_dir):
    docs, asked = docs_and_queries(spark, sf_dir)
    vectors = materialise(embedding.embed(docs), "vectors")
    return retrieval.dense(vectors, materialise(embedding.embed(asked), "asked"))


@query()
def dense_text_topk(spark, sf_dir):
    """Dense search of the documents by the questions' own words: both are embedded."""
    return own_dense_hits(spark, sf_dir)


def blocks_of(spark, sf_dir, lists: dict[str, DataFrame]) -> DataFrame:
    """Fused, de-duplicated, diverse hits with the passage each stands for: the first document of its source, of even sources,
    and the hit's own text where there is no such passage."""
    docs = read(spark, sf_dir, "documents")
    children = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id"), F.coalesce("text", F.lit("")).alias("text"))
    even = docs.where(F.substring("source", -1, 1).isin(*"02468"))
    parents = even.groupBy(F.col("source").alias("parent_id")).agg(F.min("doc_id").alias("id")).join(children.select("id", "text"), "id").select("parent_id", "text")
    return retrieval.fusion_blocks(lists, passages(spark, sf_dir), children, parents, WEIGHTS)


@query(f"""WITH {BM25_SQL}, {DENSE_SQL}, {RRF_SQL}, {DEDUP_SQL}, hits AS (SELECT qid, dedup.id, rank, {sql_tokens('text')} AS item FROM dedup JOIN documents ON id = doc_id), {mmr_sql('hits', 12, 0.6)},
par AS (SELECT source AS parent_id, arg_min(coalesce(text, ''), doc_id) AS parent_text FROM documents WHERE right(source, 1) IN ('0', '2', '4', '6', '8') GROUP BY source)
SELECT p.qid, p.rank + 1 AS position, p.id, d.source AS parent_id, round(f.score::DECIMAL(20, 9), 4)::DOUBLE AS score, coalesce(nullif(parent_text, ''), coalesce(d.text, '')) AS text, coalesce(nullif(parent_text, '') <> coalesce(d.text, ''), FALSE) AS expanded
FROM picked p JOIN documents d ON d.doc_id = p.id JOIN fused f ON f.qid = p.qid AND f.id = p.id LEFT JOIN par ON par.parent_id = d.source""")
def fusion_blocks(spark, sf_dir):
    found = blocks_of(spark, sf_dir, {"dense": dense_hits(spark, sf_dir), "bm25": sparse_hits(spark, sf_dir)})
    return found.select("qid", "position", "id", "parent_id", "score", "text", "expanded")


@query()
def fusion_blocks_text(spark, sf_dir):
    """The same from the documents' own vectors: dense and sparse lists are of the same texts and questions."""
    found = blocks_of(spark, sf_dir, {"dense": own_dense_hits(spark, sf_dir), "bm25": sparse_hits(spark, sf_dir)})
    return found.select("qid", "position", "id", "parent_id", "score", "text", "matched_text", "expanded")


def names_in_benchmark(spark, sf_dir) -> DataFrame:
    """The first two words of each benchmark passage, as names of four types."""
    kind = F.element_at(F.array(*map(F.lit, graph.NODE_TYPES)), (F.col("item_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), " ").alias("name"), kind.alias("type"))


def extracted(spark, sf_dir) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("doc_id").alias("seq"))
    return materialise(extraction.by_dictionary(chunks, names_in_benchmark(spark, sf_dir)), "extracted")


@query()
def extracted_nodes(spark, sf_dir):
    """The nodes of the graph that the documents name."""
    nodes, _ = extraction.build(extracted(spark, sf_dir))
    return nodes.withColumn("chunk_ids", F.array_join(F.col("chunk_ids").cast("array<string>"), ","))


@query()
def extracted_edges(spark, sf_dir):
    _, edges = extraction.build(extracted(spark, sf_dir))
    return edges


@query()
def extraction_report(spark, sf_dir):
    return extraction.counts(extracted(spark, sf_dir))


@query(ORACLES["upsert_latest"])
def upsert_buckets(spark, sf_dir):
    """upsert_latest into a table by key, in two batches, of which each rewrites the buckets it touches."""
    path = f"{table_dir(spark)}/keyed-{uuid.uuid4().hex}"
    keyed.create(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path, "c_custkey", 16)
    key = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    new = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(key.alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("seq"))
    keyed.upsert(new.where("c_custkey < 1000000"), path, ["c_acctbal"])
    keyed.upsert(new.where("c_custkey >= 1000000"), path, ["c_acctbal"])
    return keyed.read(spark, path)


HOPS, TARGETS = 4, 12
HOPS_SQL = f"""WITH RECURSIVE g AS (SELECT source AS src, 'references' AS rel, 'lang ' || lang AS dst FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION ALL SELECT 'lang ' || lang, 'treats', source FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
e AS (SELECT src, rel, dst, count(*) AS weight, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst, rel) AS e FROM g GROUP BY src, rel, dst),
sets AS (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
walk AS (SELECT source, lang, place, 0 AS hop, []::INTEGER[] AS es, [key] AS nodes, []::VARCHAR[] AS rels, 0.0::DOUBLE AS score FROM (SELECT source, lang, 1 AS place, source AS key FROM sets UNION ALL SELECT source, lang, 2, 'lang ' || lang FROM sets)
  UNION ALL SELECT w.source, w.lang, place, hop + 1, list_append(es, e.e::INTEGER), list_append(nodes, dst), list_append(rels, rel), weight / (hop + 2) FROM walk w JOIN e ON e.src = w.nodes[-1] WHERE hop < {HOPS} AND NOT list_contains(nodes, dst)),
p AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY place, hop, es) AS ordinal FROM walk WHERE hop > 0), f AS (SELECT *, (row_number() OVER (PARTITION BY source, lang, nodes[-1] ORDER BY ordinal) = 1)::INTEGER AS new FROM p),
paths AS (SELECT * FROM f QUALIFY coalesce(sum(new) OVER (PARTITION BY source, lang ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {TARGETS})"""


@query(f"{HOPS_SQL} SELECT doc_id AS qid, ordinal::INTEGER AS ordinal, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels, score FROM paths JOIN documents d ON d.source = paths.source AND d.lang = paths.lang")
def traverse_hops(spark, sf_dir):
    """Paths of up to four hops between sources and languages, from each document's source and language."""
    docs = read(spark, sf_dir, "documents").where("source is not null and lang is not null").select("doc_id", "source", F.concat(F.lit("lang "), "lang").alias("lang"))
    said = lambda a, rel, b: docs.select(F.col(a).alias("source"), F.lit(rel).alias("relation"), F.col(b).alias("target"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("seq"))
    edges = graph.build_edges(said("source", "references", "lang").unionByName(said("lang", "treats", "source")))
    seeds = docs.select(F.col("doc_id").alias("qid"), F.posexplode(F.array("source", "lang")).alias("place", "key"))
    found = graph.traverse(seeds, edges, TARGETS, HOPS)
    return found.select("qid", "ordinal", F.array_join("nodes", ">").alias("nodes"), F.array_join("rels", ">").alias("rels"), "score")
