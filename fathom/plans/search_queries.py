"""Retrieval, fusion and graph queries."""

from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import corpus, graph, retrieval
from fathom.plans.registry import query, read, sql_strip, sql_tokens
from fathom.session import materialise

BM25_SQL = f"""tok AS (SELECT doc_id AS id, {sql_tokens('text')} AS t FROM documents), tot AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) GROUP BY id, len(t), term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, tot), idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM raw) * 0.25 ELSE raw END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS qf FROM (SELECT item_id AS qid, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT qid, id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN tf USING (term) JOIN idf USING (term), tot GROUP BY qid, id),
bm AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM scored WHERE score > 0 QUALIFY rank < 40)"""
DENSE_SQL = """dn AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM (SELECT q.vec_id AS qid, c.vec_id AS id, round(list_sum([p[1]::DOUBLE * p[2]::DOUBLE FOR p IN list_zip(q.embedding, c.embedding)]), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0) QUALIFY rank < 40)"""
EVERY_DENSE_SQL = """dn AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM (SELECT q.vec_id AS qid, c.vec_id AS id, round(list_sum([p[1]::DOUBLE * p[2]::DOUBLE FOR p IN list_zip(q.embedding, c.embedding)]), 6) AS score FROM embeddings q, embeddings c) QUALIFY rank < 40)"""
RRF_SQL = """rrf AS (SELECT qid, id, round(sum(w), 9) AS score, min((place, rank)) AS first FROM (SELECT qid, id, rank, 0 AS place, 1.0::DOUBLE / (60 + rank + 1) AS w FROM dn UNION ALL SELECT qid, id, rank, 1, 0.8::DOUBLE / (60 + rank + 1) FROM bm) GROUP BY qid, id),
fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) - 1 AS rank FROM rrf)"""
DEDUP_SQL = """dedup AS (SELECT qid, id, score, rank, source AS parent FROM fused JOIN documents ON id = doc_id QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY rank) = 1)"""


def mmr_sql(hits: str, k: int, trade: float) -> str:
    """A chain of k steps, each taking the best of what is left. hits: (qid, id, rank, item)."""
    steps = ["s0 AS MATERIALIZED (SELECT qid, id, 0 AS step FROM h WHERE pos = 1)"]
    for i in range(1, k):
        picked = " UNION ALL ".join(f"SELECT qid, id FROM s{j}" for j in range(i))
        steps.append(
            f"s{i} AS MATERIALIZED (SELECT qid, id, {i} AS step FROM (SELECT h.qid, h.id, h.rank, round({trade}::DOUBLE / (1 + h.rank) - {1 - trade}::DOUBLE * max(sim.s), 9) AS g FROM h JOIN ({picked}) p ON p.qid = h.qid JOIN sim ON sim.qid = h.qid AND sim.a = h.id AND sim.b = p.id "
            f"WHERE h.n > {k} AND NOT EXISTS (SELECT 1 FROM ({picked}) x WHERE x.qid = h.qid AND x.id = h.id) GROUP BY h.qid, h.id, h.rank) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY g DESC, rank) = 1)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(k))
    return (
        f"h AS MATERIALIZED (SELECT qid, id, rank, list_distinct(item) AS item, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos, count(*) OVER (PARTITION BY qid) AS n FROM {hits}), "
        "sim AS MATERIALIZED (SELECT x.qid, x.id AS a, y.id AS b, round(CASE WHEN len(list_distinct(x.item || y.item)) = 0 THEN 0 ELSE len(list_intersect(x.item, y.item))::DOUBLE / len(list_distinct(x.item || y.item)) END, 9) AS s FROM h x JOIN h y ON x.qid = y.qid), "
        + ", ".join(steps)
        + f", picked AS (SELECT qid, id, step::INTEGER AS rank FROM ({every}) WHERE qid IN (SELECT qid FROM h WHERE n > {k}) UNION ALL SELECT qid, id, rank::INTEGER FROM h WHERE n <= {k})"
    )


def docs_and_queries(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def sparse_hits(spark, sf_dir):
    return retrieval.bm25(*docs_and_queries(spark, sf_dir))


#: The search queries: each twentieth row, at any size.
ASKED = "id % 20 = 0"


def vectors_of(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def vectors_and_queries(spark, sf_dir):
    vectors = vectors_of(spark, sf_dir)
    return vectors, vectors.where(ASKED).withColumnRenamed("id", "qid")


def dense_hits(spark, sf_dir):
    return retrieval.dense(*vectors_and_queries(spark, sf_dir))


#: Weights of the retrievers' lists.
WEIGHTS = {"dense": 1.0, "bm25": 0.8, "graph": 0.6}


def fused_hits(spark, sf_dir):
    return retrieval.reciprocal_rank_fusion({"dense": dense_hits(spark, sf_dir), "bm25": sparse_hits(spark, sf_dir)}, WEIGHTS)


def sources_of(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent"))


def passages(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent"), "text")


@query(f"WITH {BM25_SQL} SELECT qid, id, score, rank::INTEGER AS rank FROM bm")
def bm25_topk(spark, sf_dir):
    return sparse_hits(spark, sf_dir)


@query(f"WITH {DENSE_SQL} SELECT qid, id, score, rank::INTEGER AS rank FROM dn")
def dense_topk(spark, sf_dir):
    return dense_hits(spark, sf_dir)


@query("SELECT vec_id, round(n, 5) AS before, round(sqrt(list_sum([CASE WHEN n > 0 THEN (x::DOUBLE / n) ** 2 ELSE 0.0::DOUBLE END FOR x IN embedding])), 6) AS after FROM (SELECT vec_id, embedding, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT -1 - vec_id, [x * 0 FOR x IN embedding] FROM embeddings))")
def normalise_vectors(spark, sf_dir):
    v = F.col("embedding")
    unit = retrieval.normalise(v)
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    zeros = vectors.select((-1 - F.col("vec_id")).alias("vec_id"), F.transform("embedding", lambda x: x * 0).alias("embedding"))
    return vectors.unionByName(zeros).select("vec_id", F.round(F.sqrt(retrieval.dot(v, v)), 5).alias("before"), F.round(F.sqrt(retrieval.dot(unit, unit)), 6).alias("after"))


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {RRF_SQL} SELECT f.qid, f.id, f.score, f.rank::INTEGER AS rank, round(dn.score::DECIMAL(20, 6), 4)::DOUBLE AS dense, round(bm.score::DECIMAL(20, 6), 4)::DOUBLE AS sparse FROM fused f LEFT JOIN dn USING (qid, id) LEFT JOIN bm USING (qid, id)")
def rrf_fuse(spark, sf_dir):
    return fused_hits(spark, sf_dir).select("qid", "id", "score", "rank", F.col("components")["dense"].alias("dense"), F.col("components")["bm25"].alias("sparse"))


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {RRF_SQL}, {DEDUP_SQL} SELECT qid, id, score, rank::INTEGER AS rank, parent FROM dedup")
def dedup_parent(spark, sf_dir):
    return retrieval.deduplicate(fused_hits(spark, sf_dir).join(sources_of(spark, sf_dir), "id")).select("qid", "id", "score", "rank", "parent")


@query(f"WITH {BM25_SQL}, hits AS (SELECT qid, id, rank, {sql_tokens('text')} AS item FROM bm JOIN documents ON id = doc_id), {mmr_sql('hits', 12, 0.6)} SELECT * FROM picked")
def mmr_tokens(spark, sf_dir):
    return retrieval.mmr(retrieval.with_items(materialise(sparse_hits(spark, sf_dir), "hits"), passages(spark, sf_dir)))


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {RRF_SQL}, {DEDUP_SQL}, hits AS (SELECT qid, dedup.id, rank, {sql_tokens('text')} AS item FROM dedup JOIN documents ON id = doc_id), {mmr_sql('hits', 12, 0.6)} SELECT qid, id, rank, substr(text, 1, 320) AS text FROM picked JOIN documents ON id = doc_id")
def hybrid_context(spark, sf_dir):
    lists = {"dense": dense_hits(spark, sf_dir), "bm25": sparse_hits(spark, sf_dir)}
    found = retrieval.hybrid(lists, passages(spark, sf_dir), WEIGHTS)
    return found.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 320).alias("text")), "id").select("qid", "id", "rank", "text")


@query()
def mmr_vectors(spark, sf_dir):
    items = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("item"))
    return retrieval.mmr(dense_hits(spark, sf_dir).join(items, "id").select("qid", "id", "rank", "item"), similarity=retrieval.dot)


@query()
def ann_topk(spark, sf_dir):
    return retrieval.ann(*vectors_and_queries(spark, sf_dir), k=10)


@query("""SELECT qid, id, 1.0::DOUBLE / (1 + rank) AS score, rank::INTEGER AS rank, p_brand AS parent_id, CASE WHEN p_brand LIKE '%1' OR p_brand LIKE '%2' THEN p_name ELSE 'brand ' || p_brand END AS text, NOT (p_brand LIKE '%1' OR p_brand LIKE '%2') AS expanded
FROM (SELECT l_orderkey AS qid, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS rank FROM lineitem GROUP BY l_orderkey, l_partkey) JOIN part ON p_partkey = id WHERE p_partkey % 10 <> 0""")
def parent_expand(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_partkey % 10 <> 0")  # the other ids resolve to nothing
    asked = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    children = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("parent_id"), F.col("p_name").alias("text"))
    brand = F.col("p_brand")
    parents = part.where(~brand.endswith("1")).select(brand.alias("parent_id"), F.when(brand.endswith("2"), "").otherwise(F.concat(F.lit("brand "), brand)).alias("text")).distinct()
    return retrieval.expand_parents(retrieval.resolve(asked, children), children, parents).select("qid", "id", "score", "rank", "parent_id", "text", "expanded")


QUOTA_SQL = """WITH a AS (SELECT source, count(*) AS n FROM documents WHERE n_chars >= {min} + 40 * (doc_id % 25) GROUP BY source), l AS (SELECT max(x) AS level FROM range(0, {limit} + 1) r(x) WHERE (SELECT sum(least(n, x)) FROM a) <= {limit}),
b AS (SELECT source, n, least(n, level) AS base, {limit} - (SELECT sum(least(n, level)) FROM a) AS spare, row_number() OVER (PARTITION BY n > level ORDER BY n, source) AS place, n > level AS unfilled FROM a, l)
SELECT source, (base + CASE WHEN unfilled AND place <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM b"""


@query(QUOTA_SQL.format(min=1200, limit=250))
def quotas_waterfill(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("n_chars >= 1200 + 40 * (doc_id % 25)")
    return corpus.quotas(docs.groupBy("source").agg(F.count("*").alias("n")), 250)


@query(f"""WITH u AS (SELECT doc_id, source FROM (SELECT doc_id, source, {sql_strip('text')} AS s FROM documents) WHERE len(s) >= 1200 AND NOT ({" OR ".join(f"contains(lower(substr(s, 1, 3000)), '{m}')" for m in T.BOILERPLATE)}) AND len(regexp_replace(substr(s, 1, 4000), '[^\\p{{L}}\\s]', '', 'g'))::DOUBLE / len(substr(s, 1, 4000)) >= 0.75),
a AS (SELECT source, count(*) AS n FROM u GROUP BY source), l AS (SELECT max(x) AS level FROM range(0, 301) r(x) WHERE (SELECT sum(least(n, x)) FROM a) <= 300),
q AS (SELECT source, n, least(n, level) + CASE WHEN n > level AND row_number() OVER (PARTITION BY n > level ORDER BY n, source) <= 300 - (SELECT sum(least(n, level)) FROM a) THEN 1 ELSE 0 END AS quota FROM a, l),
p AS (SELECT doc_id, u.source, row_number() OVER (PARTITION BY u.source ORDER BY doc_id) - 1 AS place, greatest(1, n // greatest(1, quota)) AS stride, quota FROM u JOIN q ON u.source = q.source)
SELECT doc_id, source, (place // stride + 1)::BIGINT AS n FROM p WHERE place % stride = 0 AND place // stride < quota""")
def stride_sample(spark, sf_dir):
    return corpus.stratified(read(spark, sf_dir, "documents"), 300)


@query()
def pack_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("").alias("title"), "source", F.lit("").alias("url"))
    return corpus.chunk_documents(docs, separator="\n")[1].select("chunk_id", "parent_id", "doc_id", "text", "section", "token_count")


def relations(spark, sf_dir):
    """Orders as statements: segment and priority of each order's customer."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey").join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    kind = F.element_at(F.array(F.lit("treats"), F.lit("made up"), F.lit("symptom_of")), (F.col("o_custkey") % 3 + 1).cast("int"))
    one = rows.select(F.col("c_mktsegment").alias("source"), kind.alias("relation"), F.col("o_orderpriority").alias("target"), F.concat(F.lit("k"), "o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("seq"))
    return one.unionByName(rows.select(F.col("o_orderpriority").alias("source"), F.lit("references").alias("relation"), F.col("n_name").alias("target"), F.concat(F.lit("k"), "o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("seq")))


REL_SQL = r"""rel AS (SELECT c_mktsegment AS s, ['treats', 'made up', 'symptom_of'][o_custkey % 3 + 1] AS r, o_orderpriority AS t, 'k' || o_orderkey AS chunk_id, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT o_orderpriority, 'references', n_name, 'k' || o_orderkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
edge AS (SELECT lower(s) AS src, CASE WHEN r = 'made up' THEN 'references' ELSE r END AS rel, lower(t) AS dst, count(*) AS weight, min_by(chunk_id, seq) AS chunk_id FROM rel GROUP BY ALL)"""
NODE_SQL = """ent AS (SELECT p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN 'medication' ELSE 'thing' END AS type, 'k' || p_partkey AS chunk_id, p_partkey AS seq FROM part UNION ALL SELECT p_type, 'symptom', 'k' || p_partkey, p_partkey FROM part),
node AS (SELECT lower(name) AS key, min_by(name, seq) AS label, CASE min_by(type, seq) WHEN 'thing' THEN 'condition' ELSE min_by(type, seq) END AS node_type, array_agg(chunk_id ORDER BY seq)[1:6] AS chunk_ids FROM ent GROUP BY 1)"""


def nodes(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    chunk = F.concat(F.lit("k"), "p_partkey").alias("chunk_id")
    brands = part.select(F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "medication").otherwise("thing").alias("type"), chunk, F.col("p_partkey").alias("seq"))
    return graph.build_nodes(brands.unionByName(part.select(F.col("p_type").alias("name"), F.lit("symptom").alias("type"), chunk, F.col("p_partkey").alias("seq"))))


@query(f"WITH {REL_SQL} SELECT * FROM edge")
def build_edges(spark, sf_dir):
    return graph.build_edges(relations(spark, sf_dir))


@query(f"WITH {NODE_SQL} SELECT key, label, node_type, array_to_string(chunk_ids, ',') AS chunk_ids, CASE WHEN node_type = 'medication' AND key LIKE '%3' THEN 'rx' || key END AS rxcui FROM node")
def entity_nodes(spark, sf_dir):
    names = read(spark, sf_dir, "part").where("p_brand like '%3'").select(F.col("p_brand").alias("name"), F.concat(F.lit("rx"), F.lower("p_brand")).alias("rxcui")).distinct()
    return graph.annotate_drugs(nodes(spark, sf_dir), names).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("""WITH q AS (SELECT c_custkey AS qid, lower(c_mktsegment) || ' with ' || lower(n_name) AS text FROM customer JOIN nation ON n_nationkey = c_nationkey), n AS (SELECT lower(n_name) AS key FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT 'united with'),
m AS (SELECT qid, key, CASE WHEN contains(text, key) THEN len(key) + 10.0::DOUBLE ELSE round(len(list_intersect(string_split(text, ' '), string_split(key, ' ')))::DOUBLE ** 2 / len(list_distinct(string_split(key, ' '))), 9) END AS score FROM q, n)
SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key)::INTEGER AS place FROM m WHERE score > 0 QUALIFY place <= 3""")
def match_entities(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    asked = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = asked.select(F.col("c_custkey").alias("qid"), F.concat("c_mktsegment", F.lit(" with "), "n_name").alias("text"))
    keys = nation.select(F.lower("n_name").alias("key")).union(read(spark, sf_dir, "region").select(F.lower("r_name"))).union(spark.createDataFrame([("united with",)], "key string")).distinct()
    return graph.match_entities(asked, keys, 3)


TRAVERSE_SQL = f"""WITH {REL_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, rel) AS e FROM edge), seed AS (SELECT c_custkey AS qid, lower(c_mktsegment) AS key, 1 AS place FROM customer),
one AS (SELECT qid, place, 1 AS hop, e AS e1, 0 AS e2, [src, dst] AS nodes, [rel] AS rels, weight / 2 AS score, dst FROM seed JOIN e ON key = src),
two AS (SELECT qid, place, 2 AS hop, a.e AS e1, b.e AS e2, [a.src, a.dst, b.dst] AS nodes, [a.rel, b.rel] AS rels, b.weight / 3 AS score, b.dst FROM seed JOIN e a ON key = a.src JOIN e b ON a.dst = b.src AND b.dst <> a.src),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, hop, e1, e2) AS ordinal FROM (SELECT * FROM one UNION ALL SELECT * FROM two)), f AS (SELECT *, (row_number() OVER (PARTITION BY qid, dst ORDER BY ordinal) = 1)::INTEGER AS new FROM p),
paths AS (SELECT qid, ordinal, nodes, rels, score FROM f QUALIFY coalesce(sum(new) OVER (PARTITION BY qid ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 25)"""


def found_paths(spark, sf_dir):
    seeds = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.lower("c_mktsegment").alias("key"), F.lit(1).alias("place"))
    return graph.traverse(seeds, graph.build_edges(relations(spark, sf_dir)))


@query(f"{TRAVERSE_SQL} SELECT qid, ordinal::INTEGER AS ordinal, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels, score FROM paths")
def traverse_2hop(spark, sf_dir):
    return found_paths(spark, sf_dir).select("qid", "ordinal", F.array_join("nodes", ">").alias("nodes"), F.array_join("rels", ">").alias("rels"), "score")


@query(f"""{TRAVERSE_SQL}, nd AS (SELECT lower(s) AS key, array_agg(chunk_id ORDER BY seq)[1:3] AS ids FROM (SELECT s, chunk_id, seq FROM rel UNION ALL SELECT t, chunk_id, seq + 1000000 FROM rel) GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ordinal) AS place FROM paths QUALIFY place <= 12),
x AS (SELECT qid, place, unnest(nodes) AS key, generate_subscripts(nodes, 1) AS spot FROM t), y AS (SELECT qid, unnest(ids) AS id, place * 1000 + spot * 10 + generate_subscripts(ids, 1) AS o FROM x JOIN nd USING (key)), z AS (SELECT qid, id, min(o) AS o FROM y GROUP BY ALL)
SELECT qid, array_to_string(array_agg(id ORDER BY o)[1:40], ',') AS ids FROM z GROUP BY qid""")
def collect_chunk_ids(spark, sf_dir):
    rel = relations(spark, sf_dir)
    ends = rel.select(F.col("source").alias("name"), "chunk_id", "seq").unionByName(rel.select(F.col("target").alias("name"), "chunk_id", (F.col("seq") + 1000000).alias("seq")))
    found = graph.collect_chunk_ids(found_paths(spark, sf_dir), graph.build_nodes(ends.withColumn("type", F.lit("condition"))))
    return found.withColumn("ids", F.array_join("ids", ","))


@query(f"WITH {REL_SQL} SELECT * FROM edge WHERE src = 'building' AND rel = 'treats'")
def neighbors(spark, sf_dir):
    return graph.neighbors_of(graph.build_edges(relations(spark, sf_dir)), F.lit("building"), "treats")


@query(f"WITH {REL_SQL}, {NODE_SQL} SELECT 'node' AS kind, coalesce(node_type, 'all') AS name, count(*) AS n FROM node GROUP BY ROLLUP (node_type) UNION ALL SELECT 'edge', coalesce(rel, 'all'), count(*) FROM edge GROUP BY ROLLUP (rel)")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(nodes(spark, sf_dir), graph.build_edges(relations(spark, sf_dir)))


@query(f"WITH {REL_SQL} SELECT count_if(r <> 'made up')::BIGINT AS accepted, count_if(r = 'made up')::BIGINT AS rejected FROM rel")
def extraction_counts(spark, sf_dir):
    return graph.extraction_counts(relations(spark, sf_dir))


#: The graph of documents: each source has its languages, each language its sources. A question names the source of one document.
DOC_GRAPH_SQL = """grel AS (SELECT source AS s, 'references' AS r, 'lang ' || lang AS t, doc_id AS chunk_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION ALL SELECT 'lang ' || lang, 'treats', source, doc_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
gedge AS (SELECT s AS src, r AS rel, t AS dst, count(*) AS weight FROM grel GROUP BY ALL), gnode AS (SELECT key, array_agg(chunk_id ORDER BY seq)[1:3] AS ids FROM (SELECT s AS key, chunk_id, chunk_id * 2 AS seq FROM grel WHERE r = 'references' UNION ALL SELECT t, chunk_id, chunk_id * 2 + 1 FROM grel WHERE r = 'references') GROUP BY key),
ask AS (SELECT item_id AS qid, regexp_replace(lower(coalesce(b.text, '') || ' in ' || coalesce(d.source, '')), '\\s+', ' ', 'g') AS text FROM benchmark b LEFT JOIN documents d ON doc_id = item_id),
seed AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS place FROM (SELECT qid, key, CASE WHEN contains(text, key) THEN len(key) + 10.0::DOUBLE ELSE round(len(list_intersect(string_split(text, ' '), string_split(key, ' ')))::DOUBLE ** 2 / len(list_distinct(string_split(key, ' '))), 9) END AS score FROM ask, gnode) WHERE score > 0 QUALIFY place <= 6),
ge AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, rel) AS e FROM gedge), g1 AS (SELECT qid, place, 1 AS hop, e AS e1, 0 AS e2, [src, dst] AS nodes, weight / 2 AS score, dst FROM seed JOIN ge ON key = src),
g2 AS (SELECT qid, place, 2 AS hop, a.e AS e1, b.e AS e2, [a.src, a.dst, b.dst] AS nodes, b.weight / 3 AS score, b.dst FROM seed JOIN ge a ON key = a.src JOIN ge b ON a.dst = b.src AND b.dst <> a.src),
gp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, hop, e1, e2) AS ordinal FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2)), gf AS (SELECT *, (row_number() OVER (PARTITION BY qid, dst ORDER BY ordinal) = 1)::INTEGER AS new FROM gp),
gpath AS (SELECT qid, ordinal, nodes, score FROM gf QUALIFY coalesce(sum(new) OVER (PARTITION BY qid ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 25),
gtop AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ordinal) AS place FROM gpath QUALIFY place <= 12), gx AS (SELECT qid, place, unnest(nodes) AS key, generate_subscripts(nodes, 1) AS spot FROM gtop),
gy AS (SELECT qid, unnest(ids) AS id, place * 1000 + spot * 10 + generate_subscripts(ids, 1) AS o FROM gx JOIN gnode USING (key)), gz AS (SELECT qid, id, min(o) AS o FROM gy GROUP BY ALL), gr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY o) - 1 AS rank FROM gz QUALIFY rank < 40)"""


def graph_hits(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("source is not null and lang is not null").select("doc_id", "source", F.concat(F.lit("lang "), "lang").alias("lang"))
    named = lambda c, seq: docs.select(F.col(c).alias("name"), F.lit("condition").alias("type"), F.col("doc_id").alias("chunk_id"), seq.alias("seq"))
    nodes = graph.build_nodes(named("source", F.col("doc_id") * 2).unionByName(named("lang", F.col("doc_id") * 2 + 1)))
    said = lambda a, rel, b: docs.select(F.col(a).alias("source"), F.lit(rel).alias("relation"), F.col(b).alias("target"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("seq"))
    edges = graph.build_edges(graph.accepted_relations(said("source", "references", "lang").unionByName(said("lang", "treats", "source"))))
    about = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    asked = read(spark, sf_dir, "benchmark").join(about, "item_id", "left").select(F.col("item_id").alias("qid"), F.concat(F.coalesce("text", F.lit("")), F.lit(" in "), F.coalesce("source", F.lit(""))).alias("text"))
    return graph.retrieve(asked, nodes, edges)


@query(f"WITH {DOC_GRAPH_SQL} SELECT qid, id, 1.0::DOUBLE / (1 + rank) AS score, rank::INTEGER AS rank FROM gr")
def graph_retrieve(spark, sf_dir):
    return graph_hits(spark, sf_dir)


@query(f"""WITH {BM25_SQL}, {DENSE_SQL}, {DOC_GRAPH_SQL}, rrf AS (SELECT qid, id, round(sum(w), 9) AS score, min((place, rank)) AS first FROM (SELECT qid, id, rank, 0 AS place, 1.0::DOUBLE / (60 + rank + 1) AS w FROM dn UNION ALL SELECT qid, id, rank, 1, 0.8::DOUBLE / (60 + rank + 1) FROM bm UNION ALL SELECT qid, id, rank, 2, 0.6::DOUBLE / (60 + rank + 1) FROM gr) GROUP BY qid, id),
fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) - 1 AS rank FROM rrf), {DEDUP_SQL}, hits AS (SELECT qid, dedup.id, rank, {sql_tokens('text')} AS item FROM dedup JOIN documents ON id = doc_id), {mmr_sql('hits', 12, 0.6)} SELECT qid, id, rank FROM picked""")
def hybrid_graph(spark, sf_dir):
    """Sparse, dense and graph hits in one context."""
    lists = {"dense": dense_hits(spark, sf_dir), "bm25": sparse_hits(spark, sf_dir), "graph": graph_hits(spark, sf_dir)}
    return retrieval.hybrid(lists, passages(spark, sf_dir), WEIGHTS)
