"""Sparse and dense retrieval for whole sets of queries, and the fusion of their result lists.

Result lists are rows (qid, id, score, rank) with ranks from 0. Scores are rounded to 6 places before ranking and ties go to
the smaller id, so that results don't depend on how sums were split.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import tokenize
from fathom.session import materialise, spread

K1, B, IDF_FLOOR = 1.5, 0.75, 0.25
BROADCAST_TERMS = 400_000
#: Documents whose tokens are counted at a time, and pairs of a posting and a question's word that are weighed at a time.
COUNTED_DOCS, PAIRS = 512, 1 << 20
RRF_K, MMR_LAMBDA, CANDIDATES, TOP = 60, 0.6, 40, 12


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their ranks. Spark keeps k rows a query and task before it shuffles."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place - 1).where(F.col("rank") < k).select("qid", "id", "score", "rank")


def term_index(docs: DataFrame) -> DataFrame:
    """docs: (id, text) -> (id, dl, term, tf): one row for each different token of a document, and one without a term for the
    document itself, so that those without tokens count too. Texts are tokenised once; a saved index is searched as it is."""

    def counted(batches):
        """A document's tokens are all in its row: they are counted there, and nothing is shuffled."""
        for batch in (whole.slice(a, COUNTED_DOCS) for whole in batches for a in range(0, whole.num_rows, COUNTED_DOCS)):
            tokens, ids = batch.column("t"), batch.column("id")
            dl = np.diff(tokens.offsets.to_numpy())
            coded = tokens.flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            cell, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            doc = np.concatenate([np.arange(len(dl)), cell // width])
            terms = pa.concat_arrays([pa.nulls(len(dl), pa.string()), coded.dictionary.take(pa.array(cell % width)).cast(pa.string())])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(dl[doc].astype(np.int32)), terms, pa.array(np.concatenate([np.ones(len(dl), np.int64), tf]))], ["id", "dl", "term", "tf"])

    key = docs.schema["id"].dataType.simpleString()
    return spread(docs.select("id", "text")).select("id", tokenize(F.col("text")).alias("t")).mapInArrow(counted, f"id {key}, dl int, term string, tf long")


def search_index(index: DataFrame, queries: DataFrame, k: int = CANDIDATES, k1: float = K1, b: float = B, block: int = 16_384) -> DataFrame:
    """index: of term_index, queries: (qid, text). Okapi scores; a word that most documents have weighs a quarter of the mean
    weight; a word asked twice counts twice. Documents that score 0 or less are left out.

    Document frequencies of all words are counted first, as the floor is a mean over the vocabulary. Only the postings of words
    that are asked for are shuffled, as numbers, once a block of queries; a block of queries and one of documents leave each
    query's best k. So no row is made for a query and a document that share a word.
    """
    total = index.where("term is null").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    if not total["n_docs"]:
        return queries.select("qid").limit(0).join(index.select("id").limit(0)).select("qid", "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    n_docs, avgdl = F.lit(total["n_docs"]), F.lit(total["avgdl"])
    asked = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qf"))
    asked = materialise(asked, "asked")
    terms = materialise(asked.select("term").distinct().withColumn("n", F.monotonically_increasing_id()), "asked-terms")
    small = F.broadcast if terms.count() <= BROADCAST_TERMS else lambda df: df
    df = index.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    weighed = df.withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).join(small(terms), "term", "left")
    idf = materialise(weighed.groupBy(F.coalesce("n", F.lit(-1).cast("long")).alias("n")).agg(F.sum("raw").alias("raw"), F.count("*").alias("words")), "weights")  # -1: all words not asked for
    mean = idf.agg((F.sum("raw") / F.sum("words")).alias("mean")).first()["mean"]
    idf = idf.where("n >= 0").select("n", F.when(F.col("raw") < 0, F.lit(mean) * IDF_FLOOR).otherwise(F.col("raw")).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    postings = index.join(small(terms.join(small(idf), "n")), "term").select("id", "n", weight.alias("w"))
    numbered = asked.join(small(terms), "term").select(F.col("qid").alias("asked_qid"), F.col("n").alias("asked_n"), "qf")
    n_q = max(1, -(-queries.count() // block))
    docs_a_block = max(2048, asked.count() // (64 * n_q))  # so that a block's postings outweigh its queries' words, which they meet
    n_v = max(1, -(-total["n_docs"] // docs_a_block))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = numbered.withColumn("q_block", part("asked_qid", n_q)).withColumn("v_block", every(n_v))
    right = postings.withColumn("v_block", part("id", n_v)).withColumn("q_block", every(n_q))
    qid, vid = queries.schema["qid"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    found = left.groupBy("q_block", "v_block").cogroup(right.groupBy("q_block", "v_block")).applyInArrow(lambda q, v: _best_postings(q, v, k), f"qid {qid}, id {vid}, score double")
    return top(found, k)


def _best_postings(asked: pa.Table, postings: pa.Table, k: int, cells: int = 1 << 20) -> pa.Table:
    """(qid, id, score): the k best documents of each query, or more, by the sums of their words' weights. Documents are taken
    a few thousand at a time, so that queries times documents are about `cells`, and their postings so that about PAIRS meet a
    query's word at once, however common the words are."""
    out = [pa.table({"qid": asked["asked_qid"].slice(0, 0), "id": postings["id"].slice(0, 0), "score": pa.array([], pa.float64())})]
    if not asked.num_rows or not postings.num_rows:
        return out[0]
    asked, postings = asked.sort_by("asked_n"), postings.sort_by("id")
    qids = asked["asked_qid"].combine_chunks().dictionary_encode()
    q_of, qf, asked_n = qids.indices.to_numpy(), asked["qf"].to_numpy(), asked["asked_n"].to_numpy()
    ids = postings["id"].combine_chunks().dictionary_encode()  # in ascending order
    doc, n, w = ids.indices.to_numpy(), postings["n"].to_numpy(), postings["w"].to_numpy()
    first, past = np.searchsorted(asked_n, n, side="left"), np.searchsorted(asked_n, n, side="right")
    n_q, n_docs = len(qids.dictionary), len(ids.dictionary)
    step = max(k, cells // n_q)
    for a in range(0, n_docs, step):
        b = min(n_docs, a + step)
        low, high = np.searchsorted(doc, [a, b])
        met = np.concatenate([[0], np.cumsum(past[low:high] - first[low:high])])
        s = np.zeros(n_q * (b - a))
        at_once = [low, *(low + np.searchsorted(met, np.arange(PAIRS, met[-1], PAIRS))), high]
        for own in (slice(x, y) for x, y in zip(at_once, at_once[1:]) if x < y):
            times = past[own] - first[own]
            at = np.repeat(first[own] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            cell = q_of[at].astype(np.int64) * (b - a) + np.repeat(doc[own] - a, times)
            s += np.bincount(cell, np.repeat(w[own], times) * qf[at], len(s))
        s = np.round(s.reshape(n_q, b - a), 6)
        i, j = _best_cells(np.where(s > 0, s, -np.inf), k)
        out.append(pa.table({"qid": qids.dictionary.take(pa.array(i)), "id": ids.dictionary.take(pa.array(j + a)), "score": pa.array(s[i, j])}))
    return pa.concat_tables(out)


def _best_cells(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest values of each row, ties to the first column; those of minus infinity are left out."""
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept]


def bm25(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, k1: float = K1, b: float = B) -> DataFrame:
    """search_index over docs, (id, text), whose index is written once and read for each of its uses."""
    return search_index(materialise(term_index(docs), "terms"), queries, k, k1, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def dense(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, block: int = 4096) -> DataFrame:
    """vectors: (id, vector), queries: (qid, vector), all of length 1. Exact search: each block of queries meets all vectors.
    With a column cell in both, only those of an equal cell meet; a vector may be in several.

    Both go in blocks of about `block`, so a vector is sent once a block of queries. A pair of blocks is one matrix product,
    which leaves a query's best k.
    """
    cell = ["cell"] if "cell" in vectors.columns else []
    n_q, n_v = (max(1, -(-df.select(key).distinct().count() // block)) for df, key in ((queries, "qid"), (vectors, "id")))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    renamed = [F.col(c).alias(f"asked_{c}") for c in ("qid", "vector", *cell)]  # new columns: queries most often come from vectors
    asked = queries.where("vector is not null").select(*renamed, part("qid", n_q).alias("q_block")).withColumn("v_block", every(n_v))
    rows = vectors.where("vector is not null").select("id", "vector", *cell, part("id", n_v).alias("v_block")).withColumn("q_block", every(n_q))
    qid, vid = queries.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    keys = ["q_block", "v_block"]
    found = asked.groupBy(*keys, *(f"asked_{c}" for c in cell)).cogroup(rows.groupBy(*keys, *cell)).applyInArrow(lambda q, v: _best_of_block(q, v, k), f"qid {qid}, id {vid}, score double")
    if cell:
        found = found.groupBy("qid", "id").agg(F.max("score").alias("score"))
    return top(found, k)


def _best_of_block(asked: pa.Table, rows: pa.Table, k: int, slab: int = 128) -> pa.Table:
    """(qid, id, score): the k best rows of each query, ties to the smaller id."""
    out = pa.table({"qid": asked["asked_qid"].slice(0, 0), "id": rows["id"].slice(0, 0), "score": pa.array([], pa.float64())})
    if not asked.num_rows or not rows.num_rows:
        return out
    matrix = lambda c: c.combine_chunks().flatten().to_numpy().astype(float).reshape(len(c), -1)
    rows = rows.sort_by("id")
    q, v = matrix(asked["asked_vector"]), matrix(rows["vector"]).T
    parts = [out]
    for a in range(0, len(q), slab):
        s = np.round(q[a : a + slab] @ v, 6) + 0.0  # no negative zero
        i, j = _best_cells(s, k)
        parts.append(pa.table({"qid": asked["asked_qid"].take(pa.array(i + a)), "id": rows["id"].take(pa.array(j)), "score": pa.array(s[i, j])}))
    return pa.concat_tables(parts)


def reciprocal_rank_fusion(lists: dict[str, DataFrame], weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """(qid, id, score, rank, components): the sum of weight / (k + rank + 1) over the lists; ties by first appearance.

    components has each retriever's own score, to 4 places; null where a list has no scores.
    """
    if set(lists) - set(weights):
        raise ValueError(f"no weight for {set(lists) - set(weights)}")
    own = lambda hits: F.round(F.col("score"), 4).cast("double") if "score" in hits.columns else F.lit(None).cast("double")
    rows = [hits.select("qid", "id", "rank", F.lit(i).alias("place"), F.lit(name).alias("retriever"), own(hits).alias("own"), (weights[name] / (F.lit(float(k)) + F.col("rank") + 1)).alias("part")) for i, (name, hits) in enumerate(lists.items())]
    merged = reduce(DataFrame.unionByName, rows).groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("place", "rank")).alias("first"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "own")))).alias("components"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first", "id"))
    return merged.withColumn("rank", place - 1).select("qid", "id", "score", "rank", "components")


def deduplicate(hits: DataFrame) -> DataFrame:
    """hits: (qid, id, parent, rank, ...): the first hit of each id and of each non-empty parent. Ranks stay as they were."""
    first_id = F.row_number().over(Window.partitionBy("qid", "id").orderBy("rank"))
    once = hits.withColumn("_n", first_id).where("_n = 1")
    own = F.coalesce(F.nullif(F.col("parent").cast("string"), F.lit("")), F.concat(F.lit("\0"), F.col("id").cast("string")))
    first = F.row_number().over(Window.partitionBy("qid", own).orderBy("rank"))
    return once.withColumn("_n", first).where("_n = 1").drop("_n")


def token_set(text: Column) -> Column:
    """The distinct search tokens of a text as 64-bit hashes: sets of numbers are far cheaper to compare than of strings."""
    return F.array_distinct(F.transform(tokenize(text), lambda t: F.xxhash64(t)))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets, arrays without repeats; 0 for two empty ones."""
    return F.element_at(F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: F.coalesce(n / F.nullif(F.size(a) + F.size(b) - n, F.lit(0)), F.lit(0.0))), 1)


def mmr(hits: DataFrame, k: int = TOP, trade: float = MMR_LAMBDA, similarity=token_similarity) -> DataFrame:
    """hits: (qid, id, rank, item): picks k of each query for relevance 1 / (1 + rank) less similarity to what is picked.

    Up to k hits come back unchanged. Else the first is taken, then again and again the best by
    trade * relevance - (1 - trade) * greatest similarity, ties to the better rank. A query's hits are a top-k list of
    a few dozen, so they are one row; the picking is one fold over it.
    """
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work a row: kept apart
    rows = hits.repartition(tasks, "qid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "item"))).alias("hs"))
    hs = F.col("hs")
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def pick(acc: Column, _: Column) -> Column:
        """acc: (picked: positions from 1, worst: greatest similarity to what is picked, by position)."""
        gain = F.transform(hs, lambda h, i: F.struct(F.when(F.array_contains(acc["picked"], i + 1), float("-inf")).otherwise(F.round(F.lit(trade) / (1 + h["rank"]) - F.lit(1 - trade) * F.element_at(acc["worst"], i + 1), 9)).alias("g"), (-i).alias("o")))
        best = 1 - F.array_max(gain)["o"]
        return let(best, lambda p: let(F.element_at(hs, p), lambda chosen: F.struct(F.concat(acc["picked"], F.array(p)).alias("picked"), F.zip_with(acc["worst"], hs, lambda w, h: F.greatest(w, F.round(similarity(h["item"], chosen["item"]), 9))).alias("worst"))))

    first = let(F.element_at(hs, 1), lambda h0: F.struct(F.array(F.lit(1)).alias("picked"), F.transform(hs, lambda h: F.round(similarity(h["item"], h0["item"]), 9)).alias("worst")))
    order = F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), first, pick)["picked"]
    chosen = F.when(F.size(hs) <= k, F.transform(hs, lambda h: F.struct(h["id"].alias("id"), h["rank"].alias("rank")))).otherwise(F.transform(order, lambda p, i: F.struct(F.element_at(hs, p)["id"].alias("id"), i.alias("rank"))))
    return rows.select("qid", F.explode(chosen).alias("c")).select("qid", "c.id", "c.rank")


def expand_parents(hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds text and expanded to hits: the parent's text, or the child's where there is none. Text is joined last."""
    named = hits.join(children.select("id", "parent_id", F.col("text").alias("child_text")), "id").join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    parent = F.nullif("parent_text", F.lit(""))
    return named.withColumn("text", F.coalesce(parent, "child_text")).withColumn("expanded", F.coalesce(parent.isNotNull() & (F.col("parent_text") != F.col("child_text")), F.lit(False))).drop("child_text", "parent_text")


def resolve(ids: DataFrame, children: DataFrame) -> DataFrame:
    """ids: (qid, ids array) -> hits in that order; unknown ids are left out and their places stay empty: score is 1 / (1 + place)."""
    placed = ids.select("qid", F.posexplode("ids").alias("rank", "id"))
    return placed.join(children.select("id"), "id").select("qid", "id", (F.lit(1.0) / (1 + F.col("rank"))).alias("score"), "rank")


def with_items(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits with item, the token set of each hit's text. docs: (id, text). Only texts that are hits are tokenised, each once."""
    wanted = docs.join(hits.select("id").distinct(), "id", "left_semi").select("id", token_set(F.col("text")).alias("item"))
    return hits.join(wanted, "id")


def fused(lists: dict[str, DataFrame], parents_of: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Fusion, then de-duplication by parent. parents_of: (id, parent)."""
    return deduplicate(reciprocal_rank_fusion(lists, weights).join(parents_of, "id"))


def hybrid(lists: dict[str, DataFrame], docs: DataFrame, weights: dict[str, float], k: int = TOP) -> DataFrame:
    """Fusion, de-duplication by parent, then diversity: (qid, id, rank). docs: (id, parent, text)."""
    kept = materialise(fused(lists, docs.select("id", "parent"), weights).select("qid", "id", "rank"), "fused")
    return mmr(with_items(kept, docs).select("qid", "id", "rank", "item"), k)


def fusion_blocks(lists: dict[str, DataFrame], docs: DataFrame, children: DataFrame, parents: DataFrame, weights: dict[str, float], k: int = TOP) -> DataFrame:
    """The context of each query: (qid, position from 1, id, parent_id, score, components, text, matched_text, expanded).

    docs, lists and weights as of `hybrid`; children: (id, parent_id, text); parents: (parent_id, text). text is the whole
    passage that a hit stands for, or the hit's own where there is none. A list without hits adds nothing; a query without
    any has no blocks. Only the texts of what was picked are read: they are joined last.
    """
    merged = materialise(deduplicate(reciprocal_rank_fusion(lists, weights).join(docs.select("id", "parent"), "id")).select("qid", "id", "rank", "score", "components"), "fused")
    picked = mmr(with_items(merged, docs).select("qid", "id", "rank", "item"), k).select("qid", "id", (F.col("rank") + 1).alias("position"))
    blocks = expand_parents(picked.join(merged.drop("rank"), ["qid", "id"]), children, parents)
    matched = children.select("id", F.col("text").alias("matched_text"))
    return blocks.join(matched, "id").select("qid", "position", "id", "parent_id", F.round("score", 4).alias("score"), "components", "text", "matched_text", "expanded")


def ann(vectors: DataFrame, queries: DataFrame, k: int, bucket: float = 1.0, tables: int = 8, seed: int = 42) -> DataFrame:
    """vectors: (id, vector), queries: (qid, vector), all of length 1. Approximate search by random-projection buckets: a query
    meets the vectors that share a bucket in one of the tables. No distance is too far; a query whose buckets hold fewer than k
    vectors is answered exactly.
    """
    plane = lambda df: df.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(plane(vectors))
    cells = F.posexplode(F.transform("hashes", lambda h: vector_to_array(h)[0].cast("long"))).alias("table", "bucket")
    placed = lambda df, key: model.transform(plane(df)).select(key, "vector", cells).select(key, "vector", F.struct("table", "bucket").alias("cell"))
    found = materialise(dense(placed(vectors, "id"), placed(queries, "qid"), k), "found")
    whole = found.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") == k).select("qid")
    rest = queries.join(whole, "qid", "left_anti")
    return found.join(whole, "qid", "left_semi").unionByName(dense(vectors, rest, k))
