"""Knowledge graph: building, matching and bounded traversal, as node and edge tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import normalize_entity
from fathom.operators import automaton
from fathom.session import materialise

# Types and bounds that define the results.
NODE_TYPES = ("condition", "medication", "symptom", "guideline_section")
EDGE_TYPES = ("treats", "contraindicated_with", "symptom_of", "references", "interacts_with")
MAX_NAME, MAX_NODES, PER_NODE = 90, 25, 3


def build_nodes(entities: DataFrame, max_name: int | None = MAX_NAME) -> DataFrame:
    """entities: (name, type, chunk_id, seq) -> (key, label, node_type, chunk_ids). The first label and type by seq win;
    chunk ids are the first PER_NODE * 2 mentions in order, repeats kept. Names that are blank or over max_name go."""
    rows = entities.withColumn("key", normalize_entity(F.col("name"))).where(F.col("key") != "")
    rows = rows if max_name is None else rows.where(F.length("name") <= max_name)
    kind = F.when(F.col("type").isin(*NODE_TYPES), F.col("type")).otherwise("condition")
    place = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    few = rows.withColumn("place", place).where(F.col("place") <= PER_NODE * 2).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    first = rows.groupBy("key").agg(F.min_by("name", "seq").alias("label"), F.min_by(kind, "seq").alias("node_type"))
    return first.join(few, "key").select("key", "label", "node_type", "chunk_ids")


def build_edges(relations: DataFrame) -> DataFrame:
    """relations: (source, relation, target, chunk_id, seq) -> (src, rel, dst, weight, chunk_id). Repeats add weight, the
    first chunk stays; unknown relations are references; loops and blank ends go."""
    rows = relations.select(normalize_entity(F.col("source")).alias("src"), F.when(F.col("relation").isin(*EDGE_TYPES), F.col("relation")).otherwise("references").alias("rel"), normalize_entity(F.col("target")).alias("dst"), "chunk_id", "seq")
    rows = rows.where("src <> '' and dst <> '' and src <> dst")
    return rows.groupBy("src", "rel", "dst").agg(F.count("*").alias("weight"), F.min_by("chunk_id", "seq").alias("chunk_id"))


def accepted_relations(relations: DataFrame) -> DataFrame:
    """The extracted relations that have both ends and a known relation; the others are rejected, not made references."""
    ends = (normalize_entity(F.col("source")) != "") & (normalize_entity(F.col("target")) != "")
    return relations.where(ends & F.coalesce(F.col("relation").isin(*EDGE_TYPES), F.lit(False)))


def extraction_counts(relations: DataFrame) -> DataFrame:
    """One row: relations accepted and rejected."""
    ends = (normalize_entity(F.col("source")) != "") & (normalize_entity(F.col("target")) != "")
    known = ends & F.coalesce(F.col("relation").isin(*EDGE_TYPES), F.lit(False))
    return relations.agg(F.count_if(known).alias("accepted"), F.count_if(~known).alias("rejected"))


def annotate_drugs(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Adds rxcui to medication nodes by exact key. names: (name, rxcui)."""
    found = names.select(F.lower("name").alias("key"), F.lit("medication").alias("node_type"), "rxcui").dropDuplicates(["key"])
    return nodes.join(found, ["key", "node_type"], "left").select(*nodes.columns, "rxcui")


def match_entities(queries: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """queries: (qid, text), nodes: (key): (qid, key, score, place). A key that occurs in the text as characters scores its
    length + 10; else shared words squared over the key's words.

    Nodes meet queries through shared words, and keys inside a text are found by an automaton in one pass over it: no query is
    compared with all nodes.
    """
    text = normalize_entity(F.col("text"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    q = queries.select("qid", text.alias("text"), words(text).alias("qw"))
    n = nodes.select("key", words(F.col("key")).alias("nw"))
    shared = q.select("qid", F.explode("qw").alias("w")).join(n.select("key", F.explode("nw").alias("w")), "w").groupBy("qid", "key").agg(F.count("*").alias("shared"))
    named = automaton.occurrences(q.select("qid", "text"), "text", nodes.where("key <> ''").select(F.col("key").alias("name"), F.lit("").alias("type")).distinct(), whole_words=False)
    inside = named.select("qid", F.explode(F.array_distinct(F.transform("found", lambda x: x["name"]))).alias("key")).withColumn("inside", F.lit(True)).distinct()
    found = shared.join(inside, ["qid", "key"], "full").join(n, "key")
    score = F.when(F.col("inside"), F.length("key") + 10.0).otherwise(F.round(F.pow("shared", F.lit(2)) / F.size("nw"), 9))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key"))
    return found.select("qid", "key", score.cast("double").alias("score")).withColumn("place", place).where(F.col("place") <= limit)


def traverse(seeds: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, max_hops: int = 2) -> DataFrame:
    """seeds: (qid, key, place), edges: (src, rel, dst, weight): simple paths of up to max_hops edges from the seeds.

    (qid, ordinal, nodes, rels, score): in the order of a breadth-first search, seed by seed; edges by descending weight,
    then name. The score is the last edge's weight over the number of nodes. The search ends when max_nodes different
    targets have been reached, which is a prefix of that order. Two nodes have one edge a relation at most, as build_edges
    makes them: so a node's first (max_nodes + max_hops) * relations edges are all that can count. Queries with the same
    seeds, of which each has a few, share one search.
    """
    sets = seeds.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("seeds")).withColumn("set", F.to_json("seeds"))
    each = sets.groupBy("set").agg(F.first("seeds").alias("seeds")).select(F.col("set").alias("qid"), F.explode("seeds").alias("s")).select("qid", "s.place", "s.key")
    paths = _search(each, edges, max_nodes, max_hops).withColumnRenamed("qid", "set")
    return sets.select("qid", "set").join(paths, "set").select("qid", "ordinal", "nodes", "rels", "score")


def _prefix(paths: DataFrame, max_nodes: int) -> DataFrame:
    """paths with their ordinal, without those before which max_nodes targets have been reached."""
    order = Window.partitionBy("qid").orderBy("place", "hop", "es")
    paths = paths.withColumn("ordinal", F.row_number().over(order)).withColumn("target", F.element_at("nodes", -1))
    new = (F.row_number().over(Window.partitionBy("qid", "target").orderBy("ordinal")) == 1).cast("int")
    met = F.coalesce(F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return paths.withColumn("new", new).withColumn("met", met).where(F.col("met") < max_nodes).drop("new", "met", "target")


def _search(seeds: DataFrame, edges: DataFrame, max_nodes: int, max_hops: int) -> DataFrame:
    """Hop by hop: the paths that the last one added go on along the edges of their ends.

    Of what stands before a path in the whole order, a part is known after each hop. Where that part reaches max_nodes
    targets already, neither the path nor what follows from it can count, and both go before the next hop.
    """
    edges = edges.withColumn("e", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "rel")))
    edges = edges.where(F.col("e") <= (max_nodes + max_hops) * len(EDGE_TYPES))
    edges = materialise(edges.select("src", F.col("rel").alias("_rel"), F.col("dst").alias("_dst"), F.col("weight").alias("_weight"), "e"), "edges")
    step = lambda hop: (F.lit(hop).alias("hop"), F.concat("es", F.array("e")).alias("es"), F.concat("nodes", F.array("_dst")).alias("nodes"), F.concat("rels", F.array("_rel")).alias("rels"), (F.col("_weight") / (hop + 1)).alias("score"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    ends = seeds.select("qid", "place", none("int").alias("es"), F.array("key").alias("nodes"), none("string").alias("rels"))
    paths = None
    for hop in range(1, max_hops + 1):
        met = ends.withColumn("src", F.element_at("nodes", -1)).join(edges, "src").where(~F.array_contains("nodes", F.col("_dst"))).select("qid", "place", *step(hop))
        paths = _prefix(met if paths is None else paths.unionByName(met), max_nodes)
        if hop < max_hops:
            paths = materialise(paths, "paths").drop("ordinal")
            ends = paths.where(F.col("hop") == hop).select("qid", "place", "es", "nodes", "rels")
    return paths.select("qid", "ordinal", "nodes", "rels", "score")


def collect_chunk_ids(paths: DataFrame, nodes: DataFrame, best: int = 12, limit: int = 40) -> DataFrame:
    """(qid, ids): the first PER_NODE chunks of each node on the best paths by score, in order, without repeats."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ordinal"))
    top = paths.withColumn("place", place).where(F.col("place") <= best).select("qid", "place", F.posexplode("nodes").alias("at", "key"))
    few = top.join(nodes.select("key", F.slice("chunk_ids", 1, PER_NODE).alias("ids")), "key")
    rows = few.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "at", "ids"))).alias("all"))
    return rows.select("qid", F.slice(F.array_distinct(F.flatten(F.transform("all", lambda x: x["ids"]))), 1, limit).alias("ids"))


def retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 6, best: int = 12, most: int = 40) -> DataFrame:
    """queries: (qid, text) -> hits (qid, id, score, rank): the chunks of the nodes on the best paths from the entities that a
    text names. The score is 1 / (1 + rank)."""
    ids = collect_chunk_ids(traverse(match_entities(queries, nodes, limit), edges), nodes, best, most)
    return ids.select("qid", F.posexplode("ids").alias("rank", "id")).select("qid", "id", (F.lit(1.0) / (1 + F.col("rank"))).alias("score"), "rank")


def neighbors_of(edges: DataFrame, key: Column | str, relation: str | None = None) -> DataFrame:
    found = edges.where(F.col("src") == key)
    return found if relation is None else found.where(F.col("rel") == relation)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): totals, nodes by type, edges by relation."""
    by_type = nodes.rollup("node_type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.coalesce("node_type", F.lit("all")).alias("name"), "n")
    by_relation = edges.rollup("rel").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.coalesce("rel", F.lit("all")).alias("name"), "n")
    return by_type.unionByName(by_relation)
