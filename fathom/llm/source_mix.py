"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import WORD, materialise, whole

BINS = 4096


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """row: the document as it came; the size, the seeded place in its source's order and that place's bin."""
    row = docs.select(F.struct("*").alias("row"))
    source = F.col("row.source")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row.doc_id").cast("string")).cast("binary"))
    return row.select(
        "row",
        F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)).alias("sk"),
        F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        F.conv(F.substr(key, F.lit(1), F.lit(3)), 16, 10).cast("int").alias("bin"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sources: one row (sk, source, source_size) each. Adds weight and target.

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes. A source stops at
    max_epochs times its size. Sorted by the level at which they stop, the stopped sources come first; the first that
    does not stop fixes the level of all after it.
    """
    everything = Window.partitionBy(F.lit(0))
    by_code_point = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("place", F.row_number().over(by_code_point))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights) + 1).cast("long"))
    cap = F.col("source_size") * max_epochs
    by_level = everything.orderBy(cap / F.col("weight"), "place")
    before = F.coalesce(F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("room", F.sum("source_size").over(everything) - before).withColumn("rest", rest)
    open_ = F.when(cap * F.col("rest") > F.col("room") * F.col("weight"), F.struct("room", "rest"))
    level = F.first(open_, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = filled.withColumn("open", open_.isNotNull()).withColumn("level", level)
    share = F.col("level.room").cast("double") * F.col("weight").cast("double") / F.col("level.rest").cast("double")
    return filled.withColumn("target", F.when(F.col("open"), share).otherwise(cap.cast("double"))).drop("room", "rest", "open", "level", "place")


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """One row a source: source_size, target, whole repetitions of all its documents, and where the fractional one ends.

    The fractional repetition runs through the source's documents in a seeded order until `part` words are taken. The
    order is cut in BINS bins by hash, so that no source, however large, is sorted in one task: `edge` is the bin in which
    it ends, `left` the words still to be taken there.
    """
    bins = _sized(docs, seed).groupBy("sk", "bin").agg(F.sum("size").alias("bin_size"), F.first("row.source").alias("source"))
    bins = materialise(bins, "mix-bins")
    sources = bins.groupBy("sk").agg(F.first("source").alias("source"), F.sum("bin_size").alias("source_size"))
    goal = targets(sources, weights, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).drop("source")
    upto = F.coalesce(F.sum("bin_size").over(Window.partitionBy("sk").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = bins.withColumn("upto", upto).join(goal, "sk").where((F.col("upto") <= F.col("part")) & (F.col("part") < F.col("upto") + F.col("bin_size")))
    edge = edge.groupBy("sk").agg(F.min("bin").alias("edge"), F.min(F.col("part") - F.col("upto")).alias("left"))
    goal = goal.join(edge, "sk", "left").withColumn("edge", F.coalesce("edge", F.when(F.col("part") > 0, BINS).otherwise(-1)))
    return materialise(goal, "mix-plan")


def _taken(docs: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    rows = _sized(docs, seed).join(goal, "sk")
    sure = rows.where(F.col("bin") != F.col("edge")).withColumn("part_taken", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(0))
    order = Window.partitionBy("sk").orderBy("key", "row.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("size").over(order), F.lit(0))
    at_edge = rows.where(F.col("bin") == F.col("edge")).withColumn("part_taken", F.greatest(F.lit(0), F.least(F.col("left") - upto, "size")))
    return sure.unionByName(at_edge).withColumn("taken", F.col("whole") * F.col("size") + F.col("part_taken"))


@whole
def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted).

    Null or blank texts have size 0 and nothing taken. Null is a source of its own, after all others. Repeated rows are
    documents of their own. Documents with one place in the order go by doc_id and size, so reruns agree. An empty table
    gives no rows. Other columns are not read. Each source's taken words are its target rounded to a word.
    """
    docs = docs.select("doc_id", "text", "source")
    return _taken(docs, plan(docs, weights, max_epochs, seed), seed).select("row.doc_id", "size", "source_size", "target", "taken")


@whole
def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole repetition, and the first words of the document
    (with the white space between them) where the fractional one ends within it. n_chars, if there, follows the text.

    Null and blank texts have no words, so no row. Null is a source of its own. A very long text is cut as any other. Repeated
    rows are documents of their own; of ties in the seeded order the smaller doc_id, then the shorter text, comes first. An
    empty table gives no rows. Columns of docs may have any names.
    """
    rows = _taken(docs, plan(docs, weights, max_epochs, seed), seed)
    cut = (F.col("part_taken") > 0) & (F.col("part_taken") < F.col("size"))
    head = F.regexp_extract("row.text", r"^[\x20\x09-\x0D]*", 0)
    words = F.slice(F.regexp_extract_all("row.text", F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1)), F.lit(1), F.col("part_taken").cast("int"))
    piece = F.concat(head, F.array_join(words, ""))
    copies = F.concat(
        F.array_repeat(F.struct(F.lit(False).alias("cut")), (F.col("whole") + (F.col("part_taken") == F.col("size")).cast("long")).cast("int")),
        F.array_repeat(F.struct(F.lit(True).alias("cut")), cut.cast("int")),
    )
    rows = rows.where(F.col("taken") > 0).withColumn("copy", F.explode(copies))
    text = F.when(F.col("copy.cut"), piece).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("copy.cut"), F.length(piece)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*[changed[c].cast(t).alias(c) if c in changed else F.col("row")[c].alias(c) for c, t in docs.dtypes])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || doc_id) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(weight) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s
), o AS (
  SELECT *, 3 * source_size * rest > room * weight AS open FROM f
), t AS (
  SELECT source, source_size, CASE WHEN open THEN (SELECT arg_min(room::DOUBLE, 3 * source_size / weight) FROM o WHERE open) * weight::DOUBLE / (SELECT arg_min(rest::DOUBLE, 3 * source_size / weight) FROM o WHERE open)
         ELSE (3 * source_size)::DOUBLE END AS target
  FROM o
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), r AS (
  SELECT *, round(target - whole * source_size)::BIGINT AS part FROM w
)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (r.whole * d.size + greatest(0, least(r.part - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), d.size)))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
