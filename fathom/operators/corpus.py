"""Corpus building: sampling, quotas, chunking."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import TOKENS_PER_WORD, count_tokens, detect_section, normalize_breaks, quality_gate, split_sentences, stable_id, words
from fathom.operators.order import positions_by
from fathom.session import materialise, spread

CHILD, OVERLAP, PARENT = 450, 60, 2000


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash: the same on every run and cluster."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)


def quotas(available: DataFrame, limit: int) -> DataFrame:
    """available: (source, n) -> (source, quota): equal shares, what a source can't fill going to the others.

    The smallest sources are served whole until the rest's equal share is below what each has; the remainder of that share
    goes, one each, to the smallest unfilled ones, ties by name.
    """
    every = Window.partitionBy(F.lit(0))
    by_size = every.orderBy("n", "source")
    before = F.coalesce(F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = available.withColumn("place", F.row_number().over(by_size)).withColumn("before", before).withColumn("m", F.count("*").over(every))
    rows = rows.withColumn("left", F.greatest(F.lit(0), F.lit(limit) - F.col("before"))).withColumn("after", F.col("m") - F.col("place") + 1)
    unfilled = F.when(F.col("n") * F.col("after") > F.col("left"), F.struct("place", "left", "after"))
    level = F.first(unfilled, ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    share = F.floor(F.col("level.left") / F.col("level.after"))
    extra = F.col("place") - F.col("level.place") < F.col("level.left") % F.col("level.after")
    quota = F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), F.col("n")).otherwise(F.least("n", share + extra.cast("long")))
    return rows.select("source", quota.cast("long").alias("quota"))


def stratified(docs: DataFrame, limit: int, min_chars: int = 1200) -> DataFrame:
    """The usable documents of a source-balanced corpus: doc_id, source, n (the place in its source, from 1).

    Each source gives its quota by even stride through its usable documents in doc_id order.
    """
    usable = spread(docs.select("doc_id", "source", "text")).where(quality_gate(F.col("text"), min_chars).isNull()).select("doc_id", "source")
    rows = positions_by(materialise(usable, "usable"), "source", ["doc_id"], "place")  # texts are read once
    given = quotas(rows.groupBy("source").agg(F.count("*").alias("n")), limit)
    rows = rows.join(F.broadcast(given), rows.source.eqNullSafe(given.source)).drop(given.source)  # one row a source
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.lit(1), F.col("quota"))))
    rows = rows.where((F.col("place") % stride == 0) & (F.col("place") / stride < F.col("quota")))
    return rows.select("doc_id", "source", (F.floor(F.col("place") / stride) + 1).alias("n"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def pack(units: Column, limit: int, overlap: int = 0) -> Column:
    """Greedy blocks of whole units of at most limit estimated tokens, each as an array of units.

    A new block begins with the last units of the one before, as many as fit in overlap. A unit over the limit becomes
    blocks of its own, cut by words, without overlap.

    Each unit's words are counted once. The fold over the counts keeps numbers only: where the current block begins, its
    tokens, and the blocks so far as (first unit, last unit), a unit of its own having its last before its first.
    """
    wrap = int(limit / TOKENS_PER_WORD)
    span = lambda first, last: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))
    state = lambda blocks, first, t: F.struct(blocks.alias("blocks"), first.cast("int").alias("first"), t.cast("int").alias("t"))

    def tail(ns: Column, first: Column, last: Column) -> Column:
        """The first of the units up to last that fit in overlap, and their tokens."""
        if not overlap:
            return F.struct((last + 1).alias("first"), F.lit(0).alias("t"))
        start = F.struct((last + 1).alias("first"), F.lit(0).alias("t"), F.lit(True).alias("go"))
        back = F.slice(ns, first, last - first + 1)

        def step(acc: Column, n: Column) -> Column:
            fits = acc["go"] & (acc["t"] + n <= overlap)
            return F.when(fits, F.struct((acc["first"] - 1).alias("first"), (acc["t"] + n).alias("t"), F.lit(True).alias("go"))).otherwise(F.struct(acc["first"].alias("first"), acc["t"].alias("t"), F.lit(False).alias("go")))

        return F.aggregate(F.reverse(back), start, step)

    def flushed(acc: Column, last: Column) -> Column:
        """The blocks with the current one, which ends at last, if it has units."""
        return F.when(last >= acc["first"], F.array_append(acc["blocks"], span(acc["first"], last))).otherwise(acc["blocks"])

    def fold(ns: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            n = F.element_at(ns, i)
            long = state(F.array_append(flushed(acc, i - 1), span(i, F.lit(0))), i + 1, F.lit(0))
            full = (acc["t"] + n > limit) & (i > acc["first"])
            begun = _let(tail(ns, acc["first"], i - 1), lambda k: state(flushed(acc, i - 1), k["first"], k["t"] + n))
            return F.when(n > limit, long).when(full, begun).otherwise(state(acc["blocks"], acc["first"], acc["t"] + n))

        places = F.when(F.size(ns) > 0, F.sequence(F.lit(1), F.size(ns))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, state(F.array().cast("array<struct<first: int, last: int>>"), F.lit(1), F.lit(0)), step, lambda acc: flushed(acc, F.size(ns)))

    def cut(unit: Column) -> Column:
        return _let(words(unit), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / wrap).cast("int")), lambda i: F.array(F.array_join(F.slice(w, i * wrap + 1, F.lit(wrap)), " "))))

    def whole(block: Column) -> Column:
        own = F.array(F.slice(units, block["first"], block["last"] - block["first"] + 1))
        return F.when(block["last"] > 0, own).otherwise(cut(F.element_at(units, block["first"])))

    counts = F.transform(units, count_tokens)
    return F.flatten(F.transform(_let(counts, fold), whole))


def chunk_documents(docs: DataFrame, separator: str = "\n\n", child: int = CHILD, overlap: int = OVERLAP, parent: int = PARENT) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text, title, source, url) -> parents and children, with stable ids. Blank texts have neither."""
    units = F.filter(F.transform(F.split(normalize_breaks(F.col("text")), separator), lambda p: F.trim(p)), lambda p: p != "")
    rows = spread(docs.select("doc_id", "title", "source", "url", "text")).select("doc_id", "title", "source", "url", units.alias("units"))
    blocks = rows.select("doc_id", "title", "source", "url", F.posexplode(pack(F.col("units"), parent)).alias("p", "block"))
    text = F.array_join("block", " ")
    parents = blocks.select(stable_id("p", F.col("doc_id"), F.col("p")).alias("parent_id"), "doc_id", text.alias("text"), "title", "source", detect_section(text).alias("section"), "p", "url")
    cut = parents.select("parent_id", "doc_id", "title", "source", "section", "url", "p", split_sentences(F.col("text")).alias("units"))
    cut = cut.select("parent_id", "doc_id", "title", "source", "section", "url", "p", F.posexplode(pack(F.col("units"), child, overlap)).alias("c", "block"))
    text = F.array_join("block", " ")
    children = cut.select(stable_id("c", F.col("doc_id"), F.col("p"), F.col("c")).alias("chunk_id"), "parent_id", "doc_id", text.alias("text"), "title", "source", "section", "url", count_tokens(text).alias("token_count"))
    return parents.drop("p", "url"), children
