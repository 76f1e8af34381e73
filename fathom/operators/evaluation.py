"""Evaluation statistics."""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.numbers import clamp, wilson
from fathom.functions.text import content_tokens, split_claims
from fathom.operators.order import quantiles, running_sums
from fathom.session import materialise

#: Places of a block that is resampled with one seed, draws held at once, and tasks a core.
BLOCK, DRAWN, TASKS = 2048, 1 << 17, 4
#: A Poisson(1) number is at most k with AT_MOST[k]; SIXTEEN has it by the first 16 bits of a random number, or OPEN.
AT_MOST = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
OPEN = 255
_low, _high = (np.searchsorted(AT_MOST, np.arange(65536) / 65536 + x, "right") for x in (0, 1 / 65536))
SIXTEEN = np.where(_low == _high, _low, OPEN).astype(np.uint8)


def summarize(rows: DataFrame) -> DataFrame:
    """rows: (benchmark, path, correct, escalated, unparseable, latency). One row a benchmark and path, and one a path over all."""
    sums = [
        F.count("*").alias("n"), F.count_if("correct").alias("hits"), F.count_if(~F.col("escalated")).alias("answered"), F.count_if(F.col("correct") & ~F.col("escalated")).alias("good"),
        F.count_if("escalated").alias("n_escalated"), F.count_if("unparseable").alias("n_unparseable"), F.round(F.avg("latency"), 4).alias("mean_latency"),
    ]
    both = rows.groupingSets([["benchmark", "path"], ["path"]], "benchmark", "path").agg(*sums)
    low, high = wilson(F.col("hits"), F.col("n"))
    return both.select(
        F.coalesce("benchmark", F.lit("all")).alias("benchmark"), "path", "n", F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"), F.when(F.col("answered") > 0, F.round(F.col("good") / F.col("answered"), 6)).alias("answered_accuracy"),
        F.round(F.col("answered") / F.col("n"), 6).alias("coverage"), F.col("n_escalated").alias("escalated"), F.col("n_unparseable").alias("unparseable"), "mean_latency", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"),
    )


def nearest_rank(rows: DataFrame, by: str, value: str, q: float = 0.95) -> DataFrame:
    """(by, mean, median, p95, n): the interpolated median, and the value at the rank that is nearest to q, half to even."""
    rows = rows.select(by, value).where(F.col(value).isNotNull())
    means = rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"))
    ranks = quantiles(rows, by, value, {"p95": q}, nearest=True).join(quantiles(rows, by, value, {"median": 0.5}).drop("n"), by)
    return means.join(ranks, by).select(by, "mean", F.round("median", 6).alias("median"), "p95", "n")


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Of two sets as arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(part: Column, whole: Column) -> Column:
    """The share of part's tokens that whole has; 0 for no tokens."""
    return F.when(F.size(part) == 0, 0.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def lexical_faithfulness(answer: Column, contexts: Column, share: float = 0.6) -> Column:
    """The share of the answer's claims whose content tokens the contexts' tokens cover to `share`; 0 without claims."""
    known = F.array_distinct(F.flatten(F.transform(contexts, content_tokens)))
    claims = split_claims(answer)
    supported = F.filter(claims, lambda c: (F.size(content_tokens(c)) > 0) & (coverage(content_tokens(c), known) >= share))
    return F.when(F.size(claims) == 0, 0.0).otherwise(F.size(supported) / F.size(claims))


def faithfulness(supported: Column, total: Column, reported: Column, lexical: Column) -> Column:
    """A judge's supported / total, else its reported score, else the lexical one; within 0 and 1."""
    return clamp(F.coalesce(supported / F.nullif(total, F.lit(0)), reported, lexical), 0.0, 1.0)


def answer_relevance(question: Column, answer: Column) -> Column:
    return coverage(content_tokens(question), content_tokens(answer))


def context_precision(question: Column, contexts: Column, share: float = 0.3) -> Column:
    hits = F.filter(contexts, lambda c: coverage(content_tokens(question), content_tokens(c)) >= share)
    return F.when(F.size(contexts) == 0, 0.0).otherwise(F.size(hits) / F.size(contexts))


def context_recall(reference: Column, contexts: Column, share: float = 0.6) -> Column:
    return lexical_faithfulness(reference, contexts, share)


def _by_score(rows: DataFrame) -> DataFrame:
    """(score, n, pos): rows and positives at each distinct score; ties, however many, are one row."""
    return rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))


def steps(rows: DataFrame) -> DataFrame:
    """rows: (score, label 0/1) -> (score, n, pos, below, hits): at each distinct score its rows and positives, and the negatives
    and positives of all lower scores. The areas and their intervals follow from it."""
    return running_sums(_by_score(rows), ["score"], {"below": F.col("n") - F.col("pos"), "hits": F.col("pos")})


def auc_of_steps(found: DataFrame) -> DataFrame:
    right = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2))
    return found.agg((right / F.nullif((F.sum("pos") * F.sum(F.col("n") - F.col("pos"))).cast("double"), F.lit(0.0))).alias("auc"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """rows: (score, label 0/1) -> auc: of all pairs of a positive and a negative, the share ranked right; ties count half."""
    return auc_of_steps(steps(rows))


def precision_of_steps(found: DataFrame) -> DataFrame:
    all_pos, all_n = found.agg(F.sum("pos"), F.sum("n")).first()
    hits = F.lit(all_pos) - F.col("hits")  # at this score and all higher ones
    precision = hits / (F.lit(all_n) - F.col("hits") - F.col("below"))
    return found.agg((F.sum(F.col("pos") * precision) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def average_precision(rows: DataFrame) -> DataFrame:
    """rows: (score, label 0/1) -> average_precision: the sum over distinct thresholds of recall gained times precision."""
    return precision_of_steps(materialise(steps(rows), "steps"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"), F.avg("score").alias("mean_predicted"), F.avg("label").alias("observed"))


def draw(rng: np.random.Generator, counts: np.ndarray, resamples: int) -> np.ndarray:
    """(cells, resamples): how often the rows of each cell are drawn, a Poisson number with the mean of its rows.

    Sixteen random bits tell a Poisson(1) number by a table; where its steps lie within their range, further bits do.
    """
    bits = rng.bit_generator.random_raw(-(-len(counts) * resamples // 4)).view(np.uint16)[: len(counts) * resamples]
    out = SIXTEEN[bits]
    open_bits = np.flatnonzero(out == OPEN)
    out[open_bits] = np.searchsorted(AT_MOST, (bits[open_bits] + rng.random(len(open_bits))) / 65536, "right")
    out = out.reshape(len(counts), resamples)
    ties = np.flatnonzero(counts > 1)
    if len(ties):
        out = out.astype(np.int64)
        out[ties] = rng.poisson(counts[ties, None], (len(ties), resamples))
    return out


def resample(rng: np.random.Generator, n: np.ndarray, pos: np.ndarray, resamples: int) -> np.ndarray:
    """(3, resamples): positives, negatives, and pairs ranked right, of resamples of rows with n and pos by ascending score."""
    counts = np.stack([n - pos, pos], 1).ravel()  # a score's negatives, then its positives
    kept = np.flatnonzero(counts)
    positive = kept % 2 == 1
    own_at, other_at = np.flatnonzero(positive), np.flatnonzero(~positive)
    tied = np.flatnonzero(positive[1:] & (kept[1:] == kept[:-1] + 1)) + 1
    before = np.cumsum(~positive)[positive]  # how many cells of negatives precede each of positives
    exact = np.int32 if counts.sum() < 4 * BLOCK else np.float64  # sums of few rows' products fit
    out = np.zeros((3, resamples))
    step = max(1, DRAWN // max(1, len(kept)))
    for at in range(0, resamples, step):
        drawn = draw(rng, counts[kept], min(step, resamples - at))
        own = drawn[own_at].astype(exact)
        below = np.zeros((len(other_at) + 1, drawn.shape[1]), exact)
        np.cumsum(drawn[other_at], axis=0, dtype=exact, out=below[1:])
        right = np.einsum("ij,ij->j", own, below[before]).astype(float)
        if len(tied):  # of pairs of one score half are right
            right -= (drawn[tied].astype(float) * drawn[tied - 1]).sum(axis=0) / 2
        out[:, at : at + drawn.shape[1]] = own.sum(axis=0), below[-1], right
    return out


def auc_bootstrap(rows: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """low, high: the 2.5 and 97.5 percentiles of the area over Poisson resamples; those without both classes are left out.

    A row is drawn a Poisson(1) number of times, so n rows of one score and label are drawn a Poisson(n) number of times.
    """
    return interval_of_steps(steps(rows.where("score is not null and label is not null")), resamples, seed)


def interval_of_steps(found: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """auc_bootstrap of steps. Scores are resampled a block of places at a time, with the block's own seed, however they are dealt
    over tasks. Each task sends one row a resample: its positives, negatives, and the pairs ranked right within it."""

    def run(batches):
        part = TaskContext.get().partitionId()
        total = np.zeros((3, resamples))  # positives, negatives, pairs

        def add(block, n, pos):
            own = resample(np.random.default_rng([seed, block]), n, pos, resamples)
            total[2] += own[2] + own[0] * total[1]
            total[:2] += own[:2]

        held, open_block = [], None  # the scores of a block that may go on in the next batch
        for batch in batches:
            blocks, n, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "n", "pos"))
            for own in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1) if len(blocks) else []:
                if held and blocks[own[0]] != open_block:
                    add(open_block, *(np.concatenate(x) for x in zip(*held)))
                    held = []
                open_block = int(blocks[own[0]])
                held.append((n[own], pos[own]))
        if held:
            add(open_block, *(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(resamples, part)), pa.array(np.arange(resamples)), *map(pa.array, total)], ["part", "resample", "pos", "neg", "inside"])

    block = F.floor((F.col("below") + F.col("hits")) / BLOCK).cast("long").alias("block")
    tasks = TASKS * found.sparkSession.sparkContext.defaultParallelism  # by work, not by bytes, of which there are few
    dealt = found.select(block, "score", "n", F.col("pos").cast("long").alias("pos")).repartitionByRange(tasks, "block").sortWithinPartitions("block", "score")
    sums = dealt.select("block", "n", "pos").mapInArrow(run, "part long, resample long, pos double, neg double, inside double")
    below = Window.partitionBy("resample").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("right", F.col("inside") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    pairs = F.sum("pos") * F.sum("neg")
    areas = sums.groupBy("resample").agg((F.sum("right") / F.nullif(pairs, F.lit(0.0))).alias("auc")).where("auc is not null")
    return areas.agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))


def mean_pairwise_redundancy(hits: DataFrame) -> DataFrame:
    """hits: (qid, pos, tokens) -> (qid, redundancy): the mean similarity of the query's pairs of hits; 0 with fewer than two.

    A query has at most a few dozen hits: they are the result of a top-k, and pairs are made within a query only.
    """
    a, b = hits.alias("a"), hits.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.pos") < F.col("b.pos")))
    means = pairs.groupBy("a.qid").agg(F.avg(jaccard(F.col("a.tokens"), F.col("b.tokens"), 1.0)).alias("m"))
    return hits.select("qid").distinct().join(means, "qid", "left").select("qid", F.coalesce("m", F.lit(0.0)).alias("redundancy"))


def redundancy_drop(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the mean redundancy of the queries' hits before and after a selection, and the relative drop (0 from 0)."""
    means = lambda hits, name: mean_pairwise_redundancy(hits).agg(F.avg("redundancy").alias(name))
    both = means(before, "before").join(means(after, "after"))  # one row each
    return both.withColumn("drop", F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0))
