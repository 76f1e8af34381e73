"""The bounded answer loop: routing, drafting, checking, and the decision to answer, retry or escalate."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import CITATION, citations, strip
from fathom.session import materialise

THRESHOLD, MAX_REFORMULATIONS = 0.75, 2
ABSTAIN = "INSUFFICIENT_EVIDENCE"


def retrievers(route: Column) -> Column:
    """The retrievers that a route asks."""
    return F.when(route == "needs_relationship_reasoning", F.array(F.lit("vector"), F.lit("graph"))).when(route == "needs_patient_context", F.array(F.lit("vector"), F.lit("risk"))).otherwise(F.array(F.lit("vector")))


def valid_request(query: Column, patient_id: Column) -> Column:
    """ok, bad query or bad id."""
    ok = F.length(query).between(3, 2000) & (strip(query) != "")
    return F.when(~F.coalesce(ok, F.lit(False)), "bad query").when(patient_id.isNotNull() & ~patient_id.rlike(r"^[\p{L}\p{N}]{1,64}$"), "bad id").otherwise("ok")


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def question_text(stem: Column, options: Column) -> Column:
    """stem and one line an option; options: array of (label, body)."""
    return F.concat_ws("\n", stem, F.array_join(F.transform(options, lambda o: F.concat_ws(") ", o["label"], o["body"])), "\n"))


def describe_path(edges: Column) -> Column:
    """edges: array of (source, relation, target)."""
    return F.array_join(F.transform(edges, lambda e: F.concat(e["source"], F.lit(" -["), e["relation"], F.lit("]-> "), e["target"])), " → ")


def decision(score: Column, attempt: Column, threshold: float = THRESHOLD, max_reformulations: int = MAX_REFORMULATIONS) -> Column:
    """final, reformulate or escalate. No score counts as 0: it fails closed."""
    return F.when(F.coalesce(score, F.lit(0.0)) >= threshold, "final").when(F.coalesce(attempt, F.lit(0)) <= max_reformulations, "reformulate").otherwise("escalate")


def cited_blocks(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks (run_id, position, ...) whose position an answer (run_id, answer) cites."""
    cited = answers.select("run_id", F.explode(citations(F.col("answer"))).alias("position"))
    return blocks.join(cited, ["run_id", "position"], "left_semi")


def escalation(best: Column, attempts: Column, blocks: Column) -> Column:
    return F.concat(F.lit("No grounded answer after "), counted(attempts, "attempt"), F.lit(" over "), counted(blocks, "source"), F.format_string("; best groundedness %.2f.", best))


def run_loop(runs: DataFrame, draft: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], reformulate: Callable[[DataFrame], DataFrame] | None = None, threshold: float = THRESHOLD, max_reformulations: int = MAX_REFORMULATIONS) -> DataFrame:
    """runs: (run_id, query, ...). Each pass drafts and judges the runs still open; at most max_reformulations + 1 passes.

    draft adds answer; judge adds groundedness; reformulate changes query. One row a run: run_id, answer, groundedness, best,
    attempts, outcome, query (as it was last asked). Each pass is written before it is judged and before the next one begins:
    a draft is made once, and the answer, its score and the decision are of the same draft, whatever made it.
    """
    best = F.lit(0.0)
    open_, done = runs.withColumn("best", best), None
    for attempt in range(1, max_reformulations + 2):
        judged = judge(materialise(draft(open_.withColumn("attempt", F.lit(attempt))), "drafts"))
        score = F.when(F.col("answer") == ABSTAIN, 0.0).otherwise(F.coalesce("groundedness", F.lit(0.0)))
        judged = judged.withColumn("groundedness", score).withColumn("best", F.greatest("best", score)).withColumn("outcome", decision(score, F.col("attempt"), threshold, max_reformulations))
        judged = materialise(judged, "judged")
        asked = F.col("query") if "query" in judged.columns else F.lit(None).cast("string")
        ended = judged.where("outcome <> 'reformulate'").select("run_id", "answer", "groundedness", "best", F.col("attempt").alias("attempts"), "outcome", asked.alias("query"))
        done = ended if done is None else done.unionByName(ended)
        open_ = judged.where("outcome = 'reformulate'").select(*runs.columns, "best")
        open_ = reformulate(open_) if reformulate else open_
    return done


def without_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, CITATION, "")


def audit_rows(done: DataFrame) -> DataFrame:
    """The log rows of finished runs: (run_id, node, event, detail), detail being the run as JSON."""
    return done.select("run_id", F.lit("run").alias("node"), F.col("outcome").alias("event"), F.to_json(F.struct("query", "answer", "groundedness", "best", "attempts", "outcome")).alias("detail"))
