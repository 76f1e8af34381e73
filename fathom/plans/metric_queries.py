"""Evaluation and audit queries, batch and streaming."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import agent, audit, evaluation, retrieval
from fathom.plans.registry import query, read, sql_claims, sql_content, sql_tokens
from fathom.plans.search_queries import BM25_SQL, DENSE_SQL, EVERY_DENSE_SQL, RRF_SQL, dense_hits, docs_and_queries, fused_hits, mmr_sql, passages, sparse_hits, vectors_of
from fathom.session import materialise

TOP10 = "d AS (SELECT qid, list(id) AS ids FROM dn WHERE rank < 10 GROUP BY qid), s AS (SELECT qid, list(id) AS ids FROM bm WHERE rank < 10 GROUP BY qid)"


def tops(spark, sf_dir, k=10):
    """Both searches' ids for every question. A vector that no question belongs to would meet nothing in the join: it isn't asked."""
    vectors, questions = vectors_of(spark, sf_dir), docs_and_queries(spark, sf_dir)[1]
    asked = vectors.withColumnRenamed("id", "qid").join(questions, "qid", "left_semi")
    ids = lambda hits, name: hits.where(F.col("rank") < k).groupBy("qid").agg(F.collect_list("id").alias(name))
    return ids(retrieval.dense(vectors, asked), "d").join(ids(sparse_hits(spark, sf_dir), "s"), "qid")


@query(f"WITH {BM25_SQL}, {EVERY_DENSE_SQL}, {TOP10} SELECT qid, len(list_intersect(d.ids, s.ids))::DOUBLE / len(list_distinct(d.ids || s.ids)) AS overlap, len(list_filter(d.ids, lambda x: list_contains(s.ids, x))) = 0 AS complementary FROM d JOIN s USING (qid)")
def overlap_at_10(spark, sf_dir):
    both = tops(spark, sf_dir)
    return both.select("qid", evaluation.jaccard(F.col("d"), F.col("s"), 1.0).alias("overlap"), (F.size(F.array_intersect("d", "s")) == 0).alias("complementary"))


@query(f"""WITH {BM25_SQL}, {DENSE_SQL}, {RRF_SQL}, t AS (SELECT qid, id, (qid, id) IN (SELECT qid, id FROM dn) AS d, (qid, id) IN (SELECT qid, id FROM bm) AS s FROM fused WHERE rank < 12)
SELECT qid, avg((d AND NOT s)::INTEGER) AS dense_only, avg((s AND NOT d)::INTEGER) AS sparse_only, avg((d AND s)::INTEGER) AS shared FROM t GROUP BY qid""")
def provenance(spark, sf_dir):
    found = lambda hits, name: hits.select("qid", "id", F.lit(1).alias(name))
    both = fused_hits(spark, sf_dir).where(F.col("rank") < 12).join(found(dense_hits(spark, sf_dir), "d"), ["qid", "id"], "left").join(found(sparse_hits(spark, sf_dir), "s"), ["qid", "id"], "left")
    share = lambda c, name: F.avg(c.cast("int")).alias(name)
    d, s = F.col("d").isNotNull(), F.col("s").isNotNull()
    return both.groupBy("qid").agg(share(d & ~s, "dense_only"), share(s & ~d, "sparse_only"), share(d & s, "shared"))


@query(f"""WITH {BM25_SQL}, t AS (SELECT qid, rank, list_distinct({sql_tokens('text')}) AS k FROM bm JOIN documents ON id = doc_id WHERE rank < 12)
SELECT a.qid, round(avg(len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(a.k || b.k))), 9) AS redundancy FROM t a JOIN t b ON a.qid = b.qid AND a.rank < b.rank GROUP BY a.qid""")
def redundancy(spark, sf_dir):
    few = materialise(sparse_hits(spark, sf_dir).where(F.col("rank") < retrieval.TOP), "hits")
    hits = retrieval.with_items(few, passages(spark, sf_dir)).select("qid", F.col("rank").alias("pos"), F.col("item").alias("tokens"))
    return evaluation.mean_pairwise_redundancy(hits).withColumn("redundancy", F.round("redundancy", 9))


@query(f"""WITH {BM25_SQL}, hits AS (SELECT qid, id, rank, {sql_tokens('text')} AS item FROM bm JOIN documents ON id = doc_id), {mmr_sql('hits', 12, 0.6)},
sets AS (SELECT qid, id, list_distinct(item) AS k FROM hits), few AS (SELECT qid, id FROM bm WHERE rank < 12), one AS (SELECT qid, id, k FROM few JOIN sets USING (qid, id)), two AS (SELECT qid, id, k FROM picked JOIN sets USING (qid, id)),
r AS (SELECT 'before' AS kind, a.qid, avg(len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(a.k || b.k))) AS m FROM one a JOIN one b ON a.qid = b.qid AND a.id < b.id GROUP BY a.qid UNION ALL SELECT 'after', a.qid, avg(len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(a.k || b.k))) FROM two a JOIN two b ON a.qid = b.qid AND a.id < b.id GROUP BY a.qid),
q AS (SELECT (SELECT avg(coalesce(m, 0)) FROM (SELECT DISTINCT qid FROM one) LEFT JOIN (SELECT * FROM r WHERE kind = 'before') USING (qid)) AS before, (SELECT avg(coalesce(m, 0)) FROM (SELECT DISTINCT qid FROM two) LEFT JOIN (SELECT * FROM r WHERE kind = 'after') USING (qid)) AS after)
SELECT round(before, 6) AS before, round(after, 6) AS after, round(CASE WHEN before > 0 THEN (before - after) / before ELSE 0 END, 6) AS drop FROM q""")
def redundancy_drop(spark, sf_dir):
    """How redundant the best hits are, and how much less so what diversity selection makes of the candidates."""
    hits = materialise(retrieval.with_items(materialise(sparse_hits(spark, sf_dir), "hits"), passages(spark, sf_dir)), "items")
    shown = lambda few: few.join(hits.select("qid", "id", F.col("item").alias("tokens")), ["qid", "id"]).select("qid", F.col("rank").alias("pos"), "tokens")
    before, after = hits.where(F.col("rank") < retrieval.TOP).select("qid", "id", "rank"), retrieval.mmr(hits)
    return evaluation.redundancy_drop(shown(before), shown(after)).select(*[F.round(c, 6).alias(c) for c in ("before", "after", "drop")])


def talks(spark, sf_dir):
    """One row a conversation: the question, the answer and its contexts."""
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    texts = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    return said.groupBy("conv_id").agg(F.array_join(texts("user"), " ").alias("question"), F.array_join(texts("assistant"), " ").alias("answer"), texts("user").alias("contexts"))


TALK_SQL = """talk AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS question, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS answer, coalesce(list(text ORDER BY turn) FILTER (role = 'user'), []) AS contexts FROM conversations GROUP BY conv_id)"""


def covered(part: str, whole: str) -> str:
    return f"(CASE WHEN len({part}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({part}, {whole}))::DOUBLE / len({part}) END)"


@query(f"""WITH {TALK_SQL}, c AS (SELECT conv_id, unnest({sql_claims('answer')}) AS claim, list_distinct(flatten([{sql_content('x')} FOR x IN contexts])) AS known FROM talk), r AS (SELECT conv_id, avg((len({sql_content('claim')}) > 0 AND {covered(sql_content('claim'), 'known')} >= 0.6)::INTEGER) AS share FROM c GROUP BY conv_id)
SELECT conv_id, coalesce(share, 0.0) AS lexical, CASE conv_id % 3 WHEN 0 THEN least(1.0, (conv_id % 5) / 4.0)::DOUBLE WHEN 1 THEN least(1.0, (conv_id % 7) / 5.0)::DOUBLE ELSE coalesce(share, 0.0) END AS faithfulness FROM talk LEFT JOIN r USING (conv_id)""")
def lexical_faithfulness(spark, sf_dir):
    k = F.col("conv_id")
    lexical = evaluation.lexical_faithfulness(F.col("answer"), F.col("contexts"))
    rows = talks(spark, sf_dir).select("conv_id", lexical.alias("lexical"))
    supported, reported = F.when(k % 3 == 0, k % 5), F.when(k % 3 == 1, (k % 7) / 5)
    return rows.select("conv_id", "lexical", evaluation.faithfulness(supported, F.lit(4), reported, F.col("lexical")).alias("faithfulness"))


@query(f"""WITH {TALK_SQL}, c AS (SELECT conv_id, unnest({sql_claims('answer')}) AS claim, list_distinct(flatten([{sql_content('x')} FOR x IN contexts])) AS known FROM talk), r AS (SELECT conv_id, avg((len({sql_content('claim')}) > 0 AND {covered(sql_content('claim'), 'known')} >= 0.6)::INTEGER) AS share FROM c GROUP BY conv_id),
p AS (SELECT conv_id, avg(({covered(sql_content('question'), sql_content('x'))} >= 0.3)::INTEGER) AS hit FROM (SELECT conv_id, question, unnest(contexts) AS x FROM talk) GROUP BY conv_id)
SELECT conv_id, {covered(sql_content('question'), sql_content('answer'))} AS relevance, coalesce(hit, 0.0) AS precision, coalesce(share, 0.0) AS recall FROM talk LEFT JOIN r USING (conv_id) LEFT JOIN p USING (conv_id)""")
def fallback_metrics(spark, sf_dir):
    q, a, c = F.col("question"), F.col("answer"), F.col("contexts")
    return talks(spark, sf_dir).select("conv_id", evaluation.answer_relevance(q, a).alias("relevance"), evaluation.context_precision(q, c).alias("precision"), evaluation.context_recall(a, c).alias("recall"))


SCORED_SQL = "s AS (SELECT quality AS label, least(1.0, round(ln(1 + n_chars) / 10, 2))::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def scored(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("quality").alias("label"), F.least(F.lit(1.0), F.round(F.log(1 + F.col("n_chars")) / 10, 2)).alias("score"))


@query(f"WITH {SCORED_SQL}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM s) SELECT round((sum(k) FILTER (label = 1) - count_if(label = 1) * (count_if(label = 1) + 1) / 2) / (count_if(label = 1) * count_if(label = 0)), 9) AS auc FROM r")
def auc(spark, sf_dir):
    return evaluation.roc_auc(scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {SCORED_SQL}, b AS (SELECT score, count(*) AS n, sum(label) AS pos FROM s GROUP BY score), c AS (SELECT pos, sum(pos) OVER w / sum(n) OVER w AS p FROM b WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(pos * p) / sum(pos), 9) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return evaluation.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {SCORED_SQL} SELECT round(avg((score - label) ** 2), 9) AS brier, round(avg(score), 9) AS mean_predicted, round(avg(label), 9) AS observed FROM s")
def brier(spark, sf_dir):
    return evaluation.brier(scored(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("brier", "mean_predicted", "observed")])


@query()
def auc_bootstrap(spark, sf_dir):
    return evaluation.auc_bootstrap(scored(spark, sf_dir))


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 100")
def audit_recent(spark, sf_dir):
    return audit.recent(read(spark, sf_dir, "events"), "event_id", 100).select("event_id", "event_type", "value")


@query("""WITH l AS (SELECT event_type, (value / 100)::DOUBLE AS g FROM events ORDER BY event_id DESC LIMIT 2000) SELECT count_if(event_type = 'purchase')::BIGINT AS answered, count_if(event_type = 'error')::BIGINT AS escalated, round(avg(g), 6) AS mean_groundedness, round(count_if(event_type = 'error') / (count_if(event_type = 'purchase') + count_if(event_type = 'error')), 6) AS rate FROM l""")
def audit_stats(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "purchase", "final").when(F.col("event_type") == "error", "escalate")
    return audit.stats(read(spark, sf_dir, "events"), "event_id", outcome, F.col("value") / 100)


@query("""WITH r AS (SELECT CASE WHEN value >= 75 THEN 'final' WHEN event_id % 4 = 0 THEN 'escalate' ELSE 'pending' END AS outcome, event_type AS route, (event_id % 4)::INTEGER AS attempts FROM events)
SELECT 'runs' AS family, '' AS label, count(*)::BIGINT AS value FROM r UNION ALL SELECT 'escalations', '', count_if(outcome = 'escalate')::BIGINT FROM r UNION ALL SELECT 'reformulations', '', sum(greatest(attempts - 1, 0))::BIGINT FROM r
UNION ALL SELECT 'outcome', outcome, count(*) FROM r GROUP BY outcome UNION ALL SELECT 'route', route, count(*) FROM r GROUP BY route""")
def audit_counters(spark, sf_dir):
    return audit.counters(runs(spark, sf_dir))


HIST_SQL = "WITH b AS (SELECT unnest([{bounds}]) AS b), e AS (SELECT value / 100 AS v FROM events) SELECT {le} AS le, count(v) AS n FROM b LEFT JOIN e ON v <= b GROUP BY b UNION ALL SELECT '+Inf', count(v) FROM e"


@query(HIST_SQL.format(bounds=", ".join(f"{b}::DOUBLE" for b in audit.GROUNDEDNESS), le="b::VARCHAR"))
def histogram_le(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select((F.col("value") / 100).alias("v"))
    return audit.histogram(rows, "v", audit.GROUNDEDNESS).select("le", "n")


COUNTER_SQL = """r AS (SELECT CASE WHEN value >= 75 THEN 'final' WHEN event_id % 4 = 0 THEN 'escalate' ELSE 'pending' END AS outcome, event_type AS route, (event_id % 4)::INTEGER AS attempts FROM events)"""


def runs(spark, sf_dir):
    """Events as runs with an outcome, a route and attempts."""
    outcome = F.when(F.col("value") >= 75, "final").when(F.col("event_id") % 4 == 0, "escalate").otherwise("pending")
    return read(spark, sf_dir, "events").select("event_id", "value", outcome.alias("outcome"), F.col("event_type").alias("route"), (F.col("event_id") % 4).alias("attempts"))


@query("SELECT 'run_seconds_bucket{le=\"' || le || '\"} ' || n AS line FROM (" + HIST_SQL.format(bounds=", ".join(f"{float(b)}::DOUBLE" for b in audit.LATENCY), le="b::VARCHAR") + f""") UNION ALL SELECT '# TYPE run_seconds histogram' UNION ALL SELECT format('run_seconds_sum {{:.4f}}', sum(value / 100)) FROM events UNION ALL SELECT 'run_seconds_count ' || count(value) FROM events
UNION ALL SELECT line FROM (WITH {COUNTER_SQL}, c AS (SELECT 'runs' AS f, '' AS l, count(*) AS n FROM r UNION ALL SELECT 'escalations', '', count_if(outcome = 'escalate') FROM r UNION ALL SELECT 'reformulations', '', sum(greatest(attempts - 1, 0)) FROM r UNION ALL SELECT 'outcome', outcome, count(*) FROM r GROUP BY outcome UNION ALL SELECT 'route', route, count(*) FROM r GROUP BY route)
SELECT DISTINCT '# TYPE agent_' || f || '_total counter' AS line FROM c UNION ALL SELECT 'agent_' || f || '_total' || CASE WHEN l = '' THEN '' ELSE '{{' || f || '="' || l || '"}}' END || ' ' || n::BIGINT FROM c)""")
def exposition(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select((F.col("value") / 100).alias("v"))
    return audit.exposition(audit.histogram(rows, "v", audit.LATENCY), "run_seconds").unionByName(audit.counter_lines(audit.counters(runs(spark, sf_dir)), "agent"))


@query("SELECT user_id AS client, epoch_us(date_trunc('minute', ts)) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_minute(spark, sf_dir):
    return audit.over_limit(read(spark, sf_dir, "events"), "user_id", "ts", 1)


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS seq FROM events")
def running_best(spark, sf_dir):
    return audit.running_best(read(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", "best", "seq")


@query("""SELECT event_id, CASE WHEN coalesce(s, 0) >= 0.75 THEN 'final' WHEN event_id % 5 <= 2 THEN 'reformulate' ELSE 'escalate' END AS decision FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 100 END AS s FROM events)""")
def critic_decision(spark, sf_dir):
    score = F.when(F.col("event_id") % 11 != 0, F.col("value") / 100)
    return read(spark, sf_dir, "events").select("event_id", agent.decision(score, F.col("event_id") % 5).alias("decision"))


@query("""WITH r AS (SELECT event_id AS run_id, value / 100 AS v FROM events), a AS (SELECT run_id, k, v * (1 + k * 0.1::DOUBLE) AS g FROM r, range(1, 4) t(k)), f AS (SELECT run_id, min(k) FILTER (g >= 0.75) AS k FROM a GROUP BY run_id)
SELECT run_id, round(g, 9) AS groundedness, round(g, 9) AS best, a.k::INTEGER AS attempts, CASE WHEN g >= 0.75 THEN 'final' ELSE 'escalate' END AS outcome FROM a JOIN f USING (run_id) WHERE a.k = coalesce(f.k, 3)""")
def agent_loop(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), (F.col("value") / 100).alias("v"))
    draft = lambda df: df.withColumn("answer", F.concat(F.lit("draft "), F.col("attempt").cast("string")))
    judge = lambda df: df.withColumn("groundedness", F.col("v") * (1 + F.col("attempt") * F.lit(0.1)))
    return agent.run_loop(runs, draft, judge).select("run_id", F.round("groundedness", 9).alias("groundedness"), F.round("best", 9).alias("best"), "attempts", "outcome")


@query(r"""WITH a AS (SELECT conv_id, turn, text || ' [' || (turn % 4 + 1) || ']' AS answer FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, p::INTEGER AS position FROM a, range(1, 9) b(p) WHERE p = turn % 4 + 1 OR contains(answer, '[' || p || ']')""")
def cited_blocks(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("run_id"), F.concat("text", F.lit(" ["), (F.col("turn") % 4 + 1).cast("string"), F.lit("]")).alias("answer"))
    blocks = said.select("run_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("position"))
    return agent.cited_blocks(said, blocks).select("run_id.conv_id", "run_id.turn", "position")


@query("""WITH r AS (SELECT event_id AS run_id, value / 100 AS v FROM events), a AS (SELECT run_id, k, least(1.0, v + CASE WHEN run_id % 2 = 0 THEN (k - 1) * 0.4::DOUBLE ELSE 0 END) AS g FROM r, range(1, 4) t(k)), f AS (SELECT run_id, min(k) FILTER (g >= 0.75) AS k, max(g) AS best FROM a GROUP BY run_id)
SELECT run_id, CASE WHEN g >= 0.75 THEN 'final' ELSE 'escalate' END AS event, a.k::INTEGER AS attempts, round(g, 6) AS groundedness, 'q' || run_id || CASE WHEN run_id % 2 = 0 THEN repeat(' again', a.k::INTEGER - 1) ELSE '' END AS query FROM a JOIN f USING (run_id) WHERE a.k = coalesce(f.k, 3)""")
def audit_rows(spark, sf_dir):
    """One log row a finished run, of a loop in which a reworded question finds better grounds."""
    runs = read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.concat(F.lit("q"), "event_id").alias("query"), (F.col("value") / 100).alias("v"))
    draft = lambda df: df.withColumn("answer", F.concat(F.lit("draft "), F.col("attempt").cast("string")))
    words = F.size(F.split("query", " ")) - 1
    judge = lambda df: df.withColumn("groundedness", F.least(F.lit(1.0), F.col("v") + words * F.lit(0.4)))
    reworded = F.when(F.col("run_id") % 2 == 0, F.concat("query", F.lit(" again"))).otherwise(F.col("query"))
    done = agent.run_loop(runs, draft, judge, lambda df: df.withColumn("query", reworded))
    rows = agent.audit_rows(done)
    found = F.from_json("detail", "query string, groundedness double, attempts int")
    return rows.select("run_id", "event", found["attempts"].alias("attempts"), F.round(found["groundedness"], 6).alias("groundedness"), found["query"].alias("query"))


@query("SELECT event_type, count(*) AS n, count_if(value < 5)::BIGINT AS errors, max(value) AS highest FROM events GROUP BY 1")
def stream_counters(spark, sf_dir):
    from fathom.streaming.audit_stream import counters_stream, drained, event_stream

    return drained(counters_stream(event_stream(spark, f"{sf_dir}/events.parquet")), "complete")


@query("WITH r AS (SELECT user_id AS run_id, count(*) AS n, max_by(value, event_id) AS last, max(ts) AS t FROM events GROUP BY 1) SELECT run_id, n, last, 'open' AS status FROM r UNION ALL SELECT run_id, n, last, 'pending' FROM r WHERE t + INTERVAL 70 MINUTE < (SELECT max(ts) FROM events)")
def stream_run_states(spark, sf_dir):
    from fathom.streaming.audit_stream import drained, event_stream, run_states

    return drained(run_states(event_stream(spark, f"{sf_dir}/events.parquet")), "update")


@query("SELECT l_orderkey AS run_id, string_agg(l_linenumber || ':' || l_returnflag, '>' ORDER BY l_linenumber, l_returnflag, l_partkey) AS trace FROM lineitem GROUP BY 1")
def trace_sequence(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey"))).alias("t"))
    return rows.select("run_id", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), ">").alias("trace"))
