"""Text, filter and formatting queries."""

from pyspark.sql import functions as F

from fathom.functions import numbers as N
from fathom.functions import text as T
from fathom.plans.registry import query, read, sql_claims, sql_content, sql_list, sql_sentences, sql_strip, sql_tokens, sql_words


@query(f"SELECT doc_id, len({sql_tokens('text')})::INTEGER AS n_tokens, len(list_distinct({sql_tokens('text')}))::INTEGER AS n_distinct FROM documents")
def tokenize_stats(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(T.tokenize(F.col("text")))).alias("n_distinct"))


@query(f"SELECT doc_id, array_to_string(list_sort({sql_content('text')}), ' ') AS tokens FROM documents")
def content_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.content_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"SELECT doc_id, floor(len({sql_words('text')}) * 1.35::DOUBLE)::INTEGER AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query(f"SELECT doc_id, len({sql_sentences('text')})::INTEGER AS n_sentences FROM documents")
def sentence_stats(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.split_sentences(F.col("text"))).alias("n_sentences"))


@query(f"SELECT doc_id, unnest({sql_claims('text')}) AS claim FROM documents")
def claims(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(T.split_claims(F.col("text"))).alias("claim"))


@query(r"""SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_extract(text, '(?m)^\s{0,3}(#{1,6}\s+.+|[A-Z][A-Z0-9 \-/&,()]{6,80})\s*$', 1), '^#+', ''), '^\s+|\s+$', '', 'g'), 1, 120) AS section
FROM (SELECT doc_id, '## Part ' || source || chr(10) || text AS text FROM documents UNION ALL SELECT -doc_id - 1, text FROM documents)""")
def sections(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    marked = docs.select("doc_id", F.concat(F.lit("## Part "), "source", F.lit("\n"), "text").alias("text"))
    return marked.unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), "text")).select("doc_id", T.detect_section(F.col("text")).alias("section"))


@query(rf"""SELECT doc_id, 'd_' || substr(sha1(doc_id || '||' || source), 1, 16) AS stable_id,
  regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS entity,
  CASE WHEN len(text) > 320 THEN substr(text, 1, 320) || '…' ELSE text END AS snippet,
  regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS paragraphs FROM documents""")
def text_scalars(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        T.stable_id("d", F.col("doc_id"), F.col("source")).alias("stable_id"),
        T.normalize_entity(F.col("text")).alias("entity"),
        T.snippet(F.col("text")).alias("snippet"),
        T.normalize_breaks(F.replace("text", F.lit(". "), F.lit(".\n\n\n"))).alias("paragraphs"),
    )


GATE = rf"""SELECT doc_id, source, CASE WHEN s = '' THEN 'empty' WHEN len(s) < 1200 THEN 'too_short'
  WHEN {" OR ".join(f"contains(lower(substr(s, 1, 3000)), '{m}')" for m in T.BOILERPLATE)} THEN 'boilerplate'
  WHEN len(regexp_replace(substr(s, 1, 4000), '[^\p{{L}}\s]', '', 'g'))::DOUBLE / len(substr(s, 1, 4000)) < 0.75 THEN 'low_text_ratio' END AS reason
FROM (SELECT doc_id, source, {sql_strip('text')} AS s FROM documents)"""


@query(f"SELECT doc_id, reason FROM ({GATE})")
def quality_gate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.quality_gate(F.col("text")).alias("reason"))


@query(f"SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({GATE}) GROUP BY ALL")
def reject_hist(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", F.coalesce(T.quality_gate(F.col("text")), F.lit("kept")).alias("reason"))
    return docs.groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in T.IDENTIFIERS) + ") AS identifiers FROM documents")
def screen_identifiers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.screen_identifiers(F.col("text")), ",").alias("identifiers"))


@query(rf"""WITH q AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 1 THEN ' Is it safer than the other?' WHEN 2 THEN ' What for this patient?' ELSE '' END AS query, conv_id % 7 = 0 AS has_patient, (conv_id % 10) / 10.0::DOUBLE AS confidence FROM conversations WHERE role = 'user'),
r AS (SELECT *, CASE WHEN has_patient THEN 'needs_patient_context' WHEN regexp_matches(query, '{T.RELATIONAL}') THEN 'needs_relationship_reasoning' WHEN regexp_matches(query, '{T.PATIENT}') THEN 'needs_patient_context' END AS heuristic FROM q)
SELECT conv_id, turn, heuristic, coalesce(heuristic, CASE WHEN confidence < 0.5 THEN 'needs_relationship_reasoning' ELSE 'simple_factual' END) AS route,
  CASE coalesce(heuristic, CASE WHEN confidence < 0.5 THEN 'needs_relationship_reasoning' ELSE 'simple_factual' END) WHEN 'needs_relationship_reasoning' THEN 'vector,graph' WHEN 'needs_patient_context' THEN 'vector,risk' ELSE 'vector' END AS retrievers FROM r""")
def route_heuristic(spark, sf_dir):
    from fathom.operators.agent import retrievers

    asked = read(spark, sf_dir, "conversations").where("role = 'user'")
    tail = F.when(F.col("turn") % 4 == 1, " Is it safer than the other?").when(F.col("turn") % 4 == 2, " What for this patient?").otherwise("")
    heuristic = T.heuristic_route(F.concat("text", tail), F.col("conv_id") % 7 == 0)
    rows = asked.select("conv_id", "turn", heuristic.alias("heuristic"), ((F.col("conv_id") % 10) / 10.0).alias("confidence"))
    route = F.coalesce("heuristic", T.widen_route(F.lit("simple_factual"), F.col("confidence")))
    return rows.select("conv_id", "turn", "heuristic", route.alias("route"), F.array_join(retrievers(route), ",").alias("retrievers"))


@query(rf"""SELECT p_partkey, CASE WHEN v IS NULL THEN NULL WHEN v IN ('denies', 'none') THEN 0.0 WHEN regexp_extract(v, '\d+') <> '' THEN least(10.0, regexp_extract(v, '\d+')::DOUBLE) END AS pain
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'denies' WHEN 1 THEN p_size || '/10' WHEN 2 THEN 'unable' WHEN 3 THEN NULL ELSE 'about ' || p_size END AS v FROM part)""")
def coerce_number(spark, sf_dir):
    k = F.col("p_partkey") % 5
    v = F.when(k == 0, "Denies ").when(k == 1, F.concat("p_size", F.lit("/10"))).when(k == 2, "unable").when(k == 4, F.concat(F.lit("about "), "p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", N.coerce_pain(v).alias("pain"))


@query("SELECT doc_id, " + ", ".join(f"({' OR '.join(f'''contains(lower(text), '{w}')''' for w in ws)})::DOUBLE AS {n}" for n, ws in T.COMPLAINTS.items()) + " FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Chest pain, fever' WHEN 1 THEN ' SOB after a fall' ELSE '' END AS text FROM documents)")
def keyword_flags(spark, sf_dir):
    k = F.col("doc_id") % 3
    text = F.concat("text", F.when(k == 0, " Chest pain, fever").when(k == 1, " SOB after a fall").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", *[T.complaint_flag(text, n).alias(n) for n in T.COMPLAINTS])


CITED = "text || ' [' || (turn % 4 + 1) || '] and [' || (conv_id % 12) || '] [' || (turn % 4 + 1) || ']'"


@query(rf"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct([x::INTEGER FOR x IN regexp_extract_all(t, '\[(\d{{1,2}})\]', 1)])), ',') AS cited,
  len([x FOR x IN list_distinct([x::INTEGER FOR x IN regexp_extract_all(t, '\[(\d{{1,2}})\]', 1)]) IF x NOT BETWEEN 1 AND 8]) = 0 AS within FROM (SELECT conv_id, turn, {CITED} AS t FROM conversations WHERE role = 'assistant')""")
def citations_extract(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", f"{CITED} as t")
    cited = T.citations(F.col("t"))
    within = F.size(F.array_except(cited, F.sequence(F.lit(1), F.lit(8)))) == 0
    return said.select("conv_id", "turn", F.array_join(cited, ",").alias("cited"), within.alias("within"))


@query(rf"""WITH a AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Yes, it is' WHEN 1 THEN '  ' WHEN 2 THEN 'The answer is (B).' WHEN 3 THEN 'I think gamma rays do it' WHEN 4 THEN 'maybe not; no' ELSE text END AS raw, CASE conv_id % 2 WHEN 0 THEN 'yesno' ELSE 'mcq' END AS kind FROM conversations),
u AS (SELECT *, upper({sql_strip('raw')}) AS t FROM a)
SELECT conv_id, turn, CASE WHEN t = '' THEN '' WHEN kind = 'yesno' THEN CASE WHEN regexp_matches(t, '\bYES\b') THEN 'YES' WHEN regexp_matches(t, '\bNO\b') THEN 'NO' WHEN regexp_matches(t, '\bMAYBE\b') THEN 'MAYBE' ELSE '' END
  WHEN regexp_extract(t, '\b([A-D])\b', 1) IN ('A', 'B', 'C') THEN regexp_extract(t, '\b([A-D])\b', 1) WHEN contains(t, 'ALPHA') THEN 'A' WHEN contains(t, 'BETA') THEN 'B' WHEN contains(t, 'GAMMA RAYS') THEN 'C' ELSE '' END AS answer FROM u""")
def normalize_answer(spark, sf_dir):
    k = F.col("turn") % 6
    raw = F.when(k == 0, "Yes, it is").when(k == 1, "  ").when(k == 2, "The answer is (B).").when(k == 3, "I think gamma rays do it").when(k == 4, "maybe not; no").otherwise(F.col("text"))
    kind = F.when(F.col("conv_id") % 2 == 0, "yesno").otherwise("mcq")
    choices = F.create_map(*[F.lit(x) for x in ("A", "alpha", "B", "beta", "C", "gamma rays")])
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_answer(raw, kind, choices).alias("answer"))


@query(rf"""SELECT conv_id, turn, CASE WHEN len(text) NOT BETWEEN 3 AND 2000 OR {sql_strip('text')} = '' THEN 'bad query' WHEN NOT regexp_matches(pid, '^[\p{{L}}\p{{N}}]{{1,64}}$') THEN 'bad id' ELSE 'ok' END AS verdict, greatest(1, least(turn * 90, 200))::BIGINT AS row_limit
FROM (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN '../x' ELSE 'p' || conv_id END AS pid FROM conversations)""")
def request_validation(spark, sf_dir):
    from fathom.operators.agent import valid_request

    pid = F.when(F.col("turn") % 3 == 0, "../x").otherwise(F.concat(F.lit("p"), "conv_id"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", valid_request(F.col("text"), pid).alias("verdict"), N.clamp(F.col("turn") * 90, 1, 200).cast("long").alias("row_limit"))


@query(rf"""SELECT page_id, CASE WHEN lower(u) IN ('none', 'null') THEN '' ELSE u END AS url, coalesce(nullif({sql_strip('h')}, ''), {sql_strip('html')}) AS text, host || ' page ' || row_number() OVER (PARTITION BY host ORDER BY page_id) AS title
FROM (SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'null' ELSE url END AS u, CASE page_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE 'clean ' || html END AS h, coalesce(nullif(split_part(url, '/', 3), ''), 'unknown') AS host FROM pages)""")
def title_clean(spark, sf_dir):
    from fathom.operators.order import positions_by

    k, m = F.col("page_id") % 4, F.col("page_id") % 3
    url = F.when(k == 0, "None").when(k == 1, "null").otherwise(F.col("url"))
    cleaned = F.when(m == 0, "  ").when(m == 2, F.concat(F.lit("clean "), "html"))
    host = F.coalesce(F.nullif(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("")), F.lit("unknown"))
    rows = read(spark, sf_dir, "pages").select("page_id", T.clean_none(url).alias("url"), F.coalesce(F.nullif(T.strip(cleaned), F.lit("")), T.strip(F.col("html"))).alias("text"), host.alias("host"))
    numbered = positions_by(rows.select("page_id", "host"), "host", ["page_id"]).select("page_id", (F.col("position") + 1).cast("string").alias("n"))
    return rows.join(numbered, "page_id").select("page_id", "url", "text", F.concat("host", F.lit(" page "), "n").alias("title"))


@query(f"""SELECT o_orderkey, 'Q: order ' || o_orderkey || chr(10) || 'A) ' || o_orderstatus || chr(10) || 'B) ' || o_orderpriority AS question, 'c' || o_custkey || ' -[placed]-> o' || o_orderkey || ' → o' || o_orderkey || ' -[has]-> ' || o_orderstatus AS path,
  CASE WHEN o_totalprice > 200000 THEN '—' ELSE format('{{:.2f}}', o_totalprice) END AS shown, o_custkey % 3 || CASE WHEN o_custkey % 3 = 1 THEN ' source' ELSE ' sources' END || ' after ' || (o_orderkey % 4) || CASE WHEN o_orderkey % 4 = 1 THEN ' attempt' ELSE ' attempts' END AS escalation FROM orders""")
def formatters(spark, sf_dir):
    from fathom.operators.agent import counted, describe_path, question_text

    edge = lambda s, r, t: F.struct(s.alias("source"), F.lit(r).alias("relation"), t.alias("target"))
    order = F.concat(F.lit("o"), "o_orderkey")
    path = F.array(edge(F.concat(F.lit("c"), "o_custkey"), "placed", order), edge(order, "has", F.col("o_orderstatus")))
    options = F.array(F.struct(F.lit("A").alias("label"), F.col("o_orderstatus").alias("body")), F.struct(F.lit("B").alias("label"), F.col("o_orderpriority").alias("body")))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        question_text(F.concat(F.lit("Q: order "), "o_orderkey"), options).alias("question"),
        describe_path(path).alias("path"),
        F.when(F.col("o_totalprice") > 200000, "—").otherwise(F.format_string("%.2f", "o_totalprice")).alias("shown"),
        F.concat(counted(F.col("o_custkey") % 3, "source"), F.lit(" after "), counted(F.col("o_orderkey") % 4, "attempt")).alias("escalation"),
    )


@query(r"""SELECT event_id, k, coalesce(try_cast(json_extract_string(try_cast(s AS JSON), '$.k') AS BIGINT), -1) AS salvaged FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k,
  CASE WHEN event_id % 3 = 2 THEN '{}' ELSE props END AS s FROM events)""")
def json_salvage(spark, sf_dir):
    from fathom.functions.json import salvage

    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise("no object here")
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object(salvage(raw), "$.k").cast("long"), F.lit(-1)).alias("salvaged"))


@query("SELECT event_id, event_type AS event, 'r' || user_id AS run_id FROM events WHERE event_id % 5 <> 0")
def sse_parse(spark, sf_dir):
    from fathom.sources.sse import frames, parse

    events = read(spark, sf_dir, "events")
    data = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", F.concat(F.lit("r"), "user_id").alias("run_id"))))
    stream = frames(events.select(F.col("event_type").alias("event"), data.alias("data")))
    return parse(stream, "event_id long, run_id string").select("data.event_id", "event", "data.run_id")


@query(f"""SELECT item_id, array_to_string(list_sort(list_distinct([w FOR w IN {sql_words('text')} IF len(w) > 9])), ' ') AS bold, len({sql_list(['x'])}) AS n FROM benchmark""")
def markup(spark, sf_dir):
    from fathom.functions.json import marked

    long_words = F.array_sort(F.array_distinct(F.filter(T.words(F.col("text")), lambda w: F.length(w) > 9)))
    shown = F.array_join(F.transform(long_words, lambda w: F.concat(F.lit("**"), w, F.lit("**"))), " ")
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(marked(shown), " ").alias("bold"), F.lit(1).cast("long").alias("n"))
