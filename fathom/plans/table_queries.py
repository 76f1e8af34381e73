"""Cohort, aggregate and upsert queries over the star schema."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import numbers as N
from fathom.operators import cohort as C
from fathom.operators.order import quantiles
from fathom.plans.registry import query, read


@query("""SELECT o_orderkey, o_custkey, CASE WHEN upper(o_orderstatus) = 'F' THEN 1 ELSE 0 END AS admitted, c_mktsegment, coalesce(n, 0)::INTEGER AS n_diagnoses, hr_std, sbp_min, o2sat_min
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(stddev_samp(l_quantity), 6) AS hr_std, min(l_extendedprice) AS sbp_min, min(l_discount) AS o2sat_min FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def cohort_join(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    stays = C.left_join(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), ["o_custkey"], "_triage")
    lines = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    vitals = lines.groupBy("o_orderkey").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("hr_std"), F.min("l_extendedprice").alias("sbp_min"), F.min("l_discount").alias("o2sat_min"))
    rows = C.with_counts(stays, lines, "o_orderkey", "n_diagnoses").join(vitals, "o_orderkey", "left")
    return C.existing(rows.withColumn("admitted", C.label(F.col("o_orderstatus"), "F")), ["o_orderkey", "o_custkey", "admitted", "race", "c_mktsegment", "n_diagnoses", "hr_std", "sbp_min", "o2sat_min"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE round(epoch_us(l_shipdate - o_orderdate) / 3.6e9, 6) END AS hours, epoch_us(l_shipdate) / 1e6 AS epoch, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def length_of_stay_hours(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = F.try_to_timestamp(F.when(F.col("l_linenumber") == 3, "not a time").otherwise(F.col("l_shipdate").cast("string")))
    return rows.select("l_orderkey", "l_linenumber", F.round(N.hours_between(F.col("o_orderdate"), out), 6).alias("hours"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(1e6)).alias("epoch"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("""WITH j AS (SELECT l_orderkey, l_quantity, o_totalprice, o_custkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 10)
SELECT 'l_orderkey' AS "column", round(avg(CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END), 4) AS missing FROM j UNION ALL SELECT 'l_quantity', round(avg(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END), 4) FROM j
UNION ALL SELECT 'o_custkey', round(avg(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END), 4) FROM j""")
def missingness(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey"), "l_quantity")
    rows = read(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return C.missingness(rows, ["l_orderkey", "l_quantity", "o_custkey"])


@query("SELECT o_orderpriority AS value, count(*) AS n, count(DISTINCT o_custkey) AS patients, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS admitted, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("patients"), F.count_if(F.col("o_orderstatus") == "F").alias("admitted"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'nan' ELSE p_brand END AS b FROM part), k AS (SELECT b FROM p GROUP BY b HAVING count(*) >= 10)
SELECT p_partkey, k.b AS category, (p.b = k.b)::INTEGER::DOUBLE AS flag FROM p, k""")
def onehot_support(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand")).alias("brand"))
    return C.long_one_hot(part, "p_partkey", "brand", 10)


@query("""SELECT o_orderkey, round(o_totalprice / nullif((o_custkey % 5) * 20.0, 0), 6) AS shock_index, round((o_custkey % 5) * 20.0 - (o_orderkey % 7) * 10, 6) AS pulse_pressure, round((5 - coalesce(a, med)) / 4, 6) AS acuity_score, CASE WHEN p >= 0.75 THEN 'high' WHEN p >= 0.5 THEN 'elevated' WHEN p >= 0.25 THEN 'moderate' ELSE 'low' END AS band,
  round(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))), 6) AS logit, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS shown
FROM (SELECT *, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 6 END::DOUBLE AS a, (o_orderkey % 101) / 100.0::DOUBLE AS p FROM orders), (SELECT median(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 6 END::DOUBLE) AS med FROM orders)""")
def risk_numbers(spark, sf_dir):
    sbp = (F.col("o_custkey") % 5) * F.lit(20.0)
    acuity = F.nullif(F.col("o_orderkey") % 6, F.lit(0)).cast("double")
    p = (F.col("o_orderkey") % 101) / F.lit(100.0)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", sbp.alias("sbp"), ((F.col("o_orderkey") % 7) * 10).alias("dbp"), acuity.alias("acuity"), p.alias("p"))
    middle = rows.agg(F.median("acuity").alias("middle"))  # one row
    raw = F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(F.col("o_totalprice").cast("string"))
    return rows.join(F.broadcast(middle)).select(
        "o_orderkey", F.round(N.ratio(F.col("o_totalprice"), F.col("sbp")), 6).alias("shock_index"), F.round(F.col("sbp") - F.col("dbp"), 6).alias("pulse_pressure"), F.round(N.acuity_score(F.col("acuity"), F.col("middle")), 6).alias("acuity_score"),
        N.risk_band(F.col("p")).alias("band"), F.round(N.logit(F.col("p")), 6).alias("logit"), N.safe_number(raw).alias("shown"),
    )


@query("""WITH n AS (SELECT o_custkey AS c_custkey, max_by(o_orderpriority, o_orderkey) AS c_mktsegment, max_by(o_totalprice, o_orderkey) AS c_acctbal FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1)
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN n.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey""")
def upsert_latest(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    key = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    new = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(key.alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("seq"))
    return C.upsert(old, new, "c_custkey", ["c_acctbal"])


@query("SELECT s_suppkey, s_name, 'old' AS batch FROM supplier UNION ALL SELECT s_suppkey, s_name, 'new' FROM supplier WHERE s_suppkey % 2 = 0")
def append_batches(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return C.union_all([s.withColumn("batch", F.lit("old")), s.where("s_suppkey % 2 = 0").select(F.lit("new").alias("batch"), "s_name", "s_suppkey")])


@query("""WITH r AS (SELECT event_type AS benchmark, CASE WHEN event_id % 2 = 0 THEN 'rag' ELSE 'plain' END AS path, value > 50 AS correct, event_id % 5 = 0 AS escalated, event_id % 7 = 0 AS unparseable, value AS latency FROM events),
s AS (SELECT coalesce(benchmark, 'all') AS benchmark, path, count(*) AS n, count_if(correct) AS hits, count_if(NOT escalated) AS answered, count_if(correct AND NOT escalated) AS good, count_if(escalated) AS escalated, count_if(unparseable) AS unparseable, round(avg(latency), 4) AS mean_latency FROM r GROUP BY GROUPING SETS ((benchmark, path), (path)))
SELECT benchmark, path, n, round(hits / n, 6) AS accuracy, CASE WHEN answered > 0 THEN round(good / answered, 6) END AS answered_accuracy, round(answered / n, 6) AS coverage, escalated::BIGINT AS escalated, unparseable::BIGINT AS unparseable, mean_latency,
  round(greatest(0.0, (hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1.0, (hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM s""")
def bench_summary_wilson(spark, sf_dir):
    from fathom.operators.evaluation import summarize

    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("benchmark"), F.when(F.col("event_id") % 2 == 0, "rag").otherwise("plain").alias("path"), (F.col("value") > 50).alias("correct"), (F.col("event_id") % 5 == 0).alias("escalated"), (F.col("event_id") % 7 == 0).alias("unparseable"), F.col("value").alias("latency"))
    return summarize(rows)


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, max(o_totalprice) AS longest, min(o_totalprice) AS shortest FROM orders GROUP BY 1")
def token_quantiles(spark, sf_dir):
    x = "o_totalprice"
    orders = read(spark, sf_dir, "orders").select("o_orderpriority", x)
    sums = orders.groupBy("o_orderpriority").agg(F.round(F.avg(x), 4).alias("mean"), F.max(x).alias("longest"), F.min(x).alias("shortest"))
    ranks = quantiles(orders, "o_orderpriority", x, {"median": 0.5, "p95": 0.95})
    return sums.join(ranks, "o_orderpriority").select("o_orderpriority", "mean", F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"), "longest", "shortest")


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(CASE WHEN place = round_even((n - 1) * 0.95, 0) THEN value END) AS p95, n FROM
(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type, n""")
def nearest_rank_p95(spark, sf_dir):
    from fathom.operators.evaluation import nearest_rank

    return nearest_rank(read(spark, sf_dir, "events"), "event_type", "value", 0.95)


@query("SELECT event_type AS provider, count(*) AS calls, sum(length(props))::BIGINT AS tokens, count_if(value < 5)::BIGINT AS errors, round(avg(value), 6) AS mean_latency FROM events GROUP BY 1")
def usage_counters(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("calls"), F.sum(F.length("props")).alias("tokens"), F.count_if(F.col("value") < 5).alias("errors"), F.round(F.avg("value"), 6).alias("mean_latency"))


@query("""WITH w AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey + 10000000 END AS id FROM orders WHERE o_orderkey % 9 = 0), r AS (SELECT o_orderkey AS stay_id, o_custkey + 10000000 AS subject_id, o_totalprice AS price FROM orders)
SELECT id, coalesce(a.price, b.price) AS price FROM w LEFT JOIN r a ON id = a.stay_id LEFT JOIN (SELECT subject_id, max_by(price, stay_id) AS price FROM r GROUP BY 1) b ON id = b.subject_id""")
def patient_lookup(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    wanted = orders.where("o_orderkey % 9 = 0").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(F.col("o_custkey") + 10000000).alias("id")).distinct()
    rows = orders.select(F.col("o_orderkey").alias("stay_id"), (F.col("o_custkey") + 10000000).alias("subject_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    return C.look_up(wanted, rows).select("id", "price")


@query("""SELECT * FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY md5(c_custkey || ':42'), c_custkey) AS place FROM customer) WHERE place <= 50""")
def hash_sample(spark, sf_dir):
    from fathom.operators.corpus import seeded_sample

    few = seeded_sample(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 42)
    return few.withColumn("place", F.row_number().over(Window.orderBy(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(":42")).cast("binary")), "c_custkey")).cast("long"))


@query("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100")
def resume_listing(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").orderBy("doc_id").limit(100)


@query("SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY source ORDER BY n DESC, source")
def source_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).orderBy(F.desc("n"), "source")


@query("""WITH g AS (SELECT o_orderkey AS stay_id, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender, (o_custkey % 5) * 30.0::DOUBLE AS sbp, (o_orderkey % 9) * 10.0::DOUBLE AS dbp, o_totalprice / 3000 AS heartrate, CASE o_orderkey % 2 WHEN 0 THEN 'Chest Pain' ELSE 'fall' END AS cc FROM orders)
SELECT stay_id, sbp::DOUBLE AS sbp, heartrate / nullif(sbp, 0) AS shock_index, (sbp - dbp)::DOUBLE AS pulse_pressure, coalesce(gender = 'M', false)::INTEGER::DOUBLE AS gender_M, 0.0::DOUBLE AS arrival_transport_WALK, (cc = 'Chest Pain')::INTEGER::DOUBLE AS cc_chest_pain, (cc = 'fall')::INTEGER::DOUBLE AS cc_trauma, (gender IS NULL)::INTEGER::DOUBLE AS gender_nan FROM g""")
def build_features(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    stays = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("stay_id"), F.when(k == 0, "F").when(k == 1, "M").alias("gender"), ((F.col("o_custkey") % 5) * F.lit(30.0)).alias("sbp"), ((F.col("o_orderkey") % 9) * F.lit(10.0)).alias("dbp"), (F.col("o_totalprice") / 3000).alias("heartrate"),
        F.when(F.col("o_orderkey") % 2 == 0, "Chest Pain").otherwise("fall").alias("chiefcomplaint"),
    )
    wanted = ["sbp", "shock_index", "pulse_pressure", "gender_M", "arrival_transport_WALK", "cc_chest_pain", "cc_trauma", "gender_nan"]
    return C.assert_no_identifiers(C.build_features(stays, ["stay_id"], wanted))
