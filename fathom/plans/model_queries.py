"""Model queries. No SQL fits models: tests hold them against plain restatements."""

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import ml
from fathom.operators.order import medians_by_fold
from fathom.plans.registry import query, read
from fathom.session import materialise, table_dir

FEATURES = ["price", "n_lines", "quantity", "discount", "acuity"]


def stays(spark, sf_dir):
    """Orders with what their lines add up to; admitted is a shipped status."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.min("l_linestatus").alias("status"))
    rows = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    noisy = F.pmod(F.xxhash64("o_orderkey"), F.lit(100)) < 20 + F.coalesce("quantity", F.lit(20.0)) * 2
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), noisy.cast("int").alias("admitted"), F.col("o_totalprice").alias("price"), "n_lines", "quantity", "discount", F.nullif(F.pmod(F.col("o_orderkey"), F.lit(6)), F.lit(0)).cast("double").alias("acuity"))


def kept_stays(spark, sf_dir):
    """The stays as a written table: models go over them again and again."""
    return materialise(stays(spark, sf_dir), "stays")


def logistic(train, medians=None):
    return ml.fit_logistic(train, FEATURES, "admitted", medians=medians)


def calibrated(train, medians=None):
    return ml.fit_calibrated(train, FEATURES, "admitted", "subject")


def boosted(train, medians=None):
    return ml.fit_boosted(train, FEATURES, "admitted", "id", medians=medians)


def boosted_folds(dealt, numbers, medians):
    return ml.fit_boosted_folds(dealt, numbers, medians, FEATURES, "admitted", "id")


def calibrated_folds(dealt, numbers, medians):
    return ml.fit_calibrated_folds(dealt, numbers, FEATURES, "admitted", "subject")


#: Kinds whose models of all folds are fitted together.
TOGETHER = {boosted: boosted_folds, calibrated: calibrated_folds}


def unseen(rows, folds, on, fit):
    features = None if fit is calibrated else FEATURES  # whose inner folds have medians of their own
    return ml.out_of_fold(rows, folds, on, fit, features=features, together=TOGETHER.get(fit))


def by_groups(rows, fit, name):
    return ml.metrics(unseen(rows, ml.grouped_folds(rows, "subject"), "subject", fit), "admitted", name)


def ungrouped(rows, fit, name):
    return ml.metrics(unseen(rows, ml.stratified_folds(rows, "id", "admitted"), "id", fit), "admitted", name)


@query()
def grouped_cv(spark, sf_dir):
    """Logistic regression and the baselines, and what folds that ignore groups would have shown."""
    rows = kept_stays(spark, sf_dir)
    mixed = ungrouped(rows, logistic, "logistic, ungrouped")
    middle = medians_by_fold(rows, ["acuity"])[0]["acuity"]
    acuity = ml.metrics(rows.withColumn("p", (5 - F.coalesce("acuity", F.lit(middle))) / 4), "admitted", "acuity alone")
    always = ml.metrics(rows.withColumn("p", F.lit(1.0)), "admitted", "always admit")
    return reduce(DataFrame.unionByName, [by_groups(rows, logistic, "logistic"), mixed, acuity, always])


@query()
def inflation(spark, sf_dir):
    """By how much folds that ignore groups flatter the boosted trees."""
    rows = kept_stays(spark, sf_dir)
    return ml.inflation_gap(*ml.side_by_side(spark, [partial(by_groups, rows, boosted, "boosted"), partial(ungrouped, rows, boosted, "boosted, ungrouped")], 2))


@query()
def calibrated_lr(spark, sf_dir):
    return by_groups(kept_stays(spark, sf_dir), calibrated, "calibrated")


@query()
def boosted_trees(spark, sf_dir):
    return by_groups(kept_stays(spark, sf_dir), boosted, "boosted")


@query()
def model_info(spark, sf_dir):
    """The model with the least Brier score of the three, its measures and its ten most telling features."""
    rows = kept_stays(spark, sf_dir)
    fits = {"logistic": logistic, "calibrated": calibrated, "boosted": boosted}
    dealt = ml.Dealt(rows, ml.grouped_folds(rows, "subject"), "subject", FEATURES)
    told = lambda *names: [ml.metrics(ml.unseen(dealt, fits[name], together=TOGETHER.get(fits[name])), "admitted", name) for name in names]
    found = ml.side_by_side(spark, [partial(told, "logistic", "calibrated"), partial(told, "boosted")], 2)
    results = materialise(reduce(DataFrame.unionByName, sum(found, [])), "results")
    selected = ml.select_model(results).first()["model"]
    return ml.model_info(results, ml.top_features(fits[selected](rows), FEATURES))


@query("SELECT o_orderkey AS stay_id, o_custkey AS subject_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 6 END::DOUBLE AS acuity, round(o_totalprice, 2) AS price FROM orders ORDER BY o_orderkey LIMIT 25")
def list_patients(spark, sf_dir):
    rows = stays(spark, sf_dir).select(F.col("id").alias("stay_id"), F.col("subject").alias("subject_id"), "acuity", F.round("price", 2).alias("price"))
    return ml.list_patients(rows, "stay_id", ["stay_id", "subject_id", "acuity", "price"])


@query()
def predict_serve(spark, sf_dir):
    """Every stay, scored by models that were fitted without its patient."""
    rows = kept_stays(spark, sf_dir)
    dealt = materialise(rows.join(ml.grouped_folds(rows, "subject"), "subject"), "folds")
    folds = [r[0] for r in dealt.select("fold").distinct().orderBy("fold").collect()]  # five or so
    medians = medians_by_fold(dealt, FEATURES, "fold", max(folds, default=0) + 1)  # of all folds in one pass
    served = [ml.serve(held.select("id"), held, logistic(dealt.where(F.col("fold") != k).drop("fold"), medians[k])) for k in folds for held in [dealt.where(F.col("fold") == k).drop("fold")]]
    return reduce(DataFrame.unionByName, served)


@query()
def predict_saved(spark, sf_dir):
    """A calibrated model, saved, and loaded by another session: every stay, every subject by its last stay, and ids of neither."""
    rows = kept_stays(spark, sf_dir)
    path = f"{table_dir(spark)}/model-{uuid.uuid4().hex}"
    ml.save_model(spark, calibrated(rows), path)
    saved = ml.load_model(spark.newSession(), path)
    cohort = rows.select(F.col("id").alias("stay_id"), F.concat(F.lit("s"), "subject").alias("subject_id"), F.col("id").alias("seq"), *FEATURES)
    wanted = cohort.select(F.col("stay_id").cast("string").alias("id")).union(cohort.select("subject_id").distinct()).union(cohort.select(F.concat(F.lit("x"), "stay_id")))
    return ml.predict_risk(wanted, cohort, saved)


@query("""WITH RECURSIVE s AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS place FROM orders GROUP BY 1), r AS (
  SELECT 0::BIGINT AS place, NULL::BIGINT AS o_custkey, NULL::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
  UNION ALL SELECT s.place, s.o_custkey::BIGINT, list_position(load, list_min(load))::BIGINT, [CASE WHEN i = list_position(load, list_min(load)) THEN load[i] + s.n ELSE load[i] END FOR i IN range(1, 6)]::BIGINT[] FROM r JOIN s ON s.place = r.place + 1)
SELECT o_custkey, (fold - 1)::INTEGER AS fold FROM r WHERE place > 0""")
def grouped_folds(spark, sf_dir):
    return ml.grouped_folds(read(spark, sf_dir, "orders"), "o_custkey")
