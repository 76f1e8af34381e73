"""Risk models: grouped folds, three model kinds, out-of-fold predictions, serving."""

from collections.abc import Callable
from contextvars import copy_context
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.numbers import logit, risk_band
from fathom.operators import boosting
from fathom.operators.cohort import look_up
from fathom.operators.evaluation import auc_of_steps, brier, interval_of_steps, precision_of_steps, steps
from fathom.operators.order import medians_by_fold, medians_of_sets, positions_by
from fathom.session import materialise
from fathom.sources.tables import read_manifest, write_manifest

SEED, FOLDS, INNER = 42, 5, 3


def deal(sizes: list[tuple[int, int]], folds: int) -> dict[int, tuple[list[int], list[int]]]:
    """sizes: (size, how many groups have it). For each size the folds of its groups, in turn: a beginning, and a round that is
    gone through again and again after it. Each group, the largest first, goes to the fold with the fewest rows so far.

    Once all folds are within less than a group's size of each other the order in which they are served repeats itself.
    """
    load, out = [0] * folds, {}
    for size, n in sorted(sizes, reverse=True):
        first: list[int] = []
        while len(first) < n and max(load) - min(load) >= size:
            k = load.index(min(load))
            first.append(k)
            load[k] += size
        turn: list[int] = []
        if len(first) < n:
            left = n - len(first)
            turn = sorted(range(folds), key=lambda k: (load[k], k))
            for place, k in enumerate(turn):
                load[k] += size * (left // folds + (place < left % folds))
        out[size] = first, turn
    return out


def grouped_folds(rows: DataFrame, group: str, folds: int = FOLDS) -> DataFrame:
    """(group, fold): the largest groups first, each to the fold with the fewest rows; of equal groups the least key first. There
    are no more folds than groups.

    The driver gets one row for each different group size, of which there are few: groups of sizes 1 to s have s * s / 2 rows.
    """
    return deal_groups(rows.groupBy(group).agg(F.count("*").alias("_size")), group, folds)


def deal_groups(sizes: DataFrame, group: str, folds: int = FOLDS) -> DataFrame:
    """grouped_folds of groups with known sizes: (group, _size)."""
    counts = [tuple(r) for r in sizes.groupBy("_size").agg(F.count("*")).collect()]
    dealt = deal(counts, max(1, min(folds, sum(n for _, n in counts))))
    table = sizes.sparkSession.createDataFrame([(size, first, turn) for size, (first, turn) in dealt.items()], "_size long, first array<int>, turn array<int>")
    placed = positions_by(sizes, "_size", [group]).join(F.broadcast(table), "_size")
    began = F.size("first")
    later = F.element_at("turn", (F.pmod(F.col("position") - began, F.size("turn")) + 1).cast("int"))
    fold = F.when(F.col("position") < began, F.try_element_at("first", (F.col("position") + 1).cast("int"))).otherwise(F.when(F.size("turn") > 0, later))
    return placed.select(group, fold.cast("int").alias("fold"))


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int = FOLDS) -> DataFrame:
    """(key, fold): each class dealt evenly by a hash of the key."""
    placed = positions_by(rows.select(key, label), label, [F.xxhash64(F.lit(SEED), key), key])
    return placed.select(key, F.pmod("position", F.lit(folds)).cast("int").alias("fold"))


class Prepared:
    """Median imputation and class weights, fitted on training rows only. medians: where they are known already."""

    def __init__(self, train: DataFrame, features: list[str], label: str, medians: dict[str, float | None] | None = None):
        medians = medians_by_fold(train, features)[0] if medians is None else medians
        self.medians = {c: 0.0 if medians[c] is None else float(medians[c]) for c in features}
        n, pos = train.agg(F.count("*"), F.sum(label)).first()
        pos = max(1, min(n - 1, pos or 0))
        self.n, self.weights = n, (n / (2 * (n - pos)), n / (2 * pos))
        self.features, self.label = features, label

    def __call__(self, rows: DataFrame) -> DataFrame:
        weight = F.when(F.col(self.label) == 1, self.weights[1]).otherwise(self.weights[0])
        return filled(rows, self.medians).withColumn("_w", weight).withColumn("_y", F.col(self.label).cast("double"))


def filled(rows: DataFrame, medians: dict[str, float]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


class Logistic:
    """A fitted logistic regression: a function from rows to rows with p, made of column expressions alone."""

    kind = "logistic"

    def __init__(self, medians: dict[str, float], centre: list[float], scale: list[float], weights: list[float], intercept: float):
        self.medians, self.centre, self.scale, self.weights, self.intercept = medians, centre, scale, weights, intercept

    @property
    def features(self) -> list[str]:
        return list(self.medians)

    def __call__(self, rows: DataFrame) -> DataFrame:
        terms = [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(mu)) * F.lit(w / sd if sd else 0.0) for (c, m), mu, sd, w in zip(self.medians.items(), self.centre, self.scale, self.weights, strict=True)]
        return rows.withColumn("p", 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept)))))

    def importance(self) -> list[float]:
        return [abs(w) for w in self.weights]

    def to_dict(self) -> dict:
        return {"kind": self.kind, "medians": list(self.medians.items()), "centre": self.centre, "scale": self.scale, "weights": self.weights, "intercept": self.intercept}

    @staticmethod
    def from_dict(d: dict) -> "Logistic":
        return Logistic(dict(d["medians"]), d["centre"], d["scale"], d["weights"], d["intercept"])


class Calibrated:
    """The mean of logistic regressions, each with its own sigmoid."""

    kind = "calibrated"

    def __init__(self, parts: list[tuple[Logistic, float, float]]):
        self.parts = parts

    @property
    def features(self) -> list[str]:
        return self.parts[0][0].features

    def __call__(self, rows: DataFrame) -> DataFrame:
        out, names = rows, []
        for k, (base, slope, intercept) in enumerate(self.parts):
            out = base(out).withColumn(f"_p{k}", 1 / (1 + F.exp(-(slope * logit(F.col("p")) + intercept)))).drop("p")
            names.append(f"_p{k}")
        return out.withColumn("p", sum(F.col(c) for c in names) / len(names)).drop(*names)

    def importance(self) -> list[float]:
        each = [base.importance() for base, _, _ in self.parts]
        return [sum(x) / len(each) for x in zip(*each)]

    def to_dict(self) -> dict:
        return {"kind": self.kind, "parts": [[base.to_dict(), slope, intercept] for base, slope, intercept in self.parts]}

    @staticmethod
    def from_dict(d: dict) -> "Calibrated":
        return Calibrated([(Logistic.from_dict(base), slope, intercept) for base, slope, intercept in d["parts"]])


class Boosted:
    """Boosted trees on imputed features."""

    kind = "boosted"

    def __init__(self, medians: dict[str, float], trees: list[boosting.Tree]):
        self.medians, self.trees = medians, trees

    @property
    def features(self) -> list[str]:
        return list(self.medians)

    def __call__(self, rows: DataFrame) -> DataFrame:
        own = [f"_f{i}" for i in range(len(self.medians))]  # rows keep their own, as they are
        named = rows.withColumns({f: F.coalesce(F.col(c).cast("double"), F.lit(m)) for f, (c, m) in zip(own, self.medians.items(), strict=True)})
        return boosting.predict(named, self.trees, own).drop(*own)

    def importance(self) -> list[float]:
        """Each feature's share of all gains."""
        gains = [sum(g for t in self.trees for f, g in zip(t.feature, t.gain, strict=True) if f == i) for i in range(len(self.medians))]
        return [g / (sum(gains) or 1.0) for g in gains]

    def to_dict(self) -> dict:
        return {"kind": self.kind, "medians": list(self.medians.items()), "trees": [vars(t) for t in self.trees]}

    @staticmethod
    def from_dict(d: dict) -> "Boosted":
        return Boosted(dict(d["medians"]), [boosting.Tree(**t) for t in d["trees"]])


KINDS = {m.kind: m for m in (Logistic, Calibrated, Boosted)}
Model = Logistic | Calibrated | Boosted


def fit_logistic(train: DataFrame, features: list[str], label: str, c: float = 0.3, medians: dict | None = None) -> Logistic:
    """L2-penalised balanced logistic regression on standardised features; the result adds p."""
    prepared = Prepared(train, features, label, medians)
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1 / (c * max(1, prepared.n)), standardization=False, probabilityCol="_p", rawPredictionCol="_m", predictionCol="_c")]
    _, scaler, model = Pipeline(stages=stages).fit(prepared(train)).stages
    return Logistic(prepared.medians, scaler.mean.toArray().tolist(), scaler.std.toArray().tolist(), model.coefficients.toArray().tolist(), float(model.intercept))


def fit_boosted(train: DataFrame, features: list[str], label: str, key: str, rounds: int = boosting.ROUNDS, medians: dict | None = None) -> Boosted:
    """Second-order boosted trees of depth 2, each on a sample of the rows, drawn by key, and of the features."""
    medians = medians_by_fold(train, features)[0] if medians is None else medians
    medians = {c: 0.0 if medians[c] is None else float(medians[c]) for c in features}
    return Boosted(medians, boosting.fit(filled(train, medians), features, label, key, rounds))


def fit_boosted_folds(dealt: DataFrame, numbers: list[int], medians: list[dict], features: list[str], label: str, key: str, rounds: int = boosting.ROUNDS) -> list[Boosted]:
    """fit_boosted of the rows outside each of the folds, all at the same time. dealt has fold; medians: by fold."""
    own = [{c: 0.0 if medians[k][c] is None else float(medians[k][c]) for c in features} for k in numbers]
    trees = boosting.fit_together(dealt, features, label, key, seen_bits([F.col("fold") != k for k in numbers]), [list(m.values()) for m in own], rounds)
    return [Boosted(m, t) for m, t in zip(own, trees)]


def seen_bits(sets: list[Column]) -> Column:
    """One bit for each set of rows, set in the rows of which its condition holds."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(sets)])


def fit_calibrated(train: DataFrame, features: list[str], label: str, group: str, inner: int = INNER, medians: dict | None = None) -> Calibrated:
    """Sigmoid-calibrated logistic regressions, one for each inner fold, averaged. Inner folds keep groups together, and each
    has medians of its own rows, from one job; medians, those of all rows, aren't needed."""
    folds = materialise(train.join(grouped_folds(train, group, inner), group), "inner-folds")
    return _calibrated(folds, "fold", features, label, medians_by_fold(folds, features, "fold", inner))


def fit_calibrated_folds(dealt: DataFrame, numbers: list[int], features: list[str], label: str, group: str, inner: int = INNER, parallel: int = FOLDS) -> list[Calibrated]:
    """fit_calibrated of the rows outside each of the folds, all at the same time. dealt has fold. The inner folds of all are
    columns of one table, which is written once, and one job has the medians of all."""
    sizes = materialise(dealt.groupBy(group, "fold").agg(F.count("*").alias("_n")), "sizes")
    outside = [sizes.where(F.col("fold") != k).groupBy(group).agg(F.sum("_n").alias("_size")) for k in numbers]
    each = reduce(DataFrame.unionByName, [deal_groups(own, group, inner).withColumn("_k", F.lit(k)) for own, k in zip(outside, numbers)])
    columns = each.groupBy(group).agg(*[F.max(F.when(F.col("_k") == k, F.col("fold"))).alias(f"_inner{k}") for k in numbers])
    table = materialise(dealt.join(columns, group, "left"), "inner-folds")
    bits = seen_bits([(F.col("fold") != k) & (F.col(f"_inner{k}") != i) for k in numbers for i in range(inner)])
    medians = medians_of_sets(table, features, bits, len(numbers) * inner)

    def one(at: int, k: int) -> Calibrated:
        return _calibrated(table.where(F.col("fold") != k), f"_inner{k}", features, label, medians[at * inner : (at + 1) * inner])

    return side_by_side(dealt.sparkSession, [partial(one, at, k) for at, k in enumerate(numbers)], parallel)


def _calibrated(train: DataFrame, inner: str, features: list[str], label: str, medians: list[dict]) -> Calibrated:
    """train has its inner folds; medians: by inner fold, of the rows outside it."""
    parts = []
    for k, own in enumerate(medians):
        base = fit_logistic(train.where(F.col(inner) != k), features, label, medians=own)
        held = base(train.where(F.col(inner) == k)).select(F.col(label).cast("double").alias("_y"), logit(F.col("p")).alias("m"))
        parts.append((base, *_line(held)))
    return Calibrated(parts)


def _line(rows: DataFrame) -> tuple[float, float]:
    """slope and intercept of an unpenalised logistic fit of _y on m."""
    model = LogisticRegression(featuresCol="x", labelCol="_y", regParam=0.0).fit(VectorAssembler(inputCols=["m"], outputCol="x").transform(rows))
    return float(model.coefficients[0]), float(model.intercept)


def save_model(spark: SparkSession, model: Model, path: str, **told) -> None:
    """A manifest with the model, its features in order and what is told of it: kind, medians and parameters, which are few."""
    write_manifest(spark, {"features": model.features, "model": model.to_dict(), **told}, path)


def load_model(spark: SparkSession, path: str) -> tuple[Model, dict] | None:
    """(model, manifest) of a saved model, in any session; None where there is none."""
    found = read_manifest(spark, path)
    return None if found is None else (KINDS[found["model"]["kind"]].from_dict(found["model"]), found)


def predict_risk(wanted: DataFrame, cohort: DataFrame, saved: tuple[Model, dict] | None) -> DataFrame:
    """wanted: (id); cohort: (stay_id, subject_id, seq, features) -> (id, matched_on, probability, band, model): each wanted id as
    a stay's, else as a subject's, whose last stay by seq counts, else without a probability, as where there is no model.

    The features are those that the model was saved with: others in cohort are not read, and one that cohort lacks is 0.
    """
    if saved is None:
        none = lambda t: F.lit(None).cast(t)
        return wanted.select("id", none("string").alias("matched_on"), none("double").alias("probability"), none("string").alias("band"), none("string").alias("model"))
    model, told = saved
    own = [F.col(c) if c in cohort.columns else F.lit(0.0).alias(c) for c in told["features"]]
    rows = cohort.select(F.col("stay_id").cast("string").alias("stay_id"), F.col("subject_id").cast("string").alias("subject_id"), "seq", *own)
    asked = wanted.select("id", F.trim(F.col("id").cast("string")).alias("_asked"))
    found = model(look_up(asked.select(F.col("_asked").alias("id")).distinct(), rows))
    matched = F.when(F.col("stay_id") == F.col("id"), "stay_id").otherwise("subject_id")
    scored = found.select(F.col("id").alias("_asked"), matched.alias("matched_on"), F.round("p", 4).alias("probability"), risk_band(F.col("p")).alias("band"), F.lit(told["model"]["kind"]).alias("model"))
    return asked.join(scored, "_asked", "left").drop("_asked")


def calibration_slope(rows: DataFrame) -> float | None:
    """rows: (score, label). None where only one class is there."""
    labels = rows.agg(F.countDistinct("label")).first()[0]
    return None if labels < 2 else _line(rows.select(F.col("label").cast("double").alias("_y"), logit(F.col("score")).alias("m")))[0]


def side_by_side(spark: SparkSession, calls: list[Callable], parallel: int) -> list:
    """What the calls return, which run at the same time, each with this thread's folder for tables."""
    own = inheritable_thread_target(spark)(lambda context, call: context.run(call))
    with ThreadPool(parallel) as pool:
        return pool.starmap(own, [(copy_context(), call) for call in calls])


class Dealt:
    """rows with their fold, written once, and with features each fold's medians, which one pass finds. Several kinds of models
    may be held against the same folds."""

    def __init__(self, rows: DataFrame, folds: DataFrame, on: str, features: list[str] | None = None):
        self.rows = materialise(rows.join(folds, on), "folds")
        self.numbers = [r[0] for r in self.rows.select("fold").distinct().orderBy("fold").collect()]  # five or so
        self.medians = medians_by_fold(self.rows, features, "fold", max(self.numbers) + 1) if features and self.numbers else None


def out_of_fold(rows: DataFrame, folds: DataFrame, on: str, fit: Callable[..., Callable] | None, parallel: int = FOLDS, features: list[str] | None = None, together: Callable[..., list] | None = None) -> DataFrame:
    """rows with p, predicted by models that haven't seen the row's fold. The folds' models are fitted at the same time. With
    features, fit also gets the fold's medians, all of which one pass finds. together, in place of fit, is a function of (rows with
    fold, folds, medians by fold) to the models of all folds, which share their passes."""
    return unseen(Dealt(rows, folds, on, features), fit, parallel, together)


def unseen(dealt: Dealt, fit: Callable[..., Callable] | None, parallel: int = FOLDS, together: Callable[..., list] | None = None) -> DataFrame:
    """out_of_fold of rows that are dealt already."""
    rows, medians = dealt.rows, dealt.medians

    def one(k: int) -> Callable:
        return fit(rows.where(F.col("fold") != k).drop("fold"), **({} if medians is None else {"medians": medians[k]}))

    if together is not None:
        models = together(rows, dealt.numbers, medians)
    else:
        models = side_by_side(rows.sparkSession, [partial(one, k) for k in dealt.numbers], parallel)
    return reduce(DataFrame.unionByName, [model(rows.where(F.col("fold") == k)) for k, model in zip(dealt.numbers, models)])


def metrics(predictions: DataFrame, label: str, name: str, resamples: int = 2000) -> DataFrame:
    """One row for predictions with p: model, n, auc with its interval (low, high), average_precision, brier, mean_predicted,
    observed, slope (of calibration; null where it can't be fitted)."""
    s = materialise(predictions.select(F.col("p").alias("score"), F.col(label).cast("long").alias("label")), "scored")
    slope = F.lit(calibration_slope(s)).cast("double").alias("slope")
    found = materialise(steps(s), "steps")
    one = auc_of_steps(found).join(interval_of_steps(found, resamples)).join(precision_of_steps(found)).join(brier(s)).join(s.agg(F.count("*").alias("n")))  # one row each
    return one.select(F.lit(name).alias("model"), "n", "auc", "low", "high", "average_precision", "brier", "mean_predicted", "observed", slope)


def select_model(results: DataFrame) -> DataFrame:
    """The row of the model with the least Brier score; the first by name on a tie."""
    return results.orderBy("brier", "model").limit(1)


def inflation_gap(grouped: DataFrame, ungrouped: DataFrame) -> DataFrame:
    """One row: the areas with folds that keep groups together and with folds that don't, and by how much the latter flatter."""
    both = grouped.select(F.col("auc").alias("grouped_auc")).join(ungrouped.select(F.col("auc").alias("ungrouped_auc")))  # one row each
    return both.withColumn("gap", F.col("ungrouped_auc") - F.col("grouped_auc"))


def top_features(predict, features: list[str], n: int = 10) -> list[tuple[str, float]]:
    """The features that count most, ties by name: by the size of coefficients, or by their share of the trees' gains."""
    return sorted(zip(features, predict.importance()), key=lambda x: (-x[1], x[0]))[:n]


def model_info(results: DataFrame, features: list[tuple[str, float]]) -> DataFrame:
    """The selected model's row with its top features: one row."""
    return select_model(results).withColumn("top_features", F.array(*[F.struct(F.lit(name).alias("feature"), F.lit(x).alias("weight")) for name, x in features]))


def list_patients(cohort: DataFrame, order: str, columns: list[str], limit: int = 25) -> DataFrame:
    """The first stays in the given order."""
    return cohort.orderBy(order).limit(limit).select(*columns)


def serve(wanted: DataFrame, rows: DataFrame, predict) -> DataFrame:
    """wanted: (id) with the model's features found -> id, probability (4 places), band."""
    found = predict(wanted.join(rows, "id"))
    return found.select("id", F.round("p", 4).alias("probability"), risk_band(F.col("p")).alias("band"))
