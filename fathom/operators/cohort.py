"""Cohort assembly and features: joins, aggregates, one-hot columns, upserts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.numbers import coerce_pain, ratio
from fathom.functions.text import COMPLAINTS, complaint_flag
from fathom.session import materialise

# Feature and column names that define the results.
NUMERIC = ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "acuity")
CATEGORICAL = ("gender", "arrival_transport")
LEAKY = ("los_hours", "n_vital_checks", "hr_std", "sbp_min", "o2sat_min", "n_diagnoses")
FORBIDDEN = ("name", "firstname", "lastname", "address", "phone", "email", "mrn", "ssn", "dob")


def left_join(left: DataFrame, right: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Left equi-join; columns of right that left has too get the suffix."""
    clash = set(left.columns) & set(right.columns) - set(on)
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), on, "left")


def with_counts(left: DataFrame, many: DataFrame, key: str, name: str) -> DataFrame:
    """Adds how many rows of `many` each key has, 0 for none."""
    n = many.groupBy(key).agg(F.count("*").alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("int"))


def assert_no_identifiers(df: DataFrame) -> DataFrame:
    """df itself; an error if a column's name holds one of the forbidden ones."""
    bad = [c for c in df.columns if any(word in c.lower() for word in FORBIDDEN)]
    if bad:
        raise ValueError(f"identifier columns: {bad}")
    return df


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that df has, in that order."""
    return df.select(*[c for c in columns if c in df.columns])


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): the share of nulls, one pass over df."""
    shares = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 4).alias(c) for c in columns])
    return shares.unpivot([], columns, "column", "missing")


def label(status: Column, positive: str) -> Column:
    """1 where the status is the positive one, in any case; null is none."""
    return (F.upper(F.coalesce(status, F.lit(""))) == positive).cast("int")


def supported(df: DataFrame, column: str, support: int) -> DataFrame:
    """(category): those with at least `support` rows; a null counts as 'nan'."""
    named = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("category")).agg(F.count("*").alias("n"))
    return named.where(F.col("n") >= support).select("category")


def category_support(df: DataFrame, column: str, support: int, most: int = 10_000) -> list[str]:
    """The supported categories, to be columns: an error if they are more than any table can have as columns."""
    found = [r[0] for r in supported(df, column, support).orderBy("category").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories of {support} rows or more")
    return found


def long_one_hot(df: DataFrame, key: str, column: str, support: int, page: int = 10_000) -> DataFrame:
    """(key, category, flag): one row for each row of df and supported category, as a dense indicator matrix has them.

    The categories are as many as there are; about `page` of them are a literal of the plan at a time.
    """
    own = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    wanted = materialise(supported(df, column, support), "categories")
    pages = max(1, -(-wanted.count() // page))

    def of(i: int) -> DataFrame:
        some = [r[0] for r in wanted.where(F.pmod(F.xxhash64("category"), F.lit(pages)) == i).collect()]
        rows = df.select(key, own.alias("own"), F.explode(F.lit(some).cast("array<string>")).alias("category"))
        return rows.select(key, "category", (F.col("own") == F.col("category")).cast("double").alias("flag"))

    return reduce(DataFrame.unionByName, map(of, range(pages)))


def sparse_one_hot(df: DataFrame, key: str, column: str, support: int) -> DataFrame:
    """(key, category) of the flags that are 1: a row of df whose category has support. Nothing grows with their number."""
    own = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    return df.select(key, own.alias("category")).join(supported(df, column, support), "category", "left_semi").select(key, "category")


def one_hot(column: str, values: list[str]) -> list[Column]:
    named = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    return [(named == v).cast("double").alias(f"{column}_{v}") for v in values]


def build_features(df: DataFrame, keys: list[str], columns: list[str] | None = None, leaky: bool = False, support: int = 10) -> DataFrame:
    """keys and the model's features. Without `columns` rare categories are left out; with it, the result has exactly those
    features in that order, 0.0 where the data have no such feature, and unknown ones are dropped."""
    has = set(df.columns)
    out = {c: (F.col(c).try_cast("double") if c in has else F.lit(None).cast("double")) for c in NUMERIC}
    out["pain"] = coerce_pain(F.col("pain").cast("string")) if "pain" in has else F.lit(None).cast("double")
    out["shock_index"] = ratio(out["heartrate"], out["sbp"])
    out["pulse_pressure"] = out["sbp"] - out["dbp"]
    for c in CATEGORICAL:
        if c in has:
            wanted = category_support(df, c, support) if columns is None else [x.removeprefix(f"{c}_") for x in columns if x.startswith(f"{c}_")]
            out |= {f"{c}_{v}": flag for v, flag in zip(wanted, one_hot(c, wanted))}
    if "chiefcomplaint" in has:
        out |= {name: complaint_flag(F.col("chiefcomplaint"), name) for name in COMPLAINTS}
    if leaky:
        out |= {c: F.col(c).try_cast("double") for c in LEAKY if c in has}
    names = list(out) if columns is None else columns
    return df.select(*keys, *[out.get(c, F.lit(0.0)).alias(c) for c in names])


def upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """Merges new into old by key: known keys take only the `updated` columns, unknown keys the whole row.

    Of several new rows with a key the last by `seq` counts. new has old's columns and seq.
    """
    last = new.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("_place = 1").drop("_place", "seq")
    renamed = last.withColumnsRenamed({c: f"new_{c}" for c in last.columns if c != key}).withColumn("_new", F.lit(True))
    merged = old.withColumn("_old", F.lit(True)).join(renamed, key, "full")

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        known, fresh = F.col("_old").isNotNull(), F.col("_new").isNotNull()
        return F.when(known & fresh & F.lit(c in updated), F.col(f"new_{c}")).when(known, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)

    return merged.select(*[value(c) for c in old.columns])


def last_known(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("row")).select(key, "row.*")


def look_up(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """wanted: (id). rows: (stay_id, subject_id, seq, ...). The row of that stay, else the subject's last; ids without either are left out."""
    by_stay = wanted.join(rows, F.col("id") == F.col("stay_id")).select("id", *rows.columns)
    rest = wanted.join(by_stay, "id", "left_anti")
    last = last_known(rows, "subject_id", "seq")
    by_subject = rest.join(last, F.col("id") == F.col("subject_id")).select("id", *rows.columns)
    return by_stay.unionByName(by_subject)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
