"""Numeric functions: Column in, Column out; null stays null unless stated."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.text import strip


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def coerce_pain(v: Column) -> Column:
    """A 0 to 10 score from free text: words for none are 0, else the first number, at most 10."""
    s = F.lower(strip(v))
    number = F.regexp_extract(s, r"\d+", 0).try_cast("double")
    return F.when(v.isNull(), None).when(s.isin("denies", "none", "no", "0"), 0.0).when(number.isNotNull(), F.least(F.lit(10.0), number))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return a / F.nullif(b, F.lit(0.0))


def risk_band(p: Column) -> Column:
    return F.when(p >= 0.75, "high").when(p >= 0.5, "elevated").when(p >= 0.25, "moderate").when(p.isNotNull(), "low")


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval, within 0 and 1; (0, 0) for n = 0."""
    share = hits / n
    middle = (share + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), middle + half))


def acuity_score(acuity: Column, median: Column) -> Column:
    return (5 - F.coalesce(acuity, median)) / 4


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def safe_number(v: Column, digits: int = 2) -> Column:
    """A number rounded, or null for what is none."""
    x = v.try_cast("double")
    return F.when(~F.isnan(x), F.round(x, digits))
