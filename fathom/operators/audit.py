"""Audit log: events (run_id, node, event, ts, duration_ms, detail JSON) to listings, counters and histograms."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bucket bounds that define the results.
LATENCY = (0.5, 1, 2, 3, 5, 8, 13, 21, 34, 60)
GROUNDEDNESS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 1.0)


def recent(events: DataFrame, order: str, limit: int, most: int = 200) -> DataFrame:
    """The newest events; limit is held within 1 and most. Each task keeps its newest only."""
    return events.orderBy(F.desc(order)).limit(max(1, min(limit, most)))


def stats(events: DataFrame, order: str, outcome: Column, groundedness: Column, last: int = 2000) -> DataFrame:
    """answered, escalated, rate and mean groundedness over the last events. No answers and escalations: rate is null."""
    rows = events.orderBy(F.desc(order)).limit(last).select(outcome.alias("o"), groundedness.alias("g"))
    sums = rows.agg(F.count_if(F.col("o") == "final").alias("answered"), F.count_if(F.col("o") == "escalate").alias("escalated"), F.round(F.avg("g"), 6).alias("mean_groundedness"))
    return sums.withColumn("rate", F.round(F.col("escalated") / F.nullif(F.col("answered") + F.col("escalated"), F.lit(0)), 6))


def counters(runs: DataFrame) -> DataFrame:
    """runs: (outcome, route, attempts) -> (family, label, value)."""
    total = runs.groupBy().agg(F.count("*").alias("runs"), F.count_if(F.col("outcome") == "escalate").alias("escalations"), F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).cast("long").alias("reformulations"))
    wide = total.unpivot([], ["runs", "escalations", "reformulations"], "family", "value").select("family", F.lit("").alias("label"), "value")
    by = lambda c: runs.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("value")).select(F.lit(c).alias("family"), "label", "value")
    return wide.unionByName(by("outcome")).unionByName(by("route"))


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(le, n, total): how many values are at most each bound, then all; nulls aren't counted. One pass, one row a bound."""
    x = F.col(value)
    sums = rows.where(x.isNotNull()).agg(*[F.count_if(x <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("every"), F.sum(x).alias("total"))
    cells = [F.struct(F.lit(str(float(b))).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("every").alias("n"))]
    return sums.select(F.explode(F.array(*cells)).alias("c"), "total").select("c.le", "c.n", "total")


def exposition(histogram_rows: DataFrame, name: str) -> DataFrame:
    """The text lines of a histogram: its type, one line a bucket, the sum and the count."""
    line = lambda place, text: F.struct(F.lit(place).alias("place"), text.alias("line"))
    bucket = line(1, F.format_string(f'{name}_bucket{{le="%s"}} %d', "le", "n"))
    ends = F.array(line(0, F.lit(f"# TYPE {name} histogram")), bucket, line(2, F.format_string(f"{name}_sum %.4f", F.coalesce("total", F.lit(0.0)))), line(3, F.format_string(f"{name}_count %d", "n")))
    lines = F.when(F.col("le") == "+Inf", ends).otherwise(F.array(bucket))
    return histogram_rows.select(F.explode(lines).alias("x")).select("x.line")


def counter_lines(counted: DataFrame, prefix: str) -> DataFrame:
    """counters() as text: for each family its type and one line a label; a family without labels has one plain line."""
    name = F.concat(F.lit(f"{prefix}_"), "family", F.lit("_total"))
    plain = F.col("label") == ""
    value = F.when(plain, F.format_string("%s %d", name, "value")).otherwise(F.format_string('%s{%s="%s"} %d', name, "family", "label", "value"))
    types = counted.select(F.concat(F.lit("# TYPE "), name, F.lit(" counter")).alias("line")).distinct()
    return types.unionByName(counted.select(value.alias("line")))


def over_limit(events: DataFrame, client: str, ts: str, per_minute: int = 30) -> DataFrame:
    """(client, minute, n) of tumbling minutes with more than per_minute events. Works on streams too."""
    n = events.groupBy(F.col(client).alias("client"), F.window(F.col(ts).cast("timestamp"), "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > per_minute).select("client", F.unix_micros(F.col("w.start")).alias("minute"), "n")


def running_best(attempts: DataFrame, run: str, order: str, score: str) -> DataFrame:
    upto = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return attempts.withColumn("best", F.max(score).over(upto)).withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(order)))
