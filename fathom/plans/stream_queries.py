"""Streams: runs with trace and end, limits, and event frames from chunks of bytes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.plans.registry import ORACLES, query, read


@query("""WITH e AS (SELECT user_id AS run_id, event_id, epoch_us(ts) // 1000 AS t, event_type, props->>'k' AS k, lag(epoch_us(ts) // 1000) OVER w AS pt, lag(event_type) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)),
r AS (SELECT *, sum(CASE WHEN pt IS NULL OR pe = 'purchase' OR t - pt > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t, event_id) AS no FROM e),
g AS (SELECT run_id, no, min(t) AS began, max(t) AS last, count(*) AS n, string_agg(event_type, '>' ORDER BY t, event_id) AS trace, arg_max(k, (t, event_id)) FILTER (event_type <> 'error') AS k, arg_max(k, (t, event_id)) FILTER (event_type = 'error') AS error, bool_or(event_type = 'purchase') AS done FROM r GROUP BY 1, 2)
SELECT run_id, began, n, trace, k, error, CASE WHEN done THEN 'done' ELSE 'pending' END AS status FROM (SELECT *, max(no) OVER (PARTITION BY run_id) AS latest FROM g) WHERE done OR no < latest OR last + 86400000 < (SELECT max(epoch_us(ts) // 1000) - 600000 FROM events)""")
def stream_ended_runs(spark, sf_dir):
    """Each user's events as runs: a purchase ends one, and so does a day's silence."""
    from fathom.streaming.audit_stream import drained, event_stream
    from fathom.streaming.run_state import ended_runs, state_store

    k = F.get_json_object("props", "$.k")
    named = F.when(F.col("event_type") == "error", F.create_map(F.lit("error"), k)).otherwise(F.create_map(F.lit("k"), k))
    events = event_stream(spark, f"{sf_dir}/events.parquet")
    updates = events.select(F.col("user_id").alias("run_id"), "event_id", "time", F.col("event_type").alias("node"), named.alias("fields"), (F.col("event_type") == "purchase").alias("ends"))
    with state_store(spark):
        runs = drained(ended_runs(updates), "append")
    return runs.select("run_id", "began", "n", "trace", F.col("fields")["k"].alias("k"), F.col("fields")["error"].alias("error"), "status")


@query(ORACLES["rate_limit_minute"])
def rate_limit_stream(spark, sf_dir):
    from fathom.streaming.audit_stream import drained, event_stream, limit_stream

    return drained(limit_stream(event_stream(spark, f"{sf_dir}/events.parquet"), 1), "complete")


def in_chunks(events: DataFrame, size: int = 7) -> DataFrame:
    """Each user's events as frames, cut into chunks of a few bytes: (client, seq, bytes). Each fifth frame is broken."""
    from fathom.sources.sse import frames

    data = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", F.concat(F.lit("r"), "user_id").alias("run_id"))))
    told = events.select("user_id", "event_id", F.struct(F.col("event_type").alias("event"), data.alias("data")).alias("e"))
    whole = frames(told.select("user_id", "event_id", "e.*"), ["user_id", "event_id"]).withColumn("frame", F.col("frame").cast("binary"))
    cut = F.sequence(F.lit(0), F.octet_length("frame") - 1, F.lit(size))
    pieces = whole.select("user_id", "event_id", "frame", F.posexplode(cut).alias("i", "at"))
    return pieces.select(F.col("user_id").alias("client"), (F.col("event_id") * 1000 + F.col("i")).alias("seq"), F.substring(F.col("frame"), F.col("at") + 1, F.lit(size)).alias("bytes"))


def told(found: DataFrame) -> DataFrame:
    from fathom.sources.sse import parse

    return parse(found, "event_id long, run_id string").select("data.event_id", "event", "data.run_id")


@query(ORACLES["sse_parse"])
def sse_chunks(spark, sf_dir):
    """The frames of sse_parse from chunks of seven bytes."""
    from fathom.sources.sse import reassemble

    return told(reassemble(in_chunks(read(spark, sf_dir, "events"))))


@query(ORACLES["sse_parse"])
def sse_stream(spark, sf_dir):
    """The same as a stream."""
    from fathom.sources.sse import reassemble_stream
    from fathom.streaming.audit_stream import drained, event_stream

    return told(drained(reassemble_stream(in_chunks(event_stream(spark, f"{sf_dir}/events.parquet"))), "append"))
