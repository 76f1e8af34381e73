"""Run states over batches and restarts, and frames from bytes cut anywhere."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.sources import sse
from fathom.streaming.audit_stream import append_json
from fathom.streaming.run_state import PROVIDER, ended_runs, state_store

EVENTS = "run_id long, event_id long, at long, node string, fields map<string,string>, ends boolean"
DAY = 86_400


def batch(first, rows):
    return [(run, first + i, at, node, fields, ends) for i, (run, at, node, fields, ends) in enumerate(rows)]


BATCHES = [
    batch(0, [(1, 10, "plan", {"route": "a", "query": "q1"}, False), (2, 11, "plan", {"route": "b"}, False), (1, 20, "draft", {"route": "c"}, False), (3, 25, "plan", None, True), (3, 30, "plan", {"x": None}, False)]),
    batch(10, [(1, 40, "final", {"answer": "yes"}, True), (1, 50, "plan", {"query": "again"}, False), (2, 60, "draft", {"k": "1"}, False), (2, 60 + 2 * DAY, "plan", {"k": "2"}, False)]),
    batch(20, [(1, 3 * DAY, "draft", {"n": "3"}, False), (4, 9 * DAY, "plan", {}, True)]),
]
WANTED = {
    (1, 10_000, 3, "plan>draft>final", (("answer", "yes"), ("query", "q1"), ("route", "c")), "done"),
    (3, 25_000, 1, "plan", (), "done"),
    (2, 11_000, 2, "plan>draft", (("k", "1"), ("route", "b")), "pending"),  # by the next event's time
    (2, (60 + 2 * DAY) * 1000, 1, "plan", (("k", "2"),), "pending"),  # by the watermark
    (1, 50_000, 1, "plan", (("query", "again"),), "pending"),
    (3, 30_000, 1, "plan", (("x", None),), "pending"),
    (1, 3 * DAY * 1000, 1, "draft", (("n", "3"),), "pending"),
    (4, 9 * DAY * 1000, 1, "plan", (), "done"),
}


@pytest.mark.parametrize("together", [True, False])
def test_runs_over_batches_and_a_restart(spark, tmp_path, together):
    """All at once, or a batch a start, each start going on from the checkpoint: the same runs, each told once."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    before = spark.conf.get(PROVIDER, "")

    def run():
        stream = spark.readStream.schema(EVENTS).parquet(source).withColumn("time", F.timestamp_seconds("at")).withWatermark("time", "10 minutes")
        with state_store(spark):
            ended_runs(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    for rows in BATCHES:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        if not together:
            run()
    if together:
        run()
    got = [(r.run_id, r.began, r.n, r.trace, tuple(sorted(r.fields.items())), r.status) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == WANTED
    assert spark.conf.get(PROVIDER, "") == before


def test_log_is_appended_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        spark.range(i * 5, i * 5 + 5).write.mode("append").parquet(source)
        append_json(spark.readStream.schema("id long").parquet(source), out, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.id for r in spark.read.schema("id long").json(out).collect()) == list(range(10))


ENDS = ["\n", "\r\n", "\r"]


def plain_frames(data: bytes) -> list[str]:
    text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    return [x.strip("\n") for x in text.split("\n\n")[:-1] if x.strip()]


def same(frames: list[str]) -> list[str]:
    return [f.replace("\r\n", "\n").replace("\r", "\n").strip("\n") for f in frames]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["event: a", "data: é", "data: {}", ": ping", "", "日"]) | st.sampled_from(ENDS), max_size=14), st.randoms(use_true_random=False))
def test_cut_finds_the_same_frames_however_bytes_arrive(parts, rng):
    data = "".join(parts).encode() + b"x"  # no stream ends in an open \r here
    found, rest, at = [], b"", 0
    while at < len(data):
        n = rng.randint(1, 5)
        whole, rest = sse.cut(rest + data[at : at + n])
        found += [x.decode() for x in whole]
        at += n
    assert [x for x in same(found) if x] == plain_frames(data)


def test_reassembly_over_many_tasks(spark):
    """Three clients, one of them with most of the bytes; chunks of one to nine bytes; all kinds of line ends."""
    rng = random.Random(5)
    rows, wanted = [], {}
    for client, n in ((1, 400), (2, 3), (3, 40)):
        text = "".join(f"event: e{i}{rng.choice(ENDS)}data: {'é' * rng.randint(0, 9)}{i}{(e := rng.choice(ENDS))}{e}" for i in range(n))
        data, at, seq = text.encode(), 0, 0
        wanted[client] = plain_frames(data)
        while at < len(data):
            size = rng.randint(1, 9)
            rows.append((client, seq, bytearray(data[at : at + size])))
            at, seq = at + size, seq + 1
    rows += [(4, 0, bytearray(b"event: unfinished\n")), (5, 0, None), (5, 1, bytearray(b"\r\n\r\n: only a ping\n\n"))]
    chunks = spark.createDataFrame(rows, "client long, seq long, bytes binary").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges are put together
    try:
        got = sse.reassemble(chunks).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    found = {c: sorted(same([r.frame for r in got if r.client == c])) for c in (1, 2, 3)}
    assert found == {c: sorted(x) for c, x in wanted.items()}
    assert not [r for r in got if r.client == 4] and [r.frame for r in got if r.client == 5] == [": only a ping"]
    assert sse.reassemble(chunks.limit(0)).count() == 0


def test_frames_of_a_stream_over_batches(spark, tmp_path):
    from fathom.streaming.audit_stream import drained

    data = "".join(f"event: e\r\ndata: {i}é\r\n\r\n" for i in range(50)).encode()
    source = str(tmp_path / "in")
    pieces = [(1, i, bytearray(data[i * 3 : i * 3 + 3])) for i in range(-(-len(data) // 3))]
    for a in range(0, len(pieces), 100):
        spark.createDataFrame(pieces[a : a + 100], "client long, seq long, bytes binary").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("client long, seq long, bytes binary").option("maxFilesPerTrigger", 1).parquet(source)
    got = drained(sse.reassemble_stream(stream), "append")
    assert sorted(same([r.frame for r in got.collect()])) == sorted(plain_frames(data))
