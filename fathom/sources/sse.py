"""Server-sent event frames as text rows, and frames that come in chunks of bytes cut anywhere."""

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathom.session import materialise

#: A blank line: two line ends, each of them \r\n, \n or \r.
BLANK = re.compile(rb"(?>\r\n|\n|\r)(?>\r\n|\n|\r)")


def frames(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """events: (event, data) -> one text row each, with the columns in keep."""
    return events.select(*(keep or []), F.concat(F.lit("event: "), "event", F.lit("\r\ndata: "), "data", F.lit("\r\n\r\n")).alias("frame"))


def parse(stream: DataFrame, schema: str) -> DataFrame:
    """frame -> (event, data). Several data lines join; frames whose data is no JSON object are left out."""
    frame = F.regexp_replace("frame", "\r\n?", "\n")
    data = F.array_join(F.regexp_extract_all(frame, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    rows = stream.select(F.regexp_extract(frame, r"(?m)^event: ?(.*)$", 1).alias("event"), data.alias("raw"))
    return rows.where(F.try_parse_json("raw").isNotNull()).select("event", F.from_json("raw", schema).alias("data"))


def cut(data: bytes) -> tuple[list[bytes], bytes]:
    """(frames, rest): the frames that a blank line ends, without it, and the bytes after the last of them.

    A \\r at the very end stays in the rest with what it may belong to: the next byte may be its \\n.
    """
    sure = data[:-1] if data.endswith(b"\r") else data
    *whole, rest = BLANK.split(sure)
    return [x for x in whole if x.strip()], rest + data[len(sure) :]


def _text(frame: bytes) -> str:
    return frame.decode("utf-8", "replace")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (client, seq), of one range of the table. For each client in it: its bytes up to the first blank line and
    from the last one (`piece` 0 and 1; one piece if there is no blank line), and the frames between (null piece)."""
    columns = ("client", "part", "piece", "data")
    client, head, rest = None, b"", b""
    started = ended = False
    schema = None

    def flush(rows):
        if started:
            rows.append((client, 0, head if ended else rest))
            if ended:
                rows.append((client, 1, rest))

    def batch_of(rows, part):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], schema), pa.array([part] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], columns)

    part = 0
    for batch in batches:
        schema, rows = batch.schema.field("client").type, []
        for key, number, data in zip(batch.column("client").to_pylist(), batch.column("part").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            if not started or key != client:
                flush(rows)
                client, part, head, rest, started, ended = key, number, b"", b"", True, False
            rest += data or b""
            if not ended:
                sure = rest[:-1] if rest.endswith(b"\r") else rest
                if found := BLANK.search(sure):
                    head, rest, ended = rest[: found.end()], rest[found.end() :], True
            if ended:
                whole, rest = cut(rest)
                rows += [(key, None, x) for x in whole]
        yield batch_of(rows, part)
    if started:
        rows = []
        flush(rows)
        yield batch_of(rows, part)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of clients' pieces, sorted by (client, part, piece)."""
    client, rest, kind = None, b"", None

    def ended() -> list[bytes]:
        """No byte follows that might belong to a last \\r."""
        return [x for x in BLANK.split(rest)[:-1] if x.strip()]

    def batch_of(keys, found):
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(list(map(_text, found)), pa.string())], ["client", "frame"])

    for batch in batches:
        kind, keys, found = batch.schema.field("client").type, [], []
        for key, data in zip(batch.column("client").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if key != client:
                found += ended()
                keys += [client] * (len(found) - len(keys))
                client, rest = key, b""
            whole, rest = cut(rest + data)
            found += whole
            keys += [key] * len(whole)
        yield batch_of(keys, found)
    if last := ended():
        yield batch_of([client] * len(last), last)


def reassemble(chunks: DataFrame) -> DataFrame:
    """chunks: (client, seq, bytes) -> (client, frame): whole frames, whichever way their bytes were cut; an unfinished last
    one of a client is left out, and bytes that are no UTF-8 are replaced.

    Chunks are sorted over ranges of (client, seq), so that a client's stream, however long, is read by many tasks. What a
    range can't tell, the bytes before its first blank line and after its last, is two rows a client and range, and these are
    joined client by client.
    """
    kind = chunks.schema["client"].dataType.simpleString()
    ranges = chunks.select("client", "seq", "bytes").repartitionByRange("client", "seq").withColumn("part", F.spark_partition_id().cast("long"))
    found = ranges.sortWithinPartitions("client", "seq").mapInArrow(_pieces, f"client {kind}, part long, piece int, data binary")
    found = materialise(found, "frames")
    loose = found.where("piece is not null").repartition("client").sortWithinPartitions("client", "part", "piece").select("client", "data")
    sure = found.where("piece is null").select("client", F.col("data").cast("string").alias("frame"))
    return sure.unionByName(loose.mapInArrow(_joined, f"client {kind}, frame string"))


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rest = bytes(state.get[0]) if state.exists else b""
    out = []
    for rows in [pd.concat(list(batches)).sort_values("seq")]:
        whole, rest = cut(rest + b"".join(bytes(x) for x in rows["bytes"] if x is not None))
        out += map(_text, whole)
    state.update((rest,))
    yield pd.DataFrame({"client": [key[0]] * len(out), "frame": out})


def reassemble_stream(chunks: DataFrame) -> DataFrame:
    """The same of a stream whose chunks come in the order of seq, batch by batch: a client's state is the unfinished rest."""
    kind = chunks.schema["client"].dataType.simpleString()
    return chunks.groupBy("client").applyInPandasWithState(_carry, f"client {kind}, frame string", "rest binary", "append", GroupStateTimeout.NoTimeout)
