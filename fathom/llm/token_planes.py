"""Token ids as bit-plane or byte-plane chunks.

A file is a Parquet part of a table in the shared folder, written by one task of a range partitioning by doc_id: Spark's
committer makes it appear whole or not at all, and any executor can read any part. Its rows are chunks:

    shard, chunk       the writing task and the chunk's number in it; ids are stored in ascending (shard, chunk)
    first, n_ids       ids of the shard before this chunk; ids in it (the chunk index)
    doc_ids, doc_ids_n the documents whose ids the chunk holds, whole, and how many ids each has
    planes             for each block of BLOCK ids (the last padded with zeros) WIDTH zstandard frames, one a plane
    ends               where each frame ends in `planes`

Plane k of a block holds byte k (or bit k) of all its ids, least significant first.
"""

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.chunks import encode_batch
from fathom.llm.common import Generations, materialise, small_batches, texts, whole

BLOCK = 16_384
CHUNK_IDS = 16 * BLOCK
CACHED_PARTS = 500_000
SLICE_BYTES = 8 << 20  # words recur: the more text together, the fewer look-ups
WIDTH = {"byte": 4, "bit": 32}
CHUNKS = "shard int, chunk long, first long, n_ids long, doc_ids array<long>, doc_ids_n array<long>, planes binary, ends array<int>"
#: Byte-level vocabularies write a visible Latin-1 byte as itself and the n-th of the others as the letter 256 + n.
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_LETTERS = {b: chr(256 + n) for n, b in enumerate(HIDDEN)}
PACKER, UNPACKER = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def to_planes(block: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of uint32 ids; its length is a multiple of 8."""
    cells = block.astype("<u4").view(np.uint8).reshape(len(block), 4)
    if kind == "bit":
        bits = np.unpackbits(cells, axis=1, bitorder="little")
        return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    return [np.ascontiguousarray(cells[:, k]).tobytes() for k in range(4)]


def from_planes(planes: list[bytes], kind: str = "byte") -> np.ndarray:
    if kind == "bit":
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little") for p in planes], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).view("<u4").ravel()


def pack(ids: np.ndarray, kind: str = "byte") -> tuple[bytes, list[int]]:
    """All blocks' compressed planes and where each ends."""
    padded = np.zeros(-(-len(ids) // BLOCK) * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    frames = [PACKER.compress(p) for block in padded.reshape(-1, BLOCK) for p in to_planes(block, kind)]
    return b"".join(frames), np.cumsum([len(f) for f in frames], dtype=np.int32).tolist()


def unpack(planes: bytes, ends: list[int], n_ids: int, kind: str = "byte") -> np.ndarray:
    frames = [UNPACKER.decompress(planes[a:b]) for a, b in zip([0, *ends], ends)]
    width = WIDTH[kind]
    blocks = [from_planes(frames[i : i + width], kind) for i in range(0, len(frames), width)]
    return np.concatenate([*blocks, np.zeros(0, np.uint32)])[:n_ids]


@lru_cache(maxsize=1)
def loaded(path: str):
    """Once a Python worker: from texts to arrays of their ids, parts coming from a bounded cache."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    pattern, model, space = regex.compile(public_tokenizers.PATTERN), tokenizer.model, BYTE_LETTERS[32]
    cache = Generations(CACHED_PARTS)

    def merged(letters: str) -> bytes:
        """The ids of one match of the pattern, by the library's model alone."""
        return array("I", [x.id for x in model.tokenize(letters)]).tobytes()

    def piece_ids(piece: str) -> bytes:
        ids = cache.get(piece)  # a piece is a part too: most are words that stand alone elsewhere
        if ids is None:
            plain = piece.isascii() and piece.isprintable()  # but for the space, such bytes are written as themselves
            ids = cache[piece] = merged(piece.replace(" ", space) if plain else piece.encode().decode("latin-1").translate(BYTE_LETTERS))
        return ids

    def encode_parts(found: list[str]) -> list[bytes]:
        """A space and letters are one match. Letters on which versions of Unicode might differ go through the whole library."""
        out, whole = [], []
        for p in found:
            if p.isascii():
                bare = p[1:]
                if bare.isalpha() and p[0] == " ":
                    out.append(merged(space + bare))
                    continue
            elif max(p) >= "\u0250":
                whole.append(len(out))
                out.append(b"")
                continue
            out.append(b"".join(map(piece_ids, pattern.findall(p))))
        for i, x in zip(whole, tokenizer.encode_batch_fast([found[i] for i in whole], add_special_tokens=False) if whole else (), strict=True):
            out[i] = np.array(x.ids, "<u4").tobytes()
        return out

    def encode(found: list[str]) -> list[np.ndarray]:
        """A text that holds an added token, such as <|endoftext|>, goes through the library whole."""
        special = {i for i, text in enumerate(found) if any(token in text for token in added)}
        out = encode_batch(["" if i in special else text for i, text in enumerate(found)] if special else found, cache, encode_parts)
        for i in special:
            out[i] = np.array(tokenizer.encode(found[i], add_special_tokens=False).ids, np.uint32)
        return out

    return encode


def in_large_slices(batches):
    """(doc_ids, texts) of about SLICE_BYTES of text together, whatever the batches' size; one row at least."""
    numbers, found, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
            numbers.append(doc_id)
            found.append(text)
            held += len(text)
            if held >= SLICE_BYTES:
                yield numbers, found
                numbers, found, held = [], [], 0
    if found:
        yield numbers, found


def write(docs: DataFrame, path: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Encodes docs, appends end_id to each, writes the chunks in ascending doc_id order and returns the written table.

    path: a tokenizers file that every executor has. Null doc_ids come first; rows of one doc_id are ordered by their text,
    and go to several tasks where their first characters differ. A very long text is encoded, and its chunk held, whole.
    """

    def run(batches):
        encode = loaded(path)
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        held, doc_ids, size = [], [], 0

        def flush():
            nonlocal chunk, first, held, doc_ids, size
            ids = np.concatenate(held)
            planes, ends = pack(ids, kind)
            row = {"shard": shard, "chunk": chunk, "first": first, "n_ids": len(ids), "doc_ids": doc_ids, "doc_ids_n": [len(x) for x in held], "planes": planes, "ends": ends}
            chunk, first, held, doc_ids, size = chunk + 1, first + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for numbers, found in in_large_slices(batches):
            for doc_id, ids in zip(numbers, encode(found), strict=True):
                held.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc_id)
                size += len(ids) + 1
                if size >= CHUNK_IDS:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        return materialise(ordered.mapInArrow(run, CHUNKS), "token-planes")


ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ids_n", pa.list_(pa.int64())), ("planes", pa.binary()), ("ends", pa.list_(pa.int32()))])


def read(chunks: DataFrame, kind: str = "byte") -> DataFrame:
    """Documents of written chunks: doc_id, shard, first (ids before it in its shard), ids (array<int>)."""
    return _documents(chunks, kind, "ids array<int>", lambda ids: pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())))


def _documents(chunks: DataFrame, kind: str, column: str, of) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["planes"], row["ends"], row["n_ids"], kind)
                ends = np.cumsum(row["doc_ids_n"])
                each = np.split(ids, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(each), pa.int32()), pa.array(row["first"] + ends - row["doc_ids_n"], pa.int64()), pa.array([len(x) for x in each], pa.int64()), of(each)],
                    ["doc_id", "shard", "first", "n_tokens", column.split()[0]],
                )

    return chunks.mapInArrow(run, f"doc_id long, shard int, first long, n_tokens long, {column}")


def starts(chunks: DataFrame) -> DataFrame:
    """Ids of all shards before each shard, from the chunk index alone: one row per writing task."""
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


@whole
def write_and_read(docs: DataFrame, path: str, end_id: int = 2, kind: str = "byte") -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids, end ids included, of all documents before it in ascending doc_id order. A null or empty text is
    just the end id. Rows that share a doc_id are documents of their own, in the order of their texts (null first). An
    empty table gives no rows. Other columns are not read.
    """
    chunks = write(docs, path, end_id, kind)
    found = _documents(chunks, kind, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))
    return found.join(starts(chunks), "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
