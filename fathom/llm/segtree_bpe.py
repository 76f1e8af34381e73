"""Byte-level BPE encoding by segment trees over byte positions, and decoding.

Each piece of the pre-tokenising pattern has a segment tree whose leaves are byte positions: a leaf holds the rank of the
pair that starts there, the root the leftmost position of the least rank. A merge removes the pair's right symbol and
updates three leaves (itself, its live left neighbour, the removed symbol) and their ancestors, so a piece of n bytes takes
O(n log n) steps, however it merges. The trees of all pieces of like length step together as the rows of one array; the last
FEW go one by one. A piece of more than LONG bytes goes alone, in a tree of places that takes 20 bytes for each of its own.
"""

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fathom.llm.chunks import encode_batch
from fathom.llm.common import Generations, in_slices, whole, texts

NONE = np.int64(1) << np.int64(62)
CACHED_PARTS = 200_000
SLICE_BYTES = 2 << 20
FEW = 8
LONG = 1 << 16
NO_RANK = (1 << 31) - 1


class Bpe:
    """The merges of a rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pairs = pairs
        self._hash_pairs(np.fromiter(pairs.keys(), np.int64), np.fromiter(pairs.values(), np.int64))

    def _hash_pairs(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table with linear probing."""
        self.bits = int(len(keys) * 3).bit_length()
        self.slot_key, self.slot_value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.slot_key[at] == -1
            self.slot_key[at[free]] = keys[free]  # of several for a slot, one stays
            placed = self.slot_key[at] == keys
            self.slot_value[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what each pair merges into; NONE if it doesn't."""
        keys = left << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        there = self.slot_key[at]
        hit = there == keys
        out[hit] = self.slot_value[at[hit]]
        todo = np.flatnonzero(~hit & (there != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.slot_key[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.slot_value[at[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian uint32 ids of each piece. A piece that is a token is that token, else its merges decide."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = self._merge_long(piece)
            elif piece:
                by_width.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append(i)
            else:
                out[i] = b""
        for width, members in by_width.items():
            step = max(1, (1 << 21) // width)
            for first in range(0, len(members), step):
                some = members[first : first + step]
                for i, ids in zip(some, self._merge([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        n, lengths = len(pieces), np.array([len(p) for p in pieces])
        symbols = self.byte_ids[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)].reshape(n, width)
        places = np.arange(width)
        symbols[places >= lengths[:, None]] = -1
        after = np.broadcast_to(places + 1, (n, width)).copy()  # of each live symbol, its live right neighbour
        before = np.broadcast_to(places - 1, (n, width)).copy()
        # node 1 is the root, leaves begin at width; a node holds rank * width + place: the least is the leftmost of the least rank
        tree = np.full((n, 2 * width), NONE, np.int64)
        row, place = np.nonzero(places[:-1] < lengths[:, None] - 1)
        rank = self.pair_ranks(symbols[row, place], symbols[row, place + 1])
        real = rank != NONE
        tree[row[real], width + place[real]] = rank[real] * width + place[real]
        low = width
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live) > FEW:
            best = tree[live, 1]
            at = best % width
            gone = after[live, at]
            symbols[live, at] = best // width
            symbols[live, gone] = -1
            right = after[live, gone]
            after[live, at] = right
            has_right = right < lengths[live]
            before[live[has_right], right[has_right]] = at[has_right]
            left = before[live, at]
            has_left = left >= 0
            self._update(tree, width, live, gone, np.full(len(live), NONE))
            self._update(tree, width, live, at, self._key(width, symbols, live, at, right, has_right))
            self._update(tree, width, live[has_left], left[has_left], self._key(width, symbols, live[has_left], left[has_left], at[has_left], None))
            live = live[tree[live, 1] != NONE]
        for row in live.tolist():
            symbols[row] = self._merge_one(symbols[row].tolist(), after[row].tolist(), before[row].tolist(), tree[row].tolist(), width, int(lengths[row]))
        kept = symbols >= 0
        ids = symbols[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        return [ids[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]

    def _merge_one(self, symbols: list[int], after: list[int], before: list[int], tree: list[int], width: int, length: int) -> list[int]:
        """The merges of one tree. A point update stops where a node's minimum stays what it was."""
        none, pairs = int(NONE), self.pairs

        def put(leaf: int, left: int, right: int) -> None:
            rank = pairs.get(left << 32 | right) if left >= 0 else None
            node, value = width + leaf, none if rank is None else rank * width + leaf
            while node and tree[node] != value:
                tree[node] = value
                other = tree[node ^ 1] if node > 1 else none
                node >>= 1
                value = min(value, other)

        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            right = after[at] = after[gone]
            symbols[at], symbols[gone] = rank, -1
            put(gone, -1, -1)
            if right < length:
                before[right] = at
                put(at, rank, symbols[right])
            else:
                put(at, -1, -1)
            if before[at] >= 0:
                put(before[at], symbols[before[at]], rank)
        return symbols

    def _merge_long(self, piece: bytes) -> bytes:
        """The ids of one piece. An inner node holds the place of the leftmost least rank below it; leaf i is node n + i. A point
        update stops where another place stays the best."""
        n, pairs, none = len(piece), self.pairs, NO_RANK
        first = self.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int32)
        ranks = np.full(n, none, np.int32)
        for a in range(0, n - 1, LONG):
            b = min(n - 1, a + LONG)
            found = self.pair_ranks(first[a:b].astype(np.int64), first[a + 1 : b + 1].astype(np.int64))
            ranks[a:b] = np.where(found == NONE, none, found)
        nodes, past = np.zeros(n, np.int32), n
        while past > 1:  # nodes whose children are known
            low = (past + 1) // 2
            for a in range(low, past, LONG):
                i = np.arange(a, min(past, a + LONG))
                left, right = ((np.where(c >= n, c - n, nodes[np.minimum(c, n - 1)])) for c in (2 * i, 2 * i + 1))
                nodes[i] = np.where((ranks[left] < ranks[right]) | ((ranks[left] == ranks[right]) & (left < right)), left, right)
            past = low
        symbols, rank, best = (array("i", x.tobytes()) for x in (first, ranks, nodes))
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        del first, ranks, nodes

        def settle(place: int) -> None:
            node = (n + place) >> 1
            while node:
                a = 2 * node
                b = a + 1
                a, b = a - n if a >= n else best[a], b - n if b >= n else best[b]
                now = a if rank[a] < rank[b] or (rank[a] == rank[b] and a < b) else b
                if now == best[node] and now != place:
                    return
                best[node] = now
                node >>= 1

        while rank[at := best[1]] != none:
            made, gone = rank[at], after[at]
            right, left = after[gone], before[at]
            after[at], symbols[at], symbols[gone] = right, made, -1
            if rank[gone] != none:
                rank[gone] = none
                settle(gone)
            if right < n:
                before[right] = at
                rank[at] = pairs.get(made << 32 | symbols[right], none)
            else:
                rank[at] = none
            settle(at)
            if left >= 0:
                new = pairs.get(symbols[left] << 32 | made, none)
                if new != rank[left]:
                    rank[left] = new
                    settle(left)
        ids = np.frombuffer(symbols, np.int32)
        return ids[ids >= 0].astype("<u4").tobytes()

    def _key(self, width, symbols, rows, at, right, real) -> np.ndarray:
        key = np.full(len(rows), NONE)
        where = slice(None) if real is None else np.flatnonzero(real)
        rank = self.pair_ranks(symbols[rows[where], at[where]], symbols[rows[where], right[where]])
        key[where] = np.where(rank == NONE, NONE, rank * width + at[where])
        return key

    @staticmethod
    def _update(tree, width, rows, at, key) -> None:
        node = at + width
        tree[rows, node] = key
        while len(node) and node[0] > 1:  # all leaves have one depth
            parent = node >> 1
            tree[rows, parent] = np.minimum(tree[rows, 2 * parent], tree[rows, 2 * parent + 1])
            node = parent

    def encode_parts(self, found: list[str]) -> list[bytes]:
        split = [self.pattern.findall(x) for x in found]
        distinct = list({p for s in split for p in s})
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct]), strict=True))
        return [b"".join(map(ids.__getitem__, s)) for s in split]

    def encode(self, batch: list[str], cache: Generations | None = None) -> list[np.ndarray]:
        """Ids of each text, as tiktoken's encode_ordinary gives them."""
        return encode_batch(batch, Generations(CACHED_PARTS) if cache is None else cache, self.encode_parts)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def loaded(path: str, pattern: str) -> tuple[Bpe, Generations]:
    """Once a Python worker; the cache is bounded."""
    return Bpe(path, pattern), Generations(CACHED_PARTS)


@whole
def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array<int>), decoded (binary).

    path: a rank file in base64, with a token for each byte; every executor must have it. Null and empty texts have no ids
    and decode to nothing. A very long text, or one without a space, is encoded whole: some 35 bytes of memory for each byte of an
    unbroken run. Repeated rows each give a row; an empty table gives none. Other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids array<int>, decoded binary"

    def run(batches):
        bpe, cache = loaded(path, pattern)
        for batch in batches:
            found = texts(batch.column("text"))
            for a, b in in_slices(found, SLICE_BYTES):
                ids = bpe.encode(found[a:b], cache)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@whole
def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode_and_decode with ids and decoded bytes as sha256 digests, taken where they are made: ids need no row of their own.

    Null and empty texts have the digests of nothing. Repeated rows, and rows that share a doc_id, each give a row; an empty table
    gives none; other columns, whatever their names, are not read. A text of any length is encoded whole by one task.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        bpe, cache = loaded(path, pattern)
        for batch in batches:
            found = texts(batch.column("text"))
            for a, b in in_slices(found, SLICE_BYTES):
                counts, shown, decoded = [], [], []
                for ids in bpe.encode(found[a:b], cache):
                    counts.append(len(ids))
                    told, back = hashlib.sha256(), hashlib.sha256()
                    for first in range(0, len(ids), LONG):
                        some = ids[first : first + LONG].tolist()
                        told.update(("," * (first > 0) + ",".join(map(bpe.decimals.__getitem__, some))).encode())
                        back.update(bpe.decode(some))
                    shown.append(told.hexdigest())
                    decoded.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(counts, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
