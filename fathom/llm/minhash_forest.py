"""Near-duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Exact copies of a set are one class. Each class has TREES signatures of DEPTH min-hashes, and stands in TREES sorted orders, one
by each whole signature. Neighbours are those of the longest common prefix: a region, the classes that share a tree's first
BASE hashes, is one run of its order, and is gone through in blocks of BLOCK * REGION classes at most. A region that is no
larger is one block. A larger one is cut where neighbours share the fewest hashes, so the denser a region is, the deeper the
prefix that its blocks share. Orders are range-partitioned by the whole signature where a region is large, so that none, however
large, is one task's.

Within a block, those whose signatures agree in less than LIKELY of all positions are let go (a true link falls below that
with a probability under 1e-5); the others span a forest of candidate links, fewer than the block has members, however dense it
is. Blocks part pairs of a large region. Where its classes aren't all connected by then, pairs of blocks dealt by hash are
compared, each a task's group, what is connected already being passed over: so all pairs of a region meet, however large it is.
The classes that candidates connect are then compared on their full sets until all links between different parts are known to
be there or not. A pair at the threshold shares no region in any tree with a probability of (1 - 0.8**3)**16 = 1e-5; that is
the miss rate of dense regions too.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import binary_texts, in_slices, materialise, whole
from fathom.llm.components import components, joined
from fathom.llm.wordhash import mix, words

TREES, DEPTH, BASE = 16, 6, 3
HASHES = TREES * DEPTH
REGION = 512
BLOCK = 8
LIKELY = 0.60
GROUP_SHINGLES = 1 << 17
SLICE_BYTES = 1 << 20

_state = np.random.default_rng(20240607)
SLOPES = _state.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _state.integers(0, 1 << 32, HASHES, dtype=np.uint32)
STEPS = _state.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; of its whole word sequence if that is shorter."""
    found = words(texts)
    h = found.hash
    n = max(0, len(h) - k + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(k):
        runs += h[j : j + n] * STEPS[j]
    runs = mix(runs)
    out = []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([np.sum(h[a:b] * STEPS[: b - a]) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 1024):
        np.minimum(least, (low[a : a + 1024, None] * SLOPES + SHIFTS).min(axis=0), out=least)
    return least


def class_id(shingles: np.ndarray) -> int | None:
    """64 bits that equal sets share; different sets share them with a probability of 2**-64."""
    if not len(shingles):
        return None
    return int(mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, cid (null for an empty set) and signature of each document."""

    def run(batches):
        for batch in batches:
            found = binary_texts(batch.column("text"))
            for a, b in in_slices(found, SLICE_BYTES):
                sets = shingle_sets(found[a:b], k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([class_id(s) for s in sets], pa.int64()), pa.array([signature(s).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "cid", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cid long, signature binary")


def forest_rows(classes: DataFrame) -> DataFrame:
    """For each class and tree: the tree, its first BASE hashes there (the region), the others, the class, and one byte of each
    of its hashes."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, TREES, DEPTH * 4)
            low = [x.tobytes() for x in sig.reshape(len(sig), HASHES, 4)[:, :, 3]]
            for tree in range(TREES):
                first, rest = sig[:, tree, : 4 * BASE], sig[:, tree, 4 * BASE :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sig), tree, np.int32)), pa.array([x.tobytes() for x in first], pa.binary()), pa.array([x.tobytes() for x in rest], pa.binary()), batch.column("cid"), pa.array(low, pa.binary())], ["tree", "key", "deep", "cid", "low"]
                )

    return classes.select("cid", "signature").mapInArrow(run, "tree int, key binary, deep binary, cid long, low binary")


def spanning(low: np.ndarray, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest over the rows that connects those whose bytes agree in at least LIKELY of the positions, directly or not. Rows
    of one label are connected already, and get no links for that."""
    rest, links = np.arange(len(low)), []
    left = low  # the rows of rest
    while len(rest):
        queue, rest, left = [rest[0]], rest[1:], left[1:]
        while queue and len(rest):
            i = queue.pop()
            near = (left == low[i]).sum(axis=1) >= LIKELY * HASHES
            if label is not None:
                known = label[rest] == label[i]
                links += [(i, j) for j in rest[near & ~known]]
                near |= known
            elif near.any():
                links += [(i, j) for j in rest[near]]
            if near.any():
                queue += rest[near].tolist()
                rest, left = rest[~near], left[~near]
    return links


def cuts(prefix: np.ndarray, limit: int) -> list[int]:
    """Where to cut sorted signatures (rows of bytes), so that no block has more than limit rows: each cut stands where, in the
    second half of what a block may hold, neighbours share the fewest hashes."""
    out, first = [], 0
    while len(prefix) - first > limit:
        span = prefix[first + limit // 2 : first + limit + 1]
        same = (span[1:].view(">u4") == span[:-1].view(">u4")).reshape(len(span) - 1, -1)
        shared = np.cumprod(same, axis=1).sum(axis=1)
        first += limit // 2 + 1 + int(shared.argmin())
        out.append(first)
    return out


def _sorted_runs(batches, by: list[str], found_in):
    """Calls found_in(table) for each run of rows that agree in `by`, rows coming sorted by it; links as record batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]).combine_chunks() if held else table
        starts = _run_starts(held, by)
        yield _links_of(held, starts, found_in)
        held = held.slice(starts[-1])  # the last run may go on
    if held:
        yield _links_of(held, np.append(_run_starts(held, by), len(held)), found_in)


def _run_starts(table: pa.Table, by: list[str]) -> np.ndarray:
    changes = np.zeros(max(0, len(table) - 1), bool)
    for name in by:
        column = table[name].combine_chunks()
        values = np.frombuffer(b"".join(column.to_pylist()), f"V{4 * BASE}") if name == "key" else column.to_numpy()
        changes |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(changes) + 1])


def _links_of(table: pa.Table, starts: np.ndarray, found_in) -> pa.RecordBatch:
    cid, found = table["cid"].to_numpy(), []
    for i in np.flatnonzero(np.diff(starts) > 1):
        a, b = int(starts[i]), int(starts[i + 1])
        found += [(i + a, j + a) for i, j in found_in(table.slice(a, b - a))]
    at = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(cid[at[:, 0]]), pa.array(cid[at[:, 1]])], ["a", "b"])


def _bytes_of(table: pa.Table, name: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), np.uint8).reshape(-1, width)


def neighbour_links(rows: DataFrame, block: int) -> DataFrame:
    """Candidate links (a, b) within the blocks of each tree's sorted order. rows: of forest_rows, `place` being what a large
    region is spread by, and null in others, which so are never parted."""

    def found_in(region: pa.Table):
        low = _bytes_of(region, "low", HASHES)
        at = [0, *cuts(_bytes_of(region, "deep", 4 * (DEPTH - BASE)), block), len(low)]
        for a, b in zip(at, at[1:]):
            yield from ((i + a, j + a) for i, j in spanning(low[a:b]))

    def run(batches):
        return _sorted_runs(batches, ["tree", "key"], found_in)

    order = ["tree", "key", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions("tree", "key", "deep", "cid").mapInArrow(run, "a long, b long")


def links_across(rows: DataFrame) -> DataFrame:
    """Candidate links between classes of different labels that share a large region. rows: (tree, key, blocks, cid, label, low)
    of large regions. Each is dealt into blocks by hash, and each pair of them is a group."""
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = ["tree", "key", "first", "second"]
    rows = rows.select("tree", "key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "cid", "label", "low")

    def run(batches):
        return _sorted_runs(batches, by, lambda group: spanning(_bytes_of(group, "low", HASHES), group["label"].to_numpy()))

    return rows.repartition(*by).sortWithinPartitions(*by, "cid").mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame, region: int = REGION) -> DataFrame:
    """Candidate links (a, b) between classes: neighbours in the sorted orders, and then what large regions are still lacking."""
    block = BLOCK * region
    rows = forest_rows(classes)
    large = rows.groupBy("tree", "key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("tree", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    large = materialise(large, "regions")
    n_large = large.count()
    tidy = lambda links: links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not n_large:
        return tidy(neighbour_links(rows.withColumn("place", F.lit(None).cast("binary")), block))
    rows = joined(rows, large, ["tree", "key"], "left", n_large).withColumn("place", F.when(F.col("blocks").isNotNull(), F.col("deep")))
    near = materialise(tidy(neighbour_links(rows, block)), "neighbours")
    labels = components(near)
    dense = joined(rows.where("blocks is not null"), labels.withColumnRenamed("node", "cid"), "cid", "left", labels.count())
    dense = materialise(dense.select("tree", "key", "blocks", "cid", F.coalesce("component", "cid").alias("label"), "low"), "dense")
    several = dense.groupBy("tree", "key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("tree", "key")
    rest = joined(dense, materialise(several, "several"), ["tree", "key"], "left_semi", n_large)
    return near.unionByName(tidy(links_across(rest)))


def linked_parts(sets: list[np.ndarray], label: np.ndarray, percent: int) -> np.ndarray:
    """The components of the sets under similarity >= percent / 100; those of equal label are in one already.

    Breadth first: a set is compared only with those not reached yet, so a group of copies takes few comparisons.
    """
    sizes = np.array([len(s) for s in sets])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marked = np.zeros(dense.max() + 1, bool)
    part = np.full(len(sets), -1)
    rest, flat = np.arange(len(sets)), dense
    queue: list[int] = []
    while len(rest):
        if queue:
            i = queue.pop()
            own = dense[ends[i] - sizes[i] : ends[i]]
            marked[own] = True
            n = sizes[rest]
            common = np.add.reduceat(marked[flat], np.cumsum(n) - n)
            marked[own] = False
            near = 100 * common >= percent * (sizes[i] + n - common)
            at = part[i]
        else:
            at = rest[0]
            near = rest == at
        if near.any():
            near = np.isin(label[rest], label[rest[near]])
            part[rest[near]] = at
            queue += rest[near].tolist()
            flat = flat[np.repeat(~near, sizes[rest])]
            rest = rest[~near]
    return part


def confirm(members: DataFrame, percent: int) -> DataFrame:
    """members: (grp, cid, label, shingles) -> (a, b): the label of each cid in grp with that of its part, all links in grp being
    known."""

    def run(batches):
        def done(cids, labels, sets):
            cids, first = np.unique(np.array(cids), return_index=True)
            labels, sets = np.array(labels)[first], [np.frombuffer(sets[i], "<u8") for i in first]
            part = linked_parts(sets, labels, percent) if len(sets) > 1 else np.zeros(1, int)
            return pa.RecordBatch.from_arrays([pa.array(labels), pa.array(labels[part])], ["a", "b"])

        group, cids, labels, sets = None, [], [], []
        for batch in batches:
            for g, c, x, s in zip(*(batch.column(k).to_pylist() for k in ("grp", "cid", "label", "shingles"))):
                if g != group and cids:
                    yield done(cids, labels, sets)
                    cids, labels, sets = [], [], []
                group = g
                cids.append(c)
                labels.append(x)
                sets.append(s)
        if cids:
            yield done(cids, labels, sets)

    return members.repartition("grp").sortWithinPartitions("grp").select("grp", "cid", "label", "shingles").mapInArrow(run, "a long, b long")


def shingles_of(docs: DataFrame, k: int) -> DataFrame:
    """docs with the expected cid -> cid, group, n and the set's bytes, for the rows whose text has that class."""

    def run(batches):
        for batch in batches:
            found = binary_texts(batch.column("text"))
            for a, b in in_slices(found, SLICE_BYTES):
                sets = shingle_sets(found[a:b], k)
                cids, groups = batch.column("cid")[a:b].to_pylist(), batch.column("grp")[a:b].to_pylist()
                rows = [(g, c, len(s), s.tobytes()) for g, c, s in zip(groups, cids, sets) if class_id(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["grp", "cid", "n", "shingles"])

    return docs.select("text", "cid", "grp").mapInArrow(run, "grp long, cid long, n long, shingles binary")


def confirmed_parts(docs: DataFrame, one_of: DataFrame, found: DataFrame, k: int, percent: int, group_shingles: int) -> DataFrame:
    """(node, component): the classes of found with the parts that links on full sets connect. found: (node, component) of
    candidates.

    A component of up to group_shingles shingles is one task's group. A larger one is dealt into blocks. Links within blocks
    come first, then those among one class of each part: as each class is in one block there, its part is known at once. Only
    where a component is still in several parts after that, each pair of blocks is compared, what is in one part already being
    skipped, and the parts' links are followed.
    """
    n = found.count()
    wanted = materialise(joined(one_of, found.select(F.col("node").alias("cid"), F.col("component").alias("grp")), "cid", "inner", n), "members")
    sets = shingles_of(joined(docs.select("doc_id", "text"), wanted.select("doc_id", "cid", "grp"), "doc_id", "inner", n), k)
    blocks = wanted.groupBy("grp").agg(F.ceil(F.sum("n_shingles") / group_shingles).alias("blocks"))
    large = materialise(blocks.where("blocks > 1"), "large")
    n_large = large.count()
    part = lambda a, b: (F.col("a").alias(a), F.col("b").alias(b))
    if not n_large:
        return materialise(confirm(sets.withColumn("label", F.col("cid")), percent), "parts").select(*part("node", "component"))
    sets = materialise(joined(sets, large, "grp", "left", n_large), "sets")
    block = lambda n: F.when(n.isNull(), F.col("grp")).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64("cid"), n)))
    first = materialise(confirm(sets.withColumn("label", F.col("cid")).withColumn("grp", block(F.col("blocks"))), percent), "blocks")
    labelled = lambda parts: joined(sets.where("blocks is not null"), parts, "cid", "inner", n)
    # one of each part: they are few, and most often linked
    leaders = labelled(first.select(*part("cid", "label"))).where("cid = label")
    sizes = leaders.groupBy("grp").agg(F.ceil(F.sum("n") / group_shingles).alias("n_blocks"))
    second = materialise(confirm(joined(leaders, sizes, "grp", "inner", n_large).withColumn("grp", block(F.col("n_blocks"))), percent), "leaders")
    n_leaders = second.count()
    parts = joined(first.select(*part("node", "label")), second.select(*part("label", "part")), "label", "left", n_leaders)
    parts = materialise(parts.select("node", F.coalesce("part", "label").alias("component")), "parts")
    ends = joined(wanted.select("cid", "grp"), second.select(*part("cid", "part")), "cid", "inner", n_leaders).groupBy("grp").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    several = materialise(ends.where("a <> b").select("grp"), "several")
    if not several.count():
        return parts
    # groups still in several parts: all pairs of blocks
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    members = joined(labelled(parts.select(F.col("node").alias("cid"), F.col("component").alias("label"))), several, "grp", "left_semi", n_large)
    pairs = members.withColumn("block", own).withColumn("other", other).where("other <> block")
    more = components(confirm(pairs.withColumn("grp", F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other"))), percent))
    parts = joined(parts, more.select(F.col("node").alias("component"), F.col("component").alias("part")), "component", "left", more.count())
    return materialise(parts.select("node", F.coalesce("part", "component").alias("component")), "parts")


@whole
def groups(docs: DataFrame, k: int = 5, percent: int = 80, region: int = REGION, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked where the Jaccard similarity of their sets of k-word shingles is percent / 100 or more.
    Words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased. Null, empty and blank texts, and rows without a
    doc_id, link with nothing: their component is their own doc_id and they are kept. Repeated rows are exact copies; rows
    that share a doc_id but not a text are judged by their own text. A very long text is one set, held whole by one task. An
    empty table gives no rows. Other columns are not read.
    """
    described = materialise(describe(docs, k), "described")
    real = described.where("cid is not null and doc_id is not null")
    classes = real.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialise(classes, "classes")
    found = components(candidates(classes, region))
    one_of = classes.select("cid", "doc_id", "n_shingles")
    parts = confirmed_parts(docs, one_of, found, k, percent, group_shingles)
    n = parts.count()
    named = joined(one_of, parts.withColumnRenamed("node", "cid"), "cid", "inner", n).select("cid", "doc_id", "component")
    least = joined(named, named.groupBy("component").agg(F.min("doc_id").alias("least")), "component", "inner", n).select("cid", "least")
    lookup = joined(one_of, least, "cid", "left", n).select("cid", F.coalesce("least", "doc_id").alias("component_id"))
    linked = real.select("doc_id", "n_shingles", "cid").join(lookup, "cid").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    rest = described.where("cid is null or doc_id is null")  # apart, so that they are no key of the join
    return linked.unionByName(rest.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


@whole
def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, that stay: one of each group of near-duplicates. Of repeated rows one stays.

    Null, empty and blank texts, and rows without a doc_id, are near nothing, and stay. Rows that share a doc_id but not a text
    stay or go together. A very long text is one set, held by one task. An empty table stays empty. Columns may have any names.
    """
    judged = materialise(groups(docs, k, percent).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("copies")), "judged")
    gone = judged.where("not kept").select("doc_id")
    again = judged.where("kept and copies > 1").select("doc_id")
    stay = joined(docs, gone, "doc_id", "left_anti", gone.count())
    n = again.count()
    if not n:
        return stay.select(docs.columns)
    repeated = joined(stay, again, "doc_id", "left_semi", n).dropDuplicates(["doc_id", "text"])
    return joined(stay, again, "doc_id", "left_anti", n).select(docs.columns).unionByName(repeated.select(docs.columns))
