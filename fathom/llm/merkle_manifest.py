"""A Merkle manifest: every row's hash, folded into one root a tree and one root of all, with a proof for each row.

Leaves stand in order and are cut in runs. A run's fragment of a tree is a set of unresolved nodes keyed by level and index:
`collapse` replaces siblings by their parent once all of them are there, and a tree's size tells how many they are, in its last
run too. Fragments unite in any order and grouping to the same result, so runs are merged in rounds, as by treeReduce, but
with each round's fragments in a table: nothing is gathered in one place but the few nodes that stand open at a range's two
ends. The roots of the trees are the leaves of a tree of trees. Proofs go the same way back: each round hands the siblings
above a node on to the nodes that it was made of, and at last to the leaves.
"""

from collections import defaultdict
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import materialise, whole
from fathom.operators.order import positions

ARITY = 2
#: Leaves of a run, and fragments that one task merges.
RUN, FAN = 4096, 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Nodes = dict[tuple[int, int], str]


def field(value: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The lowercase hex SHA-256 of a row's fields, in the order of FIELDS."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def widths(leaves: int) -> list[int]:
    """The number of nodes of each level of a tree; the last has one."""
    found = [leaves]
    while found[-1] > 1:
        found.append(-(-found[-1] // ARITY))
    return found


def collapse(nodes: Nodes, leaves: int) -> list[tuple[int, int, list[str]]]:
    """Replaces complete runs of siblings by their parents, as long as there are any; (level, index, children's hashes) of each
    parent made, children before parents."""
    found, size, made = defaultdict(list), widths(leaves), []
    for level, index in nodes:
        found[level].append(index)
    for level, width in enumerate(size[:-1]):
        for parent, run in groupby(sorted(found[level]), lambda i: i // ARITY):
            run = list(run)
            if len(run) == min(ARITY, width - parent * ARITY):
                hashes = [nodes.pop((level, i)) for i in run]
                nodes[level + 1, parent] = sha256("".join(hashes).encode()).hexdigest()
                found[level + 1].append(parent)
                made.append((level + 1, parent, hashes))
    return made


def spread_paths(made: list, above: dict) -> dict:
    """above: for each unresolved node (siblings before, siblings after, the rest of the way) to the root, or None at its end.
    The same for the nodes of which `collapse` made them."""
    paths = dict(above)
    for level, parent, hashes in reversed(made):
        rest = paths[level, parent]
        for i, _ in enumerate(hashes):
            paths[level - 1, parent * ARITY + i] = ("".join(hashes[:i]), "".join(hashes[i + 1 :]), rest)
    return paths


def flat(path) -> tuple[list[str], list[str]]:
    before, after = [], []
    while path:
        a, b, path = path
        before.append(a)
        after.append(b)
    return before, after


def linked(before: list[str], after: list[str]):
    path = None
    for a, b in zip(reversed(before), reversed(after), strict=True):
        path = (a, b, path)
    return path


NODES = pa.schema([("run", pa.int64()), ("tree", pa.string()), ("first", pa.int64()), ("leaves", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string()), ("top", pa.bool_())])
NODE_DDL = "run long, tree string, first long, leaves long, level int, index long, hash string, top boolean"
WAY_DDL = "before array<string>, after array<string>, tops array<string>"
STRINGS = pa.list_(pa.string())
WAYS = pa.schema([*NODES, ("before", STRINGS), ("after", STRINGS), ("tops", STRINGS)])


def _by_tree(rows: list[dict]) -> dict[str, list[dict]]:
    out = defaultdict(list)
    for r in rows:
        out[r["tree"]].append(r)
    return out


def _open_nodes(run: int, tree: str, first: int, leaves: int, nodes: Nodes) -> list[dict]:
    height = len(widths(leaves)) - 1
    return [{"run": run, "tree": tree, "first": first, "leaves": leaves, "level": k, "index": i, "hash": h, "top": k == height} for (k, i), h in nodes.items()]


def _fold_run(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
    of = {t["tree"]: t for t in trees.to_pylist()}
    out = []
    for tree, leaves in _by_tree(rows.select(["tree", "place", "leaf"]).to_pylist()).items():
        first, n = of[tree]["first"], of[tree]["leaves"]
        nodes = {(0, r["place"] - first): r["leaf"] for r in leaves}
        collapse(nodes, n)
        out += _open_nodes(key[0].as_py(), tree, first, n, nodes)
    return pa.Table.from_pylist(out, NODES)


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    out = []
    for tree, part in _by_tree(rows.to_pylist()).items():
        nodes = {(r["level"], r["index"]): r["hash"] for r in part}
        collapse(nodes, part[0]["leaves"])
        out += _open_nodes(key[0].as_py(), tree, part[0]["first"], part[0]["leaves"], nodes)
    return pa.Table.from_pylist(out, NODES)


class Forest:
    """Trees over leaves (tree, leaf, others), a tree's leaves being in the given order. Names in others must differ from the
    columns of NODES and from before, after and tops."""

    def __init__(self, leaves: DataFrame, order: list):
        self.placed = positions(leaves, [F.col("tree"), *order], "place").withColumn("run", F.floor(F.col("place") / RUN).cast("long"))
        trees = self.placed.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("leaves"))
        trees = materialise(trees, "trees")
        runs = materialise(self.placed.select("tree", "run").distinct().join(trees, "tree"), "runs")
        n = trees.agg(F.max((F.col("first") + F.col("leaves") - 1) / RUN)).first()[0]
        folded = self.placed.groupBy("run").cogroup(runs.groupBy("run")).applyInArrow(_fold_run, NODE_DDL)
        self.rounds = [materialise(folded, "fragments")]
        width = 0 if n is None else int(n) + 1
        while width > 1:
            width = -(-width // FAN)
            wider = self.rounds[-1].where("not top").withColumn("run", F.floor(F.col("run") / FAN).cast("long"))
            self.rounds.append(materialise(wider.groupBy("run").applyInArrow(_merge, NODE_DDL), "fragments"))

    def roots(self) -> DataFrame:
        """One row a tree: tree, root."""
        found = self.rounds[0]
        for r in self.rounds[1:]:
            found = found.unionByName(r)
        return found.where("top").select("tree", F.col("hash").alias("root"))

    def proofs(self, above: DataFrame) -> DataFrame:
        """above: one row a tree, (tree, before, after, tops): the way from its root to the root of all, and the roots on it.

        One row a leaf: others, leaf, tops, and from level to level the siblings before and after, concatenated."""

        ways = None
        for nodes in reversed(self.rounds):
            here = nodes.where("top").join(above, "tree")
            if ways is not None:
                lower = nodes.where("not top").withColumn("wide", F.floor(F.col("run") / FAN).cast("long"))
                here = here.unionByName(lower.groupBy("wide").cogroup(ways.groupBy("run")).applyInArrow(_widen, f"{NODE_DDL}, {WAY_DDL}"))
            ways = materialise(here, "ways")

        schema = ", ".join(f"`{c}` {t}" for c, t in self.placed.drop("tree", "place", "run").dtypes) + f", {WAY_DDL}"
        return self.placed.groupBy("run").cogroup(ways.groupBy("run")).applyInArrow(_hand_down, schema)


def _paths(part: list[dict], leaves: int, ways: list[dict]):
    """Paths of the nodes in part, whose unresolved nodes' ways are known; and the tops."""
    made = collapse({(r["level"], r["index"]): r["hash"] for r in part}, leaves)
    return spread_paths(made, {(w["level"], w["index"]): linked(w["before"], w["after"]) for w in ways}), ways[0]["tops"]


def _widen(key: tuple, nodes: pa.Table, ways: pa.Table) -> pa.Table:
    """The ways of the nodes that a round merged, from those of the nodes it made of them."""
    known, out = _by_tree(ways.to_pylist()), []
    for tree, part in _by_tree(nodes.drop_columns(["wide"]).to_pylist()).items():
        paths, tops = _paths(part, part[0]["leaves"], known[tree])
        for r in part:
            before, after = flat(paths[r["level"], r["index"]])
            out.append(r | {"before": before, "after": after, "tops": tops})
    return pa.Table.from_pylist(out, WAYS)


def _hand_down(key: tuple, rows: pa.Table, ways: pa.Table) -> pa.Table:
    """The ways of a run's leaves."""
    known, members = _by_tree(ways.to_pylist()), defaultdict(list)
    for i, tree in enumerate(rows.column("tree").to_pylist()):
        members[tree].append(i)
    place, leaf = rows.column("place").to_pylist(), rows.column("leaf").to_pylist()
    before, after, tops = ([None] * len(place) for _ in range(3))
    for tree, at in members.items():
        first = known[tree][0]["first"]
        paths, own = _paths([{"level": 0, "index": place[i] - first, "hash": leaf[i]} for i in at], known[tree][0]["leaves"], known[tree])
        for i in at:
            before[i], after[i] = flat(paths[0, place[i] - first])
            tops[i] = own
    kept = rows.drop_columns(["tree", "place", "run"])
    for name, values in (("before", before), ("after", after), ("tops", tops)):
        kept = kept.append_column(name, pa.array(values, STRINGS))
    return kept


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """The root to which a leaf and its siblings lead."""
    steps = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["a"], acc, s["b"]), 256))


def proofs(docs: DataFrame, **extra: Column) -> DataFrame:
    """One row per document: doc_id, leaf, subroot (of its lang), root, before and after (its siblings on the way to the root,
    level by level, those before it and those after it concatenated), and the columns in extra, computed from FIELDS.

    Null lang is a tree of its own, first of all. Leaves stand by doc_id, null first, and those of one doc_id by their hash. A
    text of any length is hashed whole by one task. An empty table gives no rows. Other columns are not read. Rows that are
    equal in all of FIELDS are one key of the ordering's range partitions; apart from them neither a tree, of any size, nor a
    great number of trees is gathered in a task.
    """
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    leaves = docs.select("doc_id", tree.alias("tree"), leaf_hash().alias("leaf"), *[c.alias(name) for name, c in extra.items()])
    trees = Forest(leaves, [F.col("doc_id").asc_nulls_first(), "leaf"])
    total = Forest(trees.roots().select(F.col("tree").alias("name"), F.lit("").alias("tree"), F.col("root").alias("leaf")), ["name"])
    none = F.array().cast("array<string>")
    over = total.proofs(total.roots().select("tree", none.alias("before"), none.alias("after"), F.array("root").alias("tops")))
    above = over.select(F.col("name").alias("tree"), "before", "after", F.array_prepend("tops", F.col("leaf")).alias("tops"))
    found = trees.proofs(materialise(above, "above"))
    return found.select("doc_id", "leaf", F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"), "before", "after", *extra)


@whole
def manifest(docs: DataFrame) -> DataFrame:
    """`proofs`, written as a table."""
    return proofs(docs)


@whole
def digests(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of all siblings in order), folded_root and verified: every row folded along
    its siblings, those whose crc32 of doc_id 7 divides (null: the empty text) with one added to n_chars."""
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    changed = F.when(chosen & F.col("n_chars").isNotNull(), leaf_hash(n_chars=F.col("n_chars") + 1)).otherwise(leaf_hash())
    rows = proofs(docs, tampered=changed).withColumn("folded_root", fold(F.col("tampered"), F.col("before"), F.col("after")))
    proof = F.sha2(F.array_join(F.zip_with("before", "after", lambda a, b: F.concat(a, b)), ""), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = """
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce('+' || lang, '') AS t, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n0, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1, coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda a, x: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, x)), 4294967295::BIGINT), 4294967295) % 7 = 0 AS chosen
  FROM documents
), hashed AS (
  SELECT row_number() OVER () AS r, doc_id, t, sha256(head || n0 || tail) AS leaf, sha256(head || CASE WHEN chosen THEN n1 ELSE n0 END || tail) AS tampered FROM f
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed
), nodes AS (
  SELECT t, 0 AS l, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM leaves
  UNION ALL
  SELECT t, l + 1, i // 2, sha256(h || coalesce(nx, '')), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY t ORDER BY i) AS nx FROM nodes) WHERE n > 1 AND i % 2 = 0
), tops AS (
  SELECT 0 AS l, row_number() OVER (ORDER BY t) - 1 AS i, h, t, count(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT l + 1, i // 2, sha256(h || coalesce(nx, '')), '', (n + 1) // 2 FROM (SELECT *, lead(h) OVER (ORDER BY i) AS nx FROM tops) WHERE n > 1 AND i % 2 = 0
), walk AS (
  SELECT r, t, 0 AS l, i, '' AS proof, tampered AS f FROM leaves
  UNION ALL
  SELECT r, w.t, w.l + 1, w.i // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN w.i % 2 = 1 THEN coalesce(s.h, '') || f ELSE f || coalesce(s.h, '') END)
  FROM walk w JOIN nodes o ON o.t = w.t AND o.l = w.l AND o.i = w.i AND o.n > 1 LEFT JOIN nodes s ON s.t = w.t AND s.l = w.l AND s.i = xor(w.i, 1)
), up AS (
  SELECT r, w.t, 0 AS l, o.i, proof, f, o.h AS subroot FROM walk w JOIN nodes e ON e.t = w.t AND e.l = w.l AND e.n = 1 JOIN tops o ON o.t = w.t AND o.l = 0
  UNION ALL
  SELECT r, u.t, u.l + 1, u.i // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN u.i % 2 = 1 THEN coalesce(s.h, '') || f ELSE f || coalesce(s.h, '') END), subroot
  FROM up u JOIN tops o ON o.l = u.l AND o.i = u.i AND o.n > 1 LEFT JOIN tops s ON s.l = u.l AND s.i = xor(u.i, 1)
)
SELECT doc_id, leaf, subroot, e.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = e.h AS verified
FROM up JOIN tops e ON e.l = up.l AND e.n = 1 JOIN leaves USING (r)
"""
