"""Triples from texts: a pluggable extractor run over every chunk, failures kept with their error, order imposed by `seq`.

An extractor is a function that a task calls once, for a function from texts to what was found in each: a dict with entities
(name, type) and relations (source, relation, target). `by_dictionary` finds the names of a table instead.
"""

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import normalize_entity, strip
from fathom.operators import automaton, graph
from fathom.session import spread

Extractor = Callable[[], Callable[[list[str]], list[dict]]]

ENTITIES, RELATIONS = "array<struct<name: string, type: string>>", "array<struct<source: string, relation: string, target: string>>"
#: Texts that an extractor gets at a time.
AT_ONCE = 32
# Words between two names that say how they are related.
CUES = {"treats": "treats", "treat": "treats", "contraindicated": "contraindicated_with", "symptom": "symptom_of", "interacts": "interacts_with", "interact": "interacts_with"}
CUE = re.compile(r"\b(" + "|".join(CUES) + r")\b")
STOP = re.compile("[.!?] ")

_STRUCT = {ENTITIES: pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])), RELATIONS: pa.list_(pa.struct([("source", pa.string()), ("relation", pa.string()), ("target", pa.string())]))}


def _said(value) -> str:
    return "" if value is None else str(value).strip()


def _cleaned(found: dict) -> tuple[list[dict], list[dict]]:
    """What has the right form; an extractor's answer may hold anything."""
    entities = [{"name": _said(e.get("name")), "type": _said(e.get("type")) or "condition"} for e in found.get("entities") or [] if isinstance(e, dict)]
    relations = [{k: _said(r.get(k)) for k in ("source", "relation", "target")} for r in found.get("relations") or [] if isinstance(r, dict)]
    return entities, relations


def extract(chunks: DataFrame, extractor: Extractor, at_once: int = AT_ONCE) -> DataFrame:
    """chunks: (chunk_id, text, seq) -> (chunk_id, seq, entities, relations, error): one row a chunk.

    Whole texts are given, null as empty. Where the extractor fails for several texts each is tried alone, and one for which it
    fails again has no triples but the error's text.
    """

    def tried(f, some: list[str]) -> Iterator[tuple[list[dict], list[dict], str | None]]:
        try:
            answers = f(some)
            if len(answers) != len(some):
                raise ValueError(f"{len(answers)} answers to {len(some)} texts")
            yield from [(*_cleaned(x), None) for x in answers]
        except Exception as e:  # whatever an extractor raises: its text is kept in the row
            if len(some) == 1:
                yield [], [], str(e)[:300]
            else:
                for x in some:
                    yield from tried(f, [x])

    def run(batches):
        f = extractor()
        for batch in automaton.few(batches):
            found = [x or "" for x in batch.column("text").to_pylist()]
            out = [row for a in range(0, len(found), at_once) for row in tried(f, found[a : a + at_once])]
            entities, relations, errors = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("seq"), pa.array(entities, _STRUCT[ENTITIES]), pa.array(relations, _STRUCT[RELATIONS]), pa.array(errors, pa.string())], ["chunk_id", "seq", "entities", "relations", "error"])

    return spread(chunks.select("chunk_id", "seq", "text")).mapInArrow(run, _schema(chunks))


def _schema(chunks: DataFrame) -> str:
    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "seq")}
    return f"chunk_id {kind['chunk_id']}, seq {kind['seq']}, entities {ENTITIES}, relations {RELATIONS}, error string"


def _linked(text: str, found: list[dict]) -> tuple[list[dict], list[dict]]:
    """The leftmost and longest of overlapping names, and a relation between each two that follow each other in a sentence."""
    taken: list[dict] = []
    for x in sorted(found, key=lambda x: (x["start"], -x["end"])):
        if not taken or x["start"] >= taken[-1]["end"]:
            taken.append(x)
    relations = []
    for a, b in zip(taken, taken[1:]):
        between = text[a["end"] : b["start"]]
        if not STOP.search(between):
            cue = CUE.search(between)
            relations.append({"source": a["name"], "relation": CUES[cue[1]] if cue else "references", "target": b["name"]})
    return [{"name": x["name"], "type": x["type"]} for x in taken], relations


def by_dictionary(chunks: DataFrame, names: DataFrame, automaton_names: int = automaton.NAMES) -> DataFrame:
    """As `extract`, by the names of a table (name, type). Texts and names are compared in normal form, names as whole words;
    of names of one form the first type in alphabetical order counts.

    Nothing is shuffled, and no task holds all names, as `automaton.occurrences` says.
    """
    keys = names.select(normalize_entity(F.col("name")).alias("name"), "type").where("name <> ''").groupBy("name").agg(F.min(F.coalesce("type", F.lit("condition"))).alias("type"))
    rows = spread(chunks.select("chunk_id", "seq", "text")).select("chunk_id", "seq", normalize_entity(F.coalesce("text", F.lit(""))).alias("plain"))
    rows = automaton.occurrences(rows, "plain", keys, automaton_names)

    def run(batches):
        for batch in automaton.few(batches):
            out = [_linked(*x) for x in zip(batch.column("plain").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("seq"), pa.array([x[0] for x in out], _STRUCT[ENTITIES]), pa.array([x[1] for x in out], _STRUCT[RELATIONS]), pa.nulls(len(out), pa.string())], ["chunk_id", "seq", "entities", "relations", "error"])

    return rows.mapInArrow(run, _schema(chunks))


def _accepted(r: Column) -> Column:
    return (strip(r["source"]) != "") & (strip(r["target"]) != "") & F.coalesce(r["relation"].isin(*graph.EDGE_TYPES), F.lit(False))


def relations(extracted: DataFrame) -> DataFrame:
    """(source, relation, target, chunk_id, seq) of all relations, the rejected ones too; seq is (the chunk's, place in it)."""
    rows = extracted.select("chunk_id", "seq", F.posexplode("relations").alias("place", "r"))
    return rows.select("r.*", "chunk_id", F.struct("seq", "place").alias("seq"))


def mentions(extracted: DataFrame) -> DataFrame:
    """(name, type, chunk_id, seq): the declared entities of acceptable length, and then both ends of each accepted relation,
    as often as they are named. An end has the type that its chunk last declared for it, or else is a condition."""
    named = F.filter("entities", lambda e: (strip(e["name"]) != "") & (F.length(e["name"]) <= graph.MAX_NAME))
    kind = lambda name: F.coalesce(F.try_element_at(F.transform(F.filter(named, lambda e: F.lower(e["name"]) == F.lower(name)), lambda e: e["type"]), F.lit(-1)), F.lit("condition"))
    end = lambda name: F.struct(name.alias("name"), kind(name).alias("type"))
    ends = F.flatten(F.transform(F.filter("relations", _accepted), lambda r: F.array(end(r["source"]), end(r["target"]))))
    rows = extracted.select("chunk_id", "seq", F.posexplode(F.concat(named, ends)).alias("place", "e"))
    return rows.select("e.name", "e.type", "chunk_id", F.struct("seq", "place").alias("seq"))


def build(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph. extracted is read several times: a written table."""
    return graph.build_nodes(mentions(extracted), None), graph.build_edges(graph.accepted_relations(relations(extracted)))


def counts(extracted: DataFrame) -> DataFrame:
    """One row: chunks, failed, entities, and relations accepted and rejected."""
    named = F.size(F.filter("entities", lambda e: (strip(e["name"]) != "") & (F.length(e["name"]) <= graph.MAX_NAME)))
    good = F.size(F.filter("relations", _accepted))
    return extracted.agg(
        F.count("*").alias("chunks"), F.count("error").alias("failed"), F.coalesce(F.sum(named), F.lit(0)).alias("entities"),
        F.coalesce(F.sum(good), F.lit(0)).alias("accepted"), F.coalesce(F.sum(F.size("relations") - good), F.lit(0)).alias("rejected"),
    )
