"""All occurrences of many names in texts, by multi-pattern automata."""

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of one automaton.
NAMES = 200_000
#: Texts whose occurrences are Python objects at a time.
TEXTS = 256
FOUND = "array<struct<start: int, end: int, name: string, type: string>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("type", pa.string())]))


def few(batches, n: int = TEXTS):
    """The rows of the batches, at most n at a time."""
    return (whole.slice(a, n) for whole in batches for a in range(0, whole.num_rows, n))


def _matcher(column: str, rows: list[tuple[str, str]], whole_words: bool):
    """Adds the occurrences of the names to `found`. One pass over a text finds all, however many names there are."""

    def run(batches):
        automaton = ahocorasick.Automaton()
        for name, kind in rows:
            automaton.add_word(name, (len(name), name, kind))
        if rows:
            automaton.make_automaton()
        for batch in few(batches):
            out = []
            for text, before in zip(batch.column(column).to_pylist(), batch.column("found").to_pylist(), strict=True):
                for last, (n, name, kind) in automaton.iter(text or "") if rows else ():
                    a, b = last - n + 1, last + 1
                    if not whole_words or not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                        before.append({"start": a, "end": b, "name": name, "type": kind})
                out.append(before)
            yield batch.set_column(batch.schema.get_field_index("found"), "found", pa.array(out, _ARROW))

    return run


def occurrences(rows: DataFrame, column: str, names: DataFrame, at_once: int = NAMES, whole_words: bool = True) -> DataFrame:
    """rows with `found`, each occurrence (start, end, name, type) of the names (name, type), overlapping ones too, in the text
    column; a null text has none. names are distinct and not empty.

    An automaton has about at_once names. More names are several automata, which texts pass one after the other within one
    stage: nothing is shuffled, and no task holds all names.
    """
    parts = max(1, -(-names.count() // at_once))
    out = rows.withColumn("found", F.array().cast(FOUND))
    for part in range(parts):
        own = [(r["name"], r["type"]) for r in names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).select("name", "type").collect()]  # about at_once
        out = out.mapInArrow(_matcher(column, own, whole_words), out.schema)
    return out
