"""JSON and markup in text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.text import strip


def salvage(raw: Column) -> Column:
    """The JSON object in a model's answer: the text without code fences, or else from its first { to its last }; null if neither parses."""
    bare = strip(F.regexp_replace(strip(raw), r"^```[a-zA-Z]*\s*|```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    parsed = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce(parsed(F.when(bare.startswith("{"), bare)), parsed(F.nullif(inner, F.lit(""))))


def marked(c: Column) -> Column:
    """What stands in bold marks, in order."""
    return F.regexp_extract_all(c, F.lit(r"\*\*(.+?)\*\*"), F.lit(1))
