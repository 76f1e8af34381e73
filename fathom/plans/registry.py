"""Queries by name, each with DuckDB SQL for the same rows where SQL can say them."""

from fathom.session import tidy

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: SQL for what fathom.functions.text does, by the same fixed values.
from fathom.functions import text as _t  # noqa: E402


def query(sql: str | None = None):
    """Registers a query. The tables that its operators write on the way are deleted when its result is there."""

    def register(f):
        QUERIES[f.__name__] = tidy(f)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_tokens(c: str) -> str:
    return f"[t FOR t IN regexp_extract_all(lower(coalesce({c}, '')), '{_t.TOKEN}') IF len(t) > 1 AND t NOT IN ({sql_list(_t.SEARCH_STOP)})]"


def sql_content(c: str) -> str:
    return f"list_distinct([t FOR t IN regexp_extract_all(lower(coalesce({c}, '')), '{_t.TOKEN}') IF len(t) > 2 AND t NOT IN ({sql_list(_t.CLAIM_STOP)})])"


def sql_strip(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"


def sql_words(c: str) -> str:
    return rf"[w FOR w IN string_split_regex(coalesce({c}, ''), '\s+') IF w <> '']"


def sql_sentences(c: str) -> str:
    split = rf"string_split(regexp_replace(coalesce({c}, ''), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return rf"[s FOR s IN [regexp_replace(s, '^\s+|\s+$', '', 'g') FOR s IN {split}] IF s <> '']"


def sql_claims(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(coalesce({c}, ''), '\[\d{{1,2}}\]', '', 'g'), '(?m)^\s*[-*•]\s*', '', 'g')"
    return rf"[s FOR s IN {sql_sentences(bare)} IF len([w FOR w IN string_split_regex(s, '\s+') IF w <> '']) >= 4]"
