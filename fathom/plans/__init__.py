"""All queries of the library by name, and their DuckDB SQL."""

from fathom.plans import metric_queries, model_queries, search_queries, table_queries, text_queries  # noqa: F401, I001
from fathom.plans import index_queries, stream_queries  # noqa: F401  they take up SQL of the others
from fathom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
