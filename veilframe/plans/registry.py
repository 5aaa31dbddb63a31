"""All queries over the engine's own operators, with their SQL."""

from . import relational_queries, text_queries  # noqa: F401  (they register themselves)
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
