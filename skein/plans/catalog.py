"""All queries of the library itself."""

from __future__ import annotations

from . import q_connections, q_documents, q_more, q_sources, q_study, q_text  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
