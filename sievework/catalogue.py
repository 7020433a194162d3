"""The registry of queries and their SQL."""

from __future__ import annotations

from .plans import annotations, audits, catalogs, cells, databases, evidence, intake, national, parsing, releases, resolution, splits, structures, workbooks  # noqa: F401
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
