"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import analysis, compare, control, engines, fourier, geometry  # noqa: F401  each registers its queries
from .bridge import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
