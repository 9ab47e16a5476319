"""Every query over the supplied tables, by name, with SQL that gives the same rows."""

from __future__ import annotations

from pulsegrid.plans import events, extras, rules, signals  # noqa: F401  they register their queries
from pulsegrid.plans.base import QUERIES, SQL, Query

FLAGSHIP = "flagship"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
