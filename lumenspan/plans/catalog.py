"""All queries over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from lumenspan.plans import changes, groups, joins, repos, scans  # noqa: F401  they register their queries
from lumenspan.plans.shared import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
