"""All ledger queries by operator id, and the SQL that gives the same rows."""

from __future__ import annotations

from .operators import aggregates, analyses, joins, scalars, state, stores, windows  # noqa: F401  they register their queries
from .plans.register import QUERIES, SQL  # noqa: F401
from .sources import formats  # noqa: F401
from .streaming import live  # noqa: F401
