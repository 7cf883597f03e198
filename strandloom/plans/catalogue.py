"""Every query of the engine and, where SQL can say the same, the SQL."""

from __future__ import annotations

from . import alignment, clustering, evaluation, features

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for group in (evaluation, features, clustering, alignment):
    QUERIES |= group.QUERIES
    ORACLES |= group.ORACLES
