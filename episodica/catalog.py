"""The registered queries, their SQL, and the name of the flagship."""

from __future__ import annotations

from episodica.plans import aggregates, documents, gates, grids, joins, layouts, named, projections, reports, rules, scalars, selection, streams, verification, windows, workflow  # noqa: F401
from episodica.plans.registry import QUERIES, SQL

FLAGSHIP = "grasp_onsets"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
