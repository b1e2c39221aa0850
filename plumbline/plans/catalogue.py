"""All queries of the engine over the driver's tables."""

from __future__ import annotations

from plumbline.plans import audit_queries, package_queries, score_queries, text_queries

QUERIES, ORACLES = {}, {}
for _part in (text_queries.R, score_queries.R, package_queries.R, audit_queries.R):
    QUERIES.update(_part.queries)
    ORACLES.update(_part.oracles)

flagship = text_queries.coverage_ledger
