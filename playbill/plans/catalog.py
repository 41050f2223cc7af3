"""All registered queries."""

from __future__ import annotations

from playbill.plans import function_queries, join_queries, listing_queries, ranking_queries, score_queries, stream_queries  # noqa: F401  (they register their queries)
from playbill.plans.registry import REGISTRY, Entry


def entries() -> dict[str, Entry]:
    return dict(REGISTRY)
