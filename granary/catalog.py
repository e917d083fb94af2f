"""All registered reference-style queries: importing the modules registers them."""

from __future__ import annotations

from granary.operators import aggregates, filters, joins, sets, sinks, windows  # noqa: F401
from granary.functions import lints, queries as functions_queries  # noqa: F401
from granary.plans import edition_texts, editions, forecast, gates, identity, quality, radar, score, shopping, tier1, weekly  # noqa: F401
from granary.registry import QUERIES, SQL  # noqa: F401
from granary.sources import adapters, scans, sitemaps, sql, web  # noqa: F401
from granary.streaming import jobs, live, queue  # noqa: F401
