"""The engine's own queries and their DuckDB oracles, all registered."""

from __future__ import annotations

from agora.plans import finder_plans, lifecycle_plans, model_plans, monitor_plans, node_plans, page_plans, review_plans, store_plans, stream_plans, text_plans  # noqa: F401
from agora.plans.page_plans import flagship  # noqa: F401
from agora.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
