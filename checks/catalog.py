"""All registered queries."""

from checks import (  # noqa: F401
    on_answers,
    on_decisions,
    on_labels,
    on_metrics,
    on_questions,
    on_routers,
    on_sampling,
    on_storage,
)
from checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
