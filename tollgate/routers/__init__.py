"""Routers: how much does a question need the strong model?

A router has ``fit(train)``, which returns a fitted router with ``score(df)``. Scoring
adds a ``score`` in [0, 1]; higher means "send to strong".
"""

from tollgate.routers.base import ROUTERS, FittedRouter, Router, load_router, register_router
from tollgate.routers.baselines import LengthRouter, OracleRouter, RandomRouter
from tollgate.routers.embedding import EmbeddingRouter
from tollgate.routers.tfidf import HashedTfidfRouter, TfidfRouter

__all__ = [
    "ROUTERS", "FittedRouter", "Router", "load_router", "register_router",
    "RandomRouter", "LengthRouter", "OracleRouter", "EmbeddingRouter", "TfidfRouter",
]
