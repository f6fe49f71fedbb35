"""Every registered plan and, where SQL can express it, the query that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import twin

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, needs: str = "", oracle: str | None = None):
    """Registers a function of (spark, sf_dir); `oracle` is its SQL over the views named in `needs`."""

    def register(fn):
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = fn
        if oracle is not None:
            ORACLES[name] = twin(needs, oracle)
        return fn

    return register
