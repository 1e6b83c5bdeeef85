"""The registered queries and, where SQL can say it, the text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.inputs import Inputs, oracle_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable:
    """Register a function of ``Inputs`` under a key."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = oracle_text(oracle)
        return build

    return register
