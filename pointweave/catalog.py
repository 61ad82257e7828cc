"""The registry of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointweave.plans import grouped, predicting, scalar, spatial, symbols  # noqa: F401  they register their queries
from pointweave.plans.base import ORACLES, QUERIES

flagship = spatial.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
