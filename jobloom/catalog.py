"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.plans import collect, daily, files, parity, portals  # noqa: F401 - the others register their queries with parity's

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = parity.QUERIES
ORACLES: dict[str, str] = parity.ORACLES
flagship = parity.flagship
