"""All queries of the engine over the driver tables, with the DuckDB SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import learning_queries, matrix_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**matrix_queries.QUERIES, **learning_queries.QUERIES}
ORACLES: dict[str, str] = {**matrix_queries.ORACLES, **learning_queries.ORACLES}
FLAGSHIP = matrix_queries.recommend_two_hop
