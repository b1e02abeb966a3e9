"""The catalogue: a query for each operator, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, graphs, relational, scalars

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**scalars.QUERIES, **relational.QUERIES, **graphs.QUERIES, **documents.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**scalars.SQL, **relational.SQL, **graphs.SQL, **documents.SQL}
