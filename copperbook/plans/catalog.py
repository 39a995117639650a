"""All registered queries by name."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperbook.plans import (
    estate_oracles,
    estate_queries,
    keyed_queries,
    record_queries,
    streaming_queries,
)

Query = Callable[[SparkSession, str], DataFrame]


def _portable(query: Query) -> Query:
    """Give whole numbers one width, so that results compare across engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = query(spark, sf_dir)
        return result.select(
            *[
                F.col(name).cast("bigint").alias(name) if dtype in ("int", "smallint", "tinyint") else F.col(name)
                for name, dtype in result.dtypes
            ]
        )

    return run


def queries() -> dict[str, Query]:
    estate = {name: _portable(query) for name, query in estate_queries.QUERIES.items()}
    return {**estate, **record_queries.QUERIES, **keyed_queries.QUERIES, **streaming_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        **estate_oracles.ORACLES,
        **record_queries.ORACLES,
        **keyed_queries.ORACLES,
        **streaming_queries.ORACLES,
    }
