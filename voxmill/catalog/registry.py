"""Name -> query registry behind ``queries()`` and ``oracle_sql()``."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxmill.derived import Tables, check_sql

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}
SURVEY: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its check SQL."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        SURVEY[name] = ids
        if sql is not None:
            CHECKS[name] = check_sql(sql)
        return fn
    return wrap


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]
    return lambda spark, folder: fn(Tables(spark, folder))
