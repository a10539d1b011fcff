"""Where queries register: name, operators of the inventory they cover, callable and SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Query:
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(lambda name: table(spark, sf_dir, name))


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Registers a function of the tables under its own name."""

    def add(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        REGISTRY[run.__name__] = Query(tuple(covers.split()), run, sql)
        return run

    return add
