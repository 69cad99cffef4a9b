"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables by name, and the domain's views of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, table: str, exprs: list[str], where: str | None = None) -> DataFrame:
        df = getattr(self, table)
        return (df.where(where) if where else df).selectExpr(*exprs)


def query(sql: str | None = None, dates: tuple[str, ...] = (), lists: tuple[str, ...] = ()):
    """Register a function of Tables under its own name. Columns of `dates` and `lists` are shown as text on both sides."""

    def add(f):
        def run(spark, sf_dir):
            out = f(Tables(spark, sf_dir))
            return out.withColumns({c: F.col(c).cast("string") for c in dates} | {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists})

        QUERIES[f.__name__] = run
        if sql is not None:
            shown = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates] + [f"array_to_string({c}, ',') AS {c}" for c in lists]
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(shown)}) FROM ({sql})" if shown else sql
        return f

    return add
