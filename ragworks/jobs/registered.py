"""Registering queries together with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables under a folder, by name; sql() runs a statement over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, statement: str) -> DataFrame:
        statement = statement.replace("{", "{{").replace("}", "}}")
        frames = {t: getattr(self, t) for t in TABLES if f" {t} " in f"{statement} ".replace("\n", " ").replace(")", " ").replace(",", " ")}
        for name in frames:
            statement = _whole(statement, name)
        return self.spark.sql(statement, **frames)


def _whole(statement: str, name: str) -> str:
    return re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", statement)


def query(oracle: str | None = None) -> Callable:
    """Register a function of Tables under its own name, with SQL for the same rows where there is one."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register
