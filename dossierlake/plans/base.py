"""Registration of queries: a name, its DataFrame plan and, where there is one, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")


class Tables:
    """Tables of a folder as attributes; only those used are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register the function's plan under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def same_sql(name: str, sql: str, oracle: str | None = None) -> None:
    """Register a query that is plain SQL; ``oracle`` where the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        used = {n: getattr(t, n) for n in TABLES if f"{{{n}}}" in sql}
        return spark.sql(sql, **used)

    QUERIES[name] = run
    SQL[name] = oracle or sql.format(**{n: n for n in TABLES})
