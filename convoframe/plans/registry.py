"""Where queries register: a function of the tables, and the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver tables under a folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text, source = views.VIEWS[name]
        self.read(source).createOrReplaceTempView(f"convoframe_{source}")
        return self.spark.sql(text.format(**{source: f"convoframe_{source}"}))

    @cached_property
    def msgs(self) -> DataFrame:
        return self.read("conversations").select(
            F.col("conv_id").alias("chat_id"), "turn", "role", F.col("text").alias("content")
        )

    @cached_property
    def docs(self) -> DataFrame:
        return self.read("documents")


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query, with the views that its SQL refers to."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql is not None:
            parts = [f"{v} as ({views.sql_text(v)})" for v in uses]
            SQL[name] = (f"with {', '.join(parts)} " if parts else "") + sql.strip()
        return make

    return register


def time_text(column):
    """A timestamp as text, equal in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
