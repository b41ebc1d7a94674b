"""Where users' own functions enter: scalar functions, aggregates, table functions and sources, all over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType, _parse_datatype_string


def scalar(fn: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A function of pandas Series as a column function, e.g. a model that scores (query, text)."""
    return F.pandas_udf(fn, _parse_datatype_string(returns))


def aggregate(fn: Callable[[pd.Series], Any], returns: str) -> Callable[[Column], Column]:
    """A statistic of a group's values as an aggregate. The values of one group meet in one task: for groups of cases, not for a corpus."""

    def own(values: pd.Series) -> Any:
        return fn(values)

    own.__annotations__ = {"values": pd.Series, "return": {"double": float, "int": int, "long": int, "string": str}[returns]}
    return F.pandas_udf(own, _parse_datatype_string(returns))


def table_function(spark: SparkSession, name: str, fn: Callable[..., Iterator[tuple]], returns: str) -> None:
    """A generator of rows as an SQL table function: SELECT … FROM t, LATERAL name(t.column)."""

    class Rows:
        def eval(self, *args):
            yield from fn(*args)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))


class _Page(InputPartition):
    def __init__(self, index: int):
        self.index = index


class PagedSource(DataSource):
    """A source that is read page by page, a partition each: options pages, size and a module-level function `fetch` given as "module:name".

    fetch(page, size) yields tuples of the schema that was given. A lost executor's pages are fetched again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.pages, self.size = int(options.get("pages", "1")), int(options.get("size", "100"))
        self.where = options["fetch"]

    def partitions(self):
        return [_Page(i) for i in range(self.pages)]

    def read(self, partition: _Page):
        import importlib

        module, _, name = self.where.partition(":")
        yield from getattr(importlib.import_module(module), name)(partition.index, self.size)


def observations(page: int, size: int) -> Iterator[tuple]:
    """Made-up observations, as a service that is asked page by page gives them."""
    for k in range(page * size, (page + 1) * size):
        yield k, f"trace-{k % 7}", "ERROR" if k % 11 == 0 else "DEFAULT", float(k * 37 % 100)


def read_pages(spark: SparkSession, schema: str, fetch: str, pages: int, size: int) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").schema(schema).option("fetch", fetch).option("pages", str(pages)).option("size", str(size)).load()
