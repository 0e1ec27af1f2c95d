"""A paged search server as a Spark data source.

``transport`` names a Python callable "module:function" that takes a request (query, sort, size, search_after) and gives a list of hits
(dictionaries with _id, _source and sort).  Slices of the index are read in parallel, each page by page from the last sort values.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Slice(InputPartition):
    def __init__(self, number: int, of: int):
        super().__init__(number)
        self.number, self.of = number, of


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Slice]:
        n = int(self.options.get("slices", "1"))
        return [_Slice(k, n) for k in range(n)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        module, name = self.options["transport"].split(":")
        ask = getattr(importlib.import_module(module), name)
        request = {"query": json.loads(self.options.get("query", '{"match_all": {}}')), "sort": ["@timestamp", "_id"], "size": int(self.options.get("size", "1000")), "index": self.options.get("index", "*")}
        if partition.of > 1:
            request["slice"] = {"id": partition.number, "max": partition.of}
        while hits := ask(request):
            for h in hits:
                yield h["_id"], json.dumps(h["_source"], ensure_ascii=False)
            request = request | {"search_after": hits[-1]["sort"]}


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logweave_search"

    def schema(self) -> str:
        return "event_ref string, raw string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_search(spark: SparkSession, transport: str, text: str = "", since: int | None = None, until: int | None = None, slices: int = 1, size: int = 1000):
    """event_ref and raw (JSON) of the hits of a query in the search language, filtered at the server."""
    from logweave.plans.remote_filter import compile_remote

    spark.dataSource.register(SearchSource)
    query = json.dumps(compile_remote(text, since, until))
    return spark.read.format("logweave_search").options(transport=transport, query=query, slices=str(slices), size=str(size)).load()
