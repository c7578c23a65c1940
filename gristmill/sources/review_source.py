"""A batch data source for app-store reviews: one partition for each app, fetched by a client of the caller's own.

    spark.dataSource.register(ReviewSource)
    spark.read.format("reviews").option("client", "package.module:function").option("apps", "a,b").load()

client(app_id, count, lang, country) yields raw records (dicts of the raw schema's fields). (S1)
"""

from __future__ import annotations

from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gristmill import schemas

COUNT = 2_500


class _App(InputPartition):
    def __init__(self, app_id: str):
        self.app_id = app_id


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def partitions(self) -> list[_App]:
        return [_App(a.strip()) for a in self.options.get("apps", "").split(",") if a.strip()]

    def read(self, partition: _App):
        module, _, function = self.options["client"].partition(":")
        fetch = getattr(import_module(module), function)
        o = self.options
        for i, record in enumerate(fetch(partition.app_id, int(o.get("count", COUNT)), o.get("lang", "en"), o.get("country", "us"))):
            yield (partition.app_id, *(record.get(n) for n in self.names), i)


class ReviewSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reviews"

    def schema(self) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.RAW) + ", seq bigint"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), [f.name for f in schemas.RAW if f.name != "app_id"])
