"""Newline-delimited JSON over HTTP as a Spark data source, one partition per address.

``spark.dataSource.register(NdjsonSource)`` and then
``spark.read.format("ndjson").option("urls", "http://a/x http://b/y").load()`` give one ``value`` column of JSON lines,
to be parsed with ``from_json``. Lines are streamed, so a response of any length needs the memory of one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Address(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options.get("urls", "").split()
        self.timeout = float(options.get("timeout", "60"))
        if not self.urls:
            raise ValueError("option 'urls' is missing")

    def partitions(self):
        return [_Address(u) for u in self.urls]

    def read(self, partition):
        from urllib.request import urlopen

        with urlopen(partition.url, timeout=self.timeout) as response:
            for line in response:
                if text := line.decode("utf-8").strip():
                    yield (text,)


class NdjsonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ndjson"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
