"""A resumable collector: every source for every day as a streaming source, whose offset is the last day asked for.

Each batch asks for the days that have come since the batch before, a partition for each source and day, side by side. A
reply that is missing or too short is asked for again, a bounded number of times, and what stays short is marked. The
offsets are in the stream's checkpoint: a collector that is stopped and started again goes on after the last whole batch,
and a batch that was under way is asked for again as a whole, into the same folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..sources.connectors import SHORTEST_REPLY

SCHEMA = "source string, day string, attempts int, short boolean, body string"
Fetch = Callable[[str, str], str | None]


class Request(InputPartition):
    def __init__(self, source: str, day: str):
        super().__init__((source, day))
        self.source, self.day = source, day


def asked(fetch: Fetch, source: str, day: str, attempts: int) -> tuple:
    """The reply, after as many attempts as it takes to get one that is long enough."""
    body = None
    for k in range(1, attempts + 1):
        new = fetch(source, day)
        body = new if new is not None else body
        if body is not None and len(body) >= SHORTEST_REPLY:
            return (source, day, k, False, body)
    return (source, day, attempts, True, body)


def register(spark: SparkSession, name: str, fetch: Fetch, attempts: int = 3) -> None:
    """A streaming source of that name. Options: sources (separated by commas), first and last, the range of days."""

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.sources = [s for s in options["sources"].split(",") if s]
            self.first, self.last = (dt.date.fromisoformat(options[k]) for k in ("first", "last"))

        def initialOffset(self) -> dict:  # noqa: N802
            return {"next": str(self.first)}

        def latestOffset(self) -> dict:  # noqa: N802
            return {"next": str(self.last + dt.timedelta(1))}

        def partitions(self, start: dict, end: dict) -> list[Request]:
            day, stop = (dt.date.fromisoformat(x["next"]) for x in (start, end))
            days = [str(day + dt.timedelta(k)) for k in range((stop - day).days)]
            return [Request(s, d) for d in days for s in self.sources]

        def commit(self, end: dict) -> None:
            pass

        def read(self, partition: Request) -> Iterator[tuple]:
            yield asked(fetch, partition.source, partition.day, attempts)

    def label(cls):
        return name

    source = type("Crawl", (DataSource,), {"name": classmethod(label), "schema": lambda self: SCHEMA, "streamReader": lambda self, schema: Reader(self.options)})
    spark.dataSource.register(source)


def replies(spark: SparkSession, name: str, sources: list[str], first: str, last: str) -> DataFrame:
    """The stream of replies of a registered source."""
    return spark.readStream.format(name).options(sources=",".join(sources), first=first, last=last).load()


def collect(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the replies to a table, a folder for each batch, so that a batch that is run again adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
