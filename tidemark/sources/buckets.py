"""Upserts that rewrite only what they touch: a table in buckets by hash of its keys.

The rows of bucket b as of version v are in data/v=v/bucket=b. versions/n=N says which version of each bucket counts as of
merge N; it is written last, as one small file, so a merge that fails leaves the table as it was, and readers see either
the state before or the state after it. A merge reads and writes the buckets in which its rows fall. Two merges at a time
of the same table aren't supported: the second to finish fails, because its number is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_of
from ..operators.relational import upsert


@dataclass(frozen=True)
class Buckets:
    """A table of this schema under a path. The number of buckets must stay as it was at the first merge."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> tuple[int, dict[int, int]]:
        """The number of merges so far, and the version of each bucket that has rows: `buckets` entries at most."""
        try:
            every = self.spark.read.schema("bucket int, version int, n int").parquet(f"{self.path}/versions")
            last = every.agg(F.max("n")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, {}
        return last, {r["bucket"]: r["version"] for r in every.filter(F.col("n") == last).collect()}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self.versions()[1])

    def merge(self, rows: DataFrame, order: list) -> list[int]:
        """New keys are added, rows of known ones are replaced; of rows that share a key the first in the order counts. Returns the touched buckets."""
        number, have = self.versions()
        number += 1
        own = first_of(rows, list(self.keys), order).select(*self.spark.createDataFrame([], self.schema).columns)
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())
        if not touched:
            return []
        before = self._read({b: have[b] for b in touched if b in have})
        merged = upsert(before, own, list(self.keys), order).withColumn("bucket", self._bucket())
        merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/v={number}")
        now = have | dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.parquet(f"{self.path}/versions/n={number}")
        return touched
