"""Runs stored in buckets by key, so that two of them are compared where they lie."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COMPARE_COLS
from ..sources.store import Store
from .runs import compare_runs


class Snapshots:
    """Folders of a store, one a run; each holds `buckets` sorted buckets of the key.

    All runs of a store have the same number of buckets, which its first run sets. A key is never null.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "para_id", buckets: int = 200):
        self.spark, self.key, self.store = spark, key, Store(spark, root)
        if not self.store.claim("_buckets", str(buckets)):
            buckets = int(self.store.read("_buckets"))
        self.buckets = buckets

    def _folder(self, run_id: int) -> str:
        return f"run-{run_id:09d}"

    def save(self, run_id: int, parsed: DataFrame) -> None:
        """Store a run; one of that id must not exist. A row without a key fails the write."""
        if self.store.exists(self._folder(run_id)):
            raise ValueError(f"run {run_id} is stored already")
        key = F.coalesce(F.col(self.key), F.raise_error(F.lit(f"a row without {self.key}")).cast(parsed.schema[self.key].dataType))
        rows = parsed.withColumn(self.key, key).repartition(self.buckets, self.key)
        name, aside = f"snapshot_{uuid.uuid4().hex}", f"_aside/{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.store.full(aside)).saveAsTable(name)
        self.spark.sql(f"drop table {name}")  # the files stay, for the table is external
        self.store.move(aside, self._folder(run_id))

    def load(self, run_id: int) -> DataFrame:
        """A stored run, its buckets known to the planner."""
        path = self.store.full(self._folder(run_id))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
        name = f"snapshot_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{self.key}`) sorted by (`{self.key}`) into {self.buckets} buckets location '{path}'")
        return self.spark.table(name)

    def compare(self, old: int, new: int, compare: list[str] = COMPARE_COLS) -> DataFrame:
        """compare_runs() of two stored runs, bucket by bucket: neither is shuffled."""
        return compare_runs(self.load(old), self.load(new), self.key, compare, null_keys=False)
