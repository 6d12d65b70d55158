"""A keyed snapshot that batches are merged into, each at most once.

A snapshot lies in buckets of its keys' hashes. A batch rewrites the buckets that it touches, under its own id, and then
writes a manifest: for each bucket, the version that holds it. Readers follow the newest complete manifest, so they see
all of a batch or nothing; a batch that comes again finds its manifest and changes nothing, and one that was cut off is
written over. Buckets are copied on write into a file each, so small files don't pile up; vacuum() removes those that no
kept manifest names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Snapshot:
    """Rows of ``schema`` by ``keys``; of rows with one key the one whose ``order`` is greatest stays (ties: any column
    order decides alike in every run)."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.schema, self.keys, self.order, self.buckets = spark, root.rstrip("/"), schema, keys, order, buckets

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        there, at = self._files(), self._path(name)
        return [s.getPath().getName() for s in there.listStatus(at)] if there.exists(at) else []

    def versions(self) -> list[int]:
        """Ids of merged batches whose manifest is complete, ascending."""
        found = [int(n.removeprefix("v=")) for n in self._listed("manifests") if n.startswith("v=")]
        return sorted(v for v in found if self._files().exists(self._path(f"manifests/v={v}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """The version that holds each bucket, after the newest batch or that of ``version``; at most ``buckets`` entries."""
        known = [v for v in self.versions() if version is None or v <= version]
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.root}/manifests/v={known[-1]}").collect()} if known else {}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Merge a batch; False if one of this id or a later one has been merged before."""
        if any(v >= batch_id for v in self.versions()):
            return False
        columns = self.spark.createDataFrame([], self.schema).columns
        batch = batch.select(*columns).persist()
        held = self.manifest()
        touched = {r.b for r in batch.select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets``
        both = batch.unionByName(self._rows({b: v for b, v in held.items() if b in touched}))
        best = both.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *(c for c in columns if c not in self.order))).alias("r")).select("r.*").select(*columns)
        best.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={batch_id}")
        new = held | dict.fromkeys(touched, batch_id)
        self.spark.createDataFrame(sorted(new.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/v={batch_id}")
        batch.unpersist()
        return True

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch."""
        return lambda batch, batch_id: self.merge(batch, batch_id) and None

    def vacuum(self, keep: int = 1) -> int:
        """Remove what only manifests older than the newest ``keep`` name, or none; the number of buckets removed."""
        kept = self.versions()[-keep:]
        named = {(b, v) for k in kept for b, v in self.manifest(k).items()}
        there, gone = self._files(), 0
        for folder in self._listed("data"):
            version = int(folder.removeprefix("v="))
            if kept and version > kept[-1]:  # a batch may be at work
                continue
            buckets = [int(n.removeprefix("bucket=")) for n in self._listed(f"data/{folder}") if n.startswith("bucket=")]
            idle = [b for b in buckets if (b, version) not in named]
            for b in idle:
                there.delete(self._path(f"data/{folder}/bucket={b}"), True)
            gone += len(idle)
            if len(idle) == len(buckets):
                there.delete(self._path(f"data/{folder}"), True)
        for v in set(self.versions()) - set(kept):
            there.delete(self._path(f"manifests/v={v}"), True)
        return gone


FILING = "corp string, year int, kind string, rcept_no string, report_nm string, rcept_dt string"


def corrections(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Snapshot:
    """The newest filing of each company, year and type, whatever order corrections arrive in."""
    return Snapshot(spark, root, FILING, ["corp", "year", "kind"], ["rcept_dt", "rcept_no"], buckets)
