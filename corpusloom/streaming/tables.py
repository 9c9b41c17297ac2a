"""A table that micro-batches add rows to, one row a key: files in buckets by key, named by a manifest.

    <table>/data/v<batch>/<BUCKET>=<b>/*.parquet
    <table>/manifests/<batch>.json    {"buckets": n, "live": {"<b>": ["v3", "v7"]}}

A row's bucket is a hash of its key. A batch reads the keys of the buckets it touches, adds
a folder to those where it has new keys and, where a bucket has MOST folders already, writes
them again as one together with the new rows. What is live is said by the last manifest,
which is put in place by a rename after all files are written, so a batch that breaks off
leaves the table as it was, and one that is run again after its manifest is there does
nothing. Files and manifests that the last two manifests don't name are removed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import dedup_keep_first

#: Folders of a bucket before they are written as one; the name of the partition column.
MOST, BUCKET = 8, "bucket_of_key"


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or the last one; without any, that of an empty table."""
        found = self.versions()
        if not found:
            return {"buckets": self.buckets, "live": {}}
        stream = self._fs.open(self._at("manifests", f"{found[-1] if version is None else version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        draft = self._at("manifests", f".{version}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, self._at("manifests", f"{version}.json")):
            raise RuntimeError(f"manifest {version} of {self.path} was not put in place")

    def folders(self, manifest: dict, buckets: list[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{v}/{BUCKET}={b}" for b, of in manifest["live"].items() if buckets is None or int(b) in buckets for v in of]

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table's rows, as the last manifest has them."""
        return self._rows(self.folders(self.manifest()))

    def merge(self, batch: DataFrame, number: int, order: list[str]) -> None:
        """Add the first row, by order, of each key that the table lacks; an existing row wins. Null is a key like others."""
        versions = self.versions()
        if versions and versions[-1] >= number:
            return  # this batch is in the table
        manifest = self.manifest()
        if manifest["buckets"] != self.buckets:
            raise ValueError(f"the table has {manifest['buckets']} buckets")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        first = dedup_keep_first(batch, [self.key], order).withColumn(BUCKET, bucket).persist()
        try:
            touched = [r[0] for r in first.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
            stored = self._rows(self.folders(manifest, touched)).select(F.col(self.key).alias("_key"))
            same = lambda a, b: a[self.key].eqNullSafe(b["_key"])
            # of the stored keys only those of the batch go on, so that a small batch is broadcast and the table is not shuffled
            asked = first.select(F.col(self.key).alias("_asked"))
            met = stored.join(asked, F.col("_key").eqNullSafe(F.col("_asked")), "left_semi")
            new = first.join(met, same(first, met), "left_anti")
            full = [b for b in touched if len(manifest["live"].get(str(b), ())) >= MOST]
            again = self._rows(self.folders(manifest, full)).withColumn(BUCKET, bucket)
            new.unionByName(again).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/v{number}")
        finally:
            first.unpersist()
        live = {b: list(of) for b, of in manifest["live"].items()}
        for name in self._names("data", f"v{number}"):
            if name.startswith(f"{BUCKET}="):
                b = name.partition("=")[2]
                live[b] = [f"v{number}"] if int(b) in full else [*live.get(b, []), f"v{number}"]
        self._publish(number, {"buckets": self.buckets, "live": live})
        self._clean()

    def _clean(self) -> None:
        *old, before, last = [None, None, *self.versions()]
        named = set().union(*(self.folders(self.manifest(v)) for v in (before, last) if v is not None))
        for v in old:
            if v is not None:
                self._fs.delete(self._at("manifests", f"{v}.json"), False)
        for version in self._names("data"):
            inside = [n for n in self._names("data", version) if n.startswith(f"{BUCKET}=")]
            gone = [n for n in inside if f"{self.path}/data/{version}/{n}" not in named]
            if len(gone) == len(inside):
                self._fs.delete(self._at("data", version), True)
            else:
                for n in gone:
                    self._fs.delete(self._at("data", version, n), True)
