"""Archives of samples: tar shards (by the data source of `tars`), zip manifests and .npy tensors."""

from __future__ import annotations

import io
import json
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tars
from .stores import opened, settings

IMAGES = (".jpg", ".jpeg", ".png", ".webp")


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The paths of zips, dealt one by one; no content is read."""
    found = _files(spark, path, pattern).select("path")
    return found.repartition(max(1, min(found.count(), tars.MOST_TASKS)))


def _tars(spark: SparkSession, path: str, **options: str) -> DataFrame:
    tars.register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(tars.Tars.name()).options(**settings(spark), pushdown=pushdown, **options).load(path)


def read_members(spark: SparkSession, path: str, pattern: str = "*.{tar,tgz,tar.gz}", suffixes: tuple[str, ...] | None = None, content: bool = True) -> DataFrame:
    """(shard, position, name, content, status) of each member file of each archive, compressed or not.

    suffixes: only names that end so, in any case. Without `content`, that column is null
    and plain tars are read by their headers only. What a broken archive holds up to the
    break is kept; a last row without a name then says 'corrupt'.
    """
    return _tars(spark, path, pattern=pattern, suffixes=",".join(suffixes or ()), content=str(content).lower())


def read_tar_samples(spark: SparkSession, path: str, pattern: str = "*.tar", suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(shard, base, files): members that share a base form one sample, a map from extension to content; suffixes: only of members whose names end so.

    A task puts the samples of its archives together, so nothing is shuffled. Of members
    with one base and extension the last counts.
    """
    return _tars(spark, path, pattern=pattern, rows="samples", suffixes=",".join(suffixes or ())).filter("base is not null").drop("status")


def read_tgz_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """(shard, position, name, status) of image members of gzip tars."""
    return read_members(spark, path, "*.{tgz,tar.gz}", suffixes, content=False).drop("content")


def read_zip_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, p, prompt, status): entries of each zip's first .json that name a file of the archive.

    A broken zip, or one whose .json is no JSON, is one row without a name that says 'corrupt'.
    """

    options = settings(spark)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for where in pdf["path"]:
                archive = where.rsplit("/", 1)[-1]
                rows = []
                try:
                    with opened(where, options) as file, zipfile.ZipFile(file) as z:
                        inside = z.namelist()
                        if first := next((n for n in inside if n.endswith(".json")), None):
                            there = {n.rsplit("/", 1)[-1] for n in inside} | set(inside)
                            found = json.loads(z.read(first))
                            rows = [(archive, k, json.dumps(v), "ok") for k, v in found.items() if k in there] if isinstance(found, dict) else []
                except (zipfile.BadZipFile, ValueError, EOFError, OSError, zlib.error) as e:
                    rows = [(archive, None, None, f"corrupt: {type(e).__name__}")]
                yield pd.DataFrame(rows, columns=["archive", "name", "attributes", "status"])

    got = _listed(spark, path, "*.zip").mapInPandas(run, "archive string, name string, attributes string, status string")
    return got.select("archive", "name", F.get_json_object("attributes", "$.p").alias("p"), F.get_json_object("attributes", "$.prompt").alias("prompt"), "status")


def read_npy_latents(spark: SparkSession, path: str, fraction: float = 1.0) -> DataFrame:
    """(latent_name, shape, latent) of .npy tensors; unreadable files are dropped.

    fraction keeps the first max(1, floor(n * fraction)) names in sorted order; the cut is
    made on the listing, before any content is read.
    """
    files = _files(spark, path, "*.npy").withColumn("latent_name", F.element_at(F.split("path", "/"), -1))
    if fraction < 1.0:
        names = files.select("latent_name")
        keep = max(1, int(names.count() * fraction))
        last = names.orderBy("latent_name").limit(keep).agg(F.max("latent_name").alias("m")).first()["m"]
        files = files.filter(F.col("latent_name") <= F.lit(last))

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["latent_name"], pdf["content"], strict=True):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                except (ValueError, OSError, EOFError):
                    continue
                rows.append((name, list(map(int, a.shape)), a.astype(np.float32).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["latent_name", "shape", "latent"])

    return files.select("latent_name", "content").mapInPandas(run, "latent_name string, shape array<int>, latent array<float>")


def decode_captions(samples: DataFrame) -> DataFrame:
    """Samples with txt and json as strings, bytes that are not UTF-8 left out."""
    lenient = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore")), "string")
    return samples.withColumn("txt", lenient(F.col("files")["txt"])).withColumn("json", lenient(F.col("files")["json"]))
