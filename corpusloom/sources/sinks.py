"""Writing datasets, batches and tar shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..operators.sampling import train_val_split
from . import tars
from .stores import settings


def write_filtered(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path, compression="snappy")


def write_batches(df: DataFrame, path: str, rows_per_file: int = 5_000) -> None:
    """Parquet files of at most rows_per_file rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def union_sources(*dfs: DataFrame) -> DataFrame:
    """All rows; a column that a source lacks is null there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_dataset(df: DataFrame, path: str, val_size: int, seed: int, key: str, shard_dir: str = "", image_size: int = 512) -> DataFrame:
    """split=train/ and split=val/ below path, and the written configuration, as one row, beside them."""
    train_val_split(df, val_size, seed, key).write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    spark = df.sparkSession
    back = spark.read.parquet(f"{path}/data")
    size = lambda s: F.count_if(F.col("split") == s)
    columns = F.array(*map(F.lit, df.columns))
    config = back.agg(F.lit("standard").alias("mode"), size("train").alias("train_size"), size("val").alias("val_size"), F.lit(shard_dir).alias("shard_dir"), F.lit(image_size).alias("image_size"), columns.alias("columns"), F.lit(seed).alias("seed"), F.current_timestamp().cast("string").alias("created"))
    config.write.mode("overwrite").json(f"{path}/dataset_config")
    return spark.read.json(f"{path}/dataset_config")


def write_tar_samples(samples: DataFrame, path: str, shard: str = "shard", stats: bool = False, compress: str | None = None) -> DataFrame:
    """One tar per shard with <key>.jpg and <key>.txt of its rows (key, image, caption), in the order of keys; (shard, file, n_samples, n_failed, bytes), once all are written.

    A shard is written by one task (assign_shards bounds its rows), row by row; nothing of
    a job that fails stays. A row without key or image is not written, but counted in
    n_failed; a null caption is empty. stats: a sidecar <shard>_stats.json beside each tar.
    compress: 'gz' for .tar.gz.
    """
    spark = samples.sparkSession
    tars.register(spark)
    rows = samples.select(F.col(shard).cast("string").alias("shard"), F.col("key").cast("string").alias("key"), "image", "caption").repartition("shard").sortWithinPartitions("shard", "key")
    options = {**settings(spark), "stats": str(stats).lower(), "summary": storage.new_path(spark, "shards") + ".jsonl"} | ({"compress": compress} if compress else {})
    rows.write.format(tars.Tars.name()).mode("append").options(**options).save(path.rstrip("/"))
    return spark.read.schema("shard string, file string, n_samples long, n_failed long, bytes long").json(options["summary"])
