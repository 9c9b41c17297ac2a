"""Reading metadata tables, logs and listings."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chance, text
from ..operators.filters import ALIASES, normalize_columns
from ..operators.sampling import cut_after


def read_metadata(spark: SparkSession, path: str, recursive: bool = True, normalize: bool = True) -> DataFrame:
    """All parquet files below a path, unreadable ones skipped, with file and row_index columns.

    Files may name their columns differently: schemas are merged, then aliases folded.
    """
    df = spark.read.option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True).option("mergeSchema", True).option("pathGlobFilter", "*.parquet").parquet(path)
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    return normalize_columns(df, ALIASES) if normalize else df


def read_keys(spark: SparkSession, path: str, key: str = "image_key") -> DataFrame:
    """The key column alone; the scan reads no other."""
    return spark.read.parquet(path).select(key)


def read_done_log(spark: SparkSession, path: str) -> DataFrame:
    """(value): the distinct lines of a text log."""
    return spark.read.text(path).distinct()


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt): stripped lines, empty ones dropped."""
    return spark.read.text(path).select(text.strip(F.col("value")).alias("prompt")).filter(F.col("prompt") != "")


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a parquet path; no column is read."""
    return spark.read.parquet(path).count()


def read_capped(spark: SparkSession, path: str, n: int, seed: int, name: Column | None = None) -> DataFrame:
    """Exactly n rows (or all) of a parquet path: files in random order, each file's rows in theirs.

    Rows are counted by file from the footers, no column being read; running sums over the
    files choose those that are read whole and the one that is read up to a row. No other
    file is opened again, and nothing is sorted. name: what the order is drawn by, the
    file's own name unless given; equal names follow each other by path. The driver holds
    the chosen paths, as it holds the listing.
    """
    where = F.col("_metadata.file_path")
    rows = spark.read.parquet(path)
    counts = rows.groupBy(where.alias("_file"), (F.element_at(F.split(where, "/"), -1) if name is None else name).alias("_name")).agg(F.count("*").alias("_rows"))
    parts = counts.withColumn("_hash", chance.hash_order(seed, F.col("_name")))
    whole, broken, rest = cut_after(parts, n, ["_hash", "_name", "_file"])
    paths = [unquote(r["_file"]) for r in whole.select("_file").collect()]
    reader = spark.read.schema(rows.schema)
    reader = reader if set(path) & set("*?[{") else reader.option("basePath", path)  # else partition columns would be lost
    read = lambda *files: reader.parquet(*files)
    out = read(*paths) if paths else rows.limit(0)
    return out.unionByName(read(unquote(broken["_file"])).filter(F.col("_metadata.row_index") < rest)) if broken else out


def shard_inventory(spark: SparkSession, path: str, suffix: str = "tar") -> DataFrame:
    """(directory, n_shards, bytes, successes): per directory, from the listing and the JSON sidecars.

    A shard's sidecar is <stem>_stats.json beside it; a missing or bad one counts 0.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "length")
    stem = lambda c, tail: F.regexp_replace(c, tail, "")
    shards = files.select(stem(F.col("path"), rf"\.{suffix}$").alias("stem"), "length")
    notes = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_stats.json").option("wholetext", True).text(path)
    notes = notes.select(stem(F.col("_metadata.file_path"), r"_stats\.json$").alias("_path"), F.expr("try_cast(get_json_object(value, '$.successes') as bigint)").alias("successes"))
    local = F.regexp_replace("stem", "^[a-z]+:/+", "/")
    joined = shards.withColumn("_path", local).join(notes.withColumn("_path", F.regexp_replace("_path", "^[a-z]+:/+", "/")), "_path", "left")
    return joined.groupBy(F.regexp_replace("_path", "/[^/]*$", "").alias("directory")).agg(F.count("*").alias("n_shards"), F.sum("length").alias("bytes"), F.sum(F.coalesce("successes", F.lit(0))).alias("successes"))
