"""Structured Streaming jobs: ingestion, deduplication, upsert, progress and averages.

Every job runs over what is there now and stops; its checkpoint makes a later run take up
only what is new, exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..config import BROAD, FilterConfig
from ..operators import filters
from .averages import Average
from .tables import BucketTable


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files at a path (a folder, a glob or one file)."""
    head, _, last = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a single file is only found through a glob
    return reader.parquet(path if any(c in path for c in "*?[{") else f"{head}/{last[:-1]}[{last[-1]}]")


def _drain(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _stored(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    _drain(df.writeStream.format("parquet").outputMode(mode).option("path", out), checkpoint)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, cfg: FilterConfig = BROAD) -> DataFrame:
    """New metadata rows normalised, filtered and appended to a parquet table; returns the table."""
    kept = filters.select_output(filters.quality_filter(filters.normalize_columns(stream), cfg))
    return _stored(kept, out, checkpoint)


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, delay: str, out: str, checkpoint: str) -> DataFrame:
    """One row of each key; keys are remembered for the watermark's delay. ts must be among the keys' rows, not the keys."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return _stored(timed.dropDuplicatesWithinWatermark(keys), out, checkpoint)


def upsert_stream(stream: DataFrame, key: str, order: list[str], out: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """Rows whose key the table lacks are added; an existing row wins. Returns the table.

    The table is a BucketTable: a batch reads and rewrites only the buckets it touches, of
    which each has a bounded number of folders, and a batch that is run again changes nothing.
    """
    table = BucketTable(stream.sparkSession, out, stream.schema, key, buckets)
    _drain(stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number, order)), checkpoint)
    return table.read()


def progress_stream(stream: DataFrame, ts: str, by: list[str], window: str, delay: str, out: str, checkpoint: str) -> DataFrame:
    """(start, by..., n) per tumbling window once the watermark has passed it; later rows are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counts = timed.groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
    return _stored(counts, out, checkpoint)


WHOLE, TIMES = ("long", "integer", "short", "byte"), ("timestamp", "timestamp_ntz")


def _filled(df: DataFrame, column: str) -> Column:
    """The column with 0 for a null where pandas would turn whole numbers into floats or knows no null."""
    kind = df.schema[column].dataType
    return F.coalesce(F.col(column), F.lit(0).cast(kind)) if kind.typeName() in (*WHOLE, "float", "double", "decimal") else F.col(column)


def _comparable(df: DataFrame, column: str) -> list[Column]:
    """Columns whose values Python puts in the column's order, nulls first; times as microseconds."""
    c, kind = F.col(column), df.schema[column].dataType.typeName()
    if kind in TIMES:
        c = F.unix_micros(c.cast("timestamp"))
    return [F.coalesce(c, F.lit(-(1 << 63)))] if kind in (*WHOLE, *TIMES) else [c.isNotNull(), _filled(df, column)]


def ema_stream(stream: DataFrame, by: str, order: list[str], value: str, decay: float, out: str, checkpoint: str, hold: int = 256, ttl: int | None = None, groups: int | None = None) -> DataFrame:
    """(by, ema, n, n_late) so far of each key: averages.Average as keyed state; exact where a value comes at most `hold` places late, n_late counts the others.

    groups: keep the state of keys together, in so many groups by hash, the same in each run of
    a checkpoint. It spares calls of the state store where most keys have news in most
    micro-batches; without it each key has a state, which `ttl` needs. A group's rows in one
    micro-batch may come in any order, as long as they are not more than Average's chunk; a
    key with more should have them in one file, in order. Nulls of the order come first.
    """
    if ttl and groups:
        raise ValueError("a time to live is one of keys, not of groups")
    spark, kind = stream.sparkSession, stream.schema[by].dataType.simpleString()
    group = F.pmod(F.xxhash64(by), F.lit(groups)) if groups else _filled(stream, by)
    places = [p.alias(f"o{i}") for i, p in enumerate(p for c in order for p in _comparable(stream, c))]
    rows = stream.filter(F.col(value).isNotNull()).select(group.alias("g"), F.col(by).isNotNull().alias("there"), _filled(stream, by).alias("k"), *places, F.col(value).cast("double").alias("v"))
    folded = rows.groupBy("g").transformWithStateInPandas(Average(by, decay, hold, ttl), f"{by} {kind}, ema double, n long, n_late long", "Append", "ProcessingTime" if ttl else "None")
    folded = folded.withColumn("ema", F.coalesce("ema", F.lit(float("nan"))))  # pandas hands on a NaN as null
    # the store that keeps several states of a key; and no batches without data, which a time to live would ask for without end
    needed = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in needed}
    for k, v in needed.items():
        spark.conf.set(k, v)
    try:
        rows = _stored(folded, out, checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return rows.groupBy(by).agg(F.max_by("ema", "n").alias("ema"), F.max("n").alias("n"), F.max("n_late").alias("n_late"))


def scratch(spark: SparkSession, label: str) -> tuple[str, str]:
    """An output path and a checkpoint path in the shared folder."""
    path = storage.new_path(spark, label)
    return f"{path}/table", f"{path}/checkpoint"
