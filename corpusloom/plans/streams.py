"""Queries that run as streams over the table's files and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..streaming import jobs
from . import training  # noqa: F401  registers the batch query, whose SQL is used here
from .registry import ORACLES, query, table


def _stream(spark, sf_dir, name):
    return jobs.source(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


@query("""select concat('http://img.example/', source) as "URL", lang as "TEXT" from documents where source is not null and lang is not null and n_chars % 100 >= 65""")
def ingest_stream(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents").select(F.concat(F.lit("http://img.example/"), "source").alias("url"), F.concat("lang", F.lit(" " * 20)).alias("caption"), (F.col("n_chars") % 100 / 10.0).alias("aesthetic"))
    return jobs.ingest_stream(docs, *jobs.scratch(spark, "ingest")).select("URL", F.trim("TEXT").alias("TEXT"))


@query("select event_type, user_id from events group by all")
def dedup_stream(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").select("event_type", "user_id", "ts")
    return jobs.dedup_stream(events, ["event_type", "user_id"], "ts", "3650 days", *jobs.scratch(spark, "dedup")).select("event_type", "user_id")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as rn from events) where rn = 1")
def upsert_stream(spark, sf_dir):
    """One file is one micro-batch; within it the smallest event wins."""
    events = _stream(spark, sf_dir, "events").select("user_id", "event_id")
    return jobs.upsert_stream(events, "user_id", ["event_id"], *jobs.scratch(spark, "upsert"))


@query("""with w as (select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by all), m as (select max(ts) - interval '10 minutes' as mark from events)
select cast(start as timestamp) as start, event_type, n from w, m where start + interval '1 hour' <= date_trunc('millisecond', mark)""")
def progress_stream(spark, sf_dir):
    """Closed hourly windows; those still open at the watermark are left out."""
    events = _stream(spark, sf_dir, "events").select("ts", "event_type")
    return jobs.progress_stream(events, "ts", ["event_type"], "1 hour", "10 minutes", *jobs.scratch(spark, "progress")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""select c_custkey as custkey, min_by(o_orderkey, o_orderkey) as orderkey, 3 as batches from customer join orders on o_custkey = c_custkey group by c_custkey""")
def upsert_batches(spark, sf_dir):
    """Each customer's first order, out of three micro-batches of ascending orders; most customers come again in each."""
    path = storage.new_path(spark, "orders")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    low, high = orders.agg(F.percentile_approx("orderkey", [0.3, 0.6])).first()[0]
    for k, part in enumerate((orders.filter(F.col("orderkey") <= low), orders.filter((F.col("orderkey") > low) & (F.col("orderkey") <= high)), orders.filter(F.col("orderkey") > high))):
        part.repartition(1).write.parquet(f"{path}/{k}")  # one file after the other: the order of the stream
    out, checkpoint = jobs.scratch(spark, "upsert")
    found = jobs.upsert_stream(jobs.source(spark, f"{path}/*/*.parquet", orders.schema, 1), "custkey", ["orderkey"], out, checkpoint, buckets=16)
    return found.withColumn("batches", F.lit(len(spark.read.text(f"{checkpoint}/commits").select(F.input_file_name()).distinct().collect())))


@query(ORACLES["ema"])
def ema_stream(spark, sf_dir):
    """The average as keyed state, over four micro-batches of events by time; each is written by all tasks, a user's events in one file and in order."""
    path, (out, checkpoint) = storage.new_path(spark, "events"), jobs.scratch(spark, "ema")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts, users = events.agg(F.percentile_approx(at, [0.25, 0.5, 0.75]), F.approx_count_distinct("user_id")).first()
    cuts = cuts or []
    part = sum((F.coalesce(at > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for k in range(len(cuts) + 1):
        events.filter(part == k).repartition("user_id").sortWithinPartitions("ts", "event_id").write.parquet(f"{path}/{k}")
        # what is new since the run before is one micro-batch
        found = jobs.ema_stream(jobs.source(spark, f"{path}/*/*.parquet", events.schema), "user_id", ["ts", "event_id"], "value", 0.99, out, checkpoint, hold=32, groups=1 + users // 64)
    return found.select("user_id", F.round("ema", 6).alias("ema"), "n")
