"""Counts, shares and running metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATENT_BYTES
from ..functions import arrays, text
from .filters import PEOPLE
from .scans import numbered


def keep_summary(df: DataFrame, keep: Column, file: str | None = None) -> DataFrame:
    """One row: seen, kept, keep_pct and, with a file column, n_files."""
    kept = F.count_if(F.coalesce(keep, F.lit(False)))
    out = [F.count("*").alias("seen"), kept.alias("kept"), (kept * 100.0 / F.greatest(F.lit(1), F.count("*"))).alias("keep_pct")]
    return df.agg(*out, *([F.countDistinct(file).alias("n_files")] if file else []))


def shard_stats(samples: DataFrame, shard: str, status: Column, no_caption: Column) -> DataFrame:
    """Per shard: total, valid, corrupt, invalid and no_caption; a short caption counts beside its sample's status."""
    s = samples.withColumn("_status", status)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return s.groupBy(shard).agg(
        F.count("*").alias("total"), count((F.col("_status") == "ok") & ~no_caption).alias("valid"), count(F.col("_status") == "corrupt").alias("corrupt"),
        count(~F.col("_status").isin("ok", "corrupt")).alias("invalid"), count(no_caption).alias("no_caption"),
    )


def keyword_share(df: DataFrame, column: str, words=PEOPLE, whole_word: bool = False) -> DataFrame:
    """One row: how many texts contain any of the words, and their share in per cent."""
    hit = F.coalesce(text.contains_any(F.col(column), words, whole_word), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hit"), (F.count_if(hit) * 100.0 / F.greatest(F.lit(1), F.count("*"))).alias("pct"))


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows of each source, and of all (source null)."""
    return df.rollup(source).agg(F.count("*").alias("n"))


def group_by_shard(items: DataFrame, shard: str, base: str, output: str) -> DataFrame:
    """Per shard the sorted list of its items; a shard is one archive, so a list is bounded by an archive's members."""
    return items.groupBy(shard).agg(F.sort_array(F.collect_list(F.struct(base, output))).alias("items"))


def encode_summary(status: DataFrame, column: str = "status") -> DataFrame:
    """One row: encoded, failed, skipped, and the bytes expected of what is or will be encoded."""
    n = lambda s: F.count_if(F.col(column) == s)
    return status.agg(n("encoded").alias("encoded"), n("failed").alias("failed"), n("skipped").alias("skipped"), ((n("encoded") + n("failed") + n("skipped")) * LATENT_BYTES).alias("expected_bytes"))


def batch_loss(df: DataFrame, a: str, b: str, weight: str | None, by: list[str]) -> DataFrame:
    """Mean over the rows of each group of the weighted squared error of two arrays."""
    loss = arrays.squared_error(F.col(a), F.col(b))
    return df.groupBy(*by).agg(F.avg(loss * F.col(weight) if weight else loss).alias("loss"), F.count("*").alias("n"))


def latent_stats(df: DataFrame, value: str) -> DataFrame:
    """One row over all entries of all arrays: n, mean and population std, from sums."""
    x = F.col(value)
    sums = df.agg(F.sum(F.size(x)).alias("n"), F.sum(arrays.total(x)).alias("s"), F.sum(arrays.total(x, lambda v: v * v)).alias("s2"))
    return sums.select("n", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))).alias("std"))


def running_mean(df: DataFrame, value: str, order: list[str], by: list[str], every: int = 100, **scan) -> DataFrame:
    """The mean so far at every `every`-th row of each group; nulls count as steps, not as values. scan: options of scans.numbered."""
    v = F.col(value).cast("double")
    out = numbered(df, by, order, "step", {"_total": v, "_values": v.isNotNull().cast("long")}, **scan)
    return out.withColumn("step", F.col("step").cast("int")).withColumn("running_mean", F.try_divide("_total", "_values")).drop("_total", "_values").filter(F.col("step") % every == 0)


def running_best(df: DataFrame, value: str, epoch: str, by: list[str]) -> DataFrame:
    """Per epoch: its mean, the smallest mean so far, and whether this epoch set it."""
    epochs = df.groupBy(*by, epoch).agg(F.avg(value).alias("epoch_mean"))
    over = Window.partitionBy(*by).orderBy(epoch)
    before = F.min("epoch_mean").over(over.rowsBetween(Window.unboundedPreceding, -1))
    return epochs.withColumn("best", F.least("epoch_mean", before)).withColumn("new_best", before.isNull() | (F.col("epoch_mean") < before))


def ema(df: DataFrame, value: str, order: list[str], by: list[str], decay: float = 0.9999, **scan) -> DataFrame:
    """Per group: the exponential average at its last row, and the number of rows.

    The decay warms up as min(decay, (1 + s) / (10 + s)) at step s; the first value starts
    the average. A step maps the average e to d * e + (1 - d) * v, and such maps compose, so
    a row's weight in the result is the product of the decays behind it: up to step s that
    product is 10! / ((s + 2) ... (s + 10)) as long as the decay warms up, and shrinks by
    `decay` a step from there on. The average is therefore a sum over numbered rows, which
    each task adds up for itself, however many rows a group has.
    """
    warm = max(0, math.ceil((10 * decay - 1) / (1 - decay)) - 1) if decay < 1 else 1 << 62  # the last step below `decay`

    def log_product(s):
        up = F.least(s, F.lit(warm))
        rising = sum((F.log(up + k) for k in range(3, 11)), F.log(up + 2))
        return F.lit(math.lgamma(11)) - rising + (s - up) * math.log(decay)

    rows = df.filter(F.col(value).isNotNull()).select(*by, *(c for c in order if c not in by), F.col(value).cast("double").alias("_v"))
    stepped = numbered(rows, by, order, "_step", total="_all_steps", **scan)
    at, last = F.col("_step") - 1, F.col("_all_steps") - 1
    rate = F.least(F.lit(decay), (1 + at).cast("double") / (10 + at))
    weight = F.when(at == 0, 1.0).otherwise(1 - rate) * F.exp(log_product(last) - log_product(at))
    return stepped.groupBy(*by).agg(F.sum(F.col("_v") * weight).alias("ema"), F.count("*").alias("n"))


def throughput(df: DataFrame, ts: str, order: list[str], by: list[str], every: int, **scan) -> DataFrame:
    """Per group and `every` rows: the seconds they took and items a second (null for none)."""
    marks = numbered(df, by, order, "_rn", **scan).withColumn("chunk", F.floor((F.col("_rn") - 1) / every))
    seconds = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))
    return marks.groupBy(*by, "chunk").agg(F.count("*").alias("items"), (seconds / 1e6).alias("seconds")).withColumn("rate", F.try_divide(F.col("items"), F.col("seconds")))
