"""Numbers and running sums along an order, for groups of any size.

A group is usually numbered by one window. A hot group, which holds more than a share of
all rows, is first cut into blocks at quantiles of its order, taken from a sample, so that
a window never meets much more than that share. Each block of a hot group has a summary
(its rows and sums); the summaries are scanned, and every row takes what the blocks before
its own have. There are at most `share` hot groups and `share` blocks besides, so the cuts
and the shifts are small tables, and the rows themselves are shuffled once, by group and
block, as they would be for a plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group with more than a row in SHARE of all is hot, if it has LEAST rows or more; sampled rows for each cut.
SHARE, LEAST, SAMPLED = 256, 1 << 16, 64

#: Every so many cuts one is looked at first.
STRIDE = 8


def _matches(by: list[str], other: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{other}{i}")) for i, c in enumerate(by)]


def _block(key: Column) -> Column:
    """How many of the ascending `_cuts` are less than the key."""
    passed = lambda cuts: F.coalesce(F.size(F.filter(cuts, lambda c: c < key)), F.lit(0))
    return passed(F.col("_every")) * STRIDE + passed(F.slice("_cuts", passed(F.col("_every")) * STRIDE + 1, STRIDE - 1))


def _cuts(df: DataFrame, by: list[str], key: Column, groups: DataFrame, rows: int, share: int, least: int) -> DataFrame:
    """(_of0.., _n, _cuts, _every): the hot groups, their rows, and ascending values of `key` that cut them into blocks."""
    named = groups.select(*(F.col(c).alias(f"_of{i}") for i, c in enumerate(by)), "_n")
    sampled = df.filter(F.pmod(F.xxhash64(key), F.lit(max(1, rows // (share * SAMPLED)))) == 0)
    drawn = sampled.join(F.broadcast(named.drop("_n")), _matches(by, "_of"), "left_semi").groupBy(*(F.col(c).alias(f"_in{i}") for i, c in enumerate(by))).agg(F.array_sort(F.collect_set(key)).alias("_sample"))
    found = named.join(drawn, [F.col(f"_of{i}").eqNullSafe(F.col(f"_in{i}")) for i in range(len(by))], "left").drop(*(f"_in{i}" for i in range(len(by))))
    blocks = F.least(F.ceil(F.col("_n") * share / rows), F.ceil(F.col("_n") / least), F.size("_sample"))
    at = F.transform(F.sequence(F.lit(1), F.greatest(blocks - 1, F.lit(0)).cast("int")), lambda k: F.floor(k * F.size("_sample") / blocks).cast("int"))
    cuts = F.when(blocks > 1, F.array_distinct(F.transform(at, lambda k: F.get(F.col("_sample"), k)))).otherwise(F.slice(F.col("_sample"), 1, 0))
    every = F.filter("_cuts", lambda c, i: i % STRIDE == STRIDE - 1)
    return found.withColumn("_cuts", cuts).withColumn("_every", every).drop("_sample")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "rn", sums: dict[str, Column] | None = None, total: str | None = None, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """df with `name`, the 1-based place of each row of its group in the order; `sums`: names of running sums, this row included, and what they add up; `total`: a name for the group's rows.

    order: columns, ascending, nulls first, that together name a row of its group; groups
    by null are groups. Rows equal in the whole order share a block. df is read up to four
    times, so it should be cheap to read.
    """
    sums = sums or {}
    kept = df.columns
    rows = df.withColumns({f"_sum_{n}": c for n, c in sums.items()})
    if not by:
        rows, by = rows.withColumn("_all", F.lit(0)), ["_all"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.max("_n").alias("most")).first()
    key = F.struct(*order)
    own = Window.partitionBy(*by, "_block").orderBy(*order)
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    if (whole["most"] or 0) < least or whole["most"] * share <= whole["n"]:
        cut, hot = rows.withColumn("_block", F.lit(0)), None
    else:
        hot = F.broadcast(_cuts(rows, by, key, counts.filter((F.col("_n") >= least) & (F.col("_n") * share > whole["n"])), whole["n"], share, least))  # fewer than `share`
        cut = rows.join(hot, _matches(by, "_of"), "left").withColumn("_block", F.coalesce(_block(key), F.lit(0))).drop("_cuts", "_every")
    places = {name: F.row_number().over(own).cast("long"), **{n: F.coalesce(F.sum(f"_sum_{n}").over(running), F.lit(0)) for n in sums}}
    if total:
        places["_in_block"] = F.count("*").over(Window.partitionBy(*by, "_block"))
    out = cut.withColumns(places)
    if hot is None:
        return out.select(*kept, name, *sums, *([F.col("_in_block").alias(total)] if total else []))
    before = Window.partitionBy(*(f"_at{i}" for i in range(len(by)))).orderBy("_before").rowsBetween(Window.unboundedPreceding, -1)
    summaries = cut.filter("_n is not null").groupBy(*(F.col(c).alias(f"_at{i}") for i, c in enumerate(by)), F.col("_block").alias("_before")).agg(F.count("*").alias("_rows"), *(F.coalesce(F.sum(f"_sum_{n}"), F.lit(0)).alias(f"_add_{n}") for n in sums))
    shifts = summaries.select(*(f"_at{i}" for i in range(len(by))), "_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"), *(F.coalesce(F.sum(f"_add_{n}").over(before), F.lit(0)).alias(f"_shift_{n}") for n in sums))
    moved = out.join(F.broadcast(shifts), [*_matches(by, "_at"), F.col("_block") == F.col("_before")], "left")  # fewer than 2 * share rows
    plus = lambda n, shift: (F.col(n) + F.coalesce(F.col(shift), F.lit(0))).alias(n)
    return moved.select(*kept, plus(name, "_shift"), *(plus(n, f"_shift_{n}") for n in sums), *([F.coalesce("_n", "_in_block").alias(total)] if total else []))
