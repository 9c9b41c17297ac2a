"""Repeatable orders, samples, splits, shards and mixes.

A global position never needs a window over a whole large table. By a hash, rows are dealt
over slices of that order, numbered inside their slice, and shifted by the sizes of the
slices before, of which there are at most 65,536. By given columns, `scans.numbered` cuts
the order at its quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import chance
from .scans import SHARE, numbered

#: About so many rows a slice, each a window partition; most blocks of an order by columns.
SLICE_ROWS, MOST_BLOCKS = 1 << 22, 1 << 12


def _slice_digits(rows: int) -> int:
    """Hex digits of the hash that name a slice: 2 to 4."""
    digits = 2
    while digits < 4 and rows > SLICE_ROWS * 16**digits:
        digits += 1
    return digits


def _numbered(df: DataFrame, slice_: Column, order: list, name: str, by: list[str]) -> DataFrame:
    """1-based position by (slice, order) within each `by` group; df is read twice."""
    cut = df.withColumn("_slice", slice_)
    sizes = cut.groupBy(*by, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_slice"]
    shift = sizes.select(*(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = own.join(shift, [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)])
    return joined.select(*df.columns, (F.col("_own") + F.col("_shift")).alias(name))


def position(df: DataFrame, seed: int, key: str, name: str = "rn", by: list[str] | None = None) -> DataFrame:
    """df with the 1-based place of each row in the hash order, overall or within each group."""
    h = chance.hash_order(seed, F.col(key))
    return _numbered(df, F.substring(h, 1, _slice_digits(df.count())), [h, key], name, by or [])


def ordered_position(df: DataFrame, order: str, ties: list[str], name: str = "rn", by: list[str] | None = None) -> DataFrame:
    """df with the 1-based place of each row by a column and its ties, overall or within each group.

    Blocks are cut at quantiles of the whole order, ties included, so a value that many rows
    have is spread as well; there are 256 of them, doubled while one has over SLICE_ROWS rows.
    """
    rows, share = df.count(), SHARE
    while share < MOST_BLOCKS and rows > SLICE_ROWS * share:
        share *= 2
    return numbered(df, by or [], [order, *ties], name, share=share)


def shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """df in a repeatable random order."""
    return df.orderBy(chance.hash_order(seed, F.col(key)), key)


def cut_after(counts: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, Row | None, int]:
    """counts: parts with their `_rows`. The parts, in order, of which every row is among the first n; the part where row n lies, if it isn't its last, and how many of its rows are among them."""
    added = numbered(counts, [], order, "_place", {"_upto": F.col("_rows")})
    broken = added.filter((F.col("_upto") > n) & (F.col("_upto") - F.col("_rows") < n)).first()
    return added.filter(F.col("_upto") <= n).drop("_place"), broken, n - (broken["_upto"] - broken["_rows"]) if broken else 0


def cap_samples(df: DataFrame, n: int, seed: int, file: str, row: str, unit: str = "file") -> DataFrame:
    """Exactly n rows (or all): files in random order, each file's rows in theirs; unit 'row' shuffles rows.

    Rows are counted by file, or by the first digits of their hash, and running sums of the
    counts pick the files that stay whole and the one that is cut; only its rows are numbered.
    """
    if unit == "file":
        parts = df.groupBy(file).agg(F.count("*").alias("_rows")).withColumn("_hash", chance.hash_order(seed, F.col(file)))
        whole, broken, rest = cut_after(parts, n, ["_hash", file])
        kept = df.join(whole.select(F.col(file).alias("_file")), F.col(file).eqNullSafe(F.col("_file")), "left_semi")
        mine, order = F.col(file).eqNullSafe(F.lit(broken[file] if broken else None)), [row]
    elif unit == "row":
        df = df.withColumn("_hash", chance.hash_order(seed, F.col(file), F.col(row)))
        digits = F.substring("_hash", 1, 4)
        whole, broken, rest = cut_after(df.groupBy(digits.alias("_digits")).agg(F.count("*").alias("_rows")), n, ["_digits"])
        last = whole.agg(F.max("_digits").alias("d")).first()["d"]
        kept = df.filter(digits <= F.lit(last)) if last is not None else df.limit(0)
        mine, order = digits == F.lit(broken["_digits"] if broken else None), ["_hash", file, row]
    else:
        raise ValueError(f"unknown unit {unit!r}")
    if broken:
        kept = kept.unionByName(numbered(df.filter(mine), [], order, "_rn").filter(F.col("_rn") <= rest).drop("_rn"))
    return kept.drop("_hash")


def train_val_split(df: DataFrame, val_size: int, seed: int, key: str, least_val: int = 0) -> DataFrame:
    """df with split: the first min(val_size, n // 10) rows of the hash order are val (at least least_val)."""
    n = df.count()
    val = max(min(val_size, n // 10), least_val)
    return position(df, seed, key, "_rn").withColumn("split", F.when(F.col("_rn") <= val, "val").otherwise("train")).drop("_rn")


def epoch_shards(df: DataFrame, epoch: int, ranks: int, seed: int, key: str) -> DataFrame:
    """Rows of one epoch with their rank: equal contiguous slices of the epoch's order, the remainder dropped."""
    n = df.count()
    each = n // ranks
    return position(df, seed + epoch, key, "_rn").filter(F.col("_rn") <= each * ranks).withColumn("rank", F.floor((F.col("_rn") - 1) / max(1, each)).cast("long")).drop("_rn")


def assign_batches(df: DataFrame, size: int, by: list[str], order: list[str], drop_last: bool = False, **scan) -> DataFrame:
    """df with batch: runs of `size` rows within each group; drop_last leaves out a shorter last one. scan: options of scans.numbered."""
    out = numbered(df, by, order, "_rn", total="_n" if drop_last else None, **scan).withColumn("batch", F.floor((F.col("_rn") - 1) / size))
    if drop_last:
        out = out.filter((F.col("batch") + 1) * size <= F.col("_n")).drop("_n")
    return out.drop("_rn")


def assign_shards(df: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """df with shard: runs of `size` rows of the whole hash order."""
    return position(df, seed, key, "_rn").withColumn("shard", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def split_workers(df: DataFrame, order: str, ties: list[str]) -> DataFrame:
    """df with worker: the first n // 2 rows by order are 0, the rest 1."""
    n = df.count()
    return ordered_position(df, order, ties, "_rn").withColumn("worker", F.when(F.col("_rn") <= n // 2, 0).otherwise(1)).drop("_rn")


def mix_sources(df: DataFrame, source: str, counts: dict[str, int], seed: int, key: str) -> DataFrame:
    """A fixed number of rows of each listed source (or all it has), drawn by the hash order."""
    quota = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))
    drawn = position(df.filter(F.col(source).isin(*counts)), seed, key, "_rn", [source])
    return drawn.filter(F.col("_rn") <= quota[F.col(source)]).drop("_rn")


def mix_weights(df: DataFrame, source: str, weights: dict[str, float], total: int, seed: int, key: str) -> DataFrame:
    """As mix_sources, with shares of a total."""
    whole = sum(weights.values())
    return mix_sources(df, source, {s: int(total * w / whole) for s, w in weights.items()}, seed, key)
