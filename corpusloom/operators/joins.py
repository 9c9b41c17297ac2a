"""Joins by key: prompts, latents, work lists and archive members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import keys


def attach_prompts(images: DataFrame, prompts: DataFrame, key: str, position: str, prompt: str = "prompt", name: str = "name") -> DataFrame:
    """Each image with its key's prompt, the last by position; without one, or with an empty one, its name."""
    last = prompts.groupBy(key).agg(F.max_by(prompt, position).alias("_prompt"))
    return images.join(last, key, "left").withColumn("caption", F.coalesce(F.nullif(F.col("_prompt"), F.lit("")), F.col(name))).drop("_prompt")


def match_latents(items: DataFrame, latents: DataFrame, key: str = "image_key") -> DataFrame:
    """Items that have a latent."""
    return items.withColumn("latent_name", keys.latent_name(F.col(key))).join(latents.select("latent_name"), "latent_name", "left_semi")


def attach_latents(items: DataFrame, latents: DataFrame, key: str = "image_key") -> DataFrame:
    """Items with their latents; items without one are left out."""
    return items.withColumn("latent_name", keys.latent_name(F.col(key))).join(latents, "latent_name")


def pending(work: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Work that is not done yet."""
    return work.join(done, key, "left_anti")


def select_latents(latents: DataFrame, kept: DataFrame, key: str = "image_key", key_mode: str = "latent_name") -> DataFrame:
    """Latents whose item was kept. key_mode 'raw' compares the key itself with the file's stem, which never matches keys of several parts."""
    if key_mode == "raw":
        return latents.withColumn("_stem", keys.path_stem(F.col("latent_name"))).join(kept.select(F.col(key).alias("_stem")), "_stem", "left_semi").drop("_stem")
    return latents.join(kept.select(keys.latent_name(F.col(key)).alias("latent_name")), "latent_name", "left_semi")


#: Keys that one task counts; one row in LOOKS is looked at for keys that come very often, of which OFTEN at most are merged first.
KEYS_A_TASK, LOOKS, OFTEN = 1 << 20, 1 << 10, 1 << 10


def name_collisions(items: DataFrame, key: str = "image_key") -> DataFrame:
    """(latent_name, n_keys) of names that several different keys share.

    Rows are dealt by name over tasks that grow in number with the rows, so a task counts
    about KEYS_A_TASK keys of any input. Keys with some 64 * LOOKS rows or more are first
    merged where they are.
    """
    each = items.select(F.col(key).alias("_key")).filter("_key is not null")
    looks = each.groupBy(F.when(F.rand(1) * LOOKS < 1, F.col("_key")).alias("_key")).agg(F.count("*").alias("n"))
    frequent = F.collect_list(F.when(F.col("_key").isNotNull() & (F.col("n") > 64), F.struct("n", "_key")))
    rows, seen = looks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.slice(F.sort_array(frequent, asc=False), 1, OFTEN)).first()
    if seen:
        often = F.col("_key").isin([r["_key"] for r in seen])
        each = each.filter(~often).unionByName(each.filter(often).distinct())
    dealt = each.repartition(rows // KEYS_A_TASK + 1, keys.latent_name(F.col("_key")))
    return dealt.select(keys.latent_name(F.col("_key")).alias("latent_name"), "_key").distinct().groupBy("latent_name").agg(F.count("*").alias("n_keys")).filter("n_keys > 1")


#: Letters of the pieces by which names are indexed.
GRAM = 3


def _grams(name: Column, size: int) -> Column:
    """The distinct runs of `size` letters in a name; of size 0 the empty one."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - size + 1))
    return F.array_distinct(F.when(F.length(name) >= size, F.transform(starts, lambda i: name.substr(i, F.lit(size)))))


def containing(bases: DataFrame, members: DataFrame, shard: str, base: str, name: str, position: str) -> DataFrame:
    """(shard, base, member): the first member of the shard, by position, whose name contains the base, where there is one.

    Names are indexed by their runs of GRAM letters. A base meets only members that hold the
    rarest of its runs in its shard, which the count of each run tells, and is looked for
    in those; shorter bases are runs themselves. A name that a shard repeats is indexed once.
    Sides that a run or a name is exploded into are merged by shuffles: Spark sizes them by
    the files they come from, many times too small, and would broadcast them.
    """
    asked = storage.written(bases.select(shard, base).filter(F.col(base).isNotNull()).distinct(), "asked")
    sizes = sorted(r[0] for r in asked.select(F.least(F.length(base), F.lit(GRAM))).distinct().collect())  # GRAM + 1 numbers at most
    runs = [asked.filter(F.least(F.length(base), F.lit(GRAM)) == q).select(shard, base, F.explode(_grams(F.col(base), q)).alias("_gram")) for q in sizes]
    if not runs:
        return asked.withColumn("member", F.lit(None).cast("string"))
    wanted = reduce(DataFrame.unionByName, runs)
    firsts = members.groupBy(F.col(shard), F.col(name).alias("_name")).agg(F.min(position).alias("_at"))
    index = reduce(DataFrame.unionByName, [firsts.select(shard, "_name", "_at", F.explode(_grams(F.col("_name"), q)).alias("_gram")) for q in sizes])
    index = index.join(wanted.select(shard, "_gram").distinct().hint("merge"), [shard, "_gram"], "left_semi")
    counts = index.groupBy(shard, "_gram").agg(F.count("*").alias("_n"))
    rarest = wanted.join(counts.hint("merge"), [shard, "_gram"], "left").groupBy(shard, base).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least"))
    met = rarest.select(shard, base, F.col("_least.gram").alias("_gram")).join(index.hint("merge"), [shard, "_gram"]).filter(F.contains("_name", F.col(base)))
    return met.groupBy(shard, base).agg(F.min_by("_name", "_at").alias("member"))


def resolve_member(items: DataFrame, members: DataFrame, shard: str, base: str, name: str, position: str) -> DataFrame:
    """Each item with its archive member: the one whose stem or name equals its base, else the first that contains it.

    Only the misses of the equi join are looked for inside names, by an index of letter runs.
    """
    named = members.select(shard, F.explode(F.array_distinct(F.array(keys.path_stem(F.col(name)), F.col(name)))).alias(base), F.col(name).alias("member"), F.col(position).alias("_at"))
    exact = items.join(named.groupBy(shard, base).agg(F.min_by("member", "_at").alias("member")).hint("merge"), [shard, base], "left")
    found, missed = exact.filter("member is not null"), exact.filter("member is null").drop("member")
    return found.unionByName(missed.join(containing(missed, members, shard, base, name, position).hint("merge"), [shard, base], "left"))


def missing_shards(items: DataFrame, shards: DataFrame, shard: str) -> DataFrame:
    """(shard, n_items) of shards that items name but the listing lacks."""
    return items.groupBy(shard).agg(F.count("*").alias("n_items")).join(shards.select(shard), shard, "left_anti")


def top_k(df: DataFrame, score: str, k: int, by: list[str], ties: list[str]) -> DataFrame:
    """The k best rows of each group by score."""
    over = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)
