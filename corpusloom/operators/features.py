"""Feature jobs: vocabulary and tokens, noise schedules, training examples, encoders."""

from __future__ import annotations

import contextlib
import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SCALING, TOKENS
from ..functions import arrays, chance
from .joins import pending
from .sampling import assign_batches

PAD, BOS, EOS, UNK = 0, 1, 2, 3

#: Bounds of a vocabulary that is looked up inside the rows, and the places that its words are dealt over.
DICTIONARY_WORDS, DICTIONARY_BYTES, PLACES = 200_000, 4 << 20, 4096


def words(column: str) -> Column:
    return F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda w: w != "")


def build_vocab(df: DataFrame, column: str, size: int) -> DataFrame:
    """(word, n, id): the `size` most frequent words, ties by word; ids begin after the special ones."""
    counts = df.select(F.explode(words(column)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size)  # bounded by size, so one window over it is small
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) + UNK).cast("int"))


def looked_up(vocab: DataFrame) -> Callable[[Column], Column] | None:
    """A function from a word to its id (null for none) for a vocabulary (word, id) of at most DICTIONARY_WORDS words and DICTIONARY_BYTES letters; else None.

    The words lie in an array of small maps, at the place that their hash names, which is a
    constant of the plan and goes to every task with it.
    """
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES)).cast("int")
    rows = vocab.select("word", "id", place(F.col("word"))).limit(DICTIONARY_WORDS + 1).collect()
    if len(rows) > DICTIONARY_WORDS or sum(len(w.encode()) for w, _, _ in rows) > DICTIONARY_BYTES:
        return None
    held: list[dict[str, int]] = [{} for _ in range(PLACES)]
    for word, number, at in rows:
        held[at][word] = number
    places = F.from_json(F.lit(json.dumps(held)), "array<map<string,int>>")
    return lambda word: F.try_element_at(F.get(places, place(word)), word)


def encode_tokens(df: DataFrame, key: str, column: str, vocab: DataFrame, max_len: int = TOKENS) -> DataFrame:
    """(key, input_ids, attention_mask) of each row: BOS, known words or UNK, EOS; cut and padded to max_len.

    Only the first max_len - 2 words of a caption can be in its result, so no more are
    looked up. A vocabulary beyond the bounds of `looked_up` is joined by word instead,
    which takes one row of each key.
    """
    first = F.slice(F.coalesce(words(column), F.array().cast("array<string>")), 1, max_len - 2)
    if id_of := looked_up(vocab):
        grouped = df.select(key, F.transform(first, lambda w: F.coalesce(id_of(w), F.lit(UNK))).alias("ids"))
    else:
        grouped = _joined_ids(df.select(key, F.posexplode_outer(first).alias("pos", "word")), key, vocab)
    seq = F.concat(F.array(F.lit(BOS)), F.col("ids"), F.array(F.lit(EOS)))
    return grouped.select(key, arrays.fit_length(seq, max_len, PAD).alias("input_ids"), arrays.attention_mask(F.size("ids") + 2, max_len).alias("attention_mask"))


def _joined_ids(long: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """(key, ids) from (key, pos, word), by joins."""
    found = long.join(vocab.select("word", "id"), "word", "left")
    ids = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id")))))
    return found.groupBy(key).agg(ids.alias("ids")).select(key, F.transform("ids", lambda x: x["id"]).alias("ids"))


def encode_with(df: DataFrame, key: str, column: str, load: Callable[[], Callable], max_len: int = TOKENS) -> DataFrame:
    """As encode_tokens, with the caller's tokeniser; load() runs once in each task and returns a function from a list of texts to a list of id lists. A null caption is an empty one."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        tokenize = load()
        for batch in batches:
            got = tokenize([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(x)[:max_len] for x in got], pa.list_(pa.int32()))], [key, "ids"])

    ids = df.select(key, column).mapInArrow(run, f"{key} {kind}, ids array<int>")
    return ids.select(key, arrays.fit_length(F.col("ids"), max_len, PAD).alias("input_ids"), arrays.attention_mask(F.size("ids"), max_len).alias("attention_mask"))


def crop_plan(width: Column, height: Column, target: int = 512, variant: str = "integer") -> Column:
    """struct(new_w, new_h, left, top, resample): the short side becomes target, then a centre crop.

    Variant 'integer' scales the long side by long * target / short; 'factor' multiplies
    both sides by target / short in floating point, which can differ by a pixel.
    """
    short = F.least(width, height)
    if variant == "integer":
        scaled = lambda side: F.floor(side * target / short)
        new_w, new_h = (F.when(side == short, F.lit(target)).otherwise(scaled(side)).cast("long") for side in (width, height))
    elif variant == "factor":
        new_w, new_h = (F.floor(side * (F.lit(float(target)) / short)).cast("long") for side in (width, height))
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return F.struct(
        new_w.alias("new_w"), new_h.alias("new_h"), F.floor((new_w - target) / 2).cast("long").alias("left"), F.floor((new_h - target) / 2).cast("long").alias("top"),
        F.when(short > target, "down").otherwise("up").alias("resample"),
    )


def noise_schedule(spark: SparkSession, steps: int = 1000, kind: str = "scaled_linear", first: float = 0.00085, last: float = 0.012) -> DataFrame:
    """(t, beta, alpha_bar, sqrt_ab, sqrt_1m_ab, snr) for t in [0, steps): a small dimension table."""
    share = F.col("t") / F.lit(float(max(1, steps - 1)))
    if kind == "scaled_linear":
        beta = F.pow(math.sqrt(first) + share * (math.sqrt(last) - math.sqrt(first)), 2)
    elif kind == "linear":
        beta = first + share * (last - first)
    else:
        raise ValueError(f"unknown schedule {kind!r}")
    table = spark.range(steps).select(F.col("id").cast("int").alias("t")).withColumn("beta", beta)
    ab = F.exp(F.sum(F.log(1 - F.col("beta"))).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return table.withColumn("alpha_bar", ab).withColumn("sqrt_ab", F.sqrt("alpha_bar")).withColumn("sqrt_1m_ab", F.sqrt(1 - F.col("alpha_bar"))).withColumn("snr", F.col("alpha_bar") / (1 - F.col("alpha_bar")))


def draw_timestep(seed: int, key: Column, kind: str = "uniform", steps: int = 1000, mu: float = 0.0, sigma: float = 1.0) -> Column:
    """A uniform integer in [0, steps), or a logit-normal number clamped to [0.001, 0.999]."""
    if kind == "uniform":
        return F.floor(chance.uniform(f"{seed}t", key) * steps).cast("int")
    if kind == "logit_normal":
        z = mu + sigma * chance.normal(f"{seed}t", key)
        return F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(0.001)), F.lit(0.999))
    raise ValueError(f"unknown draw {kind!r}")


def noise(seed: int, key: Column, a: Column) -> Column:
    """A standard normal array as long as a, from seed, key and place."""
    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: chance.normal(seed, key, i))


def training_examples(df: DataFrame, key: str, x: str, schedule: DataFrame, seed: int, objective: str = "epsilon", eps: Column | None = None, steps: int = 1000) -> DataFrame:
    """df with t, x_t and target, for the objectives epsilon, velocity and flow. eps: given noise instead of drawn."""
    key_col = F.col(key)
    out = df.withColumn("eps", noise(seed, key_col, F.col(x)) if eps is None else eps)
    mix = lambda a, b, p, q: F.zip_with(a, b, lambda u, v: p * u.cast("double") + q * v)
    if objective == "flow":
        t = draw_timestep(seed, key_col, "logit_normal")
        out = out.withColumn("t", t)
        return out.withColumn("x_t", mix(F.col(x), F.col("eps"), 1 - F.col("t"), F.col("t"))).withColumn("target", mix(F.col(x), F.col("eps"), F.lit(-1.0), F.lit(1.0)))
    out = out.withColumn("t", draw_timestep(seed, key_col, steps=steps)).join(F.broadcast(schedule.select("t", "sqrt_ab", "sqrt_1m_ab")), "t")  # one row for each step
    out = out.withColumn("x_t", mix(F.col(x), F.col("eps"), F.col("sqrt_ab"), F.col("sqrt_1m_ab")))
    if objective == "epsilon":
        return out.withColumn("target", F.col("eps"))
    if objective == "velocity":
        return out.withColumn("target", mix(F.col(x), F.col("eps"), -F.col("sqrt_1m_ab"), F.col("sqrt_ab")))
    raise ValueError(f"unknown objective {objective!r}")


def snr_weight(snr: Column, gamma: float = 5.0) -> Column:
    """min(snr, gamma) / snr with both clamped at 1e-6; NaN counts as 1."""
    least = F.lit(1e-6)
    return F.nanvl(F.greatest(F.least(snr, F.lit(gamma)), least) / F.greatest(snr, least), F.lit(1.0))


def flow_snr_weight(t: Column, gamma: float = 5.0) -> Column:
    """The weight for snr = ((1 - t) / t)^2, clamped to [0, 1]."""
    snr = F.pow(F.try_divide(1 - t, t), 2)
    return F.least(F.greatest(snr_weight(snr, gamma), F.lit(0.0)), F.lit(1.0))


def caption_dropout(df: DataFrame, columns: list[str], p: float, seed: int, key: str, empty: str = "") -> DataFrame:
    """With probability p all the columns of a row become empty, together."""
    gone = chance.uniform(seed, F.col(key)) < p
    return df.withColumns({c: F.when(gone, F.lit(empty)).otherwise(F.col(c)) for c in columns})


def encode_batches(df: DataFrame, done: DataFrame, key: str, value: str, load: Callable[[], Callable], batch_size: int = 32) -> DataFrame:
    """(key, latent, failed) of the rows that are not done, encoded in batches.

    load() runs once in each Python worker and returns a function from a float matrix
    (batch x n) to a matrix. A batch that fails is tried row by row; a row that fails, or
    has no usable vector, is marked. value: arrays of one length.
    """
    work = pending(df.select(key, value), done.select(key), key)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode = load()

        def latents(column):
            """A result, or None, for each vector of a list column."""
            begin, end = (column.offsets.to_numpy()[k : k + len(column)] for k in (0, 1))
            values = column.values
            nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))]) if values.null_count else None
            good = column.is_valid().to_numpy(zero_copy_only=False) & (end > begin) & (True if nulls is None else nulls[end] == nulls[begin])
            flat = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            out: list = [None] * len(column)
            rows = [(i, flat[begin[i] : end[i]]) for i in np.flatnonzero(good)]
            try:
                for (i, _), v in zip(rows, encode(np.stack([v for _, v in rows])) if rows else (), strict=True):
                    out[i] = np.asarray(v, np.float32)
            except Exception:
                out = [None] * len(column)
                for i, v in rows:
                    with contextlib.suppress(Exception):
                        out[i] = np.asarray(encode(v[None])[0], np.float32)
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                got = latents(part.column(1))
                offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in got])]).astype(np.int32)
                missing = np.array([x is None for x in got])
                held = [x for x in got if x is not None]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held) if held else np.zeros(0, np.float32)), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(missing)], [key, "latent", "failed"])

    return work.mapInArrow(run, f"{key} {kind}, latent array<float>, failed boolean")


def block_mean_encoder(factor: int = 8) -> Callable[[], Callable]:
    """load() for encode_batches: block means of each row, scaled."""
    return lambda: lambda x: x[:, : x.shape[1] // factor * factor].reshape(len(x), -1, factor).mean(2) * SCALING


def collate_batches(df: DataFrame, key: str, order: list[str], tensors: dict[str, int], size: int, by: list[str] | None = None) -> DataFrame:
    """Training batches, one row each: (by.., batch, n, keys) and for each tensor its rows one after the other as one flat array, with <name>_shape = [n, length].

    tensors: array columns and the length each must have. A batch is `size` rows of the
    order, the last one of a group being shorter; of a batch, rows with a null tensor, one
    of another length or one with a null in it are left out, and a batch without any other
    row is none. A batch is a bounded number of rows, so a row of the result is as well.
    """
    by = by or []
    whole = reduce(lambda a, b: a & b, [F.coalesce((F.size(c) == n) & ~F.exists(c, lambda x: x.isNull()), F.lit(False)) for c, n in tensors.items()])
    placed = assign_batches(df.select(*dict.fromkeys([*by, key, *order, *tensors])), size, by, order)
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(key).alias("_key"), *(F.col(c).alias(f"_t{i}") for i, c in enumerate(tensors)))))
    held = placed.filter(whole).groupBy(*by, "batch").agg(rows.alias("_rows"))
    flat = {c: F.flatten(F.col("_rows").getField(f"_t{i}")).alias(c) for i, c in enumerate(tensors)}
    shapes = [F.array(F.size("_rows"), F.lit(n)).alias(f"{c}_shape") for c, n in tensors.items()]
    return held.select(*by, "batch", F.size("_rows").alias("n"), F.col("_rows").getField("_key").alias("keys"), *(x for pair in zip(flat.values(), shapes, strict=True) for x in pair))
