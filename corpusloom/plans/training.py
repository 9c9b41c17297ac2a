"""Queries of metrics, tokens, schedules, training examples and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, chance
from ..operators import features, metrics
from .registry import meta, query, table

_U = "cast(concat('0x', substr(md5(concat('{seed}:', cast({key} as varchar))), 1, 8)) as bigint) / 4294967296.0"


@query("""select user_id, event_id, step, round(m, 6) as running_mean from (select user_id, event_id, cast(row_number() over w as int) as step,
  avg(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as m from events window w as (partition by user_id order by ts, event_id)) where step % 10 = 0""")
def running_mean(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return metrics.running_mean(df, "value", ["ts", "event_id"], ["user_id"], 10).select("user_id", "event_id", "step", F.round("running_mean", 6).alias("running_mean"))


@query("""with e as (select event_type, date_trunc('day', ts) as epoch, avg(value) as m from events group by all),
b as (select *, min(m) over (partition by event_type order by epoch rows between unbounded preceding and 1 preceding) as before from e)
select event_type, epoch, round(m, 6) as epoch_mean, round(least(m, before), 6) as best, before is null or m < before as new_best from b""")
def running_best(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_type", F.date_trunc("day", "ts").alias("epoch"), "value")
    best = metrics.running_best(df, "value", "epoch", ["event_type"])
    return best.select("event_type", F.col("epoch").cast("timestamp_ntz").alias("epoch"), F.round("epoch_mean", 6).alias("epoch_mean"), F.round("best", 6).alias("best"), "new_best")


@query("""with recursive s as (select user_id, value as v, row_number() over (partition by user_id order by ts, event_id) as rn from events where value is not null),
f as (select user_id, rn, v as e from s where rn = 1 union all
  select s.user_id, s.rn, f.e * least(0.99, s.rn / (9.0 + s.rn)) + s.v * (1 - least(0.99, s.rn / (9.0 + s.rn))) from f join s on s.user_id = f.user_id and s.rn = f.rn + 1)
select user_id, round(max_by(e, rn), 6) as ema, count(*) as n from f group by user_id""")
def ema(spark, sf_dir):
    return metrics.ema(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], ["user_id"], 0.99).withColumn("ema", F.round("ema", 6))


@query("""with m as (select event_type, ts, (row_number() over (partition by event_type order by ts, event_id) - 1) // 100 as chunk from events),
c as (select event_type, cast(chunk as bigint) as chunk, count(*) as items, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds from m group by all)
select event_type, chunk, items, round(seconds, 6) as seconds, round(items / nullif(seconds, 0), 9) as rate from c""")
def throughput(spark, sf_dir):
    out = metrics.throughput(table(spark, sf_dir, "events"), "ts", ["ts", "event_id"], ["event_type"], 100)
    return out.select("event_type", "chunk", "items", F.round("seconds", 6).alias("seconds"), F.round("rate", 9).alias("rate"))


@query("""select a.label, round(avg(list_sum(list_transform(range(1, 65), lambda i: pow(cast(a.embedding[i] as double) - cast(b.embedding[i] as double), 2))) / 64 * 0.5), 6) as loss, count(*) as n
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 group by a.label""")
def batch_loss(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", "label", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").withColumn("w", F.lit(0.5))
    return metrics.batch_loss(pairs, "a", "b", "w", ["label"]).withColumn("loss", F.round("loss", 6))


@query("""select cast(count(*) as bigint) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from (select cast(unnest(embedding) as double) as x from embeddings)""")
def latent_stats(spark, sf_dir):
    out = metrics.latent_stats(table(spark, sf_dir, "embeddings"), "embedding")
    return out.select(F.col("n").cast("long").alias("n"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("select vec_id, round(list_aggregate(list_transform(embedding, lambda x: cast(x as double)), 'stddev_pop'), 6) as std, cast(len(embedding) * 32768 as bigint) as bytes from embeddings")
def tensor_moments(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.std(F.col("embedding")), 6).alias("std"), arrays.tensor_bytes(F.size("embedding")).alias("bytes"))


_VOCAB = r"""w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as w from documents),
vocab as (select word, n, cast(row_number() over (order by n desc, word) + 3 as int) as id from (select word, count(*) as n from (select unnest(w) as word from w) group by word) order by n desc, word limit 2000)"""


@query(f"with {_VOCAB} select word, n, id from vocab")
def build_vocab(spark, sf_dir):
    return features.build_vocab(table(spark, sf_dir, "documents"), "text", 2000)


@query(rf"""with {_VOCAB}, p as (select doc_id, unnest(list_slice(w, 1, 75)) as word, unnest(range(1, least(len(w), 75) + 1)) as pos from w),
g as (select p.doc_id, list(coalesce(v.id, 3) order by p.pos) as ids from p left join vocab v on p.word = v.word group by p.doc_id),
s as (select w.doc_id, coalesce(g.ids, []::int[]) as ids from w left join g on w.doc_id = g.doc_id)
select doc_id, array_to_string(list_resize(list_concat([1], ids, [2]), 77, 0), ',') as input_ids, least(len(ids) + 2, 77) as n_mask from s""")
def encode_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = features.encode_tokens(docs, "doc_id", "text", features.build_vocab(docs, "text", 2000))
    return out.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("n_mask"))


_SCHEDULE = """schedule as (select t, beta, exp(sum(ln(1 - beta)) over (order by t)) as ab from (select t, pow(sqrt(0.00085) + t / 999.0 * (sqrt(0.012) - sqrt(0.00085)), 2) as beta from (select unnest(range(1000)) as t)))"""
_T = "cast(floor(" + _U.format(seed="3t", key="event_id") + " * 1000) as int)"


@query(f"""with {_SCHEDULE} select event_id, cast(s.t as int) as t, round(s.ab, 8) as alpha_bar, round(s.ab / (1 - s.ab), 6) as snr,
  round(greatest(least(s.ab / (1 - s.ab), 5.0), 1e-6) / greatest(s.ab / (1 - s.ab), 1e-6), 8) as weight from events e join schedule s on s.t = {_T}""")
def timestep_weights(spark, sf_dir):
    """A timestep for every event, with its schedule row and loss weight."""
    drawn = table(spark, sf_dir, "events").select("event_id", features.draw_timestep(3, F.col("event_id")).alias("t"))
    out = drawn.join(F.broadcast(features.noise_schedule(spark)), "t")
    return out.select("event_id", "t", F.round("alpha_bar", 8).alias("alpha_bar"), F.round("snr", 6).alias("snr"), F.round(features.snr_weight(F.col("snr")), 8).alias("weight"))


@query("""with u as (select event_id, 0.001 + (event_id % 999) / 1000.0 as t from events)
select event_id, round(least(greatest(greatest(least(pow((1 - t) / t, 2), 5.0), 1e-6) / greatest(pow((1 - t) / t, 2), 1e-6), 0), 1), 8) as weight from u""")
def flow_weights(spark, sf_dir):
    t = 0.001 + (F.col("event_id") % 999) / 1000.0
    return table(spark, sf_dir, "events").select("event_id", F.round(features.flow_snr_weight(t), 8).alias("weight"))


def _examples(objective, target, x_t):
    """Given noise (the next vector), so that SQL can follow."""

    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings")
        pairs = e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("given")), "vec_id")
        out = features.training_examples(pairs, "vec_id", "embedding", features.noise_schedule(spark), 3, objective, eps=F.col("given"))
        placed = lambda c: F.round(arrays.total(F.transform(c, lambda x, i: x * (i + 1))), 5)
        return out.select("vec_id", "t", placed("x_t").alias("x_sum"), placed("target").alias("target_sum"))

    run.__name__ = f"examples_{objective}"
    t = "cast(floor(" + _U.format(seed="3t", key="a.vec_id") + " * 1000) as int)"
    query(f"""with {_SCHEDULE}, v as (select a.vec_id, cast(s.t as int) as t, sqrt(s.ab) as p, sqrt(1 - s.ab) as q, list_transform(a.embedding, lambda x: cast(x as double)) as x, list_transform(b.embedding, lambda x: cast(x as double)) as e
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 join schedule s on s.t = {t})
select vec_id, t, {_PLACED.format(x_t)} as x_sum, {_PLACED.format(target)} as target_sum from v""")(run)


#: A sum of an array's entries times their places.
_PLACED = "round(list_sum(list_transform(range(1, len(x) + 1), lambda i: i * ({0}))), 5)"

_examples("epsilon", "e[i]", "p * x[i] + q * e[i]")
_examples("velocity", "p * e[i] - q * x[i]", "p * x[i] + q * e[i]")


def _normal(seed, key):
    return f"sqrt(-2 * ln(1 - {_U.format(seed=seed + 'a', key=key)})) * cos(2 * pi() * {_U.format(seed=seed + 'b', key=key)})"


@query(f"""with v as (select vec_id, least(greatest(1 / (1 + exp(-{_normal("3t", "vec_id")})), 0.001), 0.999) as t, list_transform(embedding, lambda y: cast(y as double)) as x,
  list_transform(range(0, len(embedding)), lambda i: {_normal("3", "concat(cast(vec_id as varchar), ':', cast(i as varchar))")}) as e from embeddings)
select vec_id, round(t, 9) as t, {_PLACED.format("(1 - t) * x[i] + t * e[i]")} as x_sum, {_PLACED.format("e[i] - x[i]")} as target_sum from v""")
def examples_flow(spark, sf_dir):
    """Logit-normal times and drawn noise; arrays are compared by sums of their entries times their places."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = features.training_examples(e, "vec_id", "embedding", features.noise_schedule(spark), 3, "flow")
    placed = lambda c: F.round(arrays.total(F.transform(c, lambda x, i: x * (i + 1))), 5)
    return out.select("vec_id", F.round("t", 9).alias("t"), placed("x_t").alias("x_sum"), placed("target").alias("target_sum"))


@query(f"""select row_id, case when u < 0.1 then '' else caption end as caption, case when u < 0.1 then '' else lang end as lang
from (select doc_id as row_id, substr(text, 1, cast(10 + doc_id % 330 as int)) as caption, lang, {_U.format(seed='9', key='doc_id')} as u from documents)""")
def caption_dropout(spark, sf_dir):
    df = meta(spark, sf_dir).select("row_id", F.col("TEXT").alias("caption"), "lang")
    return features.caption_dropout(df, ["caption", "lang"], 0.1, 9, "row_id")


@query("""select l_orderkey, l_linenumber, array_to_string(list_resize(list_slice(range(1, cast(l_quantity as int) * 2 + 1), 1, 77), 77, 0), ',') as ids, least(cast(l_quantity as int) * 2, 77) as n_mask from lineitem""")
def fit_arrays(spark, sf_dir):
    """Arrays of any length cut and padded to 77, with their masks."""
    n = F.col("l_quantity").cast("int") * 2
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array_join(arrays.fit_length(F.sequence(F.lit(1), n)).cast("array<string>"), ",").alias("ids"),
        F.aggregate(arrays.attention_mask(n), F.lit(0), lambda s, x: s + x).alias("n_mask"),
    )


@query("""select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: cast(embedding[i] as double) * ((i - 1) // 8 + 1))) / 8 * 0.18215, 4) as placed, cast(8 as bigint) as n, false as failed from embeddings where vec_id % 5 <> 0""")
def encode_latents(spark, sf_dir):
    """Batched encoding of what is not done yet; latents are compared by the sum of their entries times their places."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = features.encode_batches(e, e.filter("vec_id % 5 = 0"), "vec_id", "embedding", features.block_mean_encoder())
    placed = arrays.total(F.transform("latent", lambda x, i: x.cast("double") * (i + 1)))
    return out.select("vec_id", F.round(placed, 4).alias("placed"), F.size("latent").cast("long").alias("n"), "failed")


@query("""select doc_id, array_to_string(list_resize(list_slice(list_transform(regexp_split_to_array(coalesce(text, ''), ' '), lambda w: length(w) + 1), 1, 77), 77, 0), ',') as input_ids,
  cast(least(len(regexp_split_to_array(coalesce(text, ''), ' ')), 77) as bigint) as n_mask from documents""")
def encode_with(spark, sf_dir):
    """A tokeniser of the caller's: here each word's length, and one."""
    out = features.encode_with(table(spark, sf_dir, "documents"), "doc_id", "text", lambda: lambda texts: [[len(w) + 1 for w in t.split(" ")] for t in texts])
    return out.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("n_mask"))


@query(f"select event_id, round({_U.format(seed='11', key='event_id')}, 9) as u from events")
def hash_uniform(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(chance.uniform(11, F.col("event_id")), 9).alias("u"))


@query("""with p as (select vec_id, label, embedding, (row_number() over (partition by label order by vec_id) - 1) // 24 as batch from embeddings),
j as (select p.*, [len(coalesce(text, '')), doc_id] as ids from p join documents on doc_id = vec_id where vec_id % 11 <> 0 and embedding is not null)
select label, cast(batch as bigint) as batch, cast(count(*) as int) as n, array_to_string(list(vec_id order by vec_id), ',') as keys, array_to_string([count(*), 64], ',') as latent_shape,
  array_to_string(flatten(list(ids order by vec_id)), ',') as input_ids, array_to_string([count(*), 2], ',') as input_ids_shape,
  round(list_sum(list_transform(flatten(list(embedding order by vec_id)), lambda x, i: i * cast(x as double))), 3) as placed
from j group by label, batch""")
def collate_batches(spark, sf_dir):
    """Batches of 24 vectors of a label with two numbers of a document each; every eleventh latent is missing and left out of its batch."""
    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    tokens = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.length(F.coalesce("text", F.lit(""))).cast("long"), "doc_id").alias("input_ids"))
    rows = vectors.select("vec_id", "label", F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("latent")).join(tokens, "vec_id", "left")
    out = features.collate_batches(rows, "vec_id", ["vec_id"], {"latent": 64, "input_ids": 2}, 24, by=["label"])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    placed = arrays.total(F.transform("latent", lambda x, i: x.cast("double") * (i + 1)))
    return out.select("label", "batch", "n", text("keys"), text("latent_shape"), text("input_ids"), text("input_ids_shape"), F.round(placed, 3).alias("placed"))
