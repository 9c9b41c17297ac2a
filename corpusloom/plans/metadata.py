"""Queries of the metadata stage: filters, funnel, deduplication, caption rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BROAD, REFINED, FilterConfig
from ..functions import registered, text
from ..operators import dedup, filters, metrics
from .registry import ITEMS, META, items, meta, query, table

_PASSES = """"URL" is not null and "TEXT" is not null and aesthetic_score >= {a} and similarity >= {s} and "WIDTH" >= 512 and "HEIGHT" >= 512
  and "WIDTH" / cast("HEIGHT" as double) between 0.5 and 2.0 and length("TEXT") between 20 and 300 and pwatermark < {w} and "NSFW" in ('UNLIKELY', 'unlikely')"""
_BROAD, _REFINED = _PASSES.format(a=6.5, s=0.28, w=0.5), _PASSES.format(a=7.5, s=0.30, w=0.15)
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WORDS = f"len(list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> ''))"
#: Frequent words of the documents stand in for the deny lists.
_NAMES, _TERMS = ("token", "license", "idiot"), ("trash", "enenen")


@query(f"""with {META} select "URL", "TEXT", aesthetic_score, similarity from (
  select *, row_number() over (partition by "URL" order by row_id) as rn from meta where {_BROAD}) where rn = 1""")
def filtered_metadata(spark, sf_dir):
    """Read, filter, keep the first of each URL, project: the whole metadata stage."""
    return filters.select_output(dedup.dedup_keep_first(filters.quality_filter(meta(spark, sf_dir)), ["URL"], ["row_id"]))


@query(f"with {META} select row_id from meta where {_REFINED}")
def refined_metadata(spark, sf_dir):
    return filters.quality_filter(meta(spark, sf_dir), REFINED).select("row_id")


@query(f"""with {META}, m as (select *, case when not coalesce("URL" is not null and "TEXT" is not null, false) then 0 when not coalesce(aesthetic_score >= 6.5, false) then 1
  when not coalesce(similarity >= 0.28, false) then 2 when not coalesce("WIDTH" >= 512 and "HEIGHT" >= 512, false) then 3
  when not coalesce("WIDTH" / cast("HEIGHT" as double) between 0.5 and 2.0, false) then 4 when not coalesce(length("TEXT") between 20 and 300, false) then 5
  when not coalesce(pwatermark < 0.5, false) then 6 when not coalesce("NSFW" in ('UNLIKELY', 'unlikely'), false) then 7 else 8 end as failed from meta)
select cast(s.step + 1 as int) as step, s.filter, cast((select count(*) from m where failed = s.step) as bigint) as removed, cast((select count(*) from m where failed > s.step) as bigint) as survivors
from (select unnest(['null_drop', 'aesthetic', 'clip_sim', 'dimensions', 'aspect', 'caption_len', 'watermark', 'nsfw']) as filter, unnest(range(8)) as step) s
union all select 9, 'dedup', (select count(*) - count(distinct "URL") from m where failed = 8), (select count(distinct "URL") from m where failed = 8)""")
def filter_funnel(spark, sf_dir):
    return filters.filter_funnel(meta(spark, sf_dir))


def _filter(name, sql, cfg=BROAD):
    """One predicate of the filter by itself."""

    def run(spark, sf_dir):
        df = meta(spark, sf_dir)
        return df.filter(dict(filters.predicates(df, cfg))[name]).select("row_id")

    run.__name__ = f"filter_{name}"
    query(f"with {META} select row_id from meta where {sql}")(run)


_filter("null_drop", '"URL" is not null and "TEXT" is not null')
_filter("aesthetic", "aesthetic_score >= 6.5")
_filter("clip_sim", "similarity >= 0.28")
_filter("dimensions", '"WIDTH" >= 512 and "HEIGHT" >= 512')
_filter("aspect", '"WIDTH" / cast("HEIGHT" as double) between 0.5 and 2.0')
_filter("caption_len", 'length("TEXT") between 20 and 300')
_filter("watermark", "pwatermark < 0.5")
_filter("nsfw", "\"NSFW\" in ('UNLIKELY', 'unlikely')")


@query(f"with {META} select row_id from meta where pwatermark < 0.2")
def filter_nsfw_score(spark, sf_dir):
    """The numeric form of the safety column."""
    df = meta(spark, sf_dir).withColumn("NSFW", F.col("pwatermark"))
    return df.filter(dict(filters.predicates(df, FilterConfig()))["nsfw"]).select("row_id")


@query("""select doc_id as row_id, text as "TEXT", n_chars as "WIDTH", lang as "URL" from documents""")
def normalize_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("caption"), F.lit(None).cast("string").alias("text"), F.col("n_chars").alias("width"), F.col("lang").alias("url"))
    return filters.normalize_columns(docs).select("row_id", "TEXT", "WIDTH", "URL")


@query(f'with {META} select row_id, "URL" from (select *, row_number() over (partition by "URL" order by row_id) as rn from meta) where rn = 1')
def dedup_keep_first(spark, sf_dir):
    return dedup.dedup_keep_first(meta(spark, sf_dir), ["URL"], ["row_id"]).select("row_id", "URL")


@query(f'with {META} select row_id, "URL", source from (select *, row_number() over (partition by "URL", source order by row_id) as rn from meta) where rn = 1')
def dedup_per_file(spark, sf_dir):
    """Repeats across files survive: the source stands for the file."""
    return dedup.dedup_keep_first(meta(spark, sf_dir), ["URL"], ["row_id"], scope="file", file="source").select("row_id", "URL", "source")


@query(f"""with {META} select "URL", row_id, source from (select *, row_number() over (partition by "URL" order by case when row_id % 3 = 0 then 0 else 1 end, row_id) as rn from meta) where rn = 1""")
def merge_keep_existing(spark, sf_dir):
    m = meta(spark, sf_dir).select("URL", "row_id", "source")
    return dedup.merge_keep_existing(m.filter("row_id % 3 = 0"), m.filter("row_id % 3 <> 0"), "URL", ["row_id"])


@query(rf"""with recursive t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '{_SPACE}+'), lambda x: x <> '') as w from documents),
e as (select doc_id, len(s) as n, unnest(s) as h from (select doc_id, list_distinct(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) as s from t where len(w) > 0)),
links as materialized (select a.doc_id as a, b.doc_id as b from e a join e b on a.h = b.h and a.doc_id < b.doc_id and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*))),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as node, doc_id as root from documents union select x.b, r.root from reach r join ways x on x.a = r.node where r.root < x.b)
select d.doc_id, min(r.root) as component_id, coalesce((select count(*) from ways x where x.a = d.doc_id), 0) as n_links from documents d join reach r on r.node = d.doc_id group by d.doc_id""")
def near_dedup(spark, sf_dir):
    """Every document with its class: five-word shingles, Jaccard 0.8."""
    return dedup.near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query(rf"""with recursive t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '{_SPACE}+'), lambda x: x <> '') as w from documents),
sets as materialized (select doc_id, list_sort(list_distinct(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: cast(concat('0x', substr(md5(array_to_string(list_slice(w, i + 1, i + 5), ' ')), 1, 15)) as bigint)))) as s from t where len(w) > 0),
classes as materialized (select s, min(doc_id) as k from sets group by s),
e as (select k, len(s) as n, unnest(s) as h from classes),
links as materialized (select a.k as a, b.k as b from e a join e b on a.h = b.h and a.k < b.k and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n
  group by a.k, b.k, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*))),
ways as (select a, b from links union all select b, a from links),
reach as (select k as node, k as root from classes union select x.b, r.root from reach r join ways x on x.a = r.node where r.root < x.b),
roots as (select node, min(root) as root from reach group by node)
select d.doc_id, coalesce(r.root, d.doc_id) as component_id from documents d left join sets using (doc_id) left join classes c on c.s = sets.s left join roots r on r.node = c.k""")
def near_dedup_bands(spark, sf_dir):
    """Every document with its class: MinHash bands, then all that they leave apart, Jaccard 0.8."""
    return dedup.near_duplicate_bands(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query(rf"""with {META}, c as (select row_id, regexp_replace(lower("TEXT"), '^{_SPACE}+|{_SPACE}+$', '', 'g') as t from meta)
select row_id from c where length(t) >= 12 and {_WORDS} >= 3 and not regexp_matches(t, 'token|license|idiot') and not regexp_matches(t, 'trash|enenen')""")
def keep_caption(spark, sf_dir):
    return meta(spark, sf_dir).filter(filters.keep_caption(F.col("TEXT"), _NAMES, _TERMS)).select("row_id")


@query(rf"""with {META}, c as (select row_id, regexp_replace(lower("TEXT"), '^{_SPACE}+|{_SPACE}+$', '', 'g') as t from meta)
select count(*) as seen, count(*) filter (where keep) as kept, round(count(*) filter (where keep) * 100.0 / greatest(1, count(*)), 6) as keep_pct, count(distinct source) as n_files
from (select m.source, coalesce(length(t) >= 12 and {_WORDS} >= 3, false) as keep from c join meta m on c.row_id = m.row_id)""")
def keep_summary(spark, sf_dir):
    m = meta(spark, sf_dir)
    return metrics.keep_summary(m, filters.keep_caption(F.col("TEXT"), (), ()), "source").withColumn("keep_pct", F.round("keep_pct", 6))


@query(rf"""with {META} select row_id from meta where length(regexp_replace("TEXT", '^{_SPACE}+|{_SPACE}+$', '', 'g')) >= 10""")
def caption_present(spark, sf_dir):
    return meta(spark, sf_dir).filter(filters.caption_present(F.col("TEXT"))).select("row_id")


@query("""select count(*) as n, count(*) filter (where hit) as n_hit, round(count(*) filter (where hit) * 100.0 / greatest(1, count(*)), 6) as pct
from (select coalesce(regexp_matches(lower(text), 'portrait|face|woman|man|girl|boy|person|human|character|anime|figure|lady|guy'), false) as hit from documents)""")
def keyword_share(spark, sf_dir):
    return metrics.keyword_share(table(spark, sf_dir, "documents"), "text").withColumn("pct", F.round("pct", 6))


@query("select source, count(*) as n from documents group by rollup (source)")
def source_counts(spark, sf_dir):
    return metrics.source_counts(table(spark, sf_dir, "documents"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 100) as a from embeddings),
s as (select vec_id, list_aggregate(a, 'avg') as m, list_aggregate(a, 'stddev_pop') as sd from v)
select vec_id, case when sd < 12.4 then 'near_blank' when m < -2 then 'too_dark' when m > 2 then 'too_bright' else 'ok' end as status from s""")
def pixel_status(spark, sf_dir):
    """Thresholds fitted to embeddings, which stand in for pixels."""
    a = F.transform("embedding", lambda x: x.cast("double") * 100)
    return table(spark, sf_dir, "embeddings").select("vec_id", filters.pixel_status(a, min_std=12.4, dark=-2.0, bright=2.0).alias("status"))


@query("""select l_orderkey, l_linenumber from lineitem where l_quantity / nullif(l_orderkey % 60, 0) >= 0.55""")
def tall_person(spark, sf_dir):
    """One box per line: its quantity as height, in an image as high as the order's remainder."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.struct(F.col("l_quantity").alias("h"))).alias("boxes"), (F.col("l_orderkey") % 60).alias("height"))
    return df.filter(filters.tall_person(F.col("boxes"), F.col("height"))).select("l_orderkey", "l_linenumber")


@query("""with s as (select l_orderkey % 100 as shard, case when l_quantity < 3 then 'corrupt' when l_quantity < 6 then 'near_blank' else 'ok' end as status, l_linenumber = 7 as short from lineitem)
select shard, count(*) as total, count(*) filter (where status = 'ok' and not short) as valid, count(*) filter (where status = 'corrupt') as corrupt,
  count(*) filter (where status not in ('ok', 'corrupt')) as invalid, count(*) filter (where short) as no_caption from s group by shard""")
def shard_stats(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("shard", F.col("l_orderkey") % 100)
    status = F.when(F.col("l_quantity") < 3, "corrupt").when(F.col("l_quantity") < 6, "near_blank").otherwise("ok")
    return metrics.shard_stats(df, "shard", status, F.col("l_linenumber") == 7)


@query("""with t as (select conv_id, turn, regexp_replace(text, '(?i)^\\s+|\\s+$', '', 'g') as t from conversations)
select conv_id, turn, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) as n_words, substr(regexp_replace(substr(t, 1, 50), '[^\\p{L}\\p{N} _-]', '_', 'g'), 1, 50) as slug, concat(lpad(cast(turn as varchar), 3, '0'), '_', substr(regexp_replace(substr(t, 1, 50), '[^\\p{L}\\p{N} _-]', '_', 'g'), 1, 50)) as file from t where t is not null""".replace("\\\\", "\\"))
def prompt_slugs(spark, sf_dir):
    """Word counts and file names of prompts."""
    t = text.strip(F.col("text"))
    return table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", text.word_count(t).cast("long").alias("n_words"), text.slug(t).alias("slug"), text.slug(t, index=F.col("turn")).alias("file"))


@query("""select event_id, case when event_id % 3 = 0 then event_type else coalesce(json_extract_string(props, '$.k'), '') end as caption from events""")
def resolve_caption(spark, sf_dir):
    """The plain text, where there is one, else the JSON field, else nothing."""
    json = F.concat(F.lit('{"caption": "'), F.get_json_object("props", "$.k"), F.lit('"}'))
    txt = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_type", F.lit("\n")))
    return table(spark, sf_dir, "events").select("event_id", text.resolve_caption(txt, json).alias("caption"))


@query("""select doc_id, case when doc_id % 3 = 1 then lang when doc_id % 2 = 0 then source else cast(doc_id as varchar) end as prompt from documents where lang <> '' and source <> ''""")
def manifest_prompt(spark, sf_dir):
    """The manifest's short field, its long one, or the file's name."""
    docs, i = table(spark, sf_dir, "documents").filter("lang <> '' and source <> ''"), F.col("doc_id")
    p, prompt = F.when(i % 3 == 1, F.col("lang")).when(i % 3 == 2, F.lit("")), F.when(i % 2 == 0, F.col("source"))
    return docs.select("doc_id", text.manifest_prompt(p, prompt, i.cast("string")).alias("prompt"))


@query("""select doc_id, concat(replace(source, '/', '_'), '__', cast(doc_id as varchar), '.npy') as latent, source as shard, cast(doc_id as varchar) as base,
  cast(concat('0x', substr(md5(concat('4:', cast(doc_id as varchar))), 1, 8)) as bigint) / 4294967296.0 as u from documents where not contains(source, '::')""")
def sql_functions(spark, sf_dir):
    """The registered functions, called from SQL."""
    registered.register(spark)
    table(spark, sf_dir, "documents").filter("not contains(source, '::')").selectExpr("doc_id", "concat(source, '::', doc_id) as k").createOrReplaceTempView("_keys_of_documents")
    return spark.sql("select doc_id, latent_name(k) as latent, key_shard(k) as shard, key_base(k) as base, hash_uniform('4', cast(doc_id as string)) as u from _keys_of_documents")


@query("select lang as source, doc_id, 'a photo' as caption from documents")
def template_caption(spark, sf_dir):
    """One fixed caption and a provenance column for a whole source."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), "doc_id", F.lit("a photo").alias("caption"))


@query(f"with {ITEMS} select l_orderkey % 1000 as shard, count(*) as n_items, md5(string_agg(image_key, ',' order by l_linenumber, image_key)) as outputs from items group by 1")
def group_by_shard(spark, sf_dir):
    """Every shard's whole list, as a digest."""
    df = items(spark, sf_dir).select((F.col("l_orderkey") % 1000).alias("shard"), F.col("l_linenumber").alias("base"), F.col("image_key").alias("output"))
    return metrics.group_by_shard(df, "shard", "base", "output").select("shard", F.size("items").cast("long").alias("n_items"), F.md5(F.array_join(F.transform("items", lambda x: x["output"]), ",")).alias("outputs"))


@query("""select count(*) filter (where l_returnflag = 'A') as encoded, count(*) filter (where l_returnflag = 'R') as failed, count(*) filter (where l_returnflag = 'N') as skipped, cast(count(*) * 32768 as bigint) as expected_bytes from lineitem where l_returnflag in ('A', 'R', 'N')""")
def encode_summary(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for x in ("A", "encoded", "R", "failed", "N", "skipped")))
    return metrics.encode_summary(table(spark, sf_dir, "lineitem").select(names[F.col("l_returnflag")].alias("status")))


@query("""select doc_id, lang, source from documents where source is not null and lang is not null and length(text) % 7 in (1, 4) and list_contains(['en', 'fr'], lang)""")
def filter_with(spark, sf_dir):
    """A predicate of the caller's over two columns, with a table that it loads."""
    docs = table(spark, sf_dir, "documents").filter("source is not null and lang is not null").withColumn("n", F.length("text"))

    def load():
        wanted, rests = {"en", "fr"}, {1, 4}
        return lambda lang, n: [None if b is None else a in wanted and b % 7 in rests for a, b in zip(lang.to_pylist(), n.to_pylist(), strict=True)]

    return filters.filter_with(docs, ["lang", "n"], load).select("doc_id", "lang", "source")


@query("""select row_id from (select doc_id as row_id, text as "TEXT", 'u' as "URL", n_chars from documents) where "TEXT" is not null and length("TEXT") between 20 and 300
union all select doc_id from documents where false""")
def required_columns(spark, sf_dir):
    """Two tables, one without captions: the one that lacks a required column gives nothing, the other its rows that pass."""
    docs = table(spark, sf_dir, "documents")
    whole = filters.quality_filter(filters.normalize_columns(docs.select(F.col("doc_id").alias("row_id"), F.lit("u").alias("url"), F.col("text").alias("caption"))))
    lacking = filters.quality_filter(filters.normalize_columns(docs.select(F.col("doc_id").alias("row_id"), F.lit("u").alias("url"))))
    return whole.select("row_id").unionByName(lacking.select("row_id"))
