"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, bpe, decontaminate, extract, forest, langid, negatives, pieces, quality, reputation, simhash, substring, toxicity, whitening


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = base.held_out("doc_id", 5, 0)
    scored, _ = quality.classify(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"), ~out, 0.3)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = base.held_out("doc_id", 3, 1)
    return langid.identify(base.table(spark, sf_dir, "documents"), ~out).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(base.table(spark, sf_dir, "documents"), bits=4, shingle=4, seed=42)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id", "n_links")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(base.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = base.held_out("doc_id", 3, 1)
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, base.table(spark, sf_dir, "labels"), ~out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(base.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"), size=13, share=20).drop("spans")


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(base.table(spark, sf_dir, "pages"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.deduplicate(docs, min_words=50, line_words=25).select("doc_id", "text", "removed", F.size("removed").alias("n_removed"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = base.table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, window=(30, 90))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(base.table(spark, sf_dir, "embeddings"), count=4)


#: Host, path and verdict of the query's rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document whose number ends its path."""
    pages, labels = base.table(spark, sf_dir, "pages").select("page_id", "url"), base.table(spark, sf_dir, "labels")
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)(?:[.]html|/)?(?:[?#].*)?$', 1) as bigint)")
    counted = pages.select(reputation.host(F.col("url")).alias("host"), number.alias("doc_id")).filter("doc_id is not null").groupBy("host", "doc_id").agg(F.count("*").alias("pages"))
    quality_of = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    outcomes = counted.join(quality_of, "doc_id").groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.when(F.col("quality") == 1, F.col("pages")).otherwise(0)).alias("good"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return reputation.judge(pages, rules, outcomes).select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bound"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_langid, op3_simhash, op4_bpe, op5_toxicity, op6_forest, op7_decontaminate, op8_extract, op9_tokens, op10_substring, op11_negatives, op12_whitening, op13_urls)
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op7_decontaminate": r"""
with item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null),
windows as (
  select distinct item_id, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') as win, least(13, len(w)) as n
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as k from item_words where len(w) > 0)),
sizes as (select distinct n from windows),
docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
places as (
  select doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') as win
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as k from docs, sizes where len(w) >= n)),
met as (select p.doc_id, p.n, p.k, x.item_id from places p join windows x on p.win = x.win and p.n = x.n),
hits as (select doc_id, count(distinct h) as n_hit from (select doc_id, unnest(generate_series(k, k + n - 1)) as h from met) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from met group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit, cast(coalesce(i.n_items, 0) as bigint) as n_items,
  sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated
from docs d left join hits h on d.doc_id = h.doc_id left join items i on d.doc_id = i.doc_id
""",
    "op11_negatives": """
with kept as (
  select vec_id, cast(label as bigint) as label, embedding, max(len(embedding)) over () as d from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from kept where len(embedding) = d),
scores as (
  select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as same, list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) as score
  from rows a join rows c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as integer) as rank,
  other_id as negative_id, cast(positive_score as bigint) as positive_score, cast(score as bigint) as negative_score
from positives join scores using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 10
""",
    "op13_urls": f"""
with rests as (select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{reputation.UPPER}', '{reputation.LOWER}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
    try_cast(regexp_extract(url, '/([0-9]+)(?:[.]html|/)?(?:[?#].*)?$', 1) as bigint) as doc_id
  from rests),
outcomes as (
  select host, count(*) as n, count(*) filter (where quality = 1) as good
  from parts join (select doc_id, min(quality) as quality from labels where quality is not null group by doc_id) using (doc_id) group by host),
hosts as (
  select host, coalesce(n, 0) as n, coalesce(good, 0) as good, regexp_replace(host, ':[0-9]*$', '') as name
  from (select distinct host from parts) left join outcomes using (host)),
named as (
  select *, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') as two, array_to_string(list_slice(string_split(name, '.'), -3, -1), '.') as three, string_split(name, '.')[-1] as last_label,
    regexp_matches(name, '^[0-9.]*$') as digits
  from hosts),
placed as (
  select host, n, good, case when digits then name when two in {reputation.SUFFIXES} then three else two end as domain, case when digits then name when two in {reputation.SUFFIXES} then two else last_label end as suffix
  from named),
whole as (select (coalesce(sum(good), 0) + 1.0::double) / (coalesce(sum(n), 0) + 2) as mean from placed),
suffix_counts as (select suffix, sum(n) as n, sum(good) as good from placed group by suffix),
domain_counts as (select domain, suffix, sum(n) as n, sum(good) as good from placed group by domain, suffix),
levels as (
  select 'suffix' as level, '' as above, n, good from suffix_counts union all select 'domain', suffix, n, good from domain_counts union all select 'host', domain, n, good from placed),
sums as (
  select level, above, count(*) as k, sum(n)::double as total, sum(good)::double as hits, sum(good::double * good / n) as share, sum(n::double * n) as squares from levels where n > 0 group by level, above),
squares as (
  select level, sum(k - 1) as between_df, sum(total - k) as within_df, sum(total - squares / total) as sizes, sum(share - hits * hits / total) as apart, sum(hits - share) as inside from sums group by level),
means as (select level, between_df > 0 and within_df > 0 and apart + inside > 0 as known, apart / nullif(between_df, 0) as b, inside / nullif(within_df, 0) as w, sizes / nullif(between_df, 0) as size from squares),
strengths as (
  select l.level, case when known and b > w then least(greatest((b + (size - 1) * w) / (b - w) - 1, {reputation.WEAKEST}), {reputation.STRONGEST}) when known then {reputation.STRONGEST} else {reputation.UNKNOWN} end::double as k
  from (values ('suffix'), ('domain'), ('host')) l(level) left join means using (level)),
suffixes as (select suffix, (mean * k + good) / (k + n) as prior from suffix_counts, whole, strengths where level = 'suffix'),
domains as (select domain, (prior * k + good) / (k + n) as prior from domain_counts join suffixes using (suffix), strengths where level = 'domain'),
posteriors as (select host, prior * k + good as a, (1 - prior) * k + n - good as b from placed join domains using (domain), strengths where level = 'host'),
bounds as (select host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as bound from posteriors),
rules(of, start, decision) as (values {", ".join(str(r) for r in URL_RULES)}),
ruled as (
  select distinct host, path, first(of || start order by length(of || start) desc) as rule, first(decision order by length(of || start) desc) as decision
  from (select distinct host, path from parts) p join rules r on (host = of or ends_with(host, '.' || of)) and starts_with(path, start) group by host, path)
select page_id, host, path, rule, coalesce(decision, case when bound >= 0.8 then 'allow' else 'block' end) as verdict, round(bound, 6) as bound
from parts join bounds using (host) left join ruled using (host, path)
""",
}
