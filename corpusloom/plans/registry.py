"""Registration of queries with their SQL, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The metadata view over documents and labels, in SQL.
META = """meta as (
  select d.doc_id as row_id, concat('http://img.example/', md5(substr(d.text, 1, 40)), '.jpg') as "URL",
    substr(d.text, 1, cast(10 + d.doc_id % 330 as int)) as "TEXT",
    cast(256 + (d.doc_id * 37) % 1280 as int) as "WIDTH", cast(256 + (d.doc_id * 53) % 1280 as int) as "HEIGHT",
    (40 + d.doc_id * 7 % 50) / 1e1 as aesthetic_score, (20 + d.doc_id * 11 % 30) / 1e2 as similarity, (d.doc_id * 13 % 100) / 1e2 as pwatermark,
    case when l.toxic = 1 then 'LIKELY' when l.toxic = 0 then 'UNLIKELY' end as "NSFW", d.lang, d.source
  from documents d left join labels l on d.doc_id = l.doc_id)"""


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata view: captions, sizes and scores of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    i = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        i.alias("row_id"), F.concat(F.lit("http://img.example/"), F.md5(F.substring("text", 1, 40)), F.lit(".jpg")).alias("URL"), F.expr("substr(text, 1, cast(10 + doc_id % 330 as int))").alias("TEXT"),
        (256 + i * 37 % 1280).cast("int").alias("WIDTH"), (256 + i * 53 % 1280).cast("int").alias("HEIGHT"),
        ((40 + i * 7 % 50) / 10.0).alias("aesthetic_score"), ((20 + i * 11 % 30) / 100.0).alias("similarity"), (i * 13 % 100 / 100.0).alias("pwatermark"),
        F.when(F.col("toxic") == 1, "LIKELY").when(F.col("toxic") == 0, "UNLIKELY").alias("NSFW"), "lang", "source",
    )


#: Work items over lineitem: a shard is an order, a member one of its lines.
ITEMS = """items as (
  select l_orderkey, l_linenumber, concat('part-', lpad(cast(l_orderkey % 100 as varchar), 6, '0'), '.tar::', cast(l_orderkey as varchar), '/', cast(l_linenumber as varchar)) as image_key,
    l_quantity, l_extendedprice
  from lineitem)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.format_string("part-%06d.tar::%d/%d", F.col("l_orderkey") % 100, "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("image_key"), "l_quantity", "l_extendedprice")
