"""Callables of the user's: predicates over batches, collated batches, shards from SQL, encoders, dictionaries, members by parts of names."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from test_files import tar

from corpusloom.operators import features, filters, joins
from corpusloom.plans import catalogue
from corpusloom.sources import tars


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_see_their_columns_only(spark, tmp_path):
    """A mask of lists, numpy or Arrow; nulls drop; load runs once in a worker however many tasks it has."""
    df = spark.range(1000).withColumn("t", F.concat(F.lit("w"), "id")).withColumn("wide", F.repeat(F.lit("x"), 50)).repartition(12)
    log = tmp_path / "loads"

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        import pyarrow as pa

        return lambda t, i: pa.array([None if n % 5 == 0 else x.endswith("7") for x, n in zip(t.to_pylist(), i.to_pylist(), strict=True)])

    out = filters.filter_with(df, ["t", "id"], load)
    assert sorted(r.id for r in out.collect()) == [i for i in range(1000) if i % 10 == 7]
    assert out.columns == df.columns and "wide" not in plan(out.select("id")).split("ArrowEvalPython")[1].split("\n")[0]
    loads = log.read_text().split()
    assert len(loads) == len(set(loads))
    assert filters.filter_with(df, ["id"], lambda: lambda i: i.to_numpy() % 2 == 0).count() == 500
    assert filters.filter_with(df.limit(0), ["id"], lambda: lambda i: [True] * len(i)).count() == 0
    with pytest.raises(Exception, match="a mask of 1"):
        filters.filter_with(df, ["id"], lambda: lambda i: [True]).count()


def test_collated_batches(spark):
    rows = [(i % 2, i, None if i == 4 else [float(i), None] if i == 6 else [float(i)] if i == 8 else [float(i), -float(i)], [i, i + 1, i + 2]) for i in range(14)]
    df = spark.createDataFrame(rows, "g int, k int, latent array<float>, ids array<int>")
    got = {(r.g, r.batch): r for r in features.collate_batches(df, "k", ["k"], {"latent": 2, "ids": 3}, 3, ["g"]).collect()}
    assert set(got) == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)}
    assert (got[0, 0].keys, got[0, 0].latent, got[0, 0].latent_shape, got[0, 0].ids_shape) == ([0, 2], [0.0, 0.0, 2.0, -2.0], [2, 2], [2, 3])
    assert got[0, 1].keys == [10] and got[0, 1].ids == [10, 11, 12] and got[1, 2].keys == [13] and got[1, 0].n == 3
    alone = features.collate_batches(df.filter("k = 4"), "k", ["k"], {"latent": 2}, 3)
    assert alone.count() == 0 and alone.columns == ["batch", "n", "keys", "latent", "latent_shape"]


def test_shards_from_sql(spark, tmp_path):
    tar(tmp_path / "a.tar", [("x.jpg", b"J"), ("x.txt", b"cap\xff"), ("y.jpeg", b"K"), ("y.json", json.dumps({"caption": "c"}).encode())])
    tar(tmp_path / "b.tar", [("z.jpg", b"Z" * 2000), ("w.jpg", b"W" * 2000)], cut=3000)
    tars.register_shard_function(spark)
    spark.createDataFrame([(str(tmp_path / "a.tar"),), (str(tmp_path / "b.tar"),), (None,), (str(tmp_path / "none.tar"),)], "path string").createOrReplaceTempView("some_tars")
    rows = spark.sql("select s.* from some_tars t, lateral read_shard(t.path) s").collect()
    good = {r.base: (r.exts, bytes(r.image), r.txt, r.json) for r in rows if r.status == "ok"}
    assert good == {"x": (["jpg", "txt"], b"J", "cap", None), "y": (["jpeg", "json"], b"K", None, '{"caption": "c"}'), "z": (["jpg"], b"Z" * 2000, None, None)}
    assert sorted(r.status for r in rows if r.status != "ok") == ["corrupt: FileNotFoundError", "corrupt: ReadError"]


def test_encoding_of_matrices(spark):
    """Rows of other lengths, nulls inside, failures of a batch and of a row; the result's floats are the encoder's."""
    rows = [(i, [float(i)] * 4) for i in range(70)] + [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0] * 6), (104, [13.0] * 4)]

    def load():
        def encode(x):
            if (x == 13).any():
                raise ValueError("unlucky")
            return x[:, :2] * 2 + 1

        return encode

    got = {r.k: r for r in features.encode_batches(spark.createDataFrame(rows, "k int, v array<float>"), spark.createDataFrame([(5,)], "k int"), "k", "v", load, batch_size=16).collect()}
    assert set(got) == {k for k, _ in rows} - {5}
    failed = {k for k, r in got.items() if r.failed}
    assert failed == {13, 100, 101, 102, 104} and all((r.latent is None) == r.failed for r in got.values())
    assert got[103].latent == [3.0, 3.0] and all(got[k].latent == [2.0 * k + 1] * 2 for k in range(70) if k not in (5, 13))


def test_tokens_by_dictionary_and_by_join(spark, monkeypatch):
    draw = random.Random(5)
    letters = ["é", "日本", 'q"uote', "back\\slash", "tab", "a", "b", "c'"]
    texts = [(i, " ".join(draw.choice(letters) for _ in range(draw.randrange(90)))) for i in range(200)] + [(500, None), (501, ""), (502, " A  É ")]
    df = spark.createDataFrame(texts, "k long, t string")
    vocab = features.build_vocab(df, "t", 6)
    one = features.encode_tokens(df, "k", "t", vocab)
    assert "Exchange" not in plan(one) and "Join" not in plan(one)
    with monkeypatch.context() as m:
        m.setattr(features, "DICTIONARY_WORDS", 3)
        two = features.encode_tokens(df, "k", "t", vocab)
        assert "Join" in plan(two)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    ids = {r.word: r.id for r in vocab.collect()}
    want = [1, *(ids.get(w, 3) for w in texts[7][1].lower().split()[:75]), 2]
    assert one.filter("k = 7").first().input_ids == (want + [0] * 77)[:77]


def test_members_by_parts_of_names(spark):
    """Against a look at every name: bases of every length, two shards, a shard without members, ties by position."""
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abcé") for _ in range(n))
    members = [("s" if i % 3 else "t", f"{word(3)}/{word(4)}_{i}.jpg", i) for i in range(300)]
    items = [(draw.choice("stu"), word(draw.randrange(5))) for _ in range(400)] + [("s", None), ("s", "zzz"), ("t", "_29"), ("t", members[0][1])]
    got = joins.resolve_member(spark.createDataFrame(items, "shard string, base string"), spark.createDataFrame(members, "shard string, name string, pos int"), "shard", "base", "name", "pos")
    found = {(r.shard, r.base): r.member for r in got.collect()}
    for shard, base in items:
        own = [name for s, name, _ in members if s == shard and base is not None]
        exact = [n for n in own if n == base or n.rpartition("/")[2].rpartition(".")[0] == base]
        inside = [n for n in own if base in n]
        assert found[shard, base] == (exact or inside or [None])[0], (shard, base)
    assert got.count() == len(items)


def test_the_index_joins_by_runs(spark):
    items, members = spark.createDataFrame([("s", "abcd")], "shard string, base string"), spark.createDataFrame([("s", "xabcdx", 1)], "shard string, name string, pos int")
    text = plan(joins.resolve_member(items, members, "shard", "base", "name", "pos"))
    assert "NestedLoop" not in text and "Cartesian" not in text
    keys = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)[^\[]*\[([^\]]*)\]", text)
    assert keys and all("," in k for k in keys)  # never by the shard alone

def test_exploded_sides_are_not_broadcast(spark):
    """Tables that a file's size makes look small are merged where names are cut into runs; a repeated name is indexed once."""
    items = spark.range(100).selectExpr("'s' as shard", "concat('b', id, 'x') as base")
    members = spark.range(200).selectExpr("'s' as shard", "concat('ab', id % 50, 'xy.jpg') as name", "id as pos")
    got = joins.resolve_member(items, members, "shard", "base", "name", "pos")
    text = plan(got)
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    assert {r.base: r.member for r in got.collect()} == {f"b{i}x": f"ab{i}xy.jpg" if i < 50 else None for i in range(100)}


def test_made_keys_of_many_digits(spark, tmp_path):
    """Numbers of more than six digits, against the query's SQL."""
    import duckdb

    rows = [(n, f"name {n}.png", "Brand#1", 7) for n in (0, 7, 999_999, 1_000_000, 1_199_999, 12_345_678)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = duck.execute(catalogue.ORACLES["made_keys"])
    names = [c[0] for c in want.description]
    got = catalogue.QUERIES["made_keys"](spark, str(tmp_path)).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_collisions_are_counted_in_tasks_of_a_size(spark, monkeypatch):
    """The tasks that count grow in number with the rows; one shuffle by name, and one of what often repeated keys leave."""
    monkeypatch.setattr(joins, "KEYS_A_TASK", 1000)
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("a/"), "id")).when(F.col("id") % 3 == 1, F.concat(F.lit("a_"), F.col("id") - 1)).when(F.col("id") % 2 == 0, "hot/key").alias("image_key"))
    got = joins.name_collisions(rows)
    assert plan(got).count("Exchange") == 1 and got.rdd.getNumPartitions() == 6
    monkeypatch.setattr(joins, "LOOKS", 2)
    often = joins.name_collisions(rows)
    assert plan(often).count("Exchange") > 1 and "Union" in plan(often)
    for found in (got, often):
        assert {(r.latent_name, r.n_keys) for r in found.collect()} == {(f"a_{i}.npy", 2) for i in range(0, 6000, 3)}
    assert joins.name_collisions(rows.limit(0)).count() == 0
