"""Hand-made rows for the traps of each rule, and invariants that SQL does not show."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.config import BROAD, FilterConfig
from corpusloom.functions import arrays, chance, keys, text
from corpusloom.operators import dedup, features, filters, joins, metrics, sampling

NAN = float("nan")
META = "URL string, TEXT string, WIDTH int, HEIGHT int, similarity double, aesthetic_score double, pwatermark double, NSFW string"
GOOD = ("u", "a caption of twenty c", 512, 512, 0.28, 6.5, 0.49, "UNLIKELY")


def changed(**new):
    return tuple(new.get(c.split()[0], v) for c, v in zip(META.split(", "), GOOD, strict=True))


def test_thresholds_and_traps(spark):
    bad = [
        changed(URL=None), changed(TEXT=None), changed(aesthetic_score=None), changed(aesthetic_score=NAN), changed(aesthetic_score=6.49), changed(similarity=NAN), changed(similarity=0.279),
        changed(WIDTH=511), changed(HEIGHT=0), changed(WIDTH=1025), changed(TEXT="x" * 19), changed(TEXT="x" * 301), changed(pwatermark=0.5), changed(pwatermark=NAN), changed(NSFW="Unlikely"), changed(NSFW=None),
    ]
    good = [GOOD, changed(WIDTH=1024), changed(TEXT="é" * 20), changed(TEXT="👍" * 300), changed(NSFW="unlikely")]
    df = spark.createDataFrame(bad + good, META)
    assert filters.quality_filter(df).count() == len(good)
    funnel = filters.filter_funnel(df).orderBy("step").collect()
    assert sum(r.removed for r in funnel) == len(bad) + 4 and [r.survivors for r in funnel[-2:]] == [len(good), 1]  # all good rows share one URL
    assert {r["filter"]: r.removed for r in funnel} == {"null_drop": 2, "aesthetic": 3, "clip_sim": 2, "dimensions": 2, "aspect": 1, "caption_len": 2, "watermark": 2, "nsfw": 2, "dedup": 4}
    assert filters.quality_filter(df, FilterConfig(allow_nsfw=True)).count() == len(good) + 2


def test_columns_that_are_missing(spark):
    df = spark.createDataFrame([("u", "x" * 20)], "url string, caption string")
    out = filters.normalize_columns(df)
    assert out.columns == ["URL", "TEXT"] and filters.quality_filter(out).count() == 1
    assert filters.select_output(out).columns == ["URL", "TEXT", "aesthetic_score", "similarity"]
    assert filters.quality_filter(df.drop("caption")).count() == 0
    both = filters.normalize_columns(spark.createDataFrame([(None, "c"), ("t", "c")], "text string, caption string"))
    assert [r.TEXT for r in both.collect()] == ["c", "t"]


def test_numeric_safety(spark):
    df = spark.createDataFrame([("u", "x" * 20, 0.19), ("u", "x" * 20, 0.2), ("u", "x" * 20, None)], "URL string, TEXT string, NSFW double")
    assert filters.quality_filter(df, BROAD).count() == 1


def test_strip_words_and_captions(spark):
    odd = " 　 a\tb\n c  "
    row = spark.createDataFrame([(odd,)], "s string").select(text.strip(F.col("s")).alias("a"), text.word_count(F.col("s")).alias("b")).first()
    assert (row.a, row.b) == (odd.strip(), len(odd.split()))
    caps = [("three nice words", True), ("two wordsxxx.", False), ("elevenchars", False), ("the OBAMA family photo", False), ("an eroticism essay here", False), (None, False), ("   one two three   ", True)]
    got = spark.createDataFrame([(c,) for c, _ in caps], "c string").select(filters.keep_caption(F.col("c")).alias("k")).collect()
    assert [r.k for r in got] == [k for _, k in caps]
    rows = [(" t ", '{"caption":"j"}', "t"), (None, '{"caption":" j "}', "j"), (None, '{"caption":""}', ""), (None, '{"TEXT":"T"}', "T"), (None, None, ""), ("", '{"caption":"j"}', "")]
    got = spark.createDataFrame([r[:2] for r in rows], "t string, j string").select(text.resolve_caption(F.col("t"), F.col("j")).alias("c")).collect()
    assert [r.c for r in got] == [r[2] for r in rows]
    got = spark.createDataFrame([("", "q", "n"), (None, "", "n"), ("p", "q", "n")], "p string, q string, n string").select(text.manifest_prompt(F.col("p"), F.col("q"), F.col("n")).alias("c")).collect()
    assert [r.c for r in got] == ["q", "n", "p"]


def test_keys(spark):
    df = spark.createDataFrame([("a.tar::b",), ("a::b::c",), ("x/y",), ("none",)], "k string")
    shard, base = keys.split_key(F.col("k"))
    assert [tuple(r) for r in df.select(shard, base, keys.latent_name(F.col("k"))).collect()] == [("a.tar", "b", "a.tar__b.npy"), ("a", "b::c", "a__b__c.npy"), ("x/y", None, "x_y.npy"), ("none", None, "none.npy")]
    names = ["a/b.c/d.e.JPG", ".hidden", "noext", "a/.hidden", "dir.x/file", "tail."]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    base, ext = keys.base_ext(F.col("n"))
    from pathlib import PurePosixPath

    got = rows.select("n", keys.path_stem(F.col("n")).alias("stem"), base.alias("base"), ext.alias("ext")).collect()
    for r in got[:5]:
        assert r.stem == PurePosixPath(r.n).stem
    for r in got:
        assert (r.base, r.ext) == ((r.n.rsplit(".", 1)[0], r.n.rsplit(".", 1)[1].lower()) if "." in r.n else (r.n, r.n))
    assert [tuple(r) for r in joins.name_collisions(spark.createDataFrame([("a/b",), ("a_b",), ("c",), ("a/b",)], "image_key string")).collect()] == [("a_b.npy", 2)]


def test_pixels(spark):
    rows = [([NAN, 1.0], "nan_or_inf"), ([float("inf")], "nan_or_inf"), ([None, 1.0], "nan_or_inf"), ([7.0] * 4, "near_blank"), ([-9.0, 9.0], "too_dark"), ([248.0, 264.0], "too_bright"), ([0.0, 200.0], "ok")]
    got = spark.createDataFrame([(r[0],) for r in rows], "a array<double>").select(filters.pixel_status(F.col("a")).alias("s"), filters.pixel_status(F.col("a"), F.lit(255), F.lit(600)).alias("t")).collect()
    assert [r.s for r in got] == [r[1] for r in rows] and {r.t for r in got} == {"too_small_255x600"}


def test_arrays(spark):
    rows = spark.createDataFrame([(None,), ([],), ([5] * 3,), (list(range(90)),)], "a array<int>")
    got = rows.select(arrays.fit_length(F.col("a")).alias("f"), arrays.attention_mask(F.size("a")).alias("m"), arrays.attention_mask(F.lit(None).cast("int")).alias("n")).collect()
    assert all(len(r.f) == len(r.m) == 77 for r in got) and got[0].f == [0] * 77 and got[2].f[:4] == [5, 5, 5, 0] and got[3].f == list(range(77))
    assert sum(got[2].m) == 3 and sum(got[3].m) == 77 and sum(got[0].n) == 77


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 100])
def test_splits_are_disjoint_and_complete(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    for parts in (1, 7):
        out = sampling.train_val_split(df.repartition(parts), 5, 3, "k").collect()
        assert sorted(r.k for r in out) == list(range(n)) and sum(r.split == "val" for r in out) == min(5, n // 10)
    ranks = sampling.epoch_shards(df, 2, 4, 3, "k").groupBy("rank").count().collect()
    assert {r["count"] for r in ranks} == ({n // 4} if n >= 4 else set())
    workers = sampling.split_workers(df, "k", ["k"]).collect()
    assert sorted(r.k for r in workers if r.worker == 0) == list(range(n // 2))


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    want = {r.k: r.rn for r in sampling.position(df.repartition(1), 9, "k").collect()}
    assert sorted(want.values()) == list(range(1, 501)) and want == {r.k: r.rn for r in sampling.position(df.repartition(7), 9, "k").collect()}
    assert [r.k for r in sampling.shuffle(df, 9, "k").collect()] == sorted(want, key=want.get)
    skew = spark.createDataFrame([(1.0, i) for i in range(300)] + [(float(i), i) for i in range(300, 320)], "v double, k long")
    assert {r.k: r.rn for r in sampling.ordered_position(skew, "v", ["k"]).collect()} == {k: k + 1 for k in range(320)}


def test_dedup_and_merge(spark):
    df = spark.createDataFrame([("u", 1, "f1"), ("u", 2, "f1"), ("u", 3, "f2"), (None, 4, "f1"), (None, 5, "f1")], "URL string, i int, file string")
    assert sorted(r.i for r in dedup.dedup_keep_first(df, ["URL"], ["i"]).collect()) == [1, 4]
    assert sorted(r.i for r in dedup.dedup_keep_first(df, ["URL"], ["i"], scope="file").collect()) == [1, 3, 4]
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2, "x"), ("b", 3, "y")], "k string, v int, extra string")
    assert sorted(map(tuple, dedup.merge_keep_existing(old, new, "k", ["v"]).collect())) == [("a", 1, None), ("b", 3, "y")]


def test_near_dedup_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    gone = {b for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert gone and {r.doc_id for r in dedup.near_dedup(docs, "doc_id", "text").collect()} == set(sets) - gone


def test_near_duplicate_classes(spark):
    w = [f"w{i}" for i in range(60)]
    middle = " ".join(w[:50])
    texts = {1: " ".join(w[4:50]), 2: " ".join(w[:46]), 3: middle, 4: "die tz.", 5: "Die  tz.", 6: "", 7: None, 8: middle, 9: "die tz. x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in dedup.near_duplicate_classes(df, "doc_id", "text", threshold=0.9).collect()}
    # 1 and 2 are linked through 3 and its copy 8 only
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 3), 8: (1, 3), 4: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 0), 9: (9, 0)}


def test_semi_and_anti_make_the_whole(spark):
    work, done = spark.range(20).withColumnRenamed("id", "k"), spark.range(5, 12).withColumnRenamed("id", "k")
    assert joins.pending(work, done, "k").count() + work.join(done, "k", "left_semi").count() == 20
    items = spark.createDataFrame([("s", "a"), ("s", "b.txt"), ("s", "mid"), ("s", "zzz"), ("t", "a")], "shard string, base string")
    members = spark.createDataFrame([("s", "x_mid_y.jpg", 2), ("s", "mid_first.jpg", 1), ("s", "d/a.jpg", 3), ("s", "b.txt", 4)], "shard string, name string, pos int")
    got = {(r.shard, r.base): r.member for r in joins.resolve_member(items, members, "shard", "base", "name", "pos").collect()}
    assert got == {("s", "a"): "d/a.jpg", ("s", "b.txt"): "b.txt", ("s", "mid"): "mid_first.jpg", ("s", "zzz"): None, ("t", "a"): None}
    latents = spark.createDataFrame([("k1.npy",), ("s__k2.npy",)], "latent_name string")
    kept = spark.createDataFrame([("k1",), ("s::k2",)], "image_key string")
    assert joins.select_latents(latents, kept).count() == 2 and joins.select_latents(latents, kept, key_mode="raw").count() == 1


def test_chance_is_repeatable_and_fair(spark):
    df = spark.range(4000)
    out = df.repartition(5).select("id", chance.uniform(1, F.col("id")).alias("u"), chance.normal(1, F.col("id")).alias("z")).agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev_pop("z")).first()
    assert abs(out[0] - 0.5) < 0.02 and 0 <= out[1] and out[2] < 1 and abs(out[3]) < 0.05 and abs(out[4] - 1) < 0.05


def test_schedules_and_examples(spark):
    last = features.noise_schedule(spark).orderBy(F.desc("t")).first()
    assert math.isclose(last.alpha_bar, 0.00466010, rel_tol=1e-5)
    assert features.noise_schedule(spark, kind="linear").count() == 1000
    for bad in (lambda: features.noise_schedule(spark, kind="cosine"), lambda: features.draw_timestep(1, F.lit(1), "x"), lambda: features.crop_plan(F.lit(1), F.lit(1), variant="x")):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([(i, [0.5] * 32) for i in range(200)], "k long, x array<float>")
    out = features.training_examples(df, "k", "x", features.noise_schedule(spark), 3, "flow")
    row = out.select(F.min("t"), F.max("t"), F.avg(arrays.mean(F.col("target"))), F.avg(F.size("x_t"))).first()
    assert 0.001 <= row[0] < row[1] <= 0.999 and abs(row[2] + 0.5) < 0.05 and row[3] == 32
    again = features.training_examples(df.repartition(3), "k", "x", features.noise_schedule(spark), 3, "flow")
    assert sorted(out.select("k", "x_t").collect()) == sorted(again.select("k", "x_t").collect())
    assert spark.range(1).select(features.snr_weight(F.lit(NAN)), features.snr_weight(F.lit(0.0)), features.flow_snr_weight(F.lit(1.0))).first()[:] == (1.0, 1.0, 1.0)
    dropped = features.caption_dropout(spark.range(2000).selectExpr("id", "'c' as a", "'d' as b"), ["a", "b"], 0.1, 1, "id")
    n = dropped.filter("a = '' and b = ''").count()
    assert 120 < n < 280 and dropped.filter("(a = '') <> (b = '')").count() == 0
    a, b = (spark.range(1).select(features.crop_plan(F.lit(777), F.lit(513), variant=v).alias("p")).first().p for v in ("integer", "factor"))
    assert a.new_h == 512 and abs(a.new_w - b.new_w) <= 1


def test_failed_batches_are_tried_row_by_row(spark):
    def load():
        def encode(x):
            if (x[:, 0] < 0).any():
                raise ValueError("bad row")
            return x[:, :2] * 2

        return encode

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0, 2.0]), (3, [3.0, 4.0]), (4, None), (5, [5.0, None])], "k long, x array<float>")
    out = {r.k: (r.latent, r.failed) for r in features.encode_batches(df, df.filter("k = 3"), "k", "x", load).collect()}
    assert out == {1: ([2.0, 4.0], False), 2: (None, True), 4: (None, True), 5: (None, True)}


def test_metrics(spark):
    series = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([4, 2, 6, 1])], "g int, s int, v double")
    e, s = 4.0, 0
    for v in (2, 6, 1):
        s += 1
        d = min(0.99, (1 + s) / (10 + s))
        e = e * d + v * (1 - d)
    assert math.isclose(metrics.ema(series, "v", ["s"], ["g"], 0.99).first().ema, e)
    best = metrics.running_best(series, "v", "s", ["g"]).orderBy("s").collect()
    assert [(r.best, r.new_best) for r in best] == [(4.0, True), (2.0, True), (2.0, False), (1.0, True)]
    none = metrics.keep_summary(series.limit(0), F.lit(True)).first()
    assert (none.seen, none.keep_pct) == (0, 0.0)
    vocab = features.build_vocab(spark.createDataFrame([("b a a",), ("",), (None,)], "t string"), "t", 10)
    assert [(r.word, r.id) for r in vocab.orderBy("id").collect()] == [("a", 4), ("b", 5)]
    docs = spark.createDataFrame([(1, "a zz b"), (2, None), (3, "a " * 100)], "k long, t string")
    tokens = {r.k: r for r in features.encode_tokens(docs, "k", "t", vocab).collect()}
    assert tokens[1].input_ids[:6] == [1, 4, 3, 5, 2, 0] and sum(tokens[1].attention_mask) == 5 and tokens[2].input_ids[:3] == [1, 2, 0]
    assert len(tokens[3].input_ids) == 77 and tokens[3].input_ids[-1] == 2 and sum(tokens[3].attention_mask) == 77


def test_ema_beyond_its_warm_up_and_in_any_group(spark):
    def fold(values, decay):
        e = values[0]
        for s, v in enumerate(values[1:], 1):
            d = min(decay, (1 + s) / (10 + s))
            e = e * d + v * (1 - d)
        return e

    rows = [(g, t, float(t * 7 % 11)) for g in ("a", None) for t in range(40)] + [("a", 40, None), ("c", 0, 5.0)]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    for decay in (0.5, 0.05, 0.9999, 1.0):
        got = {r.g: (r.ema, r.n) for r in metrics.ema(df, "v", ["t"], ["g"], decay).collect()}
        want = fold([float(t * 7 % 11) for t in range(40)], decay)
        assert set(got) == {"a", None, "c"} and got["c"] == (5.0, 1)
        assert all(math.isclose(got[g][0], want) and got[g][1] == 40 for g in ("a", None))
    assert metrics.ema(df.filter("v is null"), "v", ["t"], ["g"]).count() == 0
