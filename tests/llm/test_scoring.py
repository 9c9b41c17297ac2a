"""Quality, toxicity and language: held-out accuracy, formulas and odd rows."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import base, langid, quality, queries, toxicity


def _labels(spark, sf_dir, name):
    return {r[0]: r[1] for r in base.table(spark, sf_dir, "labels").select("doc_id", name).collect()}


def test_quality_held_out(spark, sf_dir):
    rows = queries.op1_quality(spark, sf_dir).collect()
    assert len(rows) == base.table(spark, sf_dir, "documents").count()
    label = _labels(spark, sf_dir, "quality")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = [r.predicted == label[r.doc_id] for r in rows if r.doc_id in label]
    assert np.mean(known) > 0.9


def test_discriminant_is_the_log_density_difference(spark):
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    x = [rng.normal(size=(80, d)), rng.normal(1, 2, size=(60, d))]
    rows = [(v.tolist(), k) for k in (0, 1) for v in x[k]]
    model = quality.fit(spark.createDataFrame(rows, "statistics array<double>, _label int"), shrink=0.2, ridge=0.1)
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x) / 140
    log = []
    point = rng.normal(size=(5, d))
    for k in (0, 1):
        c = 0.8 * np.cov(x[k].T, bias=True) + 0.2 * pooled
        c = 0.9 * c + 0.1 * (np.trace(c) / d + 1e-6) * np.eye(d)
        diff = point - x[k].mean(0)
        log.append(math.log(len(x[k]) / 140) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (5, 1), (7, 0), (8, 1), (None, 1), (9, None)], "doc_id long, quality int")
    for docs in (odd, nothing):
        scored, _ = quality.classify(docs, labels, F.lit(True), 0.3)
        got = scored.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        kept = quality.reject(docs, labels, F.lit(True), 0.3)
        assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in got)
    scored, _ = quality.classify(odd, labels.limit(0), F.lit(True), 0.3)
    assert {r.score for r in scored.collect()} == {0.5}


def test_toxicity_held_out_and_located(spark, sf_dir):
    label = _labels(spark, sf_dir, "toxic")
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, base.table(spark, sf_dir, "labels"), F.lit(True))
    rows = toxicity.score(docs, model).collect()
    known = [(r.score >= 0.7) == bool(label[r.doc_id]) for r in rows if r.doc_id in label]
    assert np.mean(known) > 0.9
    assert len(queries.op5_toxicity(spark, sf_dir).collect()) == len(rows)


def test_noisy_or_finds_the_sentence():
    good, bad = ["the sun shines", "we walk home"], "you are an awful grumbler"
    bags = [[set(s.split()) for s in (good + [bad] if k % 2 else good)] for k in range(60)]
    model = toxicity.fit(bags, np.arange(60) % 2)
    text = "The sun shines. You are an awful grumbler! We walk home."
    score, where = model.score(text)
    assert score > 0.7 and [text[w["start"] : w["end"]].strip() for w in where] == ["You are an awful grumbler!"]
    assert model.score("The sun shines. We walk home.")[0] < 0.3
    z = [model.bias + sum(model.weight.get(f, 0) for w in set(s.lower().split()) for f in toxicity.features(w)) for s in ("the sun shines", "you are an awful grumbler", "we walk home")]
    assert math.isclose(score, 1 - np.prod([1 / (1 + math.exp(v)) for v in z]), rel_tol=1e-9)


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (5, 0), (7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for docs in (odd, nothing):
        d = docs.select("doc_id", "text")
        got = toxicity.score(d, toxicity.train(d, labels, F.lit(True))).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit([], np.zeros(0)).score("x")[0] < 1e-6


def test_langid_held_out(spark, sf_dir):
    rows = queries.op2_langid(spark, sf_dir).join(base.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.95


def test_langid_counts_every_ngram(spark):
    texts = ["Ab, c", None, "日é", "12"]
    bucket, owner = langid.buckets(texts, 3, 15)
    # " ab c " and " 日é ": one n-gram of order n at each place that leaves room for it
    assert np.bincount(owner, minlength=4).tolist() == [6 + 5 + 4, 0, 4 + 3 + 2, 0]
    alone, _ = langid.buckets(["日é"], 3, 15)
    assert sorted(bucket[owner == 2]) == sorted(alone)


def test_langid_of_odd_rows(spark, odd, nothing):
    got = langid.identify(odd, F.lit(True)).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 7)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(nothing, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}


def test_numerals_are_no_letters():
    """Numerals of all kinds count as word characters, but a text of them alone has no language."""
    model = langid.Model(["en"], np.zeros((1 << 15, 1), np.float32), np.zeros(1), 3, 15)
    got = model.predict(["½ ² ③ Ⅷ ①", "12 ٣ _", None, "", "é", "½a", "日"])
    assert [x for x, _ in got] == ["und", "und", "und", "und", "en", "en", "en"]


def test_labels_of_one_class_only(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(6)], "doc_id long, text string")
    for label in (0, 1):
        labels = spark.createDataFrame([(i, label) for i in range(6)], "doc_id long, quality int")
        scored, _ = quality.classify(docs, labels, F.lit(True), 0.3)
        assert {(r.score, r.predicted) for r in scored.collect()} == {(float(label), label)}


def test_a_bounded_sample_is_the_same_however_rows_are_dealt(spark):
    df = spark.range(20_000)
    ids = [{r.id for r in base.bounded_sample(df.repartition(n), 1_000, "id").collect()} for n in (1, 7)]
    assert ids[0] == ids[1] and 600 <= len(ids[0]) <= 1_000
    assert base.bounded_sample(df.limit(10), 10, "id").count() == 10


def test_langid_against_an_independent_posterior(spark, sf_dir):
    """Counts and posteriors by plain dictionaries, gram by gram, for every document."""
    rows = base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()

    def grams(text):
        kept = f" {letters} " if (letters := langid.letters_of(text)) else ""
        for a in range(len(kept)):
            h = 0
            for c in kept[a : a + 3]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) * 0x9E3779B1 & 0xFFFFFFFF)
                yield ((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 17

    counts, docs = {}, {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            own = counts.setdefault(r.lang, {})
            docs[r.lang] = docs.get(r.lang, 0) + 1
            for g in grams(r.text):
                own[g] = own.get(g, 0) + 1
    total = {lang: sum(own.values()) + 0.5 * 2**15 for lang, own in counts.items()}
    got = {r.doc_id: r for r in queries.op2_langid(spark, sf_dir).collect()}
    for r in rows:
        found = list(grams(r.text))
        if not found:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        z = {lang: math.log(docs[lang] / sum(docs.values())) + sum(math.log((own.get(g, 0) + 0.5) / total[lang]) for g in found) for lang, own in counts.items()}
        best = max(sorted(z), key=z.get)
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - 1 / sum(math.exp(v - z[best]) for v in z.values())) < 1e-3


def test_toxicity_fit_is_a_minimum():
    """The fitted weights' loss (noisy-or likelihood, classes balanced, with its penalty) against a grid of changes of each weight and of the bias."""
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(12)]
    bags, y = [], []
    for _ in range(500):
        bag = [[w for w in words if rng.random() < 0.15] for _ in range(rng.integers(1, 5))]
        y.append(float(rng.random() < (0.75 if any("w0" in s or "w1" in s for s in bag) else 0.12)))
        bags.append(bag)
    y = np.array(y)
    model = toxicity.fit(bags, y)
    assert {"w0", "w1"} <= set(model.weight)

    def loss(bias, weight):
        out = 0.0
        for bag, label in zip(bags, y, strict=True):
            clean = sum(math.log1p(math.exp(bias + sum(weight.get(f, 0) for w in s for f in toxicity.features(w)))) for s in bag)
            share = y.mean()
            out += 0.5 / share * -math.log(max(1e-9, -math.expm1(-clean))) if label else 0.5 / (1 - share) * clean
        return out / len(y) + 3e-4 * sum(abs(v) for v in weight.values())

    least = loss(model.bias, model.weight)
    for step in (-0.5, -0.1, 0.1, 0.5):
        assert loss(model.bias + step, model.weight) > least - 1e-3
        for f in model.weight:
            assert loss(model.bias, model.weight | {f: model.weight[f] + step}) > least - 1e-3, (f, step)


def test_toxicity_training_is_bounded_in_bytes(spark):
    """Rows that don't fit are passed over for others that do, whatever the partitioning; a bound of nothing learns nothing."""
    rows = [(i, ("awful " if i % 2 else "fine ") + " ".join(f"u{i}x{k}" for k in range(5 if i else 5000)), i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    some = [toxicity.train(docs.repartition(n), labels, F.lit(True), most_bytes=6000) for n in (1, 5)]
    assert some[0].bias == some[1].bias and some[0].weight == some[1].weight and "awful" in some[0].weight
    assert toxicity.train(docs, labels, F.lit(True), most_bytes=1).weight == {}
