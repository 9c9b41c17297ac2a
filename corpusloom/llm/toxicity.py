"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability is logistic in the words it holds and in the beginnings of longer
words; a document's is the noisy-or of its sentences. Only documents carry labels, so the
weights are fitted through the noisy-or, by proximal gradient steps with an L1 penalty that
leaves few features. The same weights then point at the offending sentences.

Fitting reads a bounded sample: at most `sample` labelled rows (a parameter), chosen by a
hash of their ids. Scoring reads every document and the whole of each text.

Defined cases: null, empty or wordless texts have one empty sentence; repeated rows are
each scored, and of several texts of a labelled id the smallest is learnt from; null labels do not take part; several labels of one id count as the largest;
without labels of both classes the score is the share of toxic ones (0 without any).
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
_WORD = re.compile(r"[^\W\d_]+")
#: A word longer than so many letters has its beginning of that length as a feature as well.
BEGINNINGS = range(3, 9)
#: Words of one task's memo; when it is full it starts again.
MEMO_WORDS = 300_000


def sentences(text: str | None) -> list[tuple[int, int]]:
    """The character ranges of a text's sentences."""
    text = text or ""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    if at < len(text) or not out:
        out.append((at, len(text)))
    return out


def count_sentences(text: str) -> int:
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    return len(ends) + (not ends or ends[-1] < len(text))


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in BEGINNINGS if k < len(word))]


@dataclass(frozen=True)
class Model:
    """A logistic sentence model: an offset and the features whose weight is not zero."""

    bias: float
    weight: dict[str, float]
    memo: dict[str, float] = field(default_factory=dict, compare=False)

    def weighted(self, words: set[str]) -> dict[str, float]:
        """The words whose features have any weight, with its sum."""
        memo = self.memo
        if len(memo) + len(words) > MEMO_WORDS:
            memo.clear()
        for w in [w for w in words if w not in memo]:
            memo[w] = sum([self.weight.get(f, 0.0) for f in features(w)])
        return {w: x for w in words if (x := memo[w])}

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """The document's probability and its offending sentences (probability of 0.5 or more)."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a letter whose lower case is longer; offsets must hold
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        clean = float(np.log1p(np.exp(self.bias)))  # -log(1 - p) of a sentence without weighted words
        found = self.weighted(set(_WORD.findall(low)))
        if not found:
            return -math.expm1(-clean * count_sentences(low)), []
        total, bad = 0.0, []
        for a, b in sentences(low):
            z = self.bias + sum(found[w] for w in found.keys() & _WORD.findall(low, a, b))
            total += max(z, 0) + math.log1p(math.exp(-abs(z)))
            if z >= 0:
                bad.append({"start": a, "end": b, "score": 1 / (1 + math.exp(-z))})
        return -math.expm1(-total), bad


def fit(bags: list[list[list[str]]], y: np.ndarray, l1: float = 3e-4, steps: int = 300, rate: float = 1.0, min_documents: int = 4, min_z: float = 3.0) -> Model:
    """bags: per document, per sentence, its distinct words.

    Features take part if at least min_documents documents have them and toxic ones do so
    oftener, by min_z standard errors.
    """
    y = np.asarray(y, float)
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.0
        return Model(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), {})
    seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        seen[int(label)].update({f for s in bag for w in s for f in features(w)})
    clean_n, toxic_n = len(y) - y.sum(), y.sum()

    def tells(f: str, n: int) -> bool:
        every = (n + seen[0][f]) / len(y)
        return n + seen[0][f] >= min_documents and n / toxic_n - seen[0][f] / clean_n >= min_z * math.sqrt(every * (1 - every) * (1 / toxic_n + 1 / clean_n) + 1e-12)

    number = {f: k for k, f in enumerate(sorted(f for f, n in seen[1].items() if tells(f, n)))}
    word, sentence, doc_of = array("q"), array("q"), array("q")
    for d, bag in enumerate(bags):
        for s in bag:
            for w in s:
                own = [number[f] for f in features(w) if f in number]
                word.extend(own)
                sentence.extend([len(doc_of)] * len(own))
            doc_of.append(d)
    word, sentence, doc_of = (np.array(x, np.int64) for x in (word, sentence, doc_of))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes weigh the same
    w, bias, n = np.zeros(len(number)), -4.0, len(y)
    speed, bias_speed = np.zeros(len(number)), 0.0
    for _ in range(steps):
        z = bias + np.bincount(sentence, w[word], len(doc_of))
        log_clean = np.bincount(doc_of, np.logaddexp(0, z), n)  # -log(1 - P)
        p = np.clip(-np.expm1(-log_clean), 1e-9, 1)
        # d loss / d log_clean: 1 for a clean document, -(1 - P) / P for a toxic one
        g = balance * np.where(y == 1, -(1 - p) / p, 1.0) / n
        gz = g[doc_of] / (1 + np.exp(-z))
        gw, gb = np.bincount(word, gz[sentence], len(number)), gz.sum()
        speed, bias_speed = 0.9 * speed + 0.1 * gw**2, 0.9 * bias_speed + 0.1 * gb**2
        size = rate * 0.1 / (np.sqrt(speed) + 1e-4)
        w = w - size * gw
        w = np.sign(w) * np.maximum(np.abs(w) - size * l1, 0)
        bias -= rate * 0.1 * gb / (np.sqrt(bias_speed) + 1e-4)
    kept = {x: float(w[k]) for x, k in number.items() if abs(w[k]) > 1e-3}
    return Model(float(bias), kept)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = 8_000, most_bytes: int = 64 << 20) -> Model:
    """Fit on at most `sample` labelled rows of docs (doc_id, text) for which `allowed` holds, whose distinct words by sentence together take at most `most_bytes`; beyond that, rows are taken in the order of a hash of their ids as long as they fit."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = base.bounded_sample(one, sample, "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # no more rows than the bound

    def bags(texts):
        out = []
        for x in texts:
            low = (x or "").lower()
            out.append(([" ".join(sorted(set(_WORD.findall(low, a, b)))) for a, b in sentences(low)],))
        return out

    words = T.StructType([T.StructField("bag", T.ArrayType(T.StringType()))])
    held = base.written(base.add_text_columns(rows.select("doc_id", "toxic", "text"), "text", words, lambda: bags).select("doc_id", "toxic", F.array_join("bag", "\n").alias("bag")), "bags")
    sizes = held.select("doc_id", F.octet_length("bag").alias("n")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").collect()  # `sample` rows at most
    kept = held
    if sum(r["n"] for r in sizes) > most_bytes:
        fits, total = [], 0
        for r in sizes:
            if total + r["n"] <= most_bytes:
                total += r["n"]
                fits.append((r["doc_id"],))
        kept = held.join(F.broadcast(docs.sparkSession.createDataFrame(fits, held.select("doc_id").schema)), "doc_id", "left_semi")
    got = kept.toArrow().sort_by("doc_id")
    base.forget(held)
    return fit([[s.split() for s in x.split("\n")] for x in got["bag"].to_pylist()], np.array(got["toxic"].to_pylist(), float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and offending (start, end and score of each offending sentence)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weight))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])

    def make():
        own = Model(*sent.value)  # its memo ends with the task
        return lambda texts: list(map(own.score, texts))

    return base.add_text_columns(docs, "text", fields, make)
