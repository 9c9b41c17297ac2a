"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a word break; the n-grams of orders 1 to
`order` of each word, with its breaks, are hashed into 2^bits buckets. Learning counts
buckets by language in one distributed aggregation over a bounded sample; the matrix of
smoothed log probabilities (languages x buckets, a fixed size) is broadcast. Scoring is
batched: a slice of texts becomes one sparse matrix of bucket counts, in numpy.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any
learned language every row is. Ties go to the first language by name. Repeated rows are
each scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

_OTHER = re.compile(r"[\W\d_]+")
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
UNKNOWN = "und"


def letters_of(text: str | None) -> str:
    """The lower-cased letters of a text, with a space for whatever else lies between them."""
    words = _OTHER.sub(" ", (text or "").lower())
    if _BEYOND_ASCII.search(words):
        numerals = {c for c in set(words) if c != " " and not c.isalpha()}
        words = re.sub(f"[{re.escape(''.join(numerals))}]+", " ", words) if numerals else words
    return words.strip()


def buckets(texts: list[str | None], order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of every text, index of its text)."""
    kept = [(" " + x + " ") if (x := letters_of(t)) else "" for t in texts]
    sizes = np.fromiter(map(len, kept), np.int64, len(kept))
    code = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # letters to the end of the own text
    hashed, out, owner = np.zeros(len(code), np.uint32), [], []
    of = np.repeat(np.arange(len(kept)), sizes)
    for n in range(1, order + 1):
        hashed = hashed[: len(code) - n + 1] * np.uint32(0x01000193) ^ code[n - 1 :] * np.uint32(0x9E3779B1)
        mixed = (hashed ^ hashed >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        ok = left[: len(hashed)] >= n
        out.append((mixed >> np.uint32(32 - bits))[ok])
        owner.append(of[: len(hashed)][ok])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log: np.ndarray  # buckets x languages
    prior: np.ndarray
    order: int
    bits: int

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        bucket, owner = buckets(texts, self.order, self.bits)
        total = np.stack([np.bincount(owner, self.log[bucket, k], len(texts)) for k in range(len(self.languages))], axis=1)
        has = np.bincount(owner, minlength=len(texts)) > 0
        z = total + self.prior
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        best = z.argmax(1)
        return [(self.languages[b], float(p[i, b])) if has[i] else (UNKNOWN, 0.0) for i, b in enumerate(best.tolist())]


def fit(rows: DataFrame, order: int = 3, bits: int = 15, smooth: float = 0.5) -> Model:
    """rows: columns text and lang. Every task sends one count per language and bucket that it met."""

    def count(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, base.SLICE_ROWS):
                part = batch.slice(start, base.SLICE_ROWS)
                langs = np.array(part.column(1).to_pylist(), object)
                bucket, owner = buckets(part.column(0).to_pylist(), order, bits)
                for lang in set(langs.tolist()):
                    own = total.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                    own[:-1] += np.bincount(bucket[(langs == lang)[owner]], minlength=1 << bits) if len(bucket) else 0
                    own[-1] += int((langs == lang).sum())
        for lang, own in total.items():
            met = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(met), pa.string()), pa.array(met, pa.int32()), pa.array(own[met], pa.int64())], ["lang", "bucket", "n"])

    got = rows.select("text", "lang").filter("lang is not null").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(got["lang"]))
    table = np.zeros(((1 << bits) + 1, len(languages)))
    table[got["bucket"].to_numpy(int), got["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(int)] = got["n"]
    seen, rows_of = table[:-1], table[-1]
    log = np.log((seen + smooth) / (seen.sum(0) + smooth * len(seen)))
    return Model(languages, log.astype(np.float32), np.log(rows_of / max(1, rows_of.sum())), order, bits)


def identify(docs: DataFrame, allowed: Column, sample: int = 40_000, order: int = 3, bits: int = 15) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs.

    lang is read only where `allowed` holds, to learn, from at most about `sample` rows (a
    parameter) chosen by a hash of doc_id; rows without one are not learnt from.
    """
    known = docs.select("doc_id", "text", "lang").filter(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    return predict(docs.select("doc_id", "text"), fit(base.bounded_sample(known, sample, "doc_id", "text"), order, bits)).drop("text")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.add_text_columns(docs, "text", fields, lambda: sent.value.predict)
