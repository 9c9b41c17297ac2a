"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class of labelled documents gets a Gaussian over transformed statistics of the text.
Its covariance is shrunk towards the pooled covariance and towards a scaled identity, so
that it always has a Cholesky factor. A score is the posterior of class 1 from the
difference of the two log densities, whose Mahalanobis terms come from the cached inverse
of the factor.

Fitting is one distributed aggregation: every task sums counts, vectors and outer products
by class, and only those sums (2 x (1 + d + d^2) numbers) reach the driver.

Defined cases: a null or empty text has the statistics of an empty text and is scored like
any other; repeated rows are scored each; rows without a label, or with a null label, do
not take part in fitting; several labels of one id count as the smallest; with fewer than
two labelled rows of a class the score is the share of class 1 (0.5 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

STATISTICS = (
    "words", "word_length", "word_length_spread", "symbols", "capitals", "capital_words", "digits", "adjacent_repeats", "distinct_words",
    "commonest_word", "bars", "line_words", "sentence_ends", "word_entropy",
)
_SYMBOLS, _CAPITALS, _DIGITS = b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(65, 91)), bytes(range(48, 58))  # counted by deletion, in ASCII
_END = re.compile(r"[.!?](?=\s|$)")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    text = text or ""
    words, raw = text.split(), text.encode("utf-8", "replace")
    n, chars = len(words), len(raw)
    count = lambda which: chars - len(raw.translate(None, which))
    share = lambda x, of: float(np.log((x + 0.5) / (of + 1)))  # noqa: E731  log share, finite at 0
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n) if n else np.zeros(1)
    counts = np.fromiter(Counter(words).values(), dtype=np.float64) if n else np.ones(1)
    p = counts / counts.sum()
    return [
        float(np.log1p(n)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())), share(count(_SYMBOLS), chars), share(count(_CAPITALS), chars), share(sum(map(str.isupper, words)), n),
        share(count(_DIGITS), chars), share(sum(map(eq, words, words[1:])), n), share(len(counts), n + 1), share(counts.max(), n), share(text.count("|"), n), float(np.log1p(n / (text.count("\n") + 1))),
        share(len(_END.findall(text)), n), float(-(p * np.log(p)).sum() / np.log(n + 2)),
    ]


def with_statistics(df: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """df with an array column of the statistics of the whole of each text."""
    field = T.StructType([T.StructField(name, T.ArrayType(T.DoubleType()))])
    return base.add_text_columns(df, text, field, lambda: lambda texts: [(statistics(x),) for x in texts])


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor and log determinant."""

    log_prior: np.ndarray
    mean: np.ndarray
    whitener: np.ndarray
    log_det: np.ndarray
    fallback: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fallback is not None or not len(x):
            return np.full(len(x), 0.5 if self.fallback is None else self.fallback)
        log = [self.log_prior[k] - 0.5 * self.log_det[k] - 0.5 * (((x - self.mean[k]) @ self.whitener[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def labelled(df: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """df joined with one label per key, the smallest; rows without one drop out."""
    one = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("_label"))
    return df.join(one, key)


def fit(examples: DataFrame, shrink: float = 0.05, ridge: float = 0.001) -> Discriminant:
    """examples: columns statistics and _label (0 or 1), read once, in full.

    shrink: weight of the pooled covariance in each class's; ridge: weight of the identity,
    scaled by the mean variance.
    """
    d = len(STATISTICS)

    def sums(batches):
        import pandas as pd

        total = np.zeros((2, 1 + d + d * d))
        for pdf in batches:
            for k in (0, 1):
                if len(rows := pdf.loc[pdf["_label"] == k, "statistics"]):
                    x = np.stack(rows.to_list())
                    total[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"k": np.repeat([0, 1], total.shape[1]), "i": np.tile(np.arange(total.shape[1]), 2), "v": total.ravel()})

    got = examples.select("statistics", "_label").mapInPandas(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((2, 1 + d + d * d))
    total[got["k"], got["i"]] = got["v"]
    n = total[:, 0]
    if n.min() < 2:
        return Discriminant(*[np.zeros(0)] * 4, fallback=float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = total[:, 1 : 1 + d] / n[:, None]
    scatter = total[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    cov = np.stack([(1 - shrink) * scatter[k] / n[k] + shrink * pooled for k in (0, 1)])
    cov = np.stack([(1 - ridge) * c + ridge * (np.trace(c) / d + 1e-6) * np.eye(d) for c in cov])
    factor = np.linalg.cholesky(cov)
    return Discriminant(np.log(n / n.sum()), mean, np.linalg.inv(factor), 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1))


def score(df: DataFrame, model: Discriminant, statistics: str = "statistics", name: str = "score") -> DataFrame:
    """df with a double column: the posterior of class 1."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def posterior(x):
        import pandas as pd

        return pd.Series(sent.value.score(np.stack(x.to_list()) if len(x) else np.zeros((0, len(STATISTICS)))))

    return df.withColumn(name, posterior(F.col(statistics)))


def classify(docs: DataFrame, labels: DataFrame, train: Column, threshold: float) -> tuple[DataFrame, Discriminant]:
    """(doc_id, statistics, score, predicted) of each row of docs, with the model, fitted on rows where `train` holds."""
    narrow = base.written(with_statistics(docs.select("doc_id", "text")).drop("text"), "quality")
    model = fit(labelled(narrow.filter(train), labels, "quality"))
    return score(narrow, model).withColumn("predicted", (F.col("score") >= threshold).cast("int")), model


def reject(docs: DataFrame, labels: DataFrame, train: Column, threshold: float) -> DataFrame:
    """docs without those that score below the threshold; all columns kept. Statistics are computed once, beside the rows."""
    own, value = base.fresh(docs, "statistics"), base.fresh(docs, "score")
    both = base.written(with_statistics(docs), "quality")
    model = fit(labelled(both.select("doc_id", F.col(own).alias("statistics")).filter(train), labels, "quality"))
    return score(both, model, own, value).filter(F.col(value) >= threshold).select(*docs.columns)
