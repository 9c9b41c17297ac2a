"""Array expressions: fixed lengths, masks, moments and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LATENT_BYTES, TOKENS


def fit_length(a: Column, length: int = TOKENS, fill: int = 0) -> Column:
    """Exactly `length` entries: cut, padded, or all padding for null."""
    return F.slice(F.concat(F.coalesce(a, F.array().cast("array<int>")), F.array_repeat(F.lit(fill), length)), 1, length)


def attention_mask(n: Column, length: int = TOKENS) -> Column:
    """1 for the first n places, 0 behind; all ones without n."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(n.isNull() | (i <= n), 1).otherwise(0))


def tensor_bytes(n: Column) -> Column:
    return n.cast("long") * LATENT_BYTES


def total(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x.cast("double")))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def std(a: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.try_divide(F.aggregate(F.transform(a, lambda x: F.pow(x.cast("double") - mean(a), 2)), F.lit(0.0), lambda s, x: s + x), F.size(a)))


def has_bad(a: Column) -> Column:
    """Whether any entry is null, NaN or infinite."""
    return F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def squared_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of one length."""
    return F.try_divide(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x), F.size(a))
