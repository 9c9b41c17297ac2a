"""Helpers shared by the operators: Arrow row mapping, written tables, samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import forget, written  # noqa: F401  the operators take them from here

#: Rows, and characters beyond one row, handed to a text function at once; these bound a worker's memory, not the data.
SLICE_ROWS, SLICE_CHARS = 512, 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    return _free(df.columns, name)


def _free(columns: list[str], name: str) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, bounded by SLICE_ROWS and by the size of column `at`, if that is a text."""
    sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist() if pa.types.is_string(batch.schema.types[at]) else [0] * batch.num_rows
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and (k - start == SLICE_ROWS or held + n > SLICE_CHARS):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def add_text_columns(df: DataFrame, text: str, fields: T.StructType, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Append columns computed from the whole of column `text`.

    make() runs once in each task and returns a function from a list of texts (None for
    null) to one tuple per text, or to a list of Arrow columns. All other columns pass
    through unchanged; a new column whose name is taken gets another, by `fresh`.
    """
    at = df.columns.index(text)
    schema = T.StructType(df.schema.fields)
    for f in fields.fields:
        schema = T.StructType([*schema.fields, T.StructField(_free(schema.names, f.name), f.dataType)])
    kinds = list(to_arrow_schema(T.StructType(schema.fields[len(df.columns) :])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for part in slices(whole, at):
                got = list(work(part.column(at).to_pylist()))
                if not (got and isinstance(got[0], pa.Array)):
                    got = list(zip(*got, strict=True)) or [()] * len(kinds)
                new = [v.cast(k.type) if isinstance(v, pa.Array) else pa.array(v, k.type) for v, k in zip(got, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(k.name for k in kinds)])

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """About `bound` rows of df, hardly ever more, or all if there are fewer: those whose hash of the keys is below a share of its range, whatever the partitioning. Rows with the same keys go together."""
    rows = df.count()
    if rows <= bound:
        return df
    share = max(1, bound - 4 * math.isqrt(bound)) / rows  # four standard deviations less
    return df.filter(F.xxhash64(*keys) < F.lit(int(share * 2.0**64) - (1 << 63)))


def held_out(doc_id: str, folds: int, fold: int):
    """crc32 of the id as text leaves `fold`; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def join_with_hot_keys(rows: DataFrame, found: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """Inner join on key; `found` has one row for each key and, in n, the number of rows that have it.

    Keys of at least 1 / share of all rows are at most `share` many: they are joined where
    the rows are, by broadcast. Only the other keys are shuffled. found is read three
    times, so it should be a written table.
    """
    total = found.agg(F.sum(n).alias("t")).first()["t"] or 0
    hot = F.broadcast(found.filter(F.col(n) * share >= total).limit(share))
    rest = rows.join(hot.select(key), key, "left_anti").join(found.filter(F.col(n) * share < total), key)
    return rows.join(hot, key).unionByName(rest).drop(n)
