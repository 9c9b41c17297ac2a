"""The metadata quality filter, its funnel, and the caption and pixel rules."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from ..config import BROAD, FilterConfig
from ..functions import arrays, text

# Deny lists and keywords of the caption rules.
NAMES = (
    "stephen colbert", "mark zuckerberg", "elon musk", "joe biden", "donald trump", "putin", "obama", "kanye", "taylor swift",
    "kim kardashian", "jeff bezos", "bill gates", "steve jobs", "lebron james", "cristiano ronaldo", "messi",
)
TERMS = ("nude", "naked", "nsfw", "explicit", "xxx", "erotic", "porn", "topless", "lingerie", "underwear")
PEOPLE = ("portrait", "face", "woman", "man", "girl", "boy", "person", "human", "character", "anime", "figure", "lady", "guy")

# Labels that count as safe, and the names of each column in the order in which they are preferred.
SAFE_LABELS = ("UNLIKELY", "unlikely")

ALIASES = {
    "URL": ("url", "URL"),
    "TEXT": ("text", "TEXT", "caption", "CAPTION"),
    "WIDTH": ("width", "WIDTH"),
    "HEIGHT": ("height", "HEIGHT"),
    "similarity": ("similarity", "SIMILARITY", "clip_sim"),
    "aesthetic_score": ("aesthetic_score", "AESTHETIC_SCORE", "aesthetic"),
    "pwatermark": ("pwatermark", "watermark", "WATERMARK", "watermark_score"),
    "NSFW": ("nsfw", "NSFW", "punsafe", "is_nsfw"),
}

OUTPUT = {"URL": "string", "TEXT": "string", "aesthetic_score": "double", "similarity": "double"}


def normalize_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Each alias group becomes one column, the first alias that is not null winning; other columns stay.

    Names match in any case. With spark.sql.caseSensitive=true a table may hold several that
    differ by case only; otherwise Spark itself folds those into one.
    """
    used, out = set(), []
    for target, names in aliases.items():
        rank = {n: k for k, n in reversed([*enumerate(names)])} | {n.lower(): k for k, n in reversed([*enumerate(names)]) if n.lower() not in names}
        present = sorted((c for c in df.columns if c in rank or c.lower() in rank), key=lambda c: rank.get(c, rank.get(c.lower(), 0)))
        if present:
            out.append(F.coalesce(*(F.col(f"`{c}`") for c in present)).alias(target))
        used |= set(present)
    return df.select(*out, *(F.col(f"`{c}`") for c in df.columns if c not in used))


def at_least(c: str, k: float) -> Column:
    """c >= k; NaN, which Spark takes for the largest number, fails."""
    return (F.col(c) >= k) & ~F.isnan(F.col(c).cast("double"))


def predicates(df: DataFrame, cfg: FilterConfig = BROAD) -> list[tuple[str, Column]]:
    """The filters in their order; those whose column df lacks are left out."""
    has = set(df.columns).__contains__
    out = [("null_drop", F.col("URL").isNotNull() & F.col("TEXT").isNotNull())]
    if has("aesthetic_score"):
        out.append(("aesthetic", at_least("aesthetic_score", cfg.min_aesthetic)))
    if has("similarity"):
        out.append(("clip_sim", at_least("similarity", cfg.min_similarity)))
    if has("WIDTH") and has("HEIGHT"):
        out.append(("dimensions", at_least("WIDTH", cfg.min_side) & at_least("HEIGHT", cfg.min_side)))
        out.append(("aspect", F.try_divide(F.col("WIDTH"), F.col("HEIGHT")).between(cfg.min_aspect, cfg.max_aspect)))
    out.append(("caption_len", F.length("TEXT").between(cfg.min_caption, cfg.max_caption)))
    if has("pwatermark"):
        out.append(("watermark", F.col("pwatermark") < cfg.max_watermark))
    if has("NSFW") and not cfg.allow_nsfw:
        textual = isinstance(df.schema["NSFW"].dataType, T.StringType)
        out.append(("nsfw", F.col("NSFW").isin(*SAFE_LABELS) if textual else F.col("NSFW") < cfg.max_nsfw_score))
    return out


def quality_filter(df: DataFrame, cfg: FilterConfig = BROAD) -> DataFrame:
    """Rows that pass every predicate. Without URL or TEXT column nothing passes."""
    if not {"URL", "TEXT"} <= set(df.columns):
        return df.limit(0)
    for _, keep in predicates(df, cfg):
        df = df.filter(keep)
    return df


def select_output(df: DataFrame) -> DataFrame:
    """URL, TEXT and the two scores; a missing one is null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in OUTPUT.items()))


def filter_funnel(df: DataFrame, cfg: FilterConfig = BROAD) -> DataFrame:
    """(step, filter, removed, survivors) of each filter in order, then of the deduplication by URL, in one pass over df."""
    steps = predicates(df, cfg)
    failed = F.coalesce(*(F.when(F.coalesce(keep, F.lit(False)), None).otherwise(F.lit(k)) for k, (_, keep) in enumerate(steps)), F.lit(len(steps)))
    # one row for each filter, and one for each URL of what passes, of which all but one row go
    counts = df.groupBy(failed.alias("at"), F.when(failed == len(steps), F.col("URL")).alias("url")).agg(F.count("*").alias("n"))
    repeats = F.sum(F.when(F.col("at") == len(steps), F.col("n") - 1))
    removed = [*(F.sum(F.when(F.col("at") == k, F.col("n"))) for k in range(len(steps))), repeats]
    one = counts.agg(*(F.coalesce(x, F.lit(0)).alias(f"r{k}") for k, x in enumerate(removed)), F.coalesce(F.sum("n"), F.lit(0)).alias("seen"))
    gone = lambda k: sum((F.col(f"r{j}") for j in range(k + 1)), F.lit(0))
    rows = F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(name).alias("filter"), F.col(f"r{k}").alias("removed"), (F.col("seen") - gone(k)).alias("survivors")) for k, name in enumerate([*(name for name, _ in steps), "dedup"])))
    return one.select(F.inline(rows))


def keep_caption(c: Column, names=NAMES, terms=TERMS) -> Column:
    """At least 12 characters and 3 words, and neither a listed name nor a listed term in it."""
    low = text.strip(F.lower(c))
    ok = (F.length(low) >= 12) & (text.word_count(low) >= 3)
    for listed in (names, terms):
        if listed:
            ok = ok & ~text.contains_any(low, listed)
    return F.coalesce(ok, F.lit(False))


def caption_present(c: Column, least: int = 10) -> Column:
    return F.coalesce(F.length(text.strip(c)) >= least, F.lit(False))


def pixel_status(a: Column, width: Column | None = None, height: Column | None = None, target: int = 512, min_std: float = 5.0, dark: float = 2.0, bright: float = 253.0) -> Column:
    """too_small_WxH, nan_or_inf, near_blank, too_dark, too_bright or ok."""
    mean, std = arrays.mean(a), arrays.std(a)
    status = F.when(arrays.has_bad(a), "nan_or_inf").when(std < min_std, "near_blank").when(mean < dark, "too_dark").when(mean > bright, "too_bright").otherwise("ok")
    if width is None or height is None:
        return status
    return F.when((width < target / 2) | (height < target / 2), F.format_string("too_small_%dx%d", width, height)).otherwise(status)


def usable_sample(extensions: Column) -> Column:
    """A map from extension to content with an image and a caption file."""
    has = lambda k: F.map_contains_key(extensions, k)
    return (has("jpg") | has("jpeg")) & (has("txt") | has("json"))


def tall_person(boxes: Column, height: Column, share: float = 0.55) -> Column:
    """Whether any box (with a field h) takes at least that share of the image's height."""
    return F.coalesce(F.exists(boxes, lambda b: F.coalesce(F.try_divide(b["h"], height) >= share, F.lit(False))), F.lit(False))


#: What predicates have loaded in this worker, by the token of their filter.
_LOADED: dict[str, object] = {}


def filter_with(df: DataFrame, columns: list[str], load: Callable[[], Callable]) -> DataFrame:
    """Rows for which a predicate of the caller's holds.

    load() runs once in a Python worker, whose later tasks use what it gave: a function from
    the columns, as Arrow arrays of a batch, to a mask (an Arrow or numpy array, or a list).
    A null in the mask drops the row. Only the named columns go to Python.
    """
    token = uuid.uuid4().hex

    def keep(batches: Iterator):
        import pyarrow as pa

        loaded = importlib.import_module(__name__)._LOADED  # the worker's own, which outlives the task
        if token not in loaded:
            loaded[token] = load()
        predicate = loaded[token]
        for batch in batches:
            given = batch if isinstance(batch, tuple) else (batch,)
            mask = predicate(*given)
            mask = mask if isinstance(mask, pa.Array) else pa.array(mask, pa.bool_(), from_pandas=True)
            if len(mask) != len(given[0]):
                raise ValueError(f"a mask of {len(mask)} for {len(given[0])} rows")
            yield mask.cast(pa.bool_())

    mask = F.arrow_udf(keep, "boolean", ArrowUDFType.SCALAR_ITER)
    return df.filter(F.coalesce(mask(*columns), F.lit(False)))
