"""The expressions under names of their own, for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name: arguments, result, body; SQL functions, which the optimizer sees through.
FUNCTIONS = {
    "latent_name": ("image_key string", "string", "concat(replace(replace(image_key, '/', '_'), '::', '__'), '.npy')"),
    "key_shard": ("image_key string", "string", "split(image_key, '::', 2)[0]"),
    "key_base": ("image_key string", "string", "get(split(image_key, '::', 2), 1)"),
    "strip_text": ("t string", "string", r"regexp_replace(t, r'(?U)^\s+|\s+$', '')"),
    "word_count": ("t string", "bigint", r"cast(size(filter(split(t, r'(?U)\s+'), w -> w <> '')) as bigint)"),
    "text_slug": ("t string", "string", r"regexp_replace(substring(t, 1, 50), r'[^\p{L}\p{N} _-]', '_')"),
    "manifest_prompt": ("p string, prompt string, name string", "string", "coalesce(nullif(p, ''), nullif(prompt, ''), name)"),
    "hash_uniform": ("seed string, row_key string", "double", "cast(conv(substring(md5(concat(seed, ':', row_key)), 1, 8), 16, 10) as double) / 4294967296.0D"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {result} return {body}")
    return [*FUNCTIONS]
