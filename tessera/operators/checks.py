"""Data-quality checks: the rows that break a rule which a database would enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def breaks(df: DataFrame, rule: Column) -> DataFrame:
    """Rows that break the rule. Null doesn't."""
    return df.filter(~F.coalesce(rule, F.lit(True)))


def tokens_hold() -> Column:
    """Totals are sums, a part is no more than its whole, and cached and written input together neither."""
    c = F.col
    inside = lambda part, whole: F.coalesce((c(part) >= 0) & (c(part) <= c(whole)), F.lit(True))
    both = F.coalesce(c("cached_input_tokens") + c("cache_write_input_tokens") <= c("input_tokens"), F.lit(True))
    return F.coalesce(c("total_tokens") == c("input_tokens") + c("output_tokens"), F.lit(True)) & inside("cached_input_tokens", "input_tokens") & inside("cache_write_input_tokens", "input_tokens") & inside("reasoning_output_tokens", "output_tokens") & both


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    return df.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
