"""Ordering, limits and set operations on result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import format_term


def sort_desc_count(df: DataFrame, count: str, name: str) -> DataFrame:
    return df.orderBy(F.desc(count), name)


def labs_first(df: DataFrame, name: str) -> DataFrame:
    """Names ending in " Lab" before all others, then by name."""
    return df.orderBy(~F.col(name).endswith(" Lab"), name)


def head_n(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def preview_values(long_vars: DataFrame, keys: list[str], idx: str, value: str, n: int) -> DataFrame:
    """First ``n`` values per variable in index order, whether more follow, and the size.

    Indices are 0-based and dense, so the first values are found by index and never more than
    ``n`` of them meet in one group.
    """
    sizes = long_vars.groupBy(*keys).agg(F.count("*").alias("size"))
    first = long_vars.filter(F.col(idx) < n).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(idx, F.col(value).cast("string").alias("v")))).alias("_l")
    )
    shown = F.transform("_l", lambda s: s["v"])
    shown = F.when(F.col("size") > n, F.concat(shown, F.array(F.lit("...")))).otherwise(shown)
    return sizes.join(first, keys, "left").select(*keys, "size", shown.alias("preview"))


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def intersect_rows(df: DataFrame, others: list[DataFrame], pk: str) -> DataFrame:
    """Rows whose key is in every other result."""
    for o in others:
        df = df.join(o.select(pk), pk, "left_semi")
    return df


def distinct_rows(df: DataFrame, pk: str) -> DataFrame:
    return df.dropDuplicates([pk])


def table_view(df: DataFrame, public: list[str], pk: str = "id") -> DataFrame:
    """Public columns, the key first."""
    return df.select(pk, *[c for c in public if c != pk])


def drop_term_ids(df: DataFrame) -> DataFrame:
    """Where both ``x_term_id`` and ``x_term_name`` exist, keep the name as ``x``."""
    stems = [c[: -len("_term_id")] for c in df.columns if c.endswith("_term_id")]
    both = [s for s in stems if s + "_term_name" in df.columns]
    return df.drop(*[s + "_term_id" for s in both]).withColumnsRenamed({s + "_term_name": s for s in both})


def merge_term(df: DataFrame) -> DataFrame:
    """``x_term_name`` and ``x_term_id`` become ``x`` = ``name <id>``."""
    out: list[Column] = []
    for c in df.columns:
        stem = c.removesuffix("_term_name")
        if stem != c and stem + "_term_id" in df.columns:
            out.append(format_term(c, stem + "_term_id").alias(stem))
        elif not (c.endswith("_term_id") and c.removesuffix("_term_id") + "_term_name" in df.columns):
            out.append(F.col(c))
    return df.select(*out)
