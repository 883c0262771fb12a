"""Row numbers over groups of any size.

``row_number`` over a plain window sorts a whole group in one task. Here rows are first
range-partitioned by (keys, order), so a hot group spreads over many partitions; each
partition numbers its own part and adds the count of the parts before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialize


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Add a 0-based position per ``keys`` in ``order``; the order columns must make rows unique."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df, "rows").repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id())
    placed = materialize(placed, "ranges")  # fixes which row sits in which slice
    sizes = placed.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    # one row per (keys, slice): at most as many per key as there are partitions
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    cond = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = placed.withColumn("_local", local).join(offsets, cond)
    return numbered.select(*df.columns, (F.col("_local") + F.col("_offset")).alias(out))


def dense_positions(df: DataFrame, keys: list[str], value: str, out: str = "pos") -> DataFrame:
    """The distinct values per ``keys`` with their 0-based rank: keys, value, out."""
    return number_rows(df.select(*keys, value).distinct(), keys, [value], out)


def assign_ids(new_rows: DataFrame, type_col: str, upk: str, offsets: DataFrame) -> DataFrame:
    """Next ids per type, ``Type%07d``, continuing after the stored ``offsets(type, last_no)``."""
    numbered = number_rows(new_rows, [type_col], [upk], "_pos")
    known = offsets.select(F.col("type").alias(type_col), "last_no")
    nth = F.coalesce(F.col("last_no"), F.lit(0)) + F.col("_pos") + 1
    return numbered.join(known, type_col, "left").select(
        *new_rows.columns, F.format_string("%s%07d", F.col(type_col), nth.cast("bigint")).alias("id")
    )


def smallest_gap(df: DataFrame, value: str) -> DataFrame:
    """The smallest gap between sorted distinct values, and the decimals needed to show it: gap, digits."""
    ranked = number_rows(df.filter(F.col(value).isNotNull()).select(value).distinct(), [], [value], "pos")
    following = ranked.select((F.col("pos") - 1).alias("pos"), F.col(value).alias("_next"))
    gap = ranked.join(following, "pos").agg(F.min(F.col("_next") - F.col(value)).alias("gap"))
    return gap.select("gap", display_digits(F.col("gap")).alias("digits"))


def display_digits(gap):
    """Leading zeros after the decimal point; the exponent when the number prints as one; 0 without decimals."""
    text = gap.cast("string")
    zeros = F.length(F.regexp_extract(text, r"\.(0*)[1-9]", 1))
    power = F.regexp_extract(text, r"E-(\d+)$", 1).cast("int")
    return F.when(gap < 1e-6, power).when(gap == F.floor(gap), 0).when(text.contains("E-"), power - 1).otherwise(zeros)
