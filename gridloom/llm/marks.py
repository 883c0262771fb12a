"""Marks on the rows of a stored table: bitmaps by row number, one bit per row and mark.

A join on row numbers would deal the texts by number as soon as the other side is too large to broadcast. Here only numbers
are dealt; the bitmaps are some thousand times smaller than texts and meet them where they are, broadcast as long as their
measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize

#: Row numbers per bitmap, as a power of two: what ``bitmap_construct_agg`` holds.
BITMAP_BITS = 15


def marked(docs: DataFrame, row: str, rows: DataFrame, **marks: Column) -> DataFrame:
    """``docs`` with a boolean column per mark: whether ``rows`` has the row's number in a row that fulfils the condition.

    ``row`` names the number in both; it must be stored with ``docs``, not worked out again.
    """
    bucket, place = F.shiftright(row, BITMAP_BITS), F.col(row).bitwiseAND((1 << BITMAP_BITS) - 1)
    # dealt by bitmap before they are built, so that no task builds parts of all bitmaps
    numbers = rows.select(bucket.alias("mark_bucket"), place.alias("mark_place"), *[c.alias(f"mark_{m}") for m, c in marks.items()])
    built = [F.bitmap_construct_agg(F.when(F.col(f"mark_{m}"), F.col("mark_place"))).alias(f"mark_{m}") for m in marks]
    maps = materialize(numbers.repartition("mark_bucket").groupBy("mark_bucket").agg(*built), "marks")

    def bit(bitmap: str) -> Column:
        byte = F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
        return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), place.bitwiseAND(7).cast("int")) == 1, F.lit(False))

    met = docs.join(maps, bucket == F.col("mark_bucket"), "left")
    return met.select(*docs.columns, *[bit(f"mark_{m}").alias(m) for m in marks])
