"""The array catalog: storing arrays and reading their metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_brick(
    catalog: DataFrame,
    process: DataFrame,
    brick_type: str,
    type_no: str,
    name: str,
    process_term: str,
    person_term: str,
    campaign_term: str,
    input_objects: list[str],
) -> tuple[DataFrame, DataFrame]:
    """Append an array with the next id and the process that made it: (catalog, process) with the new rows.

    ``catalog(id, name, data_type)`` and ``process(id, process, person, campaign, date_start,
    date_end, input_objects, output_objects)``; ids end in seven digits.
    """

    def next_id(df: DataFrame, prefix: str) -> DataFrame:
        last = F.max(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint"))
        return df.agg(F.format_string(prefix + "%07d", F.coalesce(last, F.lit(0)) + 1).alias("id"))

    today = F.date_format(F.current_date(), "yyyy-MM-dd")
    new = next_id(catalog, "Brick").select("id", F.lit(name).alias("name"), F.lit(brick_type).alias("data_type"))
    output = new.select(F.array(F.concat(F.lit(f"Brick-{type_no}:"), "id")).alias("output_objects"), F.lit(1).alias("_k"))
    made = next_id(process, "Process").select(
        "id",
        F.lit(process_term).alias("process"),
        F.lit(person_term).alias("person"),
        F.lit(campaign_term).alias("campaign"),
        today.alias("date_start"),
        today.alias("date_end"),
        F.array(*[F.lit(o) for o in input_objects]).alias("input_objects"),
        F.lit(1).alias("_k"),
    )
    record = made.join(output, "_k").drop("_k")
    return catalog.unionByName(new), process.unionByName(record)


def add_attr(df: DataFrame, attrs: str, type_term: str, value, units: str | None = None) -> DataFrame:
    """Append a context attribute to the ``attrs`` array of every row."""
    item = F.struct(F.lit(type_term).alias("type_term"), value.cast("string").alias("value"), F.lit(units).cast("string").alias("units"))
    return df.withColumn(attrs, F.array_append(attrs, item))
