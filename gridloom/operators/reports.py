"""Counts and other aggregates over entities, processes and array catalogs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import number
from gridloom.session import materialize


def term_stat(df: DataFrame, term_col: str, terms: DataFrame, exploded: bool = False) -> DataFrame:
    """Rows per term of a property, largest first: term_id, term_name, n."""
    value = F.explode(term_col) if exploded else F.col(term_col)
    counts = df.select(value.alias("term_id")).groupBy("term_id").agg(F.count("*").alias("n"))
    return counts.join(terms.select("term_id", "term_name"), "term_id", "left").orderBy(F.desc("n"), "term_name")


def lab_rollup(counts: DataFrame, terms: DataFrame, root: str) -> DataFrame:
    """Add each term's count to each direct parent but the root; parents not yet listed are added."""
    own = counts.select("term_id", "n")
    parents = own.join(terms.select("term_id", "parents"), "term_id").select(F.explode("parents").alias("term_id"), "n")
    total = own.unionByName(parents.filter(F.col("term_id") != root)).groupBy("term_id").agg(F.sum("n").alias("n"))
    return total.join(terms.select("term_id", "term_name"), "term_id", "left").orderBy(F.desc("n"), "term_name")


def brick_full_types(bricks: DataFrame) -> DataFrame:
    """Arrays per data type and ordered dimension types, with the total of the data type."""
    pairs = bricks.groupBy("data_type", "dim_types").agg(F.count("*").alias("n"))
    totals = pairs.groupBy("data_type").agg(F.sum("n").alias("total"))
    return pairs.join(totals, "data_type").select("data_type", "total", F.array_join("dim_types", ",").alias("dims"), "n")


def types_stat(tables: dict[str, DataFrame], brick_types: DataFrame) -> DataFrame:
    """Rows per entity type and per array type, by name; an empty table counts 0."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    arrays = brick_types.groupBy("name").agg(F.count("*").alias("n"))
    return functools.reduce(DataFrame.unionByName, [*parts, arrays]).orderBy("name")


def keep_latest_process(process: DataFrame, process_output: DataFrame) -> DataFrame:
    """Processes that have the highest id for any of their outputs, and those without outputs."""
    latest = process_output.groupBy("obj").agg(F.max("process_id").alias("id")).select("id").distinct()
    makes = process_output.select(F.col("process_id").alias("id")).distinct()
    return process.join(latest, "id", "left_semi").unionByName(process.join(makes, "id", "left_anti"))


def multi_producer_objects(process_output: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` objects with the most producers, of those with more than one."""
    counts = process_output.groupBy("obj").agg(F.count_distinct("process_id").alias("producers"))
    return counts.filter("producers > 1").orderBy(F.desc("producers"), "obj").limit(n)


BOOLEAN_TEXTS = ["true", "false", "yes", "no", "1", "0", "t", "f"]  # fixed values
COMPATIBLE = [("oterm_ref", "string"), ("object_ref", "string"), ("float", "double"), ("int", "integer")]  # fixed values


def infer_column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Type of each text column from its non-empty values, in one pass: column, inferred.

    Null when all values are empty.
    """
    aggs = []
    for c in columns:
        v = F.when(F.trim(c) != "", F.trim(c))
        aggs += [
            F.count(v).alias(c + "#n"),
            F.count_if(~F.lower(v).isin(BOOLEAN_TEXTS)).alias(c + "#bool"),
            F.count_if(v.isNotNull() & v.try_cast("decimal(38,0)").isNull() | v.contains(".") | v.rlike("[eE]")).alias(c + "#int"),
            F.count_if(v.isNotNull() & number(v).isNull()).alias(c + "#num"),
        ]
    row = df.agg(*aggs)
    kinds = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(f"`{c}#n`") == 0, F.lit(None))
            .when(F.col(f"`{c}#bool`") == 0, "boolean")
            .when(F.col(f"`{c}#int`") == 0, "integer")
            .when(F.col(f"`{c}#num`") == 0, "double")
            .otherwise("string")
            .alias("inferred"),
        )
        for c in columns
    ]
    return row.select(F.explode(F.array(*kinds)).alias("k")).select("k.column", "k.inferred")


def check_declared_types(inferred: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared against inferred type: column, declared, inferred, final, warning.

    A compatible declaration stays; otherwise the inferred type wins with a warning. Without
    values the declaration, or else string, is taken.
    """
    both = inferred.join(declared, "column", "left")
    low_d, low_i = F.lower("declared"), F.lower("inferred")
    same = low_d == low_i
    for a, b in COMPATIBLE:
        same = same | ((low_d == a) & (low_i == b))
        if b in ("double", "integer"):
            same = same | ((low_d == b) & (low_i == a))
    final = (
        F.when(F.col("inferred").isNull(), F.coalesce("declared", F.lit("string")))
        .when(F.col("declared").isNull() | ~same, F.col("inferred"))
        .otherwise(F.col("declared"))
    )
    warning = F.coalesce(F.col("inferred").isNotNull() & F.col("declared").isNotNull() & ~same, F.lit(False))
    return both.select("column", "declared", "inferred", final.alias("final"), warning.alias("warning"))


def validation_counts(df: DataFrame, checks: dict) -> DataFrame:
    """Total, valid and invalid counts per variable; ``checks`` maps a name to its validity column."""
    aggs = [F.count("*").alias("total_count")]
    aggs += [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()]
    row = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).alias("invalid_count")) for n in checks])
    out = row.select("total_count", F.explode(items).alias("i"))
    return out.select(
        "i.variable",
        "total_count",
        (F.col("total_count") - F.col("i.invalid_count")).alias("valid_count"),
        F.col("i.invalid_count").alias("invalid_count"),
    )


def mapped_ref_count(cells: DataFrame, value: str, targets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """How many cells match each entity property: property, n.

    Cells are first counted per distinct value, so a frequent value joins once.
    """
    counts = cells.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    parts = []
    for name, (df, col) in targets.items():
        known = df.select(F.col(col).cast("string").alias("_v")).distinct()
        hit = counts.join(known, "_v", "left_semi").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
        parts.append(hit.select(F.lit(name).alias("property"), "n"))
    return functools.reduce(DataFrame.unionByName, parts)


def brick_index_rows(brick_terms: DataFrame, closure: DataFrame) -> DataFrame:
    """Search rows per array: brick_id, kind (term, value, ancestor), term_id, value; each once.

    ``brick_terms(brick_id, term_id, value)`` lists every term of attributes, dimensions and
    variables with the values given for it. Rows stay long, so a large array is no large row.
    """
    none = F.lit(None).cast("string")
    brick_terms = materialize(brick_terms.select("brick_id", "term_id", "value").distinct(), "brick_terms")  # read three times
    own = brick_terms.select("brick_id", F.lit("term").alias("kind"), "term_id", none.alias("value"))
    values = brick_terms.filter("value is not null").select("brick_id", F.lit("value").alias("kind"), "term_id", "value")
    pairs = brick_terms.select("brick_id", "term_id").distinct()
    above = pairs.join(closure.select("term_id", "ancestor_id"), "term_id").select(
        "brick_id", F.lit("ancestor").alias("kind"), F.col("ancestor_id").alias("term_id"), none.alias("value")
    )
    return own.unionByName(values).unionByName(above).distinct()


def dim_unique_check(dim: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Per dimension: are the tuples of variable values unique."""
    per = dim.groupBy(*keys, *variables).agg(F.count("*").alias("_n"))
    return per.groupBy(*keys).agg(F.sum("_n").alias("size"), (F.max("_n") == 1).alias("is_unique"))


def distinct_dim_values(dim: DataFrame, idx: str, var: str) -> DataFrame:
    """Unique values in first-seen order: value, first_idx."""
    return dim.groupBy(F.col(var).alias("value")).agg(F.min(idx).alias("first_idx")).orderBy("first_idx")


def map_stats(points: DataFrame) -> DataFrame:
    """Means of position and color; least, greatest and least non-zero color."""
    low = F.min(F.when(F.col("color") != 0, F.col("color")))
    return points.agg(
        F.avg("latitude").alias("mean_latitude"),
        F.avg("longitude").alias("mean_longitude"),
        F.min("color").alias("lowest"),
        F.max("color").alias("highest"),
        low.alias("lowest_non_zero"),
        (F.sum("color") / F.count("*")).alias("average"),
    )
