"""What sectioned CSV arrays say about themselves, and their values as tables.

Works on the lines of ``brick_files.scan_brick_csv``. An array has either ``values`` lines, one per value column, or none:
then the lines of its first dimension are the value columns, further dimensions count from one less, and the first index
of a data row selects the column.

``terms(term_id, term_name, target, scalar_type)`` tells how values of a term are typed: ``target`` is null (plain),
``oref`` (a term: an id and a name column) or the referenced column ``sdt_<table>_<column>``. ``below(child_id, parent_id,
is_below)`` is as for ``brick_column_names``. Both are small beside the data; Spark sees their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import term_id_of, term_name_of
from gridloom.session import materialize
from gridloom.sources.brick_files import brick_column_names

#: The two columns of a term, and what an id refers to.
TERM_COLUMNS = ("sys_oterm_id", "sys_oterm_name")
TERM_KEY = "sys_oterm.sys_oterm_id"


def _field(n: int) -> Column:
    return F.get("fields", F.lit(n))


def _rest(n: int) -> Column:
    """Fields from the n-th on."""
    return F.when(F.size("fields") > n, F.slice("fields", F.lit(n + 1), F.size("fields"))).otherwise(F.array().cast("array<string>"))


def _term(col: Column) -> Column:
    return F.struct(term_id_of(col).alias("id"), term_name_of(col).alias("name"))


def meta(lines: DataFrame) -> DataFrame:
    """Context lines: brick_key, n (from 1, in file order), property term, units (the unpaired last term), values."""
    head = lines.filter("is_head AND token = 'meta'")
    given = F.filter(_rest(1), lambda x: x != "")
    order = Window.partitionBy("brick_key").orderBy("section")  # the context lines of one array
    return head.select(
        "brick_key", F.row_number().over(order).alias("n"), term_id_of(_field(1)).alias("property_id"), term_name_of(_field(1)).alias("property_name"), given.alias("line")
    ).filter(F.size("line") > 0)


def _forms(lines: DataFrame) -> DataFrame:
    """brick_key, merged: whether the first dimension becomes columns."""
    return lines.filter("is_head").groupBy("brick_key").agg((F.count_if((F.col("token") == "values") & (F.size("fields") > 1)) == 0).alias("merged"))


def variables(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per variable, with term names where known: brick_key, place (to order by), kind, dim, pos (which value column,
    or index of the first dimension), dim_id, dim_name, var_id, var_name, extra, unit_id, unit_name, comment, target,
    scalar_type, line."""
    forms = _forms(lines)
    head = lines.filter("is_head")
    values = head.filter((F.col("token") == "values") & (F.size("fields") > 1)).select(
        "brick_key", "section", F.lit(0).alias("at"), F.lit("variable").alias("kind"), F.lit(None).cast("int").alias("dim"),
        F.lit(None).cast("struct<id:string,name:string>").alias("d"), _term(_field(1)).alias("v"), F.transform(_rest(2), _term).alias("e"), "fields",
    )
    marks = head.filter((F.col("token") == "dmeta") & (F.size("fields") > 3)).select(
        "brick_key", "section", F.lit(0).alias("at"), F.lit("dimension_variable").alias("kind"), _field(1).try_cast("int").alias("dim"),
        _term(_field(2)).alias("d"), _term(_field(3)).alias("v"), F.transform(_rest(4), _term).alias("e"), "fields",
    )
    marks = marks.join(forms, "brick_key")
    merged = marks.filter("merged AND dim = 1").select("brick_key", "section")
    lists = lines.filter("NOT is_head AND token = 'dmeta'").join(merged, ["brick_key", "section"], "left_semi")
    lists = lists.filter(_field(0).rlike("^[0-9]+$")).select(
        "brick_key", "section", _field(0).try_cast("int").alias("at"), F.lit("variable").alias("kind"), F.lit(None).cast("int").alias("dim"),
        F.lit(None).cast("struct<id:string,name:string>").alias("d"), _term(F.coalesce(_field(1), F.lit(""))).alias("v"), F.transform(_rest(2), _term).alias("e"), "fields",
    )
    marks = marks.filter("NOT (merged AND dim = 1)").withColumn("dim", F.col("dim") - F.col("merged").cast("int")).drop("merged")
    found = values.unionByName(marks).unionByName(lists).withColumn("place", F.struct("section", "at"))
    # the variables of one array, or of one of its dimensions
    numbered = Window.partitionBy("brick_key", "kind", "dim").orderBy("place")
    found = found.withColumn("pos", F.row_number().over(numbered))
    found = found.withColumn("index", F.when((F.col("kind") == "variable") & (F.col("at") > 0), F.col("at")).otherwise(F.col("pos")))
    found = materialize(found, "variables")
    names = terms.select(F.col("term_id"), F.col("term_name"))

    def named(df: DataFrame, of: str, out: str) -> DataFrame:
        own = names.select(F.col("term_id").alias(f"{out}_t"), F.col("term_name").alias(f"{out}_n"))
        df = df.join(own, F.col(f"{of}.id") == F.col(f"{out}_t"), "left")
        return df.withColumn(f"{out}_id", F.col(f"{of}.id")).withColumn(f"{out}_name", F.coalesce(f"{out}_n", f"{of}.name")).drop(f"{out}_t", f"{out}_n")

    further = found.select("brick_key", "place", F.posexplode("e").alias("k", "x"))
    further = further.join(names, F.col("x.id") == F.col("term_id"), "left")
    further = further.groupBy("brick_key", "place").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("term_name", "x.name").alias("name")))).alias("x"))
    out = named(named(found, "d", "dim"), "v", "var").join(further.select("brick_key", "place", F.transform("x", lambda s: s["name"]).alias("extra")), ["brick_key", "place"], "left")
    typed = terms.select(F.col("term_id").alias("var_id"), "target", "scalar_type")
    out = out.join(typed, "var_id", "left")
    n = F.size("e")
    unit = F.when(n % 2 == 1, F.get("e", n - 1))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 2, F.lit(2)), lambda i: F.concat_ws("=", F.get("e", i)["name"], F.get("e", i + 1)["name"])))
    comment = F.array_join(F.concat(F.array("var_name"), F.coalesce(pairs, F.array().cast("array<string>"))), ", ")
    return out.select(
        "brick_key", "place", "kind", "dim", "pos", "index", "dim_id", "dim_name", "var_id", "var_name",
        F.coalesce("extra", F.array().cast("array<string>")).alias("extra"), unit["id"].alias("unit_id"), unit["name"].alias("unit_name"),
        comment.alias("comment"), "target", "scalar_type", F.array_join("fields", ",").alias("line"),
    )


def columns(found: DataFrame, below: DataFrame) -> DataFrame:
    """One row per column of each array's wide table, from ``variables``: its name, made unique by position, and part (of
    the variable: from 1)."""
    kind = F.when(F.col("target") == "oref", "oref").when(F.col("target").isNotNull(), "ref")
    target = F.when(F.col("target") == "oref", F.lit(",".join(TERM_COLUMNS))).otherwise(F.col("target"))
    kinds = found.withColumnRenamed("kind", "role").withColumn("role_dim", F.col("dim_id"))
    named = brick_column_names(kinds.withColumn("kind", kind).withColumn("target", target), below)
    rows = named.withColumnRenamed("kind", "typed").withColumnRenamed("role", "kind").select("*", F.posexplode("columns").alias("part", "name"))
    rows = rows.withColumn("first", F.when(F.col("kind") == "variable", 1).otherwise(0))
    order = Window.partitionBy("brick_key", "name").orderBy("first", "place", "part")  # equal names of one array
    again = F.row_number().over(order)
    return rows.withColumn("column_name", F.when(again == 1, F.col("name")).otherwise(F.concat_ws("_", "name", again.cast("string"))))


def typedef_rows(cols: DataFrame) -> DataFrame:
    """Column definitions of every array: type, scalar type, foreign key, units, dimension and variable with their terms."""
    words = F.split("target", "_")
    table = F.concat(F.lit("sdt_"), words[1])
    of_ref = F.when((F.size(words) > 2) & (words[0] == "sdt"), F.concat(table, F.lit("."), F.col("target"))).otherwise(F.col("target"))
    is_id = (F.col("typed") == "oref") & (F.col("part") == 0)
    key = F.when(is_id, F.lit(TERM_KEY)).when(F.col("typed") == "ref", of_ref)
    comment = F.when(is_id, F.concat("comment", F.lit(", ontology term CURIE"))).otherwise(F.col("comment"))
    return cols.select(
        "brick_key", "column_name", F.col("kind").alias("column_type"), "scalar_type", key.alias("foreign_key"), comment.alias("comment"),
        "unit_id", "unit_name", F.col("dim").alias("dimension_number"), "dim_id", "dim_name", F.col("pos").alias("variable_number"),
        "var_id", "var_name", "line",
    )


CELLS_OF_TASK = 250_000  # fixed value: about so many cells are grouped by one task, whatever their number


def _expanded(value: Column, typed: Column) -> Column:
    """The values of a variable's columns: of a term its id and name, of a reference its name, else the text."""
    name = term_name_of(value)
    return F.when(typed == "oref", F.array(term_id_of(value), name)).when(typed == "ref", F.array(name)).otherwise(F.array(value))


def _arrays(lines: DataFrame, cols: DataFrame) -> DataFrame:
    """One row per array with value columns: brick_key, n (dimensions in its data lines), merged, n_cells (as declared),
    per_index (cells per index of each dimension that stays), places (column name to the variables behind it: index, part, typed).

    Value columns of an array are few: they are columns of the wide table.
    """
    sizes = F.max(F.transform(_rest(1), lambda x: x.try_cast("int")))
    shapes = lines.filter("is_head AND token = 'size'").groupBy("brick_key").agg(sizes.alias("size")).filter("size IS NOT NULL")
    own = cols.filter("kind = 'variable'").groupBy("brick_key", "column_name").agg(F.array_sort(F.collect_list(F.struct("index", "part", "typed"))).alias("at"))
    own = own.groupBy("brick_key").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "at"))).alias("places"))
    stay = F.when(F.col("merged"), F.slice("size", F.lit(2), F.greatest(F.size("size") - 1, F.lit(0)))).otherwise(F.col("size"))
    cells = F.aggregate("stay", F.lit(1.0), lambda n, x: n * F.greatest(x, F.lit(1)))
    per_index = F.transform("stay", lambda x: cells / F.greatest(x, F.lit(1)))
    out = shapes.join(_forms(lines), "brick_key").join(own, "brick_key").withColumn("stay", stay)
    return out.select("brick_key", F.size("size").alias("n"), "merged", cells.alias("n_cells"), per_index.alias("per_index"), "places")


def cell_rows(lines: DataFrame, arrays: DataFrame, names: list[str]) -> DataFrame:
    """array_no, at (0-based index array over the dimensions that stay) and the value columns (text), one row per cell.

    A line of data gives its values to their columns by itself; only the wide rows meet, and only by cell.
    """
    data = lines.filter("NOT is_head AND token = 'data'")
    body = data.select("brick_key", "fields").join(arrays, "brick_key").filter(F.size("fields") > F.col("n"))
    index = F.transform(F.slice("fields", F.lit(1), F.col("n")), lambda x: x.try_cast("int") - 1)
    rows = body.select("array_no", "merged", "places", index.alias("index"), F.slice("fields", F.col("n") + 1, F.size("fields")).alias("vals"))
    rows = rows.filter(~F.exists("index", lambda x: x.isNull()))
    at = F.when(F.col("merged"), F.slice("index", F.lit(2), F.size("index"))).otherwise(F.col("index"))

    def here(place: Column) -> Column:  # has the line a value of this variable
        return F.when(F.col("merged"), place["index"] == F.col("index")[0] + 1).otherwise(place["index"].between(1, F.size("vals")))

    def value(place: Column) -> Column:
        text = F.get("vals", F.when(F.col("merged"), 0).otherwise(place["index"] - 1))
        return F.get(_expanded(text, place["typed"]), place["part"])

    any_here = F.exists(F.flatten(F.map_values("places")), here)
    rows = rows.filter(any_here).select(
        "array_no", at.alias("at"),
        *[F.get(F.filter(F.transform(F.filter(F.try_element_at("places", F.lit(c)), here), value), lambda x: x.isNotNull()), F.lit(0)).alias(c) for c in names],
    )
    rows = rows.repartition(-(-data.count() // CELLS_OF_TASK) or 1, "array_no", "at")
    return rows.groupBy("array_no", "at").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def dimension_values(lines: DataFrame, cols: DataFrame) -> DataFrame:
    """array_no, dim, idx (0-based), column_name, value (text); ``cols`` with the numbers of their arrays."""
    own = cols.filter("kind = 'dimension_variable'").withColumn("section", F.col("place.section"))
    body = lines.filter("NOT is_head AND token = 'dmeta'").filter(_field(0).rlike("^[0-9]+$"))
    rows = body.select("brick_key", "section", (_field(0).try_cast("int") - 1).alias("idx"), F.coalesce(_field(1), F.lit("")).alias("value"))
    rows = rows.join(own.select("brick_key", "array_no", "section", "dim", "typed", "part", "column_name"), ["brick_key", "section"])
    return rows.select("array_no", "dim", "idx", "column_name", F.get(_expanded(F.col("value"), F.col("typed")), F.col("part")).alias("value"))


def wide(lines: DataFrame, cols: DataFrame) -> DataFrame:
    """One row per cell, of all arrays: brick_key, the columns of their dimensions, then those of their values.

    Arrays of one kind share their columns; of a column that an array doesn't have the values are null. Cells are dealt to
    as many tasks as their number needs; an index that many cells of its array share is dealt to several.
    """
    cols = materialize(cols, "columns")
    listed = cols.groupBy("kind", "dim", "column_name").agg(F.min(F.struct("place", "part")).alias("p")).orderBy("p").collect()  # column names
    arrays = materialize(_arrays(lines, cols).withColumn("array_no", F.monotonically_increasing_id()), "arrays")
    numbers = arrays.select("brick_key", "array_no", "n_cells", "per_index")
    out = materialize(cell_rows(lines, arrays, [r.column_name for r in listed if r.kind == "variable"]), "cells")
    tasks = -(-out.count() // CELLS_OF_TASK) or 1
    values = dimension_values(lines, cols.join(numbers.select("brick_key", "array_no"), "brick_key"))
    names: list[str] = []
    for dim in sorted({r.dim for r in listed if r.kind == "dimension_variable"}):
        own = [r.column_name for r in listed if r.kind == "dimension_variable" and r.dim == dim]
        here = values.filter(F.col("dim") == dim).repartition(tasks, "array_no", "idx").groupBy("array_no", "idx")
        named = here.agg(*[F.first(F.when(F.col("column_name") == c, F.col("value")), ignorenulls=True).alias(c) for c in own])
        shares = F.greatest(F.ceil(F.coalesce(F.get("per_index", F.lit(dim - 1)), "n_cells") / CELLS_OF_TASK), F.lit(1)).cast("int")
        split = numbers.select("array_no", shares.alias("_shares"))
        named = named.join(split, "array_no").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
        out = out.join(split, "array_no").withColumn("idx", F.get("at", F.lit(dim - 1))).withColumn("_share", F.pmod(F.hash("at"), F.col("_shares"))).drop("_shares")
        keys = ["array_no", "idx", "_share"]
        out = out.repartition(tasks, *keys).join(named.repartition(tasks, *keys), keys, "left").drop("idx", "_share")
        names += own
    out = out.join(numbers.select("array_no", "brick_key"), "array_no")
    return out.select("brick_key", *[n for n in dict.fromkeys(names)], *[r.column_name for r in listed if r.kind == "variable"])


def headers(lines: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per array: name, description, type, shape, types of its dimensions, of their variables and of its values.

    Sizes, dimensions and variables of an array are few. A first dimension that becomes columns is left out.
    """
    head = lines.filter("is_head")
    field = lambda token: F.max(F.when(F.col("token") == token, _field(1)))
    size = F.max(F.when(F.col("token") == "size", F.transform(_rest(1), lambda x: x.try_cast("int"))))
    base = head.groupBy("brick_key").agg(field("name").alias("name"), field("description").alias("description"), field("type").alias("type"), size.alias("size"))
    base = base.join(_forms(lines), "brick_key").withColumn("type_id", term_id_of("type"))
    base = base.join(terms.select(F.col("term_id").alias("type_id"), "term_name"), "type_id", "left")
    shape = F.when(F.col("merged"), F.slice("size", F.lit(2), F.greatest(F.size("size") - 1, F.lit(0)))).otherwise(F.col("size"))
    base = base.select("brick_key", "name", "description", "type_id", F.coalesce("term_name", term_name_of("type")).alias("type_name"), shape.alias("shape"))
    listed = lambda rows, out, *c: rows.groupBy("brick_key").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(out))
    dims = found.filter("kind = 'dimension_variable'").groupBy("brick_key", "dim").agg(
        F.min_by("dim_id", "place").alias("dim_id"), F.min_by("dim_name", "place").alias("dim_name"), F.array_sort(F.collect_list(F.struct("place", "var_id", "var_name"))).alias("v")
    )
    dims = listed(dims, "d", "dim", "dim_id", "dim_name", "v")
    own = listed(found.filter("kind = 'variable'"), "v", "place", "var_id", "var_name")
    out = base.join(dims, "brick_key", "left").join(own, "brick_key", "left")
    pick = lambda col, name: F.transform(col, lambda x: x[name])
    return out.select(
        *base.columns, pick("d", "dim_id").alias("dim_ids"), pick("d", "dim_name").alias("dim_names"),
        F.transform("d", lambda x: F.transform(x["v"], lambda y: y["var_name"])).alias("dim_variables"), pick("v", "var_id").alias("value_ids"), pick("v", "var_name").alias("value_names"),
    )
