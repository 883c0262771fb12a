"""Array documents in JSON, read as variants: whatever an array holds is kept, and what can't be read is told.

Values may be nested lists, as deep as there are dimensions; they are taken apart level by level, so an index comes from
the places in the lists. A flat list is in row-major order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.brick_files import unravel_array

#: What the lists of a scalar type are called, besides ``<scalar type>_values``.
LISTS = {"oterm_ref": "oterm_refs", "object_ref": "object_refs"}
VALUES = {"oterm_ref": "oterm_ref", "object_ref": "object_ref"}


def _at(doc: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, f"$.{path}", kind)


def _list(doc: Column | str, path: str) -> Column:
    """The elements of a list; of a single object a list of it, as old files have."""
    many = F.try_variant_get(doc, f"$.{path}", "array<variant>")
    one = F.try_variant_get(doc, f"$.{path}", "variant")
    found = F.coalesce(many, F.when(F.schema_of_variant(one).startswith("OBJECT"), F.array(one)))
    return F.coalesce(found, F.array().cast("array<variant>"))


def _text(value: Column) -> Column:
    """A single value as text: what a text holds, otherwise as JSON writes it; null for null, lists and objects."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID"), F.lit(None)).otherwise(F.try_variant_get(value, "$", "string"))


def scan_documents(spark: SparkSession, path, whole_files: bool = True) -> DataFrame:
    """file, text, doc: documents as variants, a file or a line each; ``doc`` is null where the text is no JSON."""
    rows = spark.read.text(path, wholetext=whole_files).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.where(F.trim("text") != "").withColumn("doc", F.try_parse_json("text"))


def _faults(doc: Column) -> Column:
    sizes = F.transform(_list(doc, "dim_context"), lambda d: F.try_variant_get(d, "$.size", "int"))
    return (
        F.when(doc.isNull(), "not JSON")
        .when(~F.schema_of_variant(doc).startswith("OBJECT"), "not an object")
        .when(_at(doc, "name").isNull(), "no name")
        .when(F.size(_list(doc, "typed_values")) == 0, "no values")
        .when(F.exists(sizes, lambda s: s.isNull()), "a dimension without a size")
    )


def rejected(rows: DataFrame) -> DataFrame:
    """file, text, fault: the documents that ``accepted`` leaves out."""
    return rows.select("file", "text", _faults(F.col("doc")).alias("fault")).where(F.col("fault").isNotNull())


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(_faults(F.col("doc")).isNull()).select("file", _at("doc", "name").alias("name"), "doc")


def _attributes(context: Column) -> Column:
    """Type, units, scalar type and value of each attribute; booleans and numbers as text."""

    def one(a: Column) -> Column:
        kind = F.try_variant_get(a, "$.value.scalar_type", "string")
        keys = [F.when(kind == k, _text(F.try_variant_get(a, f"$.value.{v}", "variant"))) for k, v in VALUES.items()]
        own = [F.when(kind == k, _text(F.try_variant_get(a, f"$.value.{k}_value", "variant"))) for k in ("string", "text", "float", "double", "int", "integer", "boolean", "bool")]
        both = F.when(kind == "boolean", _text(F.try_variant_get(a, "$.value.bool_value", "variant"))).when(kind == "bool", _text(F.try_variant_get(a, "$.value.boolean_value", "variant")))
        return F.struct(
            _at(a, "value_type.oterm_ref").alias("type_id"), _at(a, "value_type.oterm_name").alias("type_name"),
            _at(a, "value_units.oterm_ref").alias("units_id"), _at(a, "value_units.oterm_name").alias("units_name"),
            kind.alias("scalar_type"), F.coalesce(*keys, *own, both, _text(F.try_variant_get(a, "$.value.string_value", "variant"))).alias("value"),
        )

    return F.transform(context, one)


def headers(docs: DataFrame) -> DataFrame:
    """One row per array: name, description, type, sizes and types of the dimensions, attributes."""
    dims = _list("doc", "dim_context")
    return docs.select(
        "file", "name", _at("doc", "description").alias("description"), _at("doc", "data_type.oterm_ref").alias("type_id"), _at("doc", "data_type.oterm_name").alias("type_name"),
        F.transform(dims, lambda d: F.try_variant_get(d, "$.size", "int")).alias("shape"), F.transform(dims, lambda d: _at(d, "data_type.oterm_ref")).alias("dim_ids"),
        F.transform(dims, lambda d: _at(d, "data_type.oterm_name")).alias("dim_names"), _attributes(_list("doc", "array_context")).alias("attributes"),
    )


def _described(rows: DataFrame, v: str, keep: list[str]) -> DataFrame:
    """The variable ``v`` with its type, units, scalar type, context, and list of values as one variant."""
    kind = _at(v, "values.scalar_type")
    named = [F.when(kind == k, F.try_variant_get(v, f"$.values.{n}", "variant")) for k, n in LISTS.items()]
    kinds = ("string", "text", "float", "double", "int", "integer", "boolean", "bool")
    plain = [F.try_variant_get(v, f"$.values.{k}_values", "variant") for k in kinds]
    own = [F.when(kind == k, p) for k, p in zip(kinds, plain, strict=True)]
    return rows.select(
        *keep, _at(v, "value_type.oterm_ref").alias("type_id"), _at(v, "value_type.oterm_name").alias("type_name"),
        _at(v, "value_units.oterm_ref").alias("units_id"), _at(v, "value_units.oterm_name").alias("units_name"), kind.alias("scalar_type"),
        _attributes(_list(v, "value_context")).alias("context"), F.coalesce(*named, *own, *plain).alias("values"),
    )


def variables(docs: DataFrame) -> DataFrame:
    """Every variable of every array: dim (null: a data variable), var (from 1), type, units, scalar type, context, values."""
    dims = docs.select("file", "name", F.posexplode(_list("doc", "dim_context")).alias("dim", "d"))
    dims = dims.select("file", "name", (F.col("dim") + 1).alias("dim"), F.posexplode(_list("d", "typed_values")).alias("var", "v"))
    data = docs.select("file", "name", F.lit(None).cast("int").alias("dim"), F.posexplode(_list("doc", "typed_values")).alias("var", "v"))
    return _described(dims.unionByName(data).withColumn("var", F.col("var") + 1), "v", ["file", "name", "dim", "var"])


def dimension_values(found: DataFrame) -> DataFrame:
    """file, name, dim, var, idx (from 0), value (text)."""
    rows = found.where(F.col("dim").isNotNull()).select("file", "name", "dim", "var", F.posexplode(F.try_variant_get("values", "$", "array<variant>")).alias("idx", "v"))
    return rows.select("file", "name", "dim", "var", "idx", _text(F.col("v")).alias("value"))


def cells(docs: DataFrame, found: DataFrame) -> DataFrame:
    """file, name, var, idx (0-based, one per dimension), value (text).

    Each level of nested lists is one step; a list at the last level runs over all dimensions that remain, row-major.
    The steps are as many as an array has dimensions at most.
    """
    shapes = docs.select("file", "name", F.transform(_list("doc", "dim_context"), lambda d: F.try_variant_get(d, "$.size", "int")).alias("shape"))
    rows = found.where(F.col("dim").isNull()).select("file", "name", "var", F.col("values").alias("v")).join(shapes, ["file", "name"])
    rows = rows.select("file", "name", "var", "shape", F.array().cast("array<int>").alias("path"), "v")
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    for _ in range(deepest):
        # a single value stays as it is; a list gives its elements
        elements = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, k: F.struct(F.concat("path", F.array(k)).alias("path"), x.alias("v")))
        rows = rows.select("file", "name", "var", "shape", F.inline(F.coalesce(elements, F.array(F.struct("path", "v")))))
    depth = F.size("path")
    head = F.when(depth > 1, F.slice("path", F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>"))
    rest = F.slice("shape", F.greatest(depth, F.lit(1)), F.size("shape"))
    tail = unravel_array(F.coalesce(F.get("path", depth - 1), F.lit(0)), rest)
    rows = rows.where((F.size("shape") == 0) | (depth > 0)).select("file", "name", "var", F.concat(head, tail).alias("idx"), _text(F.col("v")).alias("value"))
    return rows
