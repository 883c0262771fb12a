"""Type definitions: JSON to rows, column names and Spark schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import normalize_name

FIELD_SCHEMA = """name string, type_term string, scalar_type string, required boolean, PK boolean, UPK boolean,
  FK string, constraint string, units_term string, comment string"""


def _struct(ddl: str) -> str:
    return ", ".join(": ".join(p.split()) for p in ddl.replace("\n", " ").split(","))


def scan_typedefs(spark: SparkSession, path) -> DataFrame:
    """One row per field: type_name, table, pos and the field's entries. A type without a key gets ``id``."""
    types = f"array<struct<name: string, preferred_name: string, fields: array<struct<{_struct(FIELD_SCHEMA)}>>>>"
    doc = spark.read.schema(f"system_types {types}, static_types {types}").json(path, multiLine=True)

    def of(column: str, prefix: str) -> DataFrame:
        t = doc.select(F.explode(column).alias("t"))
        table = F.concat(F.lit(prefix), normalize_name(F.coalesce("t.preferred_name", "t.name")))
        return t.select(F.col("t.name").alias("type_name"), table.alias("table"), F.posexplode("t.fields").alias("pos", "f"))

    rows = of("static_types", "sdt_").unionByName(of("system_types", "sys_")).select("type_name", "table", "pos", "f.*")
    false = F.lit(False)
    rows = rows.withColumns({c: F.coalesce(c, false) for c in ("required", "PK", "UPK")})
    keyed = rows.filter("PK").select("type_name").distinct()
    none = {c: F.lit(None).cast("string") for c in ("type_term", "FK", "constraint", "units_term", "comment")}
    added = rows.select("type_name", "table").distinct().join(keyed, "type_name", "left_anti").withColumns(
        {"pos": F.lit(-1), "name": F.lit("id"), "scalar_type": F.lit("text"), "required": F.lit(True), "PK": F.lit(True), "UPK": false, **none}
    )
    return rows.unionByName(added)


def fk_column(name: Column, ref_type: Column, table: Column, is_array: Column) -> Column:
    """A referenced type inside the name is replaced by its table and ``_name(s)``; otherwise that is appended."""
    low, single = F.lower(name), F.lower(ref_type)
    plural = F.concat(single, F.lit("s"))
    suffix = F.when(is_array, "_names").otherwise("_name")
    at_plural, at_single = F.instr(low, plural), F.instr(low, single)
    at = F.when(at_plural > 0, at_plural).otherwise(at_single)
    length = F.when(at_plural > 0, F.length(plural)).otherwise(F.length(single))
    inside = F.concat(F.substr(low, F.lit(1), at - 1), table, suffix, F.substr(low, at + length))
    return normalize_name(F.when(at > 0, inside).otherwise(F.concat(low, F.lit("_"), table, suffix)))


NUMERIC = ["int", "float", "double"]  # fixed values: scalar types whose unit joins the column name


def column_rows(fields: DataFrame, units: DataFrame) -> DataFrame:
    """One row per table column with its name; a term field gives an id and a name column.

    ``units(term_id, term_name)`` names the units of numeric fields.
    """
    tables = fields.select(F.col("type_name").alias("_ref"), F.col("table").alias("_ref_table")).distinct()
    bare = F.regexp_replace("FK", r"^\[\s*|\s*\]$", "")
    rows = fields.withColumn("_ref", F.substring_index(bare, ".", 1)).join(tables, "_ref", "left")
    rows = rows.join(units.select(F.col("term_id").alias("units_term"), F.col("term_name").alias("unit_name")), "units_term", "left")
    base = normalize_name("name")
    target = F.coalesce("_ref_table", F.lower("_ref"))
    with_unit = F.when(F.lower("scalar_type").isin(NUMERIC), F.concat_ws("_", base, normalize_name("unit_name"))).otherwise(base)
    plain = (
        F.when(F.col("PK"), normalize_name(F.concat("table", F.lit("_id"))))
        .when(F.col("UPK"), normalize_name(F.concat("table", F.lit("_name"))))
        .when(F.col("FK").isNotNull(), fk_column(F.col("name"), F.col("_ref"), target, F.col("FK").startswith("[")))
        .when(base == "description", normalize_name(F.concat("table", F.lit("_description"))))
        .otherwise(with_unit)
    )
    names = F.when(
        F.col("scalar_type") == "term", F.array(F.concat(base, F.lit("_sys_oterm_id")), F.concat(base, F.lit("_sys_oterm_name")))
    ).otherwise(F.array(plain))
    fk = F.when((F.col("scalar_type") == "term") & (F.col("part") == 0), "sys_oterm.id").otherwise(F.col("FK"))
    return rows.select("*", F.posexplode(names).alias("part", "column")).withColumn("fk_ref", fk)


def spark_type(scalar_type: str) -> T.DataType:
    if scalar_type.startswith("["):
        return T.ArrayType(spark_type(scalar_type[1:-1].strip()), containsNull=False)
    return {"int": T.IntegerType(), "float": T.DoubleType(), "double": T.DoubleType(), "bool": T.BooleanType()}.get(
        scalar_type.lower(), T.StringType()
    )


def schemas_of(columns: DataFrame) -> dict[str, T.StructType]:
    """The schema of every type. Only column metadata comes to the driver, in one job."""
    fields: dict[str, list[T.StructField]] = {}
    for r in columns.orderBy("type_name", "pos", "part").toLocalIterator():
        metadata = {"orig_name": r["name"], "is_pk": r["PK"], "is_upk": r["UPK"]}
        for key, value in (("fk", r["fk_ref"]), ("units_sys_oterm_id", r["units_term"]), ("type_sys_oterm_id", r["type_term"])):
            if value is not None:
                metadata[key] = value
        fields.setdefault(r["type_name"], []).append(T.StructField(r["column"], spark_type(r["scalar_type"]), not r["required"], metadata))
    return {name: T.StructType(own) for name, own in fields.items()}


def schema_of(columns: DataFrame, type_name: str) -> T.StructType:
    """The schema of one type."""
    return schemas_of(columns.filter(F.col("type_name") == type_name)).get(type_name, T.StructType([]))


def build_typedef_table(columns: DataFrame, terms: DataFrame) -> DataFrame:
    """All column definitions with unit and type names filled in from the terms."""
    kinds = terms.select(F.col("term_id").alias("type_term"), F.col("term_name").alias("type_sys_oterm_name"))
    return columns.join(kinds, "type_term", "left").select(
        "type_name",
        F.col("name").alias("field_name"),
        F.col("column").alias("cdm_column_name"),
        "scalar_type",
        F.col("required").alias("is_required"),
        F.col("PK").alias("is_pk"),
        F.col("UPK").alias("is_upk"),
        F.col("fk_ref").alias("fk"),
        F.col("units_term").alias("units_sys_oterm_id"),
        F.col("unit_name").alias("units_sys_oterm_name"),
        F.col("type_term").alias("type_sys_oterm_id"),
        "type_sys_oterm_name",
    )
