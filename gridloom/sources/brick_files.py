"""Array files: JSON documents, JSON blocks, sectioned CSV and long CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.text import normalize_name, term_id_of, term_name_of
from gridloom.session import materialize

_TERM = "struct<oterm_ref: string, oterm_name: string, term_name: string>"
_VALUES = (
    "struct<scalar_type: string, string_values: array<string>, float_values: array<double>, double_values: array<double>,"
    " int_values: array<bigint>, boolean_values: array<boolean>, oterm_refs: array<string>, object_refs: array<string>>"
)
_TYPED = f"array<struct<value_type: {_TERM}, value_units: {_TERM}, values: {_VALUES}>>"
_VALUE = "struct<scalar_type: string, string_value: string, float_value: double, int_value: bigint, oterm_ref: string, object_ref: string>"
DOCUMENT = (
    f"name string, description string, n_dimensions int, data_type {_TERM},"
    f" array_context array<struct<value_type: {_TERM}, value: {_VALUE}, value_units: {_TERM}>>,"
    f" dim_context array<struct<data_type: {_TERM}, size: int, typed_values: {_TYPED}>>, typed_values {_TYPED}"
)


def scan_brick_json(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Array documents, one row each. ``multi_line`` is off for one document per line."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=multi_line)


def _texts(values: Column) -> Column:
    """The values of a typed list as text, whatever field they came in."""
    kinds = ("string_values", "float_values", "double_values", "int_values", "boolean_values", "oterm_refs", "object_refs")
    return F.coalesce(*[values[k].cast("array<string>") for k in kinds])


def brick_headers(docs: DataFrame) -> DataFrame:
    """name, type, dimension sizes and names, context attributes as ``type=value``."""
    shown = F.transform(
        F.coalesce("array_context", F.array().cast(docs.schema["array_context"].dataType)),
        lambda a: F.concat(
            a["value_type"]["oterm_name"],
            F.lit("="),
            F.coalesce(
                a["value"]["string_value"], a["value"]["float_value"].cast("string"), a["value"]["int_value"].cast("string"),
                a["value"]["oterm_ref"], a["value"]["object_ref"], F.lit(""),
            ),
        ),
    )
    return docs.select(
        "name",
        F.col("data_type.oterm_ref").alias("type_term_id"),
        F.col("data_type.oterm_name").alias("type_term_name"),
        F.transform("dim_context", lambda d: d["size"]).alias("shape"),
        F.transform("dim_context", lambda d: d["data_type"]["oterm_name"]).alias("dim_types"),
        shown.alias("attrs"),
    )


def brick_dims(docs: DataFrame) -> DataFrame:
    """One row per (array, dimension, variable, index): 1-based dim and var, 0-based idx."""
    d = docs.select("name", F.posexplode("dim_context").alias("dim", "d"))
    v = d.select("name", (F.col("dim") + 1).alias("dim"), F.col("d.data_type.oterm_name").alias("dim_type"), F.posexplode("d.typed_values").alias("var", "tv"))
    return v.select(
        "name", "dim", "dim_type", (F.col("var") + 1).alias("var"), F.col("tv.value_type.oterm_name").alias("var_type"),
        F.col("tv.values.scalar_type").alias("scalar_type"), F.posexplode(_texts(F.col("tv.values"))).alias("idx", "value"),
    )


def brick_cells(docs: DataFrame) -> DataFrame:
    """One row per (array, data variable, position) with 0-based row-major indices as an array."""
    tv = docs.select("name", F.transform("dim_context", lambda d: d["size"]).alias("shape"), F.posexplode("typed_values").alias("var", "tv"))
    flat = tv.select(
        "name", "shape", F.col("tv.value_type.oterm_name").alias("data_var"), F.col("tv.values.scalar_type").alias("scalar_type"),
        F.posexplode(_texts(F.col("tv.values"))).alias("pos", "value"),
    )
    return flat.select("name", "data_var", "scalar_type", "pos", unravel_array(F.col("pos"), F.col("shape")).alias("idx"), "value")


def unravel_array(pos: Column, shape: Column) -> Column:
    """Row-major position to an array of 0-based indices, the shape being data: the last index runs fastest."""
    steps = F.transform(
        shape, lambda _, n: F.aggregate(F.slice(shape, n + 2, F.size(shape)), F.lit(1).cast("bigint"), lambda a, s: a * s)
    )
    return F.zip_with(steps, shape, lambda step, size: (F.floor(pos / step) % size).cast("int"))


BLOCK = 4096  # cells per JSON block, so that no array becomes one large row


def brick_to_json(headers: DataFrame, dims: DataFrame, cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Arrays as JSON texts: a header per array, and value blocks of at most ``block`` entries.

    ``headers(brick_id, ...)``, ``dims(brick_id, dim, var, idx, value)``,
    ``cells(brick_id, data_var, pos, value)``; rows: brick_id, kind, key, offset, json.
    """
    head = headers.select("brick_id", F.lit("header").alias("kind"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("offset"), F.to_json(F.struct("*")).alias("json"))

    def blocks(df: DataFrame, kind: str, key: Column, at: str) -> DataFrame:
        rows = df.select("brick_id", key.alias("key"), (F.floor(F.col(at) / block) * block).alias("offset"), F.col(at).cast("bigint").alias("at"), F.col("value"))
        items = F.array_sort(F.collect_list(F.struct("at", "value")))
        grouped = rows.groupBy("brick_id", "key", "offset").agg(items.alias("_items"))
        whole = F.struct(
            "brick_id", "key", "offset",
            F.transform("_items", lambda s: s["at"] - F.col("offset")).alias("at"), F.transform("_items", lambda s: s["value"]).alias("values"),
        )
        return grouped.select("brick_id", F.lit(kind).alias("kind"), "key", "offset", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))

    return (
        head.unionByName(blocks(dims, "dim", F.concat_ws("/", F.col("dim").cast("string"), "var"), "idx"))
        .unionByName(blocks(cells, "data", F.col("data_var"), "pos"))
    )


def scan_json_blocks(texts: DataFrame, kind: str, value_type: str) -> DataFrame:
    """Blocks back to rows: brick_id, key, pos, value."""
    schema = f"brick_id string, key string, offset bigint, at array<bigint>, values array<{value_type}>"
    rows = texts.filter(F.col("kind") == kind).select(F.from_json("json", schema).alias("b"))
    pairs = F.arrays_zip(F.col("b.at").alias("at"), F.col("b.values").alias("value"))
    return rows.select("b.brick_id", "b.key", "b.offset", F.explode(pairs).alias("p")).select(
        "brick_id", "key", (F.col("offset") + F.col("p.at")).alias("pos"), F.col("p.value").alias("value")
    )


def brick_to_csv(cells: DataFrame, idx: list[str], values: list[str], path: str) -> None:
    """Long CSV with 1-based indices: ``1,1,0.01``."""
    rows = cells.select(*[(F.col(i) + 1).cast("string").alias(i) for i in idx], *[F.col(v).cast("string").alias(v) for v in values])
    rows.write.csv(path, header=False, nullValue="")


# ---- sectioned CSV ----

# First fields of the lines that open a section.
SECTIONS = ["name", "description", "type", "meta", "values", "size", "dmeta", "data"]


def csv_fields(line) -> Column:
    """Fields of a CSV line; quoted fields may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), 1)
    return F.transform(
        raw,
        lambda f: F.trim(F.when(f.startswith('"'), F.replace(F.regexp_replace(f, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f)),
    )


def scan_brick_csv(spark: SparkSession, path) -> DataFrame:
    """Lines of sectioned CSV files with the section they stand in.

    Rows: brick_key (where the array starts), section (where its section starts), token (what
    opened it), is_head, fields. A file may hold several arrays, each opened by its ``name`` line.

    Files are read in splits. Inside a split the last opened section is carried down its lines;
    a split that begins inside a section takes it from the splits before, of which only the last
    opened section of each is compared. So a large file is never sorted in one task.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    lines = materialize(lines.filter(F.trim("value") != ""), "lines")  # fixes the line numbers
    first = F.trim(F.substring_index("value", ",", 1))
    at = F.struct("block", "line")
    marked = lines.select(
        "*",
        F.when(first.isin(SECTIONS), F.struct(at.alias("at"), first.alias("token"))).alias("opens"),
        F.when(first == "name", at).alias("starts"),
    )
    run = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.select("*", F.last("opens", True).over(run).alias("_section"), F.last("starts", True).over(run).alias("_start"))
    ends = marked.groupBy("file", "block").agg(F.max("opens").alias("e_section"), F.max("starts").alias("e_start"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "file", "block", F.last("e_section", True).over(before).alias("c_section"), F.last("e_start", True).over(before).alias("c_start")
    )
    rows = inside.join(carried, ["file", "block"])
    section, start = F.coalesce("_section", "c_section"), F.coalesce("_start", "c_start")
    key = F.concat_ws("#", "file", start["block"].cast("string"), start["line"].cast("string"))
    return rows.select(
        key.alias("brick_key"), section["at"].alias("section"), section["token"].alias("token"),
        F.col("opens").isNotNull().alias("is_head"), csv_fields("value").alias("fields"),
    )


def sectioned_headers(lines: DataFrame) -> DataFrame:
    """One row per array: name, description, type, sizes, number of values lines. Header lines are few by nature."""
    head = lines.filter("is_head")
    field = lambda token: F.max(F.when(F.col("token") == token, F.get("fields", F.lit(1))))
    return head.groupBy("brick_key").agg(
        field("name").alias("name"), field("description").alias("description"),
        term_id_of(field("type")).alias("type_term_id"), term_name_of(field("type")).alias("type_term_name"),
        F.max(F.when(F.col("token") == "size", F.transform(F.slice("fields", F.lit(2), F.size("fields")), lambda x: x.try_cast("int")))).alias("shape"),
        F.count_if(F.col("token") == "values").alias("n_values_lines"),
    )


def sectioned_dims(lines: DataFrame) -> DataFrame:
    """Dimension variable values: brick_key, dim, dim_type, var_type, idx (0-based), value."""
    head = lines.filter("is_head AND token = 'dmeta'").select(
        "brick_key", "section", F.get("fields", F.lit(1)).try_cast("int").alias("dim"),
        term_name_of(F.get("fields", F.lit(2))).alias("dim_type"), term_name_of(F.get("fields", F.lit(3))).alias("var_type"),
    )
    body = lines.filter("NOT is_head AND token = 'dmeta'").select(
        "brick_key", "section", (F.get("fields", F.lit(0)).try_cast("int") - 1).alias("idx"), F.get("fields", F.lit(1)).alias("value")
    )
    return body.join(head, ["brick_key", "section"]).drop("section")


def sectioned_cells(lines: DataFrame) -> DataFrame:
    """Data rows: brick_key, idx (0-based index array), vals (texts)."""
    shapes = sectioned_headers(lines).select("brick_key", F.size("shape").alias("n"))
    body = lines.filter("NOT is_head AND token = 'data'").join(shapes, "brick_key")
    idx = F.transform(F.slice("fields", F.lit(1), F.col("n")), lambda x: x.try_cast("int") - 1)
    vals = F.slice("fields", F.col("n") + 1, F.size("fields"))
    rows = body.filter(F.size("fields") > F.col("n")).select("brick_key", idx.alias("idx"), vals.alias("vals"))
    return rows.filter(~F.exists("idx", lambda x: x.isNull()))


# ---- column naming and column definitions ----


def brick_column_names(variables: DataFrame, below: DataFrame) -> DataFrame:
    """Wide column names per variable: ``variables`` plus ``columns``.

    ``variables(dim_id, dim_name, var_id, var_name, extra array, kind, target)``; kind is null
    (plain), ``oref`` (a term: id and name column, target holds the two suffixes joined by ``,``)
    or ``ref`` (target is the referenced column). ``below(child_id, parent_id, is_below)`` says
    whether the variable is the dimension term or under it; then the prefix is dropped.
    """
    known = below.select(F.col("child_id").alias("var_id"), F.col("parent_id").alias("dim_id"), "is_below").distinct()
    rows = variables.join(known, ["var_id", "dim_id"], "left")
    omit = F.coalesce("is_below", F.lit(False)) | F.coalesce(F.col("var_id") == F.col("dim_id"), F.lit(False))
    var, dim = normalize_name("var_name"), normalize_name("dim_name")
    extras = F.transform("extra", normalize_name)
    prefix = F.when(~omit & (dim != var), F.array(dim)).otherwise(F.array().cast("array<string>"))
    plain = F.array_join(F.concat(F.coalesce(prefix, F.array().cast("array<string>")), F.array(var), extras), "_")
    of_term = F.array_join(F.concat(F.when(omit & F.col("dim_id").isNotNull(), F.array().cast("array<string>")).otherwise(F.array(var)), extras), "_")
    of_term = F.coalesce(F.nullif(of_term, F.lit("")), var)
    ends = F.transform(F.split("target", ","), lambda s: F.concat_ws("_", of_term, s))
    ref = F.array_join(F.concat(extras, F.array("target")), "_")
    names = F.when(F.col("kind") == "oref", ends).when(F.col("kind") == "ref", F.array(ref)).otherwise(F.array(plain))
    return rows.select(*variables.columns, names.alias("columns"))


def expand_term_values(value: Column | str, kind: str | None) -> list[Column]:
    """A term value gives id and name, a reference its name only, anything else itself."""
    text = F.col(value) if isinstance(value, str) else value
    if kind == "oref":
        return [term_id_of(text), term_name_of(text)]
    return [term_name_of(text)] if kind == "ref" else [text]


def brick_typedef_rows(variables: DataFrame, headers: DataFrame) -> DataFrame:
    """Numbered column definitions per array.

    ``variables(brick_id, seq, dim, name)``: dim is null for data variables. Variables are
    numbered per dimension; dimension numbers shift by one when no values line exists, since
    the first dimension is then merged into columns. ``headers(brick_id, has_values)``.
    """
    order = Window.partitionBy("brick_id", "dim").orderBy("seq")  # the variables of one dimension
    rows = variables.join(headers, "brick_id").withColumn("variable_number", F.row_number().over(order))
    shift = F.when(F.col("has_values"), 0).otherwise(1)
    kind = F.when(F.col("dim").isNull(), "variable").otherwise("dimension_variable")
    return rows.select("brick_id", "seq", "name", kind.alias("data_type"), (F.col("dim") - shift).alias("dimension_number"), "variable_number")


def build_ndarray_table(headers: DataFrame, dims: DataFrame, data_vars: DataFrame) -> DataFrame:
    """One metadata row per array: shape, dimension types, variable types.

    ``dims(brick_id, dim, dim_type, size)`` and ``data_vars(brick_id, seq, name)`` hold the few
    dimensions and variables of an array.
    """
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    d = dims.groupBy("brick_id").agg(listed("dim", "dim_type", "size").alias("_d"))
    v = data_vars.groupBy("brick_id").agg(listed("seq", "name").alias("_v"))
    return headers.join(d, "brick_id", "left").join(v, "brick_id", "left").select(
        *headers.columns,
        F.array_join(F.transform("_d", lambda x: x["size"].cast("string")), ",").alias("shape"),
        F.transform("_d", lambda x: x["dim_type"]).alias("dim_types"),
        F.transform("_v", lambda x: x["name"]).alias("value_types"),
    )


def union_brick_metadata(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Metadata files of many arrays as one table."""
    return spark.read.csv(paths, schema=schema, header=True)

