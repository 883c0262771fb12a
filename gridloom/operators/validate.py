"""Checks of incoming rows, arrays and templates. A check gives error rows; nothing stops at the first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import cast_scalar, null_text, number, term_id_of, term_name_of

_TERM_FORM = r"^\s*[^<>]*<[^<>:]+:[^<>]+>\s*$"


# ---- single values ----


def matches(col, pattern: str) -> Column:
    """A regular expression matched at the start only."""
    return (F.col(col) if isinstance(col, str) else col).rlike(f"^(?:{pattern})")


def all_match(col: str, pattern: str) -> Column:
    """Every item of a comma list matches at its start."""
    return F.forall(F.split(col, ","), lambda x: x.rlike(f"^(?:{pattern})"))


def in_range(col: str, low, high) -> Column:
    return F.col(col).between(low, high)


def is_term_form(col: str) -> Column:
    return F.col(col).rlike(_TERM_FORM)


def int_text(col: str) -> Column:
    return F.col(col).rlike(r"^-?\d+$")


def float_text(col: str) -> Column:
    return F.col(col).rlike(r"^-?\d+(?:[.]\d*?)?$")


# ---- entity rows ----


@dataclass(frozen=True)
class Rule:
    """What one property must satisfy; unset parts are not checked."""

    prop: str
    required: bool = False
    regex: str | None = None
    list_regex: str | None = None
    range: tuple | None = None
    root_term: str | None = None
    target: tuple[DataFrame, str] | None = None


def error_rows(df: DataFrame, pk: str, checks: list[tuple[str, Column, Column | str]]) -> DataFrame:
    """One row per failed (row, property, message), all column checks in one pass."""
    found = [
        F.when(F.coalesce(failed, F.lit(False)), F.struct(F.lit(prop).alias("property"), (F.lit(msg) if isinstance(msg, str) else msg).alias("message")))
        for prop, failed, msg in checks
    ]
    errors = F.filter(F.array(*found), lambda e: e.isNotNull())
    return df.select(pk, F.explode(errors).alias("e")).select(pk, "e.property", "e.message")


def validate_entity(df: DataFrame, pk: str, rules: list[Rule], closure: DataFrame | None = None) -> DataFrame:
    """Every broken rule as (pk, property, message)."""
    checks: list[tuple[str, Column, Column | str]] = []
    for r in rules:
        v = F.col(r.prop)
        if r.required:
            checks.append((r.prop, null_text(v.cast("string")).isNull(), "required"))
        if r.regex:
            checks.append((r.prop, ~matches(v, r.regex), "does not follow the constraint"))
        if r.list_regex:
            checks.append((r.prop, ~all_match(r.prop, r.list_regex), "an item does not follow the constraint"))
        if r.range:
            checks.append((r.prop, ~in_range(r.prop, *r.range), f"not in the range [{r.range[0]}, {r.range[1]}]"))
        if r.root_term:
            checks.append((r.prop, ~is_term_form(r.prop), "not a term"))
    out = error_rows(df, pk, checks)
    for r in rules:
        if r.root_term:
            bad = validate_term(df, r.prop, r.root_term, closure)
            out = out.unionByName(bad.select(pk, F.lit(r.prop).alias("property"), F.lit("not below " + r.root_term).alias("message")))
        if r.target:
            target, key = r.target
            bad = validate_ufk(df, r.prop, target, key)
            out = out.unionByName(bad.select(pk, F.lit(r.prop).alias("property"), F.lit("reference not found").alias("message")))
    return out


def validate_term(df: DataFrame, prop: str, root: str, closure: DataFrame) -> DataFrame:
    """Rows with a well-formed term that is neither the root nor below it."""
    allowed = closure.filter(F.col("ancestor_id") == root).select(F.col("term_id").alias("_t")).distinct()
    tagged = df.filter(is_term_form(prop)).withColumn("_t", term_id_of(prop)).filter(F.col("_t") != root)
    return tagged.join(allowed, "_t", "left_anti").select(df.columns)


def validate_ufk(df: DataFrame, prop: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not a key of the target; missing references are left to ``required``."""
    known = target.select(F.col(key).alias("_k"))
    given = df.withColumn("_k", null_text(F.col(prop).cast("string"))).filter("_k is not null")
    return given.join(known.withColumn("_k", F.col("_k").cast("string")), "_k", "left_anti").select(df.columns)


def validate_columns(have: DataFrame, declared: DataFrame) -> DataFrame:
    """Required columns that are missing and columns that are not declared.

    ``have(type_name, column)``, ``declared(type_name, column, required)``.
    """
    missing = declared.filter("required").join(have, ["type_name", "column"], "left_anti")
    extra = have.join(declared, ["type_name", "column"], "left_anti")
    return missing.select("type_name", "column", F.lit("missing").alias("problem")).unionByName(
        extra.select("type_name", "column", F.lit("undeclared").alias("problem"))
    )


# ---- array cells ----


def cast_terms(cells: DataFrame, value: str, terms: DataFrame, closure: DataFrame, parent: str) -> DataFrame:
    """Cells with the term their text names: by id, or by name ignoring case; it must be below ``parent``.

    Ids and names share one lookup table, so the cells are joined once. Of several terms of one
    name the least id is taken. Adds term_id and error.
    """
    ids = terms.select(F.concat(F.lit("id "), "term_id").alias("_key"), "term_id")
    names = terms.groupBy(F.concat(F.lit("name "), F.lower("term_name")).alias("_key")).agg(F.min("term_id").alias("term_id"))
    below = closure.filter(F.col("ancestor_id") == parent).select("term_id", F.lit(True).alias("_ok")).distinct()
    found = ids.unionByName(names).join(below, "term_id", "left")
    text = F.col(value)
    key = F.when(text.contains(":"), F.concat(F.lit("id "), text)).otherwise(F.concat(F.lit("name "), F.lower(text)))
    out = cells.withColumn("_key", key).join(found, "_key", "left")
    error = F.when(F.col(value).isNull() | F.col("_ok"), F.lit(None)).when(
        F.col("term_id").isNull(), F.concat(F.lit("Can not find term: "), value)
    ).otherwise(F.lit("Term without valid parent " + parent))
    return out.select(*cells.columns, F.when(F.col("_ok"), F.col("term_id")).alias("term_id"), error.alias("error"))


def cast_object_refs(cells: DataFrame, value: str, entity: DataFrame, key: str, prop: str) -> DataFrame:
    """Cells with an error where the text is no key of the entity."""
    known = entity.select(F.col(key).cast("string").alias("_v")).distinct().withColumn("_ok", F.lit(True))
    out = cells.join(known, F.col(value) == F.col("_v"), "left")
    error = F.when(F.col(value).isNotNull() & F.col("_ok").isNull(), "Mapping to core type " + prop)
    return out.select(*cells.columns, error.alias("error"))


def validate_brick_cells(cells: DataFrame, idx: list[str], variables: dict[str, str]) -> DataFrame:
    """Cells whose text does not cast to the declared type of its variable: idx, variable, value, error."""
    found = [
        F.when(
            F.col(v).isNotNull() & cast_scalar(v, kind).isNull(),
            F.struct(F.lit(v).alias("variable"), F.col(v).alias("value"), F.lit("not " + kind).alias("error")),
        )
        for v, kind in variables.items()
    ]
    errors = F.filter(F.array(*found), lambda e: e.isNotNull())
    return cells.select(*idx, F.explode(errors).alias("e")).select(*idx, "e.variable", "e.value", "e.error")


def cell_counts(cells: DataFrame, variables: dict[str, str]) -> DataFrame:
    """variable, total_count, valid_count, invalid_count for the same check."""
    bad = [F.count_if(F.col(v).isNotNull() & cast_scalar(v, kind).isNull()).alias(v) for v, kind in variables.items()]
    row = cells.agg(F.count("*").alias("total_count"), *bad)
    items = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("bad")) for v in variables])
    out = row.select("total_count", F.explode(items).alias("i"))
    return out.select(
        "i.variable", "total_count", (F.col("total_count") - F.col("i.bad")).alias("valid_count"), F.col("i.bad").alias("invalid_count")
    )


def validate_shape(dims: DataFrame, cells: DataFrame) -> DataFrame:
    """Per array: do the variables of a dimension have equal length, and is the cell count the product of the sizes.

    ``dims(brick_id, dim, var, idx)``, ``cells(brick_id, ...)``: brick_id, vars_ok, n_expected, n_cells, shape_ok.
    """
    lengths = dims.groupBy("brick_id", "dim", "var").agg(F.count("*").alias("n"))
    per_dim = lengths.groupBy("brick_id", "dim").agg(F.max("n").alias("size"), (F.min("n") == F.max("n")).alias("same"))
    per_brick = per_dim.groupBy("brick_id").agg(
        F.product(F.col("size")).cast("bigint").alias("n_expected"), F.bool_and("same").alias("vars_ok")
    )
    counts = cells.groupBy("brick_id").agg(F.count("*").alias("n_cells"))
    n = F.coalesce("n_cells", F.lit(0))
    return per_brick.join(counts, "brick_id", "left").select(
        "brick_id", "vars_ok", "n_expected", n.alias("n_cells"), (F.col("vars_ok") & (n == F.col("n_expected"))).alias("shape_ok")
    )


def validate_grid_headers(headers: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Header tuples that stand over more than one group of interlaced columns: keys, levels, n."""
    return headers.groupBy(*keys, *levels).agg(F.count("*").alias("n")).filter("n > 1")


def validate_units(rows: DataFrame, microtypes: DataFrame, closure: DataFrame) -> DataFrame:
    """Rows whose units are not allowed: row_id, term_id, units_id, error.

    ``rows(row_id, term_id, units_id)``; ``microtypes(term_id, valid_units, valid_units_parents)``.
    Allowed are units listed by the microtype or below a listed parent; a microtype without
    both has no units.
    """
    given = rows.filter("units_id is not null").join(microtypes, "term_id")
    none = F.array().cast("array<string>")
    listed, parents = F.coalesce("valid_units", none), F.coalesce("valid_units_parents", none)
    no_units = (F.size(listed) == 0) & (F.size(parents) == 0)
    direct = given.select("row_id", "term_id", "units_id", no_units.alias("_none"), F.array_contains(listed, F.col("units_id")).alias("_listed"), parents.alias("_p"))
    open_rows = direct.filter("NOT _none AND NOT _listed")
    pairs = open_rows.select("units_id", F.explode("_p").alias("ancestor_id")).distinct()
    ok = pairs.join(closure.select(F.col("term_id").alias("units_id"), "ancestor_id"), ["units_id", "ancestor_id"])
    hit = open_rows.select("row_id", "units_id", F.explode("_p").alias("ancestor_id")).join(ok, ["units_id", "ancestor_id"], "left_semi").select("row_id")
    bad = open_rows.join(hit.distinct(), "row_id", "left_anti").select("row_id", "term_id", "units_id", F.lit("units not below a valid parent").alias("error"))
    return bad.unionByName(direct.filter("_none").select("row_id", "term_id", "units_id", F.lit("type has no units").alias("error")))


def validate_type_value(rows: DataFrame, microtypes: DataFrame, terms: DataFrame, closure: DataFrame) -> DataFrame:
    """Rows whose value does not suit the microtype: row_id, error.

    ``rows(row_id, term_id, value_id, value_text)``; ``microtypes(term_id, scalar_type, valid_values_parent)``.
    """
    given = rows.join(microtypes, "term_id")
    found = terms.select(F.col("term_id").alias("value_id"), F.lit(True).alias("_known"))
    above = closure.select(F.col("term_id").alias("value_id"), F.col("ancestor_id").alias("valid_values_parent"), F.lit(True).alias("_below")).distinct()
    full = given.join(found, "value_id", "left").join(above, ["value_id", "valid_values_parent"], "left")
    kind = F.col("scalar_type")
    error = (
        F.when((kind == "oterm_ref") & F.col("_known").isNull(), "value term not found")
        .when((kind == "oterm_ref") & F.col("valid_values_parent").isNotNull() & F.col("_below").isNull(), "value not below the valid parent")
        .when((kind == "int") & ~F.col("value_text").rlike(r"^-?\d+$"), "value is not int")
        .when((kind == "float") & number(F.col("value_text")).isNull(), "value is not float")
    )
    return full.select("row_id", error.alias("error")).filter("error is not null")


def check_term_names(cells: DataFrame, key: str, value: str, terms: DataFrame) -> DataFrame:
    """Texts in term form must name an existing term by its right name: key, value, error."""
    known = terms.select(F.col("term_id").alias("_id"), F.col("term_name").alias("_name"))
    tagged = cells.filter(F.col(value).isNotNull()).select(key, value, F.when(is_term_form(value), term_id_of(value)).alias("_id"), term_name_of(value).alias("_given"))
    error = (
        F.when(F.col("_id").isNull(), "not a term")
        .when(F.col("_name").isNull(), "unknown term")
        .when(F.col("_name") != F.col("_given"), F.concat(F.lit("wrong name, expected "), "_name"))
    )
    return tagged.join(known, "_id", "left").select(key, value, error.alias("error")).filter("error is not null")


def check_date_range(df: DataFrame, pk: str, today: Column, required: list[str], start: str, end: str) -> DataFrame:
    """Missing fields, dates in the future, and starts after their end: pk, property, message."""
    checks = [(c, null_text(F.col(c).cast("string")).isNull(), "missing") for c in required]
    checks += [
        (start, F.col(start) > today, "start in the future"),
        (end, F.col(end) > today, "end in the future"),
        (start, F.col(start) > F.col(end), "start after end"),
    ]
    return error_rows(df, pk, checks)


# ---- templates ----

_T = "struct<id: string, text: string>"
TEMPLATES = (
    f"data_type string, text string, children array<struct<text: string, properties: array<struct<property: {_T}, value: {_T}, units: {_T}>>,"
    f" dims: array<struct<type: {_T}, dim_vars: array<struct<type: {_T}, units: {_T}>>>>,"
    f" data_vars: array<struct<type: {_T}, units: {_T}>>, process: {_T}>>"
)


def scan_templates(spark, path, multi_line: bool = False) -> DataFrame:
    """Array type templates, one type per row."""
    return spark.read.schema(TEMPLATES).json(path, multiLine=multi_line)


def template_terms(types: DataFrame) -> DataFrame:
    """Every term a template uses: brick_type, template, part, term_id, name, units_id, units_name."""
    none = F.lit(None).cast("string")

    def rows(df, part, term, units=None):
        return df.select(
            "brick_type", "template", F.lit(part).alias("part"), term["id"].alias("term_id"), term["text"].alias("name"),
            (units["id"] if units is not None else none).alias("units_id"), (units["text"] if units is not None else none).alias("units_name"),
        )

    own = types.select(F.col("text").alias("brick_type"), none.alias("template"), F.struct(F.col("data_type").alias("id"), F.col("text").alias("text")).alias("t"))
    t = types.select(F.col("text").alias("brick_type"), F.explode("children").alias("c")).select("brick_type", F.col("c.text").alias("template"), "c")
    props = t.select("brick_type", "template", F.explode("c.properties").alias("p"))
    dims = t.select("brick_type", "template", F.explode("c.dims").alias("d"))
    dim_vars = dims.select("brick_type", "template", F.explode("d.dim_vars").alias("v"))
    data_vars = t.select("brick_type", "template", F.explode("c.data_vars").alias("v"))
    parts = [
        rows(own, "brick:type", F.col("t")),
        rows(props, "property:type", F.col("p.property"), F.col("p.units")),
        rows(props.filter("p.value is not null"), "property:value", F.col("p.value")),
        rows(dims, "dimension:type", F.col("d.type")),
        rows(dim_vars, "dimension:variable:type", F.col("v.type"), F.col("v.units")),
        rows(data_vars, "data:variable:type", F.col("v.type"), F.col("v.units")),
        rows(t, "process:type", F.col("c.process")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_templates(types: DataFrame, terms: DataFrame) -> DataFrame:
    """Ids that do not exist and names that do not match: brick_type, template, part, term_id, error."""
    used = template_terms(types)
    units = used.filter("units_id is not null").select(
        "brick_type", "template", F.concat("part", F.lit(":units")).alias("part"), F.col("units_id").alias("term_id"), F.col("units_name").alias("name")
    )
    every = used.filter("term_id is not null").select("brick_type", "template", "part", "term_id", "name").unionByName(units)
    known = terms.select("term_id", F.col("term_name").alias("_name"))
    error = F.when(F.col("_name").isNull(), "term not found").when(
        F.col("_name") != F.col("name"), F.concat(F.lit("wrong name, expected "), "_name")
    )
    return every.join(known, "term_id", "left").select("brick_type", "template", "part", "term_id", error.alias("error")).filter("error is not null")
