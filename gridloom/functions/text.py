"""Scalar functions on names, terms, references and labels. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing" in typed rows, and the wider set used in grids.
NULL_TEXTS = ["null", "NaN", ""]
GRID_NULL_TEXTS = ["null", "NaN", "", "-", "n/a", "N/A"]

# The only texts accepted for a boolean.
TRUE_TEXTS = ["yes", "Yes", "y", "Y", "true", "True", "TRUE", "1"]
FALSE_TEXTS = ["no", "No", "n", "N", "false", "False", "FALSE", "0"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_var_name(col, prefix: str = "") -> Column:
    """Runs of other characters become one underscore; the prefix goes in front."""
    return F.concat(F.lit(prefix), F.regexp_replace(_c(col), r"[^0-9a-zA-Z]+", "_"))


def to_object_type(col) -> Column:
    """``Sample0000012`` -> ``Sample``."""
    return F.regexp_extract(_c(col), r"^([a-zA-Z_]*)", 1)


def normalize_name(col) -> Column:
    """Lower snake case: every run of other characters is one underscore, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(col)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def format_term(name, term_id) -> Column:
    """``name <id>``; one part alone when the other is missing."""
    bracketed = F.concat(F.lit("<"), _c(term_id), F.lit(">"))
    return F.nullif(F.concat_ws(" ", _c(name), bracketed), F.lit(""))


_TERM = r"^\s*(.*?)\s*<([^<>]*)>\s*$"


def term_id_of(col) -> Column:
    return F.nullif(F.trim(F.regexp_extract(_c(col), _TERM, 2)), F.lit(""))


def term_name_of(col) -> Column:
    text = _c(col)
    name = F.when(text.rlike(_TERM), F.regexp_extract(text, _TERM, 1)).otherwise(F.trim(text))
    return F.nullif(name, F.lit(""))


def null_text(col, texts=NULL_TEXTS) -> Column:
    """Texts that stand for a missing value become null."""
    text = F.trim(_c(col))
    return F.when(~text.isin(texts), _c(col))


def nan_to_null(col) -> Column:
    return F.when(~F.isnan(_c(col)), _c(col))


def parse_array(col) -> Column:
    """``[a, b]`` -> array; null and empty give an empty array."""
    inner = F.trim(F.regexp_replace(_c(col), r"^\s*\[|\]\s*$", ""))
    items = F.transform(F.split(inner, ","), lambda x: F.trim(x))
    return F.when(_c(col).isNull() | (inner == ""), F.array().cast("array<string>")).otherwise(items)


def format_value_list(col) -> Column:
    """array -> ``[a, b]``; null gives an empty text."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(_c(col), ", "), F.lit("]")), F.lit(""))


def format_value_map(col) -> Column:
    """map -> ``{k: v}`` in key order; null gives an empty text."""
    entries = F.array_sort(F.map_entries(_c(col)))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")), F.lit(""))


def split_object_list(col) -> Column:
    """Comma list of references; an item may be quoted and then hold commas."""
    found = F.regexp_extract_all(_c(col), F.lit(r'\s*("(?:[^"]|"")*"|[^,]+)\s*(?:,|$)'), 1)
    bare = F.transform(found, lambda x: F.trim(F.regexp_replace(F.trim(x), r'^"|"$', "")))
    return F.filter(bare, lambda x: x != "")


def ref_type(ref) -> Column:
    """Type part of ``Type:id``, split at the first colon only; ``Generic`` is read as ``Brick``."""
    kind = F.trim(F.substring_index(_c(ref), ":", 1))
    return F.when(kind == "Generic", F.lit("Brick")).otherwise(kind)


def ref_key(ref) -> Column:
    """What follows the first colon; null when there is none."""
    at = F.instr(_c(ref), ":")
    return F.when(at > 0, F.trim(F.substr(_c(ref), at + 1)))


def table_of(kind) -> Column:
    """Table of a type: every ``Brick`` or ``Brick-nnn`` goes to the array table."""
    is_brick = (_c(kind) == "Brick") | _c(kind).startswith("Brick-")
    return F.when(is_brick, F.lit("ddt_ndarray")).otherwise(F.concat(F.lit("sdt_"), normalize_name(kind)))


def ref_table(ref) -> Column:
    """Table a reference lives in."""
    return table_of(ref_type(ref))


def full_type(type_name, dim_names) -> Column:
    """``Type<dim1, dim2>``."""
    return F.concat(_c(type_name), F.lit("<"), F.array_join(_c(dim_names), ", "), F.lit(">"))


def long_name(name, attrs, units) -> Column:
    """``name : type = value units ... (units)``; missing parts are left out.

    ``attrs`` is an array of texts already in ``type = value units`` form.
    """
    items = F.coalesce(_c(attrs), F.array().cast("array<string>"))
    context = F.when(F.size(items) > 0, F.concat(F.lit(": "), F.array_join(items, " ")))
    unit = F.concat(F.lit("("), _c(units), F.lit(")"))
    return F.concat_ws(" ", _c(name), context, unit)


def fill_label(pattern: str, values: dict[str, Column | str], missing: str = "N/A") -> Column:
    """Fill ``#V1`` style markers. Longer markers go first so ``#V10`` is not read as ``#V1``."""
    out = F.lit(pattern)
    for marker in sorted(values, key=len, reverse=True):
        value = F.coalesce(_c(values[marker]).cast("string"), F.lit(missing))
        out = F.replace(out, F.lit(marker), value)
    return out


def series_label(parts: list[tuple[str, Column | str]]) -> Column:
    """``name = value`` parts joined with ``; ``."""
    return F.concat_ws(
        "; ", *[F.concat(F.lit(name + " = "), _c(value).cast("string")) for name, value in parts]
    )


def concat_dim_values(*cols) -> Column:
    """One label per index from all variables of a dimension."""
    return F.concat_ws(", ", *[F.coalesce(_c(c).cast("string"), F.lit("N/A")) for c in cols])


def normalize_boolean(col) -> Column:
    """Accepted texts become 1 or 0; everything else is null and counts as an error."""
    return F.when(_c(col).isin(TRUE_TEXTS), F.lit(1)).when(_c(col).isin(FALSE_TEXTS), F.lit(0))


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(col) -> Column:
    """Text as a double, null for what is no number. The cast alone would take ``1d`` and ``2F`` for numbers."""
    text = F.trim(_c(col))
    fine = text.rlike(NUMBER) | F.lower(text).isin("nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
    return F.when(fine, text.try_cast("double"))


def cast_scalar(col, scalar_type: str) -> Column:
    """Cast text by scalar type; what does not parse becomes null."""
    text = _c(col)
    kind = scalar_type.lower()
    if kind == "int":
        return text.try_cast("bigint")
    if kind in ("float", "double"):
        return nan_to_null(number(text))
    if kind in ("bool", "boolean"):
        return normalize_boolean(text)
    return text


def line_thickness(n) -> Column:
    """round(log10 n) + 1."""
    return (F.round(F.log10(_c(n))) + 1).cast("int")


def is_dup_term(id_a, name_a, id_b, name_b) -> Column:
    """Same id, or same name ignoring case."""
    return F.coalesce(
        (_c(id_a) == _c(id_b)) | (F.lower(_c(name_a)) == F.lower(_c(name_b))), F.lit(False)
    )


def words(col) -> Column:
    """Lower-case letter/digit words of a text."""
    return F.filter(F.split(F.lower(_c(col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def comment_json(**fields) -> Column:
    """A column comment as JSON, null fields left out."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in fields.items()]))


def comment_field(col, field: str) -> Column:
    return F.get_json_object(_c(col), "$." + field)


def truncate_list(col, limit: int = 10) -> Column:
    """A list longer than ``limit`` keeps ``limit - 1`` items and says how many are left out."""
    items = _c(col)
    more = F.concat(F.lit("and "), (F.size(items) - (limit - 1)).cast("string"), F.lit(" more"))
    return F.when(F.size(items) > limit, F.concat(F.slice(items, 1, limit - 1), F.array(more))).otherwise(items)


def replace_id_prefix(col, old: str, new: str) -> Column:
    """Rewrite the leading type name of an id."""
    return F.regexp_replace(_c(col), f"^{old}(?=\\d)", new)
