"""Row filters: comparisons, membership, full text and ontology terms.

Criteria follow ``{prop: value}`` or ``{prop: {op: value}}``. Filters of one property and
one comparison are OR-ed; all others are AND-ed; full-text filters are OR-ed together.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import words

# Accepted spellings of each comparison.
OPERATIONS = {
    "=": "==", "==": "==", "eq": "==",
    ">": ">", "gt": ">",
    ">=": ">=", "gte": ">=",
    "<": "<", "lt": "<",
    "<=": "<=", "lte": "<=",
    "in": "in",
    "like": "match", "match": "match", "fulltext": "match",
}
_COMPARE = {
    "==": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "!=": operator.ne,
}
DATA_TYPE_ROOT = "DA:0000000"  # fixed value: names given for data_type are looked up below this term


@dataclass(frozen=True)
class Prop:
    """A searchable property: its scalar type and the column it lives in."""

    scalar_type: str
    column: str


@dataclass
class EntityType:
    """A typed table. ``vertex`` names the column holding its ``Type:id`` reference."""

    name: str
    df: DataFrame
    props: dict[str, Prop]
    pk: str = "id"
    upk: str | None = None
    vertex: str = "vertex"


@dataclass
class Condition:
    prop: str
    op: str
    value: object


class Ontology:
    """Terms and their closure; either may be a function, called when first needed."""

    def __init__(self, terms, closure):
        self._terms, self._closure = terms, closure

    @property
    def terms(self) -> DataFrame:
        return self._terms() if callable(self._terms) else self._terms

    @property
    def closure(self) -> DataFrame:
        return self._closure() if callable(self._closure) else self._closure


def parse_criteria(criteria: dict | None, etype: EntityType) -> list[Condition]:
    out = []
    for prop, spec in (criteria or {}).items():
        if prop not in etype.props:
            raise ValueError(f"Unknown property {prop}")
        for op, value in (spec if isinstance(spec, dict) else {"==": spec}).items():
            if op.lower() not in OPERATIONS:
                raise ValueError(f"Unknown operation: {op}")
            out.append(Condition(prop, OPERATIONS[op.lower()], value))
    return out


def compare(col: Column | str, op: str, value) -> Column:
    """One comparison; ``op`` in any accepted spelling."""
    left = F.col(col) if isinstance(col, str) else col
    return _COMPARE[OPERATIONS.get(op, op)](left, F.lit(value))


def query_words(query: str) -> list[tuple[str, bool]]:
    """The words of a full-text query, in lower case, and whether each is a beginning."""
    out = []
    for part in query.replace(",", " ").split():
        part = part.removeprefix("+")
        prefix = part.startswith("prefix:")
        part = part.removeprefix("prefix:")
        out += [(word, prefix) for word in "".join(ch if ch.isalnum() else " " for ch in part.lower()).split()]
    return out


def has_words(col, query: str) -> Column:
    """All words of ``query`` occur in the text. ``+w`` marks a word, ``prefix:w`` a word beginning.

    Words are runs of letters and digits, compared in lower case. The text is split once for all of them.
    """
    wanted = query_words(query)
    if not wanted:
        return F.lit(False)
    exact = [w for w, prefix in wanted if not prefix]
    begun = [w for w, prefix in wanted if prefix]

    def met(tokens: Column) -> Column:
        tests = [F.array_contains(tokens, w) for w in exact] + [F.exists(tokens, _begins(w)) for w in begun]
        return functools.reduce(operator.and_, tests)

    return F.get(F.transform(F.array(words(col)), met), F.lit(0))


def _begins(word: str):
    return lambda token: token.startswith(word)


def exact_pattern(value: str) -> str:
    """Every word must occur."""
    return ",".join("+" + w for w in value.split(" "))


def prefix_pattern(value: str) -> str:
    """As ``exact_pattern`` but the last word may be a beginning."""
    *head, last = value.split(" ")
    return ",".join(["+" + w for w in head] + ["prefix:" + last])


def below(terms: DataFrame, closure: DataFrame, ancestor: str, with_self: bool = False) -> DataFrame:
    """Terms under ``ancestor``."""
    ids = closure.filter(F.col("ancestor_id") == ancestor).select("term_id")
    if with_self:
        ids = ids.unionByName(terms.filter(F.col("term_id") == ancestor).select("term_id"))
    return terms.join(ids.distinct(), "term_id", "left_semi")


def is_term_id(text: str) -> bool:
    space, _, rest = text.partition(":")
    return bool(rest) and " " not in text and space.isalnum()


def resolve_terms(ontology: Ontology, value, scope: str | None = None, pattern: bool = False) -> DataFrame:
    """Ids of the terms meant by an id, a name, a list of them, a word pattern, or a table of ids: term_id.

    A name is looked up below ``scope`` when given; an id is taken as it is.
    """
    if isinstance(value, DataFrame):
        return value.select("term_id").distinct()
    terms = ontology.terms
    if pattern:
        pool = below(terms, ontology.closure, scope) if scope else terms
        return pool.filter(has_words("term_name", value)).select("term_id").distinct()
    values = value if isinstance(value, list) else [value]
    ids = [v for v in values if is_term_id(v)]
    names = [v for v in values if not is_term_id(v)]
    found = terms.filter(F.col("term_id").isin(ids)).select("term_id")
    if names:
        pool = below(terms, ontology.closure, scope) if scope else terms
        found = found.unionByName(pool.filter(F.col("term_name").isin(names)).select("term_id"))
    return found.distinct()


def semi_any(df: DataFrame, pk: str, array_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose array holds any of ``ids(term_id)``: matched on exploded keys, then by key."""
    hits = df.select(pk, F.explode(array_col).alias("term_id")).join(ids, "term_id", "left_semi").select(pk)
    return df.join(hits.distinct(), pk, "left_semi")


def apply_conditions(df: DataFrame, conditions: list[Condition], etype: EntityType, ontology: Ontology | None = None) -> DataFrame:
    """Filter ``df`` by all conditions; column predicates first, term joins after them."""
    groups: dict[tuple[str, str], list[Column]] = {}
    plain: list[Column] = []
    fulltext: list[Column] = []
    term_equal: dict[str, list[DataFrame]] = {}
    term_sets: list[tuple[str, DataFrame]] = []
    for c in conditions:
        prop = etype.props[c.prop]
        if prop.scalar_type in ("term", "[term]"):
            if c.op not in ("==", "in", "match"):
                raise ValueError(f"{c.op} has no meaning for the term property {c.prop}")
            scope = DATA_TYPE_ROOT if c.prop == "data_type" else None
            ids = resolve_terms(ontology, c.value, scope, c.op == "match")
            if prop.scalar_type == "term" and not isinstance(c.value, list) and c.op == "==":
                term_equal.setdefault(prop.column, []).append(ids)
            else:
                term_sets.append((c.prop, ids))
        elif prop.scalar_type.startswith("["):
            col = F.col(prop.column)
            if isinstance(c.value, list):
                plain.append(F.arrays_overlap(col, F.array(*[F.lit(v) for v in c.value])))
            else:
                plain.append(F.array_contains(col, c.value))
        elif c.op == "match":
            fulltext.append(has_words(prop.column, c.value))
        elif c.op == "in":
            plain.append(F.col(prop.column).isin(c.value if isinstance(c.value, list) else [c.value]))
        else:
            groups.setdefault((prop.column, c.op), []).append(compare(prop.column, c.op, c.value))
    plain += [functools.reduce(operator.or_, alts) for alts in groups.values()]
    if fulltext:
        plain.append(functools.reduce(operator.or_, fulltext))
    for p in plain:
        df = df.filter(p)
    for column, alternatives in term_equal.items():
        ids = functools.reduce(DataFrame.unionByName, alternatives)
        df = df.join(ids.select(F.col("term_id").alias(column)), column, "left_semi")
    for name, ids in term_sets:
        prop = etype.props[name]
        if prop.scalar_type == "term":
            df = df.join(ids.select(F.col("term_id").alias(prop.column)), prop.column, "left_semi")
        else:
            df = semi_any(df, etype.pk, prop.column, ids)
    return df


def coerce_value(text: str, scalar_type: str):
    """Query text to the value of a property type."""
    if scalar_type == "int":
        return int(text)
    if scalar_type in ("float", "double"):
        return float(text)
    return text


def starts_with_ci(col, text: str) -> Column:
    return F.lower(F.col(col) if isinstance(col, str) else col).startswith(text.lower())


def has_props(df: DataFrame, props: list[str]) -> DataFrame:
    """Rows where every given property exists."""
    return df.dropna(how="any", subset=props)


def types_with_props(typedef: DataFrame, props: list[str]) -> DataFrame:
    """Types that declare every property, from ``typedef(type_name, field_name)`` rows."""
    wanted = sorted(set(props))
    return (
        typedef.filter(F.col("field_name").isin(wanted))
        .groupBy("type_name")
        .agg(F.count_distinct("field_name").alias("n"))
        .filter(F.col("n") == len(wanted))
        .select("type_name")
    )


def find_one(df: DataFrame, pk: str) -> DataFrame:
    """The first match by primary key, or nothing."""
    return df.orderBy(pk).limit(1)
