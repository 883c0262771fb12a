"""Term lookups. ``terms`` has one row per term with a ``parents`` array and flags;
``closure(term_id, ancestor_id)`` holds every ancestor."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.filters import below, exact_pattern, has_words, prefix_pattern
from gridloom.session import materialize, materialize_counted


def build_terms(sources: list[DataFrame]) -> DataFrame:
    """Merge term tables; on a repeated id the first source wins."""
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    merged = functools.reduce(DataFrame.unionByName, tagged)
    return merged.groupBy("term_id").agg(F.min_by(F.struct("*"), "source_no").alias("r")).select("r.*").drop("source_no")


def describe(terms: DataFrame) -> DataFrame:
    """Definition followed by the synonyms in brackets."""
    known = F.when(F.size("synonyms") > 0, F.concat(F.lit("["), F.array_join("synonyms", "; "), F.lit("]")))
    return terms.withColumn("description", F.concat_ws(" ", "definition", known))


def with_ancestors(terms: DataFrame, closure: DataFrame) -> DataFrame:
    """Add the sorted ancestor ids of a term; their number is bounded by the depth of the ontology."""
    lists = closure.groupBy("term_id").agg(F.array_sort(F.collect_set("ancestor_id")).alias("ancestors"))
    return terms.join(lists, "term_id", "left").withColumn(
        "ancestors", F.coalesce("ancestors", F.array().cast("array<string>"))
    )


def term_by_ids(terms: DataFrame, ids: DataFrame) -> DataFrame:
    return terms.join(ids.select("term_id").distinct(), "term_id", "left_semi")


def term_by_name(terms: DataFrame, closure: DataFrame, names: DataFrame, scope: str | None = None, ignore_case: bool = False) -> DataFrame:
    """Terms with any of ``names(name)``, optionally only below ``scope``."""
    pool = below(terms, closure, scope) if scope else terms
    own, other = (F.lower("term_name"), F.lower("name")) if ignore_case else (F.col("term_name"), F.col("name"))
    return pool.join(names.select(other.alias("_k")).distinct(), own == F.col("_k"), "left_semi")


def term_pattern(terms: DataFrame, closure: DataFrame, pattern: str, scope: str | None = None) -> DataFrame:
    pool = below(terms, closure, scope) if scope else terms
    return pool.filter(has_words("term_name", pattern))


def term_prefix(terms: DataFrame, closure: DataFrame, value: str, scope: str | None = None) -> DataFrame:
    return term_pattern(terms, closure, prefix_pattern(value), scope)


def term_roots(terms: DataFrame) -> DataFrame:
    return terms.filter(F.size("parents") == 0)


def term_children(terms: DataFrame, parent: str) -> DataFrame:
    return terms.filter(F.array_contains("parents", parent))


def person_or_lab(terms: DataFrame, term_id: str) -> DataFrame:
    """A person or lab term and every direct child of it: term_id."""
    return terms.filter((F.col("term_id") == term_id) | F.array_contains("parents", term_id)).select("term_id")


def term_parents(terms: DataFrame, chosen: DataFrame) -> DataFrame:
    """Direct parents as terms: child_id and the parent's columns."""
    pairs = chosen.select(F.col("term_id").alias("child_id"), F.explode("parents").alias("term_id"))
    return pairs.join(terms, "term_id")


def term_path(terms: DataFrame, closure: DataFrame, chosen: DataFrame) -> DataFrame:
    """All ancestors as terms."""
    pairs = closure.join(chosen.select("term_id"), "term_id", "left_semi")
    pairs = pairs.select(F.col("term_id").alias("child_id"), F.col("ancestor_id").alias("term_id"))
    return pairs.join(terms, "term_id")


def scoped(terms: DataFrame, ontology_id: str | None = None, flag: str | None = None) -> DataFrame:
    """One ontology, or the dimension, dimension-variable or property microtypes."""
    if ontology_id:
        terms = terms.filter(F.col("ontology_id") == ontology_id)
    if flag:
        terms = terms.filter(F.col("is_microtype") & F.col(flag))
    return terms


def is_descendant(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """For ``pairs(child_id, parent_id)``: is the child the parent or below it."""
    known = closure.select(F.col("term_id").alias("child_id"), F.col("ancestor_id").alias("parent_id"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False)) | (F.col("child_id") == F.col("parent_id"))
    return pairs.join(known.distinct(), ["child_id", "parent_id"], "left").select("child_id", "parent_id", hit.alias("is_below"))


MANY_EXACT = 50  # fixed value: more exact hits than this stop the prefix search
SHORT_QUERY = 2  # fixed value: queries up to this length get no prefix search


def search_microtypes(terms: DataFrame, value: str) -> DataFrame:
    """Exact-word hits (rank 1), then prefix hits (rank 2) unless the exact hits are many; visible terms once."""
    visible = terms.filter(~F.col("is_hidden"))
    exact = visible.filter(has_words("term_name", exact_pattern(value))).withColumn("rank", F.lit(1))
    if len(value) <= SHORT_QUERY:
        return exact
    if exact.limit(MANY_EXACT + 1).count() > MANY_EXACT:
        return exact
    prefix = visible.filter(has_words("term_name", prefix_pattern(value))).withColumn("rank", F.lit(2))
    both = exact.unionByName(prefix)
    return both.groupBy("term_id").agg(F.min_by(F.struct("*"), "rank").alias("r")).select("r.*")


def oterm_choices(terms: DataFrame, closure: DataFrame, ids: list[str], parents: list[str]) -> DataFrame:
    """Given ids and visible descendants of given parents, by name."""
    under = closure.filter(F.col("ancestor_id").isin(parents)).select("term_id")
    found = terms.filter(~F.col("is_hidden")).join(under.distinct(), "term_id", "left_semi")
    given = terms.filter(F.col("term_id").isin(ids))
    both = given.unionByName(found).select("term_id", "term_name").distinct()
    return both.orderBy("term_name", "term_id")


def value_choices(terms: DataFrame, closure: DataFrame, value: str, valid_values_parent: str) -> DataFrame:
    """Visible terms by word beginning under a microtype's valid-values parent."""
    return term_prefix(terms, closure, value, valid_values_parent).filter(~F.col("is_hidden"))


def microtype_tree(terms: DataFrame, roots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Terms of ``wanted(term_id)`` and their ancestors in depth-first order below ``roots(term_id)``, each once.

    A sort path of names and ids is carried down level by level; of several ways to a term the
    least path stays. The paths give the order: term_id, depth, path.
    """
    spark = terms.sparkSession
    links = terms.select("term_id", "term_name", F.explode("parents").alias("parent_id"))
    links = links.join(wanted.select("term_id"), "term_id", "left_semi")
    level = roots.join(terms.select("term_id", "term_name"), "term_id").select(
        "term_id", F.array(F.concat_ws(" ", "term_name", "term_id")).alias("path")
    )
    level = materialize(level.join(wanted.select("term_id"), "term_id", "left_semi"), "tree")
    levels = [level]
    while True:
        down = level.select(F.col("term_id").alias("parent_id"), F.col("path").alias("up"))
        step = links.join(down, "parent_id").select(
            "term_id", F.concat("up", F.array(F.concat_ws(" ", "term_name", "term_id"))).alias("path")
        )
        # a term already on its own path is a cycle
        step = step.filter(F.size("path") == F.size(F.array_distinct("path")))
        level, n = materialize_counted(step.groupBy("term_id").agg(F.min("path").alias("path")), "tree")
        if n == 0:
            break
        levels.append(level)
    union = functools.reduce(DataFrame.unionByName, levels)
    best = union.groupBy("term_id").agg(F.min("path").alias("path"))
    return best.select("term_id", (F.size("path") - 1).alias("depth"), "path")


def property_for_term(typedef: DataFrame, term_id: str) -> DataFrame:
    """Properties typed by a term, with the key flags."""
    return typedef.filter(F.col("type_term_id") == term_id).select("type_name", "field_name", "is_pk", "is_upk")


def type_properties(typedef: DataFrame, terms: DataFrame) -> DataFrame:
    """Property list of each type, units in the display name."""
    units = terms.select(F.col("term_id").alias("units_term_id"), F.col("term_name").alias("units_name"))
    shown = F.concat_ws(" ", "field_name", F.concat(F.lit("("), "units_name", F.lit(")")))
    return typedef.join(units, "units_term_id", "left").select("type_name", "field_name", "scalar_type", shown.alias("display"))


def data_types(entity_types: DataFrame, brick_types: DataFrame) -> DataFrame:
    """Entity types, array types in use and the general array type, sorted: name, category."""
    generic = brick_types.limit(1).select(F.lit("NDArray").alias("name"), F.lit("DDT_").alias("category"))
    return (
        entity_types.select("name", F.lit("SDT_").alias("category"))
        .unionByName(brick_types.select("name", F.lit("DDT_").alias("category")))
        .unionByName(generic)
        .distinct()
        .orderBy("category", "name")
    )


def type_requires_process(typedef: DataFrame, root: str) -> DataFrame:
    """Types used for provenance with at least one input type that is not the root."""
    needs = F.exists(F.flatten("process_inputs"), lambda x: x != root)
    return typedef.select("type_name", (F.col("for_provenance") & F.coalesce(needs, F.lit(False))).alias("requires_process"))

