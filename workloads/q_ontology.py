"""Term graph: closure, lookups and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import filters, ontology
from workloads.registry import query
from workloads.sqlparts import CLOSURE_SQL, TERMS_SQL

T = "SELECT term_id, term_name FROM term "


@query("term_closure", CLOSURE_SQL + "SELECT term_id, ancestor_id FROM closure")
def term_closure(t):
    return t.closure.select("term_id", "ancestor_id")


@query(
    "is_descendant",
    CLOSURE_SQL
    + """, pair AS (SELECT DISTINCT 'PNAME:' || replace(p_name, ' ', '_') AS child_id, 'WORD:blue' AS parent_id FROM part
                    UNION SELECT DISTINCT 'WORD:' || split_part(p_name, ' ', 1), 'WORD:blue' FROM part)
         SELECT child_id, parent_id, child_id = parent_id OR EXISTS (SELECT 1 FROM closure
           WHERE term_id = child_id AND ancestor_id = parent_id) AS is_below FROM pair""",
)
def is_descendant(t):
    names = t.part.select("p_name").distinct()
    full = F.concat(F.lit("PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_")))
    first = F.concat(F.lit("WORD:"), F.split("p_name", " ")[0])
    pairs = names.select(F.explode(F.array(full, first)).alias("child_id"), F.lit("WORD:blue").alias("parent_id"))
    return ontology.is_descendant(pairs.distinct(), t.closure)


@query(
    "microtype_tree",
    CLOSURE_SQL
    + """, wanted AS (SELECT term_id FROM term WHERE is_microtype AND NOT is_hidden
                      UNION SELECT ancestor_id FROM closure JOIN term USING (term_id) WHERE is_microtype AND NOT is_hidden),
      tree(term_id, path) AS (
        SELECT term_id, [term_name || ' ' || term_id] FROM term WHERE term_id = 'PART:0000000'
        UNION ALL SELECT i.child, list_append(tree.path, term_name || ' ' || i.child)
        FROM tree JOIN isa i ON i.parent = tree.term_id JOIN term ON term.term_id = i.child JOIN wanted w ON w.term_id = i.child)
      SELECT term_id, len(min(path)) - 1 AS depth, array_to_string(min(path), ' > ') AS path FROM tree GROUP BY term_id""",
)
def microtype_tree(t):
    micro = t.terms.filter("is_microtype AND NOT is_hidden").select("term_id")
    wanted = micro.union(t.closure.join(micro, "term_id", "left_semi").select("ancestor_id")).distinct()
    roots = t.terms.filter("term_id = 'PART:0000000'").select("term_id")
    tree = ontology.microtype_tree(t.terms, roots, wanted)
    return tree.select("term_id", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", " > ").alias("path"))


@query("term_by_id", TERMS_SQL + T + "WHERE term_id = 'NATION:0000007'")
def term_by_id(t):
    return t.terms.filter(F.col("term_id") == "NATION:0000007").select("term_id", "term_name")


@query("term_by_ids", TERMS_SQL + T + "WHERE term_id IN (SELECT format('PERSON:{:07d}', o_custkey) FROM orders)")
def term_by_ids(t):
    ids = t.orders.select(F.format_string("PERSON:%07d", "o_custkey").alias("term_id"))
    return ontology.term_by_ids(t.terms, ids).select("term_id", "term_name")


@query(
    "term_by_name",
    CLOSURE_SQL + T + """WHERE lower(term_name) IN (SELECT lower(p_type) FROM part UNION SELECT lower(split_part(p_name, ' ', 2)) FROM part)
       AND term_id IN (SELECT term_id FROM closure WHERE ancestor_id = 'PART:0000000')""",
)
def term_by_name(t):
    names = t.part.select(F.explode(F.array(F.lower("p_type"), F.split("p_name", " ")[1])).alias("name"))
    found = ontology.term_by_name(t.terms, t.closure, names, "PART:0000000", ignore_case=True)
    return found.select("term_id", "term_name")


@query("term_prefix", CLOSURE_SQL + T + "WHERE term_name LIKE 'NATION\\_1%' ESCAPE '\\' AND ontology_id = 'geo'")
def term_prefix(t):
    """Words split at the underscore: ``NATION`` and a number beginning with 1."""
    found = ontology.term_prefix(t.terms, t.closure, "nation 1", "PLACE:0000000")
    return found.select("term_id", "term_name")


@query("term_pattern", TERMS_SQL + T + "WHERE list_contains(string_split(lower(term_name), ' '), 'ring')")
def term_pattern(t):
    return ontology.term_pattern(t.terms, t.closure, filters.exact_pattern("Ring")).select("term_id", "term_name")


@query("term_roots", TERMS_SQL + T + "WHERE term_id NOT IN (SELECT child FROM isa)")
def term_roots(t):
    return ontology.term_roots(t.terms).select("term_id", "term_name")


@query("term_children", TERMS_SQL + T + "WHERE term_id IN (SELECT child FROM isa WHERE parent = 'NATION:0000004')")
def term_children(t):
    return ontology.term_children(t.terms, "NATION:0000004").select("term_id", "term_name")


@query("term_descendants", CLOSURE_SQL + T + "WHERE term_id IN (SELECT term_id FROM closure WHERE ancestor_id = 'REGION:0000002')")
def term_descendants(t):
    return filters.below(t.terms, t.closure, "REGION:0000002").select("term_id", "term_name")


@query(
    "term_parents",
    TERMS_SQL + "SELECT child AS child_id, term_id, term_name FROM isa JOIN term ON term_id = parent",
)
def term_parents(t):
    return ontology.term_parents(t.terms, t.terms).select("child_id", "term_id", "term_name")


@query(
    "term_path",
    CLOSURE_SQL + "SELECT c.term_id AS child_id, a.term_id, a.term_name FROM closure c JOIN term a ON a.term_id = c.ancestor_id",
)
def term_path(t):
    return ontology.term_path(t.terms, t.closure, t.terms).select("child_id", "term_id", "term_name")


@query(
    "ontology_scope",
    TERMS_SQL + T + "WHERE ontology_id = 'part' AND is_microtype AND is_dimension_variable UNION ALL " + T + "WHERE is_microtype AND is_property",
)
def ontology_scope(t):
    one = ontology.scoped(t.terms, "part", "is_dimension_variable")
    return one.unionByName(ontology.scoped(t.terms, flag="is_property")).select("term_id", "term_name")


@query(
    "search_microtypes",
    TERMS_SQL
    + """SELECT term_id, term_name, CASE WHEN list_contains(string_split(lower(term_name), ' '), 'red') THEN 1 ELSE 2 END AS rank
         FROM term WHERE NOT is_hidden AND len(list_filter(string_split(lower(term_name), ' '), lambda w: starts_with(w, 'red'))) > 0""",
)
def search_microtypes(t):
    return ontology.search_microtypes(t.terms, "red").select("term_id", "term_name", "rank")


@query(
    "oterm_choices",
    CLOSURE_SQL
    + T
    + """WHERE term_id IN ('PTYPE:PROMO', 'BRAND:0000001')
         OR NOT is_hidden AND term_id IN (SELECT term_id FROM closure WHERE ancestor_id IN ('REGION:0000001', 'WORD:blue'))""",
)
def oterm_choices(t):
    return ontology.oterm_choices(t.terms, t.closure, ["PTYPE:PROMO", "BRAND:0000001"], ["REGION:0000001", "WORD:blue"])


@query(
    "value_choices",
    CLOSURE_SQL
    + T
    + """WHERE NOT is_hidden AND term_id IN (SELECT term_id FROM closure WHERE ancestor_id = 'PART:0000000')
         AND len(list_filter(string_split(lower(term_name), ' '), lambda w: starts_with(w, 'g'))) > 0""",
)
def value_choices(t):
    return ontology.value_choices(t.terms, t.closure, "g", "PART:0000000").select("term_id", "term_name")


@query(
    "build_terms",
    CLOSURE_SQL
    + """, merged AS (SELECT term_id, term_name, term_name AS shown FROM term
                      UNION ALL SELECT DISTINCT 'SEG:' || c_mktsegment, c_mktsegment, c_mktsegment FROM customer)
         SELECT term_id, shown AS term_name, 'term ' || shown || ' [' || lower(shown) || ']' AS description,
           coalesce((SELECT string_agg(ancestor_id, '|' ORDER BY ancestor_id) FROM closure c WHERE c.term_id = m.term_id), '') AS ancestors
         FROM merged m""",
)
def build_terms(t):
    """Two sources; terms of the second that the first already has are left out."""
    base = t.terms.select("term_id", "term_name")
    again = base.filter(F.col("term_id").startswith("NATION:")).select("term_id", F.lit("other name").alias("term_name"))
    segments = t.customer.select(F.concat(F.lit("SEG:"), "c_mktsegment").alias("term_id"), F.col("c_mktsegment").alias("term_name"))
    merged = ontology.build_terms([base, again.unionByName(segments.distinct())])
    merged = merged.withColumn("definition", F.concat(F.lit("term "), "term_name")).withColumn("synonyms", F.array(F.lower("term_name")))
    out = ontology.with_ancestors(ontology.describe(merged), t.closure)
    return out.select("term_id", "term_name", "description", F.array_join("ancestors", "|").alias("ancestors"))


TYPEDEF_SQL = """typedef AS (
  SELECT DISTINCT 'Part' AS type_name, 'brand' AS field_name, 'term' AS scalar_type, 'BRAND:0000001' AS type_term_id, 'PTYPE:' || min(p_type) OVER () AS units_term_id, false AS is_pk, true AS is_upk FROM part
  UNION ALL SELECT DISTINCT 'Part', 'size_' || p_size, 'int', 'BRAND:' || lpad(CAST(p_size AS VARCHAR), 7, '0'), NULL, p_size = 1, false FROM part
)"""


def typedef_rows(t):
    p = t.part
    size = F.col("p_size")
    a = p.agg(F.concat(F.lit("PTYPE:"), F.min("p_type")).alias("units_term_id")).select(
        F.lit("Part").alias("type_name"),
        F.lit("brand").alias("field_name"),
        F.lit("term").alias("scalar_type"),
        F.lit("BRAND:0000001").alias("type_term_id"),
        "units_term_id",
        F.lit(False).alias("is_pk"),
        F.lit(True).alias("is_upk"),
    )
    b = p.select("p_size").distinct().select(
        F.lit("Part").alias("type_name"),
        F.concat(F.lit("size_"), size.cast("string")).alias("field_name"),
        F.lit("int").alias("scalar_type"),
        F.format_string("BRAND:%07d", size).alias("type_term_id"),
        F.lit(None).cast("string").alias("units_term_id"),
        (size == 1).alias("is_pk"),
        F.lit(False).alias("is_upk"),
    )
    return a.unionByName(b)


@query(
    "property_for_term",
    f"WITH {TYPEDEF_SQL} SELECT type_name, field_name, is_pk, is_upk FROM typedef WHERE type_term_id = 'BRAND:0000001'",
)
def property_for_term(t):
    return ontology.property_for_term(typedef_rows(t), "BRAND:0000001")


@query(
    "type_properties",
    TERMS_SQL.rstrip()
    + f""", {TYPEDEF_SQL} SELECT type_name, field_name, scalar_type,
          field_name || coalesce(' (' || term_name || ')', '') AS display
          FROM typedef LEFT JOIN term ON term_id = units_term_id""",
)
def type_properties(t):
    return ontology.type_properties(typedef_rows(t), t.terms)


@query(
    "type_requires_process",
    """SELECT event_type AS type_name, bool_or(value > 50) AND bool_or(json_extract_string(props, '$.k') <> '7') AS requires_process
       FROM events GROUP BY 1""",
)
def type_requires_process(t):
    """The input types of an event type are its distinct ``k`` values; ``7`` stands for the root."""
    k = F.get_json_object("props", "$.k")
    typedef = t.events.groupBy(F.col("event_type").alias("type_name")).agg(
        F.bool_or(F.col("value") > 50).alias("for_provenance"), F.array(F.collect_set(k)).alias("process_inputs")
    )
    return ontology.type_requires_process(typedef, "7")


@query(
    "data_types",
    """SELECT unnest(['Customer', 'Nation', 'Part', 'Region', 'Supplier']) AS name, 'SDT_' AS category
       UNION ALL SELECT DISTINCT lower(r_name) || ' sales', 'DDT_' FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
       UNION ALL SELECT 'NDArray', 'DDT_'""",
)
def data_types(t):
    io = t.process_input.select("obj_type").union(t.process_output.select("obj_type")).distinct()
    entities = io.filter(~F.col("obj_type").startswith("Brick-")).select(F.col("obj_type").alias("name"))
    return ontology.data_types(entities, t.bricks.select(F.col("data_type_term_name").alias("name")).distinct())
