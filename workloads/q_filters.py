"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import filters, fulltext, ontology
from gridloom.operators.filters import has_words
from gridloom.plans.search import search
from workloads.registry import query
from workloads.sqlparts import CLOSURE, CLOSURE_SQL, EDGES, ISA, PROCESS, TERM, with_

PART = """SELECT format('Part{:07d}', p_partkey) AS id, p_size AS size, p_retailprice AS price FROM part"""


@query("filter_compare", PART + " WHERE p_size >= 20 AND p_size < 30 AND p_retailprice > 905")
def filter_compare(t):
    q = t.workspace.query("Part").has({"size": {"gte": 20, "<": 30}}).has({"price": {">": 905.0}})
    return q.find().select("id", "size", "price")


@query("filter_or_and", PART + " WHERE (p_size = 5 OR p_size = 7 OR p_size = 11) AND p_retailprice <= 1500")
def filter_or_and(t):
    q = t.workspace.query("Part")
    for size in (5, 7, 11):
        q.has({"size": size})
    return q.has({"price": {"lte": 1500.0}}).find().select("id", "size", "price")


@query(
    "filter_in",
    """SELECT format('Customer{:07d}', c_custkey) AS id, c_mktsegment AS segment FROM customer
       WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND c_mktsegment IN ('MACHINERY')""",
)
def filter_in(t):
    q = t.workspace.query("Customer").has({"segment": {"in": ["BUILDING", "MACHINERY", "FURNITURE"]}})
    return q.has({"segment": {"in": "MACHINERY"}}).find().select("id", "segment")


@query(
    "filter_array_has",
    """SELECT format('Part{:07d}', p_partkey) AS id, p_name AS description FROM part
       WHERE list_contains(string_split(p_name, ' '), 'blue')
         AND list_has_any(string_split(p_name, ' '), ['ring', 'bolt', 'anvil'])""",
)
def filter_array_has(t):
    q = t.workspace.query("Part").has({"words": "blue"}).has({"words": ["ring", "bolt", "anvil"]})
    return q.find().select("id", "description")


DOC_WORDS = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"


@query(
    "filter_fulltext",
    f"""SELECT doc_id, source FROM documents
        WHERE (list_contains({DOC_WORDS}, 'the') AND list_contains({DOC_WORDS}, 'and')
               OR regexp_split_to_array(lower(source), '[^\\p{{L}}\\p{{N}}]+') = ['src7']) AND n_chars > 500""",
)
def filter_fulltext(t):
    """Full-text filters OR together even over different properties; the others AND on top."""
    etype = filters.EntityType(
        "Document",
        t.documents,
        {"text": filters.Prop("text", "text"), "source": filters.Prop("text", "source"), "n": filters.Prop("int", "n_chars")},
        pk="doc_id",
    )
    conditions = filters.parse_criteria({"text": {"like": "The and"}, "source": {"match": "src7"}, "n": {">": 500}}, etype)
    return filters.apply_conditions(etype.df, conditions, etype).select("doc_id", "source")


@query(
    "fulltext_index",
    f"""SELECT doc_id, lang FROM documents
        WHERE (list_contains({DOC_WORDS}, 'the') AND list_contains({DOC_WORDS}, 'by') AND len(list_filter({DOC_WORDS}, lambda w: starts_with(w, 'ther'))) > 0)
           OR list_contains(regexp_split_to_array(lower(source), '[^\\p{{L}}\\p{{N}}]+'), 'src7')""",
)
def fulltext_index(t):
    """Two searches by a stored index of whole texts and of sources."""
    index = fulltext.FullTextIndex.store(t.documents, "doc_id", ["text", "source"])
    return index.rows(t.documents, "doc_id", [("text", filters.prefix_pattern("the by ther")), ("source", "src7")]).select("doc_id", "lang")


@query(
    "fulltext_pattern",
    f"""SELECT doc_id, lang FROM documents
        WHERE list_contains({DOC_WORDS}, 'the') AND list_contains({DOC_WORDS}, 'by')
          AND len(list_filter({DOC_WORDS}, lambda w: starts_with(w, 'ther'))) > 0""",
)
def fulltext_pattern(t):
    return t.documents.filter(has_words("text", filters.prefix_pattern("the by ther"))).select("doc_id", "lang")


@query(
    "filter_term",
    """SELECT format('Part{:07d}', p_partkey) AS id, p_type AS type_name, p_brand AS brand_name FROM part
       WHERE p_type = 'PROMO' AND p_brand IN ('Brand#3', 'Brand#12')
         AND (p_type = 'PROMO' OR p_brand = 'Brand#3')""",
)
def filter_term(t):
    """A term property given as a name, as a list of id and name, and as an array overlap."""
    q = t.workspace.query("Part").has({"type": "PROMO"}).has({"brand": {"in": ["BRAND:0000003", "Brand#12"]}})
    q.has({"features": ["PTYPE:PROMO", "Brand#3"]})
    return q.find().select("id", F.col("type_term_name").alias("type_name"), F.col("brand_term_name").alias("brand_name"))


@query(
    "filter_term_scoped",
    """SELECT format('Brick{:07d}', s_suppkey) AS id, lower(r_name) || ' sales' AS data_type
       FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
       WHERE r_name = 'ASIA'""",
)
def filter_term_scoped(t):
    """``data_type`` names are looked up below the data type root only."""
    return t.workspace.find("Brick", {"data_type": "asia sales"}).select(
        "id", F.col("data_type_term_name").alias("data_type")
    )


@query(
    "filter_person_or_lab",
    with_(EDGES, PROCESS)
    + """SELECT DISTINCT replace(obj, 'Part:', '') AS id FROM pout JOIN proc ON proc.id = process_id
         WHERE obj_type = 'Part' AND (person_term_id = 'NATION:0000003' OR person_term_id IN
           (SELECT format('PERSON:{:07d}', c_custkey) FROM customer WHERE c_nationkey = 3))""",
)
def filter_person_or_lab(t):
    request = {
        "queryMatch": {"dataModel": "Part", "dataType": "Part", "params": []},
        "processesUp": [
            {"attribute": "person", "matchType": "=", "keyword": "NATION_3", "scalarType": "term", "term": "NATION:0000003"}
        ],
    }
    return search(t.workspace, request).select("id")


@query(
    "coerce_value",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events
       WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) >= 42 AND value < 12.5""",
)
def coerce_value(t):
    """Query texts are turned into the property's type before comparing."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    rows = t.events.select("event_id", k.alias("k"), "value")
    at_least, below = filters.coerce_value("42", "int"), filters.coerce_value("12.5", "float")
    return rows.filter(filters.compare("k", "gte", at_least) & filters.compare("value", "lt", below))


@query(
    "filter_prefix_ci",
    "SELECT p_partkey AS id, p_name AS text FROM part WHERE starts_with(lower(p_name), lower('BLUE R'))",
)
def filter_prefix_ci(t):
    return t.part.filter(filters.starts_with_ci("p_name", "BLUE R")).select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("text")
    )


DOC_LABELS = "documents LEFT JOIN labels USING (doc_id)"


@query("filter_has_props", f"SELECT doc_id, quality, toxic FROM {DOC_LABELS} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def filter_has_props(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return filters.has_props(joined, ["quality", "toxic"])


TYPEDEF = """typedef(type_name, field_name) AS (
  SELECT event_type, 'value' FROM events WHERE value IS NOT NULL
  UNION SELECT event_type, 'k' FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
  UNION SELECT event_type, 'large' FROM events WHERE value > 100
)"""


@query(
    "types_with_props",
    f"WITH {TYPEDEF} SELECT type_name FROM typedef WHERE field_name IN ('k', 'large') GROUP BY 1 HAVING count(DISTINCT field_name) = 2",
)
def types_with_props(t):
    """Declared fields are read off the events of each type."""
    e = t.events
    typedef = (
        e.filter("value is not null").select("event_type", F.lit("value").alias("field_name"))
        .union(e.filter(F.get_json_object("props", "$.k").isNotNull()).select("event_type", F.lit("k")))
        .union(e.filter("value > 100").select("event_type", F.lit("large")))
        .distinct()
        .withColumnRenamed("event_type", "type_name")
    )
    return filters.types_with_props(typedef, ["k", "large"])


@query("find_one", PART + " WHERE p_size = 20 ORDER BY id LIMIT 1")
def find_one(t):
    return t.workspace.find_one("Part", {"size": 20}).select("id", "size", "price")


@query(
    "search_request",
    CLOSURE_SQL.rstrip()
    + ","
    + EDGES
    + ","
    + PROCESS
    + """,
    brickrows AS (SELECT format('Brick-{:07d}:Brick{:07d}', n_regionkey + 1, s_suppkey) AS vertex,
                  format('Brick{:07d}', s_suppkey) AS id, n_name, r_name
                  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT id FROM brickrows WHERE r_name = 'ASIA' AND n_name = 'NATION_2'""",
)
def search_request(t):
    """One JSON request: arrays of a data type, measured, and downstream of one nation."""
    request = {
        "format": "JSON",
        "queryMatch": {"category": "DDT_", "dataModel": "Brick", "dataType": "asia sales", "params": []},
        "processesUp": [{"attribute": "process", "matchType": "=", "keyword": "MEASURE", "scalarType": "term"}],
        "connectsUpTo": {
            "dataModel": "Nation",
            "params": [{"attribute": "name", "matchType": "=", "keyword": "NATION_2", "scalarType": "text"}],
        },
    }
    return search(t.workspace, request).select("id")
