"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as fx
from workloads.recast import num_id
from workloads.registry import query


@query("to_var_name", "SELECT page_id, 'PROPERTY_' || regexp_replace(url, '[^0-9a-zA-Z]+', '_', 'g') AS name FROM pages")
def to_var_name(t):
    return t.pages.select("page_id", fx.to_var_name("url", "PROPERTY_").alias("name"))


@query("to_object_type", "SELECT format('Sup_plier{:07d}', s_suppkey) AS id, 'Sup_plier' AS kind FROM supplier UNION ALL SELECT c_name, 'Customer' FROM customer")
def to_object_type(t):
    ids = t.supplier.select(num_id("Sup_plier", "s_suppkey").alias("id")).union(t.customer.select("c_name"))
    return ids.select("id", fx.to_object_type("id").alias("kind"))


@query("normalize_name", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM pages")
def normalize_name(t):
    return t.pages.select("page_id", fx.normalize_name("url").alias("name"))


@query(
    "parse_object_ref",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'Brick-' || l_linenumber AS kind, 'part: x:' || l_partkey AS key, 'ddt_ndarray' AS tab FROM lineitem WHERE l_returnflag = 'A'
       UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'Brick', l_partkey::VARCHAR, 'ddt_ndarray' FROM lineitem WHERE l_returnflag = 'N'
       UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'TnSeq_Library', l_partkey::VARCHAR, 'sdt_tnseq_library' FROM lineitem WHERE l_returnflag = 'R'""",
)
def parse_object_ref(t):
    """References of three forms; only the first colon splits."""
    part = F.col("l_partkey").cast("string")
    ref = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Brick-"), F.col("l_linenumber").cast("string"), F.lit(": part: x:"), part))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit(" Generic :"), part)).otherwise(F.concat(F.lit("TnSeq_Library:"), part))
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", ref.alias("ref"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", fx.ref_type("ref").alias("kind"), fx.ref_key("ref").alias("key"), fx.ref_table("ref").alias("tab"))


@query("split_object_list", "SELECT o_orderkey, 'Customer: ' || o_custkey || '|Order: a, ' || o_orderkey || '|x: ' || o_orderpriority AS items, 3 AS n FROM orders")
def split_object_list(t):
    text = F.format_string('Customer: %d, "Order: a, %d" , x: %s', "o_custkey", "o_orderkey", "o_orderpriority")
    items = fx.split_object_list(text)
    return t.orders.select("o_orderkey", F.array_join(items, "|").alias("items"), F.size(items).alias("n"))


@query("format_term", "SELECT doc_id, CASE WHEN quality IS NULL THEN lang ELSE lang || ' <Q:' || quality || '>' END AS term FROM documents LEFT JOIN labels USING (doc_id)")
def format_term(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", fx.format_term("lang", F.concat(F.lit("Q:"), F.col("quality").cast("string"))).alias("term"))


@query("full_type", "SELECT p_partkey, p_type || '<' || replace(p_name, ' ', ', ') || '>' AS full_type FROM part")
def full_type(t):
    return t.part.select("p_partkey", fx.full_type("p_type", F.split("p_name", " ")).alias("full_type"))


@query(
    "long_name",
    """SELECT p_partkey, p_name || CASE WHEN p_size > 10 THEN ' : type = ' || p_type || ' size = ' || p_size || ' inch' ELSE '' END || CASE WHEN p_size > 20 THEN ' (' || p_brand || ')' ELSE '' END AS name FROM part""",
)
def long_name(t):
    attrs = F.when(F.col("p_size") > 10, F.array(F.concat(F.lit("type = "), "p_type"), F.concat(F.lit("size = "), F.col("p_size").cast("string"), F.lit(" inch"))))
    return t.part.select("p_partkey", fx.long_name("p_name", attrs, F.when(F.col("p_size") > 20, F.col("p_brand"))).alias("name"))


@query(
    "normalize_boolean",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 WHEN role = 'assistant' THEN 0 END AS flag, role NOT IN ('user', 'assistant') OR turn > 5 AS is_error FROM
       (SELECT conv_id, turn, CASE WHEN turn > 5 THEN 'YES' ELSE role END AS role FROM conversations)""",
)
def normalize_boolean(t):
    """``Yes`` and ``0`` are known texts, ``YES`` is not."""
    text = F.when(F.col("turn") > 5, "YES").when(F.col("role") == "user", "Yes").when(F.col("role") == "assistant", "0").otherwise(F.col("role"))
    rows = t.conversations.select("conv_id", "turn", text.alias("v"))
    return rows.select("conv_id", "turn", fx.normalize_boolean("v").alias("flag"), (F.col("v").isNotNull() & fx.normalize_boolean("v").isNull()).alias("is_error"))


@query(
    "cast_scalar",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS i, CASE WHEN event_type <> 'error' THEN value END AS f, event_type AS s FROM events""",
)
def cast_scalar(t):
    """Numbers and text read from text; NaN and what does not parse are null."""
    f = F.when(F.col("event_type") == "error", "NaN").otherwise(F.col("value").cast("string"))
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").alias("i"), f.alias("f"), F.col("event_type").alias("s"))
    return rows.select("event_id", *[fx.cast_scalar(c, kind).alias(c) for c, kind in (("i", "int"), ("f", "float"), ("s", "string"))])


@query("line_thickness", "SELECT p_partkey, (round(log10(n)) + 1)::INT AS thickness FROM (SELECT p_partkey, n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)")
def line_thickness(t):
    n = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return n.join(t.part, "p_partkey", "left_semi").select("p_partkey", fx.line_thickness("n").alias("thickness"))


@query(
    "is_dup_term",
    "SELECT o_orderkey, o_custkey = c_nationkey OR lower(o_orderstatus || 'URNITURE') = lower(c_mktsegment) AS same FROM orders JOIN customer ON c_custkey = o_custkey",
)
def is_dup_term(t):
    """Two terms per order: its own numbers and texts, and those of its customer."""
    pairs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    name = F.lower(F.concat("o_orderstatus", F.lit("URNITURE")))
    same = fx.is_dup_term(F.col("o_custkey").cast("string"), name, F.col("c_nationkey").cast("string"), "c_mktsegment")
    return pairs.select("o_orderkey", same.alias("same"))


@query(
    "null_text",
    """SELECT doc_id, CASE WHEN lang IN ('fr', 'de', 'es') THEN NULL ELSE lang END AS plain, CASE WHEN lang IN ('fr', 'de', 'es') OR source = 'src3' THEN NULL ELSE source END AS grid FROM documents""",
)
def null_text(t):
    """Each language stands for one way to write a missing value; grids know one more."""
    lang = F.when(F.col("lang") == "fr", "null").when(F.col("lang") == "de", " NaN").when(F.col("lang") == "es", "").otherwise(F.col("lang"))
    grid = F.when(F.col("lang") != "en", lang).when(F.col("source") == "src3", "n/a").otherwise(F.col("source"))
    return t.documents.select("doc_id", fx.null_text(lang).alias("plain"), fx.null_text(grid, fx.GRID_NULL_TEXTS).alias("grid"))
