"""Validation and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import ingest, validate
from gridloom.operators.reports import brick_index_rows
from gridloom.operators.validate import Rule
from gridloom.session import scratch_path
from workloads.recast import num_id
from workloads.registry import query
from workloads.sqlparts import BRICKS, CLOSURE_SQL, EDGES, ISA, TERM, TERMS_SQL, with_

# ---- property rules ----


@query("validate_text", "SELECT p_partkey AS id, 'name' AS property, 'does not follow the constraint' AS message FROM part WHERE NOT regexp_matches(p_name, '^(?:blue|red b)')")
def validate_text(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return validate.validate_entity(rows, "id", [Rule("name", regex="blue|red b")])


@query(
    "validate_text_list",
    "SELECT p_partkey AS id, 'words' AS property, 'an item does not follow the constraint' AS message FROM part WHERE NOT (regexp_matches(split_part(p_name, ' ', 1), '^[a-r]') AND regexp_matches(split_part(p_name, ' ', 2), '^[a-r]'))",
)
def validate_text_list(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit(",")).alias("words"))
    return validate.validate_entity(rows, "id", [Rule("words", list_regex="[a-r]")])


@query("validate_range", "SELECT c_custkey AS id, 'balance' AS property, 'not in the range [0, 5000]' AS message FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000")
def validate_range(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return validate.validate_entity(rows, "id", [Rule("balance", range=(0, 5000))])


def part_terms(t):
    """The part name as a term text, or a bare name for small parts."""
    text = F.when(F.col("p_size") <= 5, F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" <PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(">"))
    )
    return t.part.select(F.col("p_partkey").alias("id"), text.alias("term"))


@query(
    "validate_term",
    """SELECT p_partkey AS id, 'term' AS property, 'not a term' AS message FROM part WHERE p_size <= 5
       UNION ALL SELECT p_partkey, 'term', 'not below WORD:blue' FROM part WHERE p_size > 5 AND split_part(p_name, ' ', 1) <> 'blue'""",
)
def validate_term(t):
    return validate.validate_entity(part_terms(t), "id", [Rule("term", root_term="WORD:blue")], t.closure)


@query(
    "validate_required",
    "SELECT doc_id, 'note' AS property, 'required' AS message FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic = 1 OR lang = 'fr'",
)
def validate_required(t):
    """Null, empty and the text ``null`` all count as missing."""
    note = F.when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, "null").when(F.col("lang") == "fr", "").otherwise("x")
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select("doc_id", note.alias("note"))
    return validate.validate_entity(rows, "doc_id", [Rule("note", required=True)])


@query("validate_ufk", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def validate_ufk(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return validate.validate_ufk(rows, "l_partkey", t.part.filter("p_size > 10"), "p_partkey")


@query(
    "validate_columns",
    """WITH have AS (SELECT DISTINCT p_type AS type_name, p_name AS "column" FROM part WHERE p_size > 20),
            dec AS (SELECT DISTINCT p_type AS type_name, p_name AS "column", starts_with(p_name, 'blue') AS required FROM part WHERE p_size <= 30)
       SELECT type_name, "column", 'missing' AS problem FROM dec WHERE required AND (type_name, "column") NOT IN (SELECT (type_name, "column") FROM have)
       UNION ALL SELECT type_name, "column", 'undeclared' FROM have WHERE (type_name, "column") NOT IN (SELECT (type_name, "column") FROM dec)""",
)
def validate_columns(t):
    """Part names stand for the columns of part types."""
    named = t.part.select(F.col("p_type").alias("type_name"), F.col("p_name").alias("column"), "p_size")
    have = named.filter("p_size > 20").select("type_name", "column").distinct()
    declared = named.filter("p_size <= 30").select("type_name", "column", F.col("column").startswith("blue").alias("required")).distinct()
    return validate.validate_columns(have, declared)


@query(
    "validate_entity",
    """SELECT c_custkey AS id, 'segment' AS property, 'does not follow the constraint' AS message FROM customer WHERE NOT regexp_matches(c_mktsegment, '^(?:[A-F])')
       UNION ALL SELECT c_custkey, 'balance', 'not in the range [-500, 9000]' FROM customer WHERE NOT c_acctbal BETWEEN -500 AND 9000
       UNION ALL SELECT c_custkey, 'nation', 'reference not found' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4)""",
)
def validate_entity(t):
    rows = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")
    )
    rules = [
        Rule("segment", required=True, regex="[A-F]"),
        Rule("balance", required=True, range=(-500, 9000)),
        Rule("nation", target=(t.nation.filter("n_regionkey <> 4"), "n_nationkey")),
    ]
    return validate.validate_entity(rows, "id", rules)


# ---- array cells ----


@query(
    "cast_terms",
    """SELECT p_partkey AS id, CASE WHEN p_size <= 10 THEN upper(p_type) WHEN p_size <= 20 THEN 'PTYPE:' || p_type WHEN p_size <= 30 THEN 'NATION:0000001' WHEN p_size <= 40 THEN p_name || '?' END AS value,
         CASE WHEN p_size <= 20 THEN 'PTYPE:' || p_type END AS term_id,
         CASE WHEN p_size BETWEEN 21 AND 30 THEN 'Term without valid parent PART:0000000' WHEN p_size BETWEEN 31 AND 40 THEN 'Can not find term: ' || p_name || '?' END AS error FROM part""",
)
def cast_terms(t):
    s = F.col("p_size")
    value = (
        F.when(s <= 10, F.upper("p_type")).when(s <= 20, F.concat(F.lit("PTYPE:"), "p_type")).when(s <= 30, "NATION:0000001").when(s <= 40, F.concat("p_name", F.lit("?")))
    )
    return validate.cast_terms(t.part.select(F.col("p_partkey").alias("id"), value.alias("value")), "value", t.terms, t.closure, "PART:0000000")


@query(
    "cast_object_refs",
    "SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS ref, CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) THEN 'Mapping to core type Part.id' END AS error FROM lineitem",
)
def cast_object_refs(t):
    cells = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("ref"))
    return validate.cast_object_refs(cells, "ref", t.part.filter("p_size <= 45"), "p_partkey", "Part.id")


CELL_TEXT = """celltext AS (SELECT o_orderkey AS i1, o_orderpriority[1:1] AS a_int, CASE WHEN o_orderstatus = 'F' THEN 'x1' ELSE '1.5' END AS b_float,
   CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'YES' END AS c_boolean FROM orders)"""


def cell_text(t):
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("i1"), F.substring("o_orderpriority", 1, 1).alias("a_int"), F.when(status == "F", "x1").otherwise("1.5").alias("b_float"),
        F.when(status == "F", "Yes").when(status == "O", "YES").alias("c_boolean"),
    )


KINDS = {"a_int": "int", "b_float": "float", "c_boolean": "boolean"}


@query(
    "validate_brick_cells",
    f"WITH {CELL_TEXT} SELECT i1, 'b_float' AS variable, b_float AS value, 'not float' AS error FROM celltext WHERE b_float = 'x1' UNION ALL SELECT i1, 'c_boolean', c_boolean, 'not boolean' FROM celltext WHERE c_boolean = 'YES'",
)
def validate_brick_cells(t):
    return validate.validate_brick_cells(cell_text(t), ["i1"], KINDS)


@query(
    "brick_cell_counts",
    f"""WITH {CELL_TEXT} SELECT 'a_int' AS variable, count(*) AS total_count, count(*) AS valid_count, 0 AS invalid_count FROM celltext
        UNION ALL SELECT 'b_float', count(*), count(*) FILTER (b_float <> 'x1'), count(*) FILTER (b_float = 'x1') FROM celltext
        UNION ALL SELECT 'c_boolean', count(*), count(*) FILTER (c_boolean IS DISTINCT FROM 'YES'), count(*) FILTER (c_boolean = 'YES') FROM celltext""",
)
def brick_cell_counts(t):
    return validate.cell_counts(cell_text(t), KINDS)


@query(
    "validate_shape",
    with_(BRICKS)
    + """, d AS (SELECT brick_id, count(DISTINCT v1) AS a, count(DISTINCT v2) AS b, count(DISTINCT v3) AS c, count(*) AS n FROM brick_cell GROUP BY 1)
         SELECT brick_id, NOT monthly OR c = 12 AS vars_ok, (a * b * CASE WHEN monthly THEN 12 ELSE c END)::BIGINT AS n_expected, n AS n_cells,
           (NOT monthly OR c = 12) AND n = a * b * CASE WHEN monthly THEN 12 ELSE c END AS shape_ok FROM d JOIN brick USING (brick_id)""",
)
def validate_shape(t):
    """Monthly arrays carry a second, full-length month variable."""
    c = t.brick_cells
    dims = None
    for n in (1, 2, 3):
        d = c.select("brick_id", F.lit(n).alias("dim"), F.lit(1).alias("var"), F.col(f"v{n}").cast("string").alias("idx")).distinct()
        dims = d if dims is None else dims.unionByName(d)
    full = t.bricks.filter("monthly").join(c.select("brick_id").distinct(), "brick_id", "left_semi")
    dims = dims.unionByName(full.select("brick_id", F.lit(3).alias("dim"), F.lit(2).alias("var"), F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<string>")).alias("idx")))
    return validate.validate_shape(dims, c)


@query(
    "validate_grid_headers",
    "SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def validate_grid_headers(t):
    """Flag and status of the lines of an order as the header tuples of a grid."""
    return validate.validate_grid_headers(t.lineitem, ["l_orderkey"], ["l_returnflag", "l_linestatus"])


def unit_rows(t):
    """Each part: its type is the microtype, its name or brand the units."""
    units = F.when(F.col("p_size") > 10, F.concat(F.lit("PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_")))).when(
        F.col("p_size") > 5, F.concat(F.lit("BRAND:"), F.lpad(F.split("p_brand", "#")[1], 7, "0"))
    )
    return t.part.select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("PTYPE:"), "p_type").alias("term_id"), units.alias("units_id"))


@query(
    "validate_units",
    """WITH u AS (SELECT p_partkey AS row_id, p_type, p_name, p_brand, p_size, 'PTYPE:' || p_type AS term_id,
              CASE WHEN p_size > 10 THEN 'PNAME:' || replace(p_name, ' ', '_') WHEN p_size > 5 THEN 'BRAND:' || lpad(split_part(p_brand, '#', 2), 7, '0') END AS units_id FROM part)
       SELECT row_id, term_id, units_id, CASE WHEN p_type = 'PROMO' THEN 'type has no units' ELSE 'units not below a valid parent' END AS error FROM u WHERE units_id IS NOT NULL AND (p_type = 'PROMO'
         OR NOT (units_id = 'BRAND:0000003' OR p_size > 10 AND (split_part(p_name, ' ', 1) = 'blue' OR split_part(p_name, ' ', 2) = 'ring')))""",
)
def validate_units(t):
    """One brand is listed, names below ``blue`` or ``ring`` are allowed; one type has no units."""
    has = F.col("p_type") != "PROMO"
    micro = t.part.select("p_type").distinct().select(
        F.concat(F.lit("PTYPE:"), "p_type").alias("term_id"),
        F.when(has, F.array(F.lit("BRAND:0000003"))).alias("valid_units"), F.when(has, F.array(F.lit("WORD:blue"), F.lit("WORD:ring"))).alias("valid_units_parents"),
    )
    return validate.validate_units(unit_rows(t), micro, t.closure)


@query(
    "validate_type_value",
    """SELECT p_partkey AS row_id, CASE p_type WHEN 'SMALL' THEN CASE WHEN p_size <= 3 THEN 'value term not found' ELSE 'value not below the valid parent' END
         WHEN 'LARGE' THEN 'value is not int' ELSE 'value is not float' END AS error FROM part
       WHERE p_type = 'SMALL' AND (p_size <= 3 OR NOT contains(p_name, 'blue')) OR p_type = 'LARGE' AND p_size > 25 OR p_type = 'PROMO' AND p_size > 40""",
)
def validate_type_value(t):
    kind = F.when(F.col("p_type") == "SMALL", "oterm_ref").when(F.col("p_type") == "LARGE", "int").when(F.col("p_type") == "PROMO", "float").otherwise("string")
    micro = t.part.select("p_type").distinct().select(
        F.concat(F.lit("PTYPE:"), "p_type").alias("term_id"), kind.alias("scalar_type"), F.lit("WORD:blue").alias("valid_values_parent")
    )
    name = F.concat(F.lit("PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_")))
    text = F.when((F.col("p_type") == "LARGE") & (F.col("p_size") > 25), "2.5").when((F.col("p_type") == "PROMO") & (F.col("p_size") > 40), "many").otherwise("12")
    rows = t.part.select(
        F.col("p_partkey").alias("row_id"), F.concat(F.lit("PTYPE:"), "p_type").alias("term_id"),
        F.when(F.col("p_size") <= 3, "PNAME:none").otherwise(name).alias("value_id"), text.alias("value_text"),
    )
    return validate.validate_type_value(rows, micro, t.terms, t.closure)


@query(
    "validate_templates",
    """WITH p AS (SELECT *, 'PNAME:' || replace(p_name, ' ', '_') AS pname, 'BRAND:' || lpad(split_part(p_brand, '#', 2), 7, '0') AS bid FROM part)
       SELECT p_type AS brick_type, 'template ' || p_partkey AS template, 'property:type' AS part, pname AS term_id, 'wrong name, expected ' || p_name AS error FROM p WHERE p_size <= 10
       UNION ALL SELECT p_type, 'template ' || p_partkey, 'data:variable:type:units', 'BRAND:9999999', 'term not found' FROM p WHERE p_size > 45
       UNION ALL SELECT p_type, 'template ' || p_partkey, 'process:type', 'PRIO:SETUP', 'wrong name, expected SETUP' FROM p WHERE p_brand = 'Brand#5'""",
)
def validate_templates(t):
    """A template per part, written as JSON and read back: wrong names and unknown units are found."""
    term = lambda i, n: F.struct(i.alias("id"), n.alias("text"))
    pname = F.concat(F.lit("PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_")))
    brand = term(F.concat(F.lit("BRAND:"), F.lpad(F.split("p_brand", "#")[1], 7, "0")), F.col("p_brand"))
    ptype = term(F.concat(F.lit("PTYPE:"), "p_type"), F.col("p_type"))
    none = F.lit(None).cast("struct<id: string, text: string>")
    prop = F.struct(term(pname, F.when(F.col("p_size") <= 10, "other").otherwise(F.col("p_name"))).alias("property"), brand.alias("value"), none.alias("units"))
    dim = F.struct(ptype.alias("type"), F.array(F.struct(brand.alias("type"), none.alias("units"))).alias("dim_vars"))
    bad_units = term(F.lit("BRAND:9999999"), F.lit("none"))
    var = F.struct(ptype.alias("type"), F.when(F.col("p_size") > 45, bad_units).alias("units"))
    process = term(F.lit("PRIO:SETUP"), F.when(F.col("p_brand") == "Brand#5", "BUILD").otherwise("SETUP"))
    child = F.struct(
        F.concat(F.lit("template "), F.col("p_partkey").cast("string")).alias("text"), F.array(prop).alias("properties"), F.array(dim).alias("dims"),
        F.array(var).alias("data_vars"), process.alias("process"),
    )
    docs = t.part.select(F.concat(F.lit("PTYPE:"), "p_type").alias("data_type"), F.col("p_type").alias("text"), F.array(child).alias("children"))
    path = scratch_path(t.spark, "templates")
    docs.write.json(path)
    return validate.validate_templates(validate.scan_templates(t.spark, path), t.terms)


@query(
    "check_term_names",
    """SELECT p_partkey AS id, CASE WHEN p_size <= 5 THEN p_name WHEN p_size <= 10 THEN 'x <PNAME:' || replace(p_name, ' ', '_') || '>' ELSE p_name || ' <PNAME:no>' END AS value,
         CASE WHEN p_size <= 5 THEN 'not a term' WHEN p_size <= 10 THEN 'wrong name, expected ' || p_name ELSE 'unknown term' END AS error FROM part WHERE p_size <= 12""",
)
def check_term_names(t):
    pname = F.concat(F.lit(" <PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(">"))
    s = F.col("p_size")
    value = F.when(s <= 5, F.col("p_name")).when(s <= 10, F.concat(F.lit("x"), pname)).when(s <= 12, F.concat("p_name", F.lit(" <PNAME:no>"))).otherwise(F.concat("p_name", pname))
    return validate.check_term_names(t.part.select(F.col("p_partkey").alias("id"), value.alias("value")), "id", "value", t.terms)


@query(
    "check_scalar_text",
    """SELECT event_id, regexp_matches(v, '^-?\\d+$') AS is_int, regexp_matches(v, '^-?\\d+([.]\\d*)?$') AS is_float FROM
       (SELECT event_id, CASE event_type WHEN 'error' THEN props WHEN 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) END AS v FROM events)""",
)
def check_scalar_text(t):
    v = (
        F.when(F.col("event_type") == "error", F.col("props")).when(F.col("event_type") == "view", F.floor("value").cast("string"))
        .otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    )
    rows = t.events.select("event_id", v.alias("v"))
    return rows.select("event_id", validate.int_text("v").alias("is_int"), validate.float_text("v").alias("is_float"))


@query(
    "check_date_range",
    """WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS s, CASE o_orderstatus WHEN 'F' THEN '1998-06-01' WHEN 'O' THEN '2001-12-31' END AS e FROM orders)
       SELECT id, 'date_end' AS property, 'missing' AS message FROM o WHERE e IS NULL UNION ALL SELECT id, 'date_start', 'start in the future' FROM o WHERE s > '2000-12-31'
       UNION ALL SELECT id, 'date_end', 'end in the future' FROM o WHERE e > '2000-12-31' UNION ALL SELECT id, 'date_start', 'start after end' FROM o WHERE s > e""",
)
def check_date_range(t):
    """The day of the check is given, so that the result does not change with time."""
    end = F.when(F.col("o_orderstatus") == "F", "1998-06-01").when(F.col("o_orderstatus") == "O", "2001-12-31")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_start"), end.alias("date_end"))
    return validate.check_date_range(rows, "id", F.lit("2000-12-31"), ["date_start", "date_end"], "date_start", "date_end")


# ---- ingest ----

UPSERT = """incoming AS (SELECT c_name AS name, CASE WHEN c_nationkey < 5 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, CASE WHEN c_nationkey < 2 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer),
  stored AS (SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_nationkey < 20),
  cls AS (SELECT i.*, CASE WHEN i.balance < -900 THEN 'invalid' WHEN s.name IS NULL THEN 'new' WHEN i.balance <> s.balance OR i.segment <> s.segment THEN 'changed' ELSE 'unchanged' END AS status,
     s.balance AS ob, s.segment AS os FROM incoming i LEFT JOIN stored s USING (name))"""


def classified(t):
    c = t.customer
    balance = F.when(F.col("c_nationkey") < 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    segment = F.when(F.col("c_nationkey") < 2, "NEW").otherwise(F.col("c_mktsegment"))
    incoming = c.select(F.col("c_name").alias("name"), balance.alias("balance"), segment.alias("segment"))
    stored = c.filter("c_nationkey < 20").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return ingest.upsert_classify(incoming, stored, "name", F.col("balance") >= -900)


@query(
    "upsert_classify",
    f"WITH {UPSERT} SELECT name, status, CASE WHEN status = 'changed' THEN concat_ws('|', CASE WHEN balance <> ob THEN 'balance' END, CASE WHEN segment <> os THEN 'segment' END) ELSE '' END AS changed FROM cls",
)
def upsert_classify(t):
    return classified(t).select("name", "status", F.array_join("changed", "|").alias("changed"))


@query(
    "check_core_vs_process",
    """SELECT p_partkey AS id, count(DISTINCT l_orderkey) AS n, CASE WHEN count(DISTINCT l_orderkey) = 0 THEN 'not found in process file' ELSE 'conflicting input objects' END AS message
       FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) <> 1""",
)
def check_core_vs_process(t):
    """Parts against all orders, of which each part should have exactly one."""
    outputs = t.lineitem.select(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("user_key"))
    return ingest.check_core_vs_process(t.part.select(F.col("p_partkey").alias("id")), "id", outputs)


@query(
    "upload_with_processes",
    f"""WITH {UPSERT}, o AS (SELECT o_orderkey AS process_id, c_name, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey)
       SELECT process_id, count(*) AS n_outputs, count(*) FILTER (status = 'invalid') AS n_bad_outputs, count(*) FILTER (o_orderpriority = '5-LOW') AS n_missing_inputs,
         count(*) FILTER (status = 'invalid') = 0 AND count(*) FILTER (o_orderpriority = '5-LOW') = 0 AS ok FROM o JOIN cls ON name = c_name GROUP BY 1""",
)
def upload_with_processes(t):
    """Each order as a process that makes its customer; low priority is an input nobody knows."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    outputs = o.select(F.col("o_orderkey").alias("process_id"), F.col("c_name").alias("user_key"))
    inputs = o.select(F.col("o_orderkey").alias("process_id"), F.col("o_orderpriority").alias("ref"))
    known = t.orders.select(F.col("o_orderpriority").alias("ref")).distinct().filter("ref <> '5-LOW'")
    return ingest.upload_with_processes(classified(t), "name", outputs, inputs, known)


@query(
    "process_conflicts",
    """WITH inc AS (SELECT o_orderkey, 'new' || o_orderkey AS id, 'old' || o_orderkey AS stored_id, o_orderstatus = 'F' AS meta, o_orderpriority = '1-URGENT' AS ins, o_orderpriority = '2-HIGH' AS outs,
              o_orderdate >= TIMESTAMP '1996-01-01' AS kept FROM orders)
       SELECT id, stored_id, CASE WHEN outs THEN 1 ELSE 0 END::BIGINT AS missing_outputs, CASE WHEN meta THEN 'campaign' ELSE '' END AS changed_metadata, ins AS changed_inputs, outs AS changed_outputs
       FROM inc WHERE kept AND (meta OR ins OR outs)""",
)
def process_conflicts(t):
    """Stored orders since 1996, loaded again: some with another campaign, other inputs, or an output left out."""
    key = F.col("o_orderkey").cast("string")
    ref = lambda kind: F.concat(F.lit(kind + ":"), key)
    base = t.orders.withColumn("a", ref("A")).withColumn("b", ref("B")).withColumn("c", ref("C"))
    stored = base.filter("o_orderdate >= '1996-01-01'").select(
        F.concat(F.lit("old"), key).alias("id"), F.lit("x").alias("campaign"), F.col("o_orderpriority").alias("process"),
        F.array("a").alias("input_objects"), F.array("b", "c").alias("output_objects"),
    )
    incoming = base.select(
        F.concat(F.lit("new"), key).alias("id"), F.when(F.col("o_orderstatus") == "F", "y").otherwise("x").alias("campaign"), F.col("o_orderpriority").alias("process"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array("c")).otherwise(F.array("a")).alias("input_objects"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.array("c")).otherwise(F.array("b", "c")).alias("output_objects"),
    )
    out = ingest.process_conflicts(incoming, stored, ["campaign", "process"])
    return out.withColumn("changed_metadata", F.array_join("changed_metadata", "|"))


@query("apply_overwrite", f"WITH {UPSERT} SELECT name, balance, segment FROM stored WHERE name NOT IN (SELECT name FROM cls WHERE status IN ('new', 'changed')) UNION ALL SELECT name, balance, segment FROM cls WHERE status IN ('new', 'changed')")
def apply_overwrite(t):
    new = classified(t).filter("status IN ('new', 'changed')").select("name", "balance", "segment")
    stored = t.customer.filter("c_nationkey < 20").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return ingest.apply_overwrite(stored, new, "name")


@query(
    "replace_process_edges",
    with_(EDGES) + "SELECT process_id, obj FROM pout WHERE process_id NOT LIKE 'ProcessB%' UNION ALL SELECT format('ProcessB{:07d}', s_suppkey), 'Brick:' || s_name FROM supplier",
)
def replace_process_edges(t):
    new = t.supplier.select(num_id("ProcessB", "s_suppkey").alias("process_id"), F.concat(F.lit("Brick:"), "s_name").alias("obj"))
    return ingest.replace_process_edges(t.process_output.select("process_id", "obj"), new)


@query(
    "load_processes",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS sys_process_id, 'sdt_supplier' AS "table", format('Supplier{:07d}', l_suppkey) AS id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)""",
)
def load_processes(t):
    """User keys of suppliers and parts become ids; parts are kept out of provenance here, unknown types fall away."""
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    rows = l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("id"),
        F.format_string('"Supplier: Supplier#%09d", Part: part-%07d, Image: x', "l_suppkey", "l_partkey").alias("input_objects"),
    )
    keys = t.supplier.select(F.lit("sdt_supplier").alias("table"), F.col("s_name").alias("key"), num_id("Supplier", "s_suppkey").alias("id")).union(
        t.part.select(F.lit("sdt_part"), num_id("part-", "p_partkey"), num_id("Part", "p_partkey"))
    )
    return ingest.load_processes(rows, "input_objects", keys, ["sdt_part"])


@query(
    "index_entities",
    "SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN 'PNAME:' || replace(p_name, ' ', '_') END AS term_term_id, p_name AS term_term_name FROM part",
)
def index_entities(t):
    return ingest.index_entities(part_terms(t), ["term"])


@query(
    "index_bricks",
    CLOSURE_SQL.rstrip()
    + "," + BRICKS
    + """, old AS (SELECT brick_id, 'PTYPE:PROMO' AS term_id FROM brick WHERE s_suppkey < 50),
      new AS (SELECT brick_id, data_type_term_id AS term_id FROM brick WHERE NOT monthly)
      SELECT brick_id, 'term' AS kind, term_id FROM old WHERE brick_id NOT IN (SELECT brick_id FROM new)
      UNION ALL SELECT brick_id, 'ancestor', ancestor_id FROM old JOIN closure USING (term_id) WHERE brick_id NOT IN (SELECT brick_id FROM new)
      UNION ALL SELECT brick_id, 'term', term_id FROM new UNION ALL SELECT brick_id, 'ancestor', ancestor_id FROM new JOIN closure USING (term_id)""",
)
def index_bricks(t):
    """The index of some arrays is made anew and takes the place of their old rows."""
    none = F.lit(None).cast("string").alias("value")
    b = t.bricks
    old = brick_index_rows(b.filter("s_suppkey < 50").select("brick_id", F.lit("PTYPE:PROMO").alias("term_id"), none), t.closure)
    new = brick_index_rows(b.filter("NOT monthly").select("brick_id", F.col("data_type_term_id").alias("term_id"), none), t.closure)
    return ingest.apply_overwrite(old, new, "brick_id").select("brick_id", "kind", "term_id")
