"""Sources and sinks. Where a file format is read, Spark first writes the file from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import comment_json, format_value_list, format_value_map, parse_array, term_id_of, term_name_of, words
from gridloom.operators import bricks
from gridloom.operators.ontology import is_descendant
from gridloom.operators.rowsets import merge_term as merge_terms
from gridloom.session import materialize, scratch_path
from gridloom.sources import brick_files, brick_json, obo, sectioned, tables, typedef
from workloads.recast import num_id
from workloads.registry import query
from workloads.sqlparts import BRICKS, CLOSURE_SQL, ISA, LINEAGE_SQL, PROCESS, SALES, SALES_SQL, TERM, TERMS_SQL, with_


def text_of(col, as_type="decimal(18,2)"):
    return F.col(col).cast(as_type).cast("string")


# ---- entity and process files ----


@query("scan_entity_tsv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents")
def scan_entity_tsv(t):
    """Whole documents, line breaks and quotes included, through a quoted TSV."""
    path = scratch_path(t.spark, "entity")
    tables.write_tsv(t.documents.select("doc_id", "text", "lang", "source"), path)
    return tables.scan_entity_tsv(t.spark, path, ["doc_id", "text", "lang", "source"])


@query("scan_process_tsv", LINEAGE_SQL + "SELECT process_term_name || ' <' || process_term_id || '>' AS process, person_term_name AS person, date_start, date_end, id FROM proc")
def scan_process_tsv(t):
    path = scratch_path(t.spark, "process")
    term = F.format_string("%s <%s>", "process_term_name", "process_term_id")
    rows = t.process.select(term.alias("process"), F.col("person_term_name").alias("person"), "date_start", "date_end", "id")
    tables.write_tsv(rows, path, quoted=False)
    return tables.scan_process_tsv(t.spark, path, rows.columns)


# ---- type definitions ----

# A type per part type; a field per part name: its second word decides what kind of field it is.
FIELD_SQL = """fld AS (
  SELECT DISTINCT p_type AS type_name, 'sdt_' || lower(p_type) AS tab, p_name AS name, split_part(p_name, ' ', 2) AS w, split_part(p_name, ' ', 1) AS c FROM part),
kinded AS (SELECT type_name, tab, name, w, c,
    CASE WHEN w = 'rod' THEN 'float' WHEN w = 'widget' THEN 'term' WHEN w = 'bolt' THEN '[text]' WHEN w = 'plate' THEN 'int' ELSE 'text' END AS scalar_type,
    CASE WHEN w = 'gear' THEN 'Small.id' WHEN w = 'ring' THEN '[Red.id]' END AS fk FROM fld),
named AS (SELECT *, replace(name, ' ', '_') AS n,
    CASE w WHEN 'gear' THEN CASE WHEN c = 'small' THEN 'sdt_small_name_gear' ELSE replace(name, ' ', '_') || '_sdt_small_name' END
           WHEN 'ring' THEN CASE WHEN c = 'red' THEN 'red_names_ring' ELSE replace(name, ' ', '_') || '_red_names' END
           WHEN 'rod' THEN replace(name, ' ', '_') || '_brand_7' WHEN 'plate' THEN replace(name, ' ', '_') || '_brand_7'
           ELSE replace(name, ' ', '_') END AS col FROM kinded),
cols AS (SELECT type_name, name AS field_name, col AS column_name, scalar_type, fk, false AS is_pk, w FROM named WHERE scalar_type <> 'term'
   UNION ALL SELECT type_name, name, n || '_sys_oterm_id', scalar_type, 'sys_oterm.id', false, w FROM named WHERE scalar_type = 'term'
   UNION ALL SELECT type_name, name, n || '_sys_oterm_name', scalar_type, NULL, false, w FROM named WHERE scalar_type = 'term'
   UNION ALL SELECT DISTINCT type_name, 'id', tab || '_id', 'text', NULL, true, 'id' FROM fld)
"""


def typedef_columns(t):
    """Writes the definitions as one JSON document and reads it; it holds metadata only."""
    w = F.split("p_name", " ")[1]
    scalar = F.when(w == "rod", "float").when(w == "widget", "term").when(w == "bolt", "[text]").when(w == "plate", "int").otherwise("text")
    fk = F.when(w == "gear", "Small.id").when(w == "ring", "[Red.id]")
    units = F.when(w.isin("rod", "plate"), "BRAND:0000007")
    field = F.struct(
        F.col("p_name").alias("name"), F.concat(F.lit("PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("type_term"),
        scalar.alias("scalar_type"), F.lit(False).alias("required"), fk.alias("FK"), units.alias("units_term"),
    )
    types = t.part.select(F.initcap("p_type").alias("name"), field.alias("f")).distinct()
    types = types.groupBy("name").agg(F.array_sort(F.collect_list("f")).alias("fields"))
    path = scratch_path(t.spark, "typedef")
    types.agg(F.array_sort(F.collect_list(F.struct("name", "fields"))).alias("static_types")).write.json(path)
    fields = typedef.scan_typedefs(t.spark, path)
    return materialize(typedef.column_rows(fields, t.terms.select("term_id", "term_name")), "typedef")


@query("column_names", f"WITH {FIELD_SQL} SELECT upper(type_name) AS type_name, field_name, column_name FROM cols")
def column_names(t):
    return typedef_columns(t).select(F.upper("type_name").alias("type_name"), F.col("name").alias("field_name"), F.col("column").alias("column_name"))


@query(
    "schema_from_typedef",
    f"""WITH {FIELD_SQL} SELECT upper(type_name) AS type_name, column_name, CASE scalar_type WHEN 'float' THEN 'double' WHEN 'int' THEN 'int' WHEN '[text]' THEN 'array<string>' ELSE 'string' END AS spark_type,
        NOT is_pk AS nullable, fk FROM cols""",
)
def schema_from_typedef(t):
    """The schemas of all types, shown as rows."""
    schemas = typedef.schemas_of(typedef_columns(t))
    rows = [(name.upper(), f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("fk")) for name, schema in schemas.items() for f in schema]
    return t.spark.createDataFrame(rows, "type_name string, column_name string, spark_type string, nullable boolean, fk string")


@query(
    "build_typedef_table",
    TERMS_SQL.rstrip()
    + f""", {FIELD_SQL} SELECT upper(type_name) AS type_name, field_name, column_name AS cdm_column_name, scalar_type, is_pk, fk,
        CASE WHEN w IN ('rod', 'plate') THEN 'Brand#7' END AS units_name, CASE WHEN w <> 'id' THEN field_name END AS type_sys_oterm_name FROM cols""",
)
def build_typedef_table(t):
    out = typedef.build_typedef_table(typedef_columns(t), t.terms)
    return out.select(
        F.upper("type_name").alias("type_name"), "field_name", "cdm_column_name", "scalar_type", "is_pk", "fk",
        F.col("units_sys_oterm_name").alias("units_name"), "type_sys_oterm_name",
    )


# ---- shaping ----


@query(
    "unique_columns",
    "SELECT l_orderkey AS k, l_partkey AS k_2, l_suppkey AS k_3, l_quantity AS v, l_tax AS v_2 FROM lineitem",
)
def unique_columns(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax").toDF("k", "k", "k", "v", "v")
    return tables.unique_columns(df)


@query(
    "parse_array_column",
    """SELECT doc_id, CASE WHEN n_chars < 100 THEN '' ELSE lang || '|' || source END AS items, CASE WHEN n_chars < 100 THEN 0 ELSE 2 END AS n FROM documents""",
)
def parse_array_column(t):
    """Texts like ``[fr, src4]``; short documents have an empty text, the shortest none at all."""
    text = F.when(F.col("n_chars") < 50, None).when(F.col("n_chars") < 100, "[]").otherwise(F.format_string("[%s, %s]", "lang", "source"))
    items = parse_array(text)
    return t.documents.select("doc_id", F.array_join(items, "|").alias("items"), F.size(items).alias("n"))


@query(
    "split_term",
    """SELECT p_partkey AS id, CASE WHEN p_size <= 10 THEN NULL ELSE 'BRAND:' || split_part(p_brand, '#', 2) END AS term_id,
         CASE WHEN p_size > 40 THEN NULL ELSE p_name END AS term_name FROM part""",
)
def split_term(t):
    """``name <id>`` with either part missing at times."""
    ident = F.concat(F.lit("<BRAND:"), F.split("p_brand", "#")[1], F.lit(">"))
    text = F.when(F.col("p_size") <= 10, F.col("p_name")).when(F.col("p_size") > 40, ident).otherwise(F.concat_ws(" ", "p_name", ident))
    return t.part.select(F.col("p_partkey").alias("id"), term_id_of(text).alias("term_id"), term_name_of(text).alias("term_name"))


@query(
    "merge_term",
    """SELECT format('Part{:07d}', p_partkey) AS id, p_type || ' <PTYPE:' || p_type || '>' AS type,
       p_brand || ' <BRAND:' || lpad(split_part(p_brand, '#', 2), 7, '0') || '>' AS brand, p_size AS size FROM part""",
)
def merge_term(t):
    return merge_terms(t.part_entity.select("id", "type_term_id", "type_term_name", "brand_term_id", "brand_term_name", "size"))


@query(
    "replace_id_prefix",
    """SELECT format('Client{:07d}', o_custkey) AS id, format('Client:Client{:07d}', o_custkey) AS ref,
         format('Client{:07d}', o_custkey) || '|' || format('Order{:07d}', o_orderkey) AS items, 'Customer seen' AS note FROM orders""",
)
def replace_id_prefix(t):
    """Only leading type names before a number change, in texts and arrays."""
    cust = num_id("Customer", "o_custkey")
    rows = t.orders.select(
        cust.alias("id"), F.concat(F.lit("Customer:"), cust).alias("ref"), F.array(cust, num_id("Order", "o_orderkey")).alias("items"), F.lit("Customer seen").alias("note")
    )
    return tables.replace_prefix_all(rows, "Customer", "Client").withColumn("items", F.array_join("items", "|"))


@query("replace_text_all", "SELECT p_partkey, replace(p_name, 'blue', 'teal') AS p_name, replace(p_type, 'blue', 'teal') AS p_type FROM part")
def replace_text_all(t):
    return tables.replace_text_all(t.part.select("p_partkey", "p_name", "p_type"), "blue", "teal")


@query(
    "conform_schema",
    "SELECT CAST(o_orderkey AS INTEGER) AS order_id, NULL::VARCHAR AS note, CAST(NULL AS INTEGER) AS priority_no, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS has_total, o_custkey AS customer FROM orders",
)
def conform_schema(t):
    schema = T.StructType(
        [
            T.StructField("order_id", T.IntegerType(), False, {"is_pk": True}),
            T.StructField("note", T.StringType()),
            T.StructField("o_orderpriority", T.IntegerType()),
            T.StructField("total", T.StringType()),
            T.StructField("customer", T.LongType()),
        ]
    )
    out = tables.conform_schema(t.orders, schema, {"o_orderkey": "order_id", "o_custkey": "customer", "o_totalprice": "total"})
    return out.select("order_id", "note", F.col("o_orderpriority").alias("priority_no"), F.col("total").isNotNull().alias("has_total"), "customer")


def saved_table(t, label, df, comment):
    path = scratch_path(t.spark, label)
    name = "gridloom_" + path.rsplit("-", 1)[1]
    tables.write_table(df, name, comment, path)
    return name


@query("write_table", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def write_table(t):
    return t.spark.table(saved_table(t, "table", t.supplier.select("s_suppkey", "s_name", "s_acctbal").filter("s_acctbal > 0"), "suppliers"))


def commented(t):
    name = saved_table(t, "commented", t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), "order lines")
    comments = {
        "l_orderkey": '{"description": "order", "type": "foreign_key", "references": "orders.o_orderkey"}',
        "l_partkey": '{"description": "part it\'s for", "type": "foreign_key", "references": "part.p_partkey"}',
        "l_suppkey": '{"description": "supplier", "type": "primary_key"}',
        "missing": "{}",
    }
    tables.set_comments(t.spark, name, "order lines", comments)
    return name


COMMENT_SQL = """SELECT CASE k WHEN 1 THEN 'l_orderkey' WHEN 2 THEN 'l_partkey' WHEN 3 THEN 'l_suppkey' ELSE 'l_quantity' END AS "column",
  CASE k WHEN 1 THEN 'order' WHEN 2 THEN 'part it''s for' WHEN 3 THEN 'supplier' END AS note, {extra} FROM (SELECT unnest([1, 2, 3, 4]) AS k, n FROM (SELECT count(*) AS n FROM lineitem))"""


@query("set_comments", COMMENT_SQL.format(extra="n AS n_rows"))
def set_comments(t):
    """Comments of a saved table, with the number of its rows."""
    name = commented(t)
    n = t.spark.table(name).agg(F.count("*").alias("n_rows")).withColumn("table", F.lit(name))
    return tables.list_foreign_keys(t.spark, name).join(n, "table").select("column", "note", "n_rows")


@query(
    "list_foreign_keys",
    COMMENT_SQL.format(extra="CASE k WHEN 1 THEN 'orders.o_orderkey' WHEN 2 THEN 'part.p_partkey' END AS \"references\", k = 3 AS is_pk"),
)
def list_foreign_keys(t):
    return tables.list_foreign_keys(t.spark, commented(t)).select("column", "references", "is_pk", "note")


@query(
    "table_samples",
    """SELECT 'customer' AS "table", count(*) AS n_rows, (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT c_name AS v FROM customer ORDER BY 1 LIMIT 3)) AS samples FROM customer
       UNION ALL SELECT 'part', count(*), (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT p_name AS v FROM part ORDER BY 1 LIMIT 3)) FROM part""",
)
def table_samples(t):
    return tables.table_samples({"customer": (t.customer, "c_name"), "part": (t.part, "p_name")})


@query(
    "records_json",
    """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_acctbal":"' || CAST(s_acctbal AS DECIMAL(18, 2)) || '","note":null}' AS record FROM supplier""",
)
def records_json(t):
    rows = t.supplier.select("s_suppkey", "s_name", text_of("s_acctbal").alias("s_acctbal"), F.lit(None).cast("string").alias("note"))
    return tables.records_json(rows)[1]


@query(
    "format_value",
    """SELECT event_id, '[' || event_type || ', ' || user_id || ']' AS list, '{k: ' || json_extract_string(props, '$.k') || '}' AS map, CASE WHEN value > 10 THEN '' ELSE '[x]' END AS missing FROM events""",
)
def format_value(t):
    props = F.from_json("props", "map<string,string>")
    gone = F.when(F.col("value") <= 10, F.array(F.lit("x")))
    return t.events.select(
        "event_id", format_value_list(F.array("event_type", F.col("user_id").cast("string"))).alias("list"),
        format_value_map(props).alias("map"), format_value_list(gone).alias("missing"),
    )


@query(
    "object_tsv",
    "SELECT format('Part{:07d}', p_partkey) || chr(9) || p_name || chr(9) || '[' || split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2) || ']' || chr(9) || p_size AS line FROM part",
)
def object_tsv(t):
    return tables.object_tsv(t.part_entity.select("id", "description", "words", "size"))[1]


@query(
    "object_metadata",
    """SELECT format('Part{:07d}', p_partkey) AS id, unnest(['type', 'brand', 'words', 'size']) AS property,
         unnest([p_type || ' <PTYPE:' || p_type || '>', p_brand || ' <BRAND:' || lpad(split_part(p_brand, '#', 2), 7, '0') || '>',
                 '[' || replace(p_name, ' ', ', ') || ']', p_size || ' inch']) AS value FROM part""",
)
def object_metadata(t):
    cols = ["id", "type_term_id", "type_term_name", "brand_term_id", "brand_term_name", "words", "size"]
    return tables.object_metadata(t.part_entity.select(*cols), "id", {"size": "inch"})


# ---- matrices and grids ----


@query(
    "unpivot_matrix",
    "SELECT s_name AS supplier, CAST(year(l_shipdate) AS VARCHAR) AS year, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
)
def unpivot_matrix(t):
    """Suppliers by years as a matrix file, read back as cells."""
    years = list(range(1995, 2002))
    q = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    by_year = q.withColumn("y", F.year("l_shipdate")).groupBy(F.col("s_name").alias("supplier")).pivot("y", years)
    matrix = by_year.agg(F.sum("l_quantity").cast("bigint"))
    path = scratch_path(t.spark, "matrix")
    tables.write_tsv(matrix, path)
    back = tables.scan_entity_tsv(t.spark, path, matrix.columns)
    return tables.unpivot_matrix(back, ["supplier"], "year", "quantity").filter("quantity <> 'null'")


@query(
    "ungrid_interlaced",
    """SELECT vec_id, CASE WHEN (k - 1) % 2 = 0 THEN 'mean' ELSE 'sd' END AS data_var, (k - 1) // 2 // 8 AS i1, (k - 1) // 2 % 8 AS i2, embedding[k]::DOUBLE AS value
       FROM embeddings, (SELECT unnest(range(1, 65)) AS k)""",
)
def ungrid_interlaced(t):
    """Each vector as a grid row: two interleaved variables over 4 x 8 columns."""
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return tables.ungrid_interlaced(rows, ["vec_id"], "v", ["mean", "sd"], [4, 8])


@query("grid_header_values", "SELECT 'l_returnflag' AS level, l_returnflag AS value, min(l_partkey) AS first_pos FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, min(l_partkey) FROM lineitem GROUP BY 2")
def grid_header_values(t):
    return tables.header_values(t.lineitem.withColumnRenamed("l_partkey", "pos"), ["l_returnflag", "l_linestatus"])


@query(
    "scan_wide_tsv_attrs",
    SALES_SQL + """, c AS (SELECT 'dim1_var1' AS object, supplier_name AS value FROM sales_cell JOIN sales_d1 USING (i1) UNION ALL SELECT 'dim2_var1', flag FROM sales_cell JOIN sales_d2 USING (i2)
        UNION ALL SELECT 'data_var1', CAST(CAST(quantity AS BIGINT) AS VARCHAR) FROM sales_cell)
      SELECT CASE object WHEN 'dim1_var1' THEN 'Supplier <ME:1>' WHEN 'dim2_var1' THEN 'Flag <ME:2>' ELSE 'Quantity <ME:3>' END AS type_term, value, count(*) AS n FROM c GROUP BY ALL""",
)
def scan_wide_tsv_attrs(t):
    """Data and attribute files of one array; every value with the term of its column."""
    wide = t.sales.wide(0, 1).select(
        F.col("supplier_name").alias("__dim1_var1"), F.col("flag").alias("__dim2_var1"), F.col("quantity").cast("bigint").alias("__data_var1")
    )
    attrs = t.supplier.limit(1).select(
        F.lit("sales").alias("__name"), F.lit("2").alias("__dim_count"), F.lit("Supplier <ME:1>").alias("__dim1_var1___type_term"),
        F.lit("Flag <ME:2>").alias("__dim2_var1___type_term"), F.lit("Quantity <ME:3>").alias("__data_var1___type_term"),
    )
    data_path, attr_path = scratch_path(t.spark, "wide"), scratch_path(t.spark, "attrs")
    tables.write_tsv(wide, data_path)
    tables.write_tsv(attrs, attr_path)
    data, described = tables.scan_wide_tsv_attrs(t.spark, data_path, attr_path)
    values = data.unpivot([], data.columns, "object", "value").withColumn("object", F.regexp_replace("object", "^__", ""))
    terms = described.filter("field = 'type_term'").select("object", F.col("value").alias("type_term"))
    return values.groupBy("object", "value").agg(F.count("*").alias("n")).join(terms, "object").select("type_term", "value", "n")


# ---- ontology files ----


@query(
    "scan_obo",
    TERMS_SQL + """SELECT term_id, term_name, 'the ' || term_name AS definition, coalesce((SELECT string_agg(parent, '|' ORDER BY parent) FROM isa WHERE child = term_id), '') AS parents,
        lower(term_name) || '|' || upper(term_name) AS synonyms, is_hidden, is_microtype, CASE WHEN is_microtype THEN 'is_microtype=true' ELSE '' END || CASE WHEN is_hidden THEN 'is_hidden=true' ELSE '' END AS props FROM term""",
)
def scan_obo(t):
    path = scratch_path(t.spark, "obo")
    flags = F.filter(F.array(F.when(F.col("is_hidden"), "is_hidden"), F.when(F.col("is_microtype"), "is_microtype")), lambda x: x.isNotNull())
    rows = t.terms.select(
        "term_id", "term_name", F.concat(F.lit("the "), "term_name").alias("definition"), "parents",
        F.array(F.lower("term_name"), F.upper("term_name")).alias("synonyms"), flags.alias("flags"),
    )
    obo.obo_stanza(rows).write.text(path, lineSep="\n\n")
    out = obo.scan_obo(t.spark, path, "all")
    props = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "")
    return out.select(
        "term_id", "term_name", "definition", F.array_join(F.array_sort("parents"), "|").alias("parents"),
        F.array_join("synonyms", "|").alias("synonyms"), "is_hidden", "is_microtype", props.alias("props"),
    )


# ---- array files ----


def vector_doc(t):
    """Every vector as a document of its own: an 8 x 8 array with row and column names."""
    term = lambda name: F.struct(F.lit("ME:1").alias("oterm_ref"), F.lit(name).alias("oterm_name"))
    names = lambda prefix: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.concat(F.lit(prefix), x.cast("string")))
    dim = lambda name, prefix: F.struct(
        term(name).alias("data_type"), F.lit(8).alias("size"),
        F.array(F.struct(term(name + " name").alias("value_type"), F.struct(F.lit("string").alias("scalar_type"), names(prefix).alias("string_values")).alias("values"))).alias("typed_values"),
    )
    label = F.struct(term("Label").alias("value_type"), F.struct(F.lit("int").alias("scalar_type"), F.col("label").cast("bigint").alias("int_value")).alias("value"))
    cells = F.struct(F.lit("double").alias("scalar_type"), F.col("embedding").cast("array<double>").alias("double_values"))
    return t.embeddings.select(
        F.format_string("vec %d", "vec_id").alias("name"), term("Vector").alias("data_type"), F.array(label).alias("array_context"),
        F.array(dim("Row", "r"), dim("Column", "c")).alias("dim_context"),
        F.array(F.struct(term("Component").alias("value_type"), cells.alias("values"))).alias("typed_values"),
    )


def read_docs(t):
    path = scratch_path(t.spark, "docs")
    vector_doc(t).write.json(path)
    return brick_files.scan_brick_json(t.spark, path, multi_line=False)


@query(
    "scan_brick_json",
    """SELECT 'vec ' || vec_id AS name, 'r' || ((k - 1) // 8 + 1) AS row_name, 'c' || ((k - 1) % 8 + 1) AS col_name, 'Label=' || label AS attrs, embedding[k]::DOUBLE AS value
       FROM embeddings, (SELECT unnest(range(1, 65)) AS k)""",
)
def scan_brick_json(t):
    """Header, dimension values and cells of every document put together again."""
    docs = read_docs(t)
    head = brick_files.brick_headers(docs).select("name", F.array_join("attrs", ";").alias("attrs"))
    dims = brick_files.brick_dims(docs)
    cells = brick_files.brick_cells(docs).select("name", F.col("idx")[0].alias("i1"), F.col("idx")[1].alias("i2"), F.col("value").cast("double").alias("value"))
    rows = dims.filter("dim = 1").select("name", F.col("idx").alias("i1"), F.col("value").alias("row_name"))
    cols = dims.filter("dim = 2").select("name", F.col("idx").alias("i2"), F.col("value").alias("col_name"))
    out = cells.join(rows, ["name", "i1"]).join(cols, ["name", "i2"]).join(head, "name")
    return out.select("name", "row_name", "col_name", "attrs", "value")


def foreign_documents(t):
    """Array documents as another program writes them, one per line: vectors of even labels as 8 lists of 8, those of odd
    ones as a flat list; every 50th is broken in one of four ways."""
    values = F.col("embedding").cast("array<double>")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(values, r * 8 + 1, F.lit(8)))
    nested = F.when(F.col("label") % 2 == 0, F.to_json(rows)).otherwise(F.to_json(values))
    text = F.concat(
        F.format_string('{"name": "vec %d", "description": "foreign", "data_type": {"oterm_ref": "DA:9", "oterm_name": "Vector"}, ', "vec_id"),
        F.lit('"array_context": [{"value_type": {"oterm_ref": "ME:4", "oterm_name": "Checked"}, "value": {"scalar_type": "boolean", "boolean_value": '),
        (F.col("label") > 4).cast("string"),
        F.lit('}}, {"value_type": {"oterm_ref": "ME:7", "oterm_name": "Length"}, "value_units": {"oterm_ref": "UO:8", "oterm_name": "m"}, "value": {"scalar_type": "int", "int_value": '),
        F.col("label").cast("string"),
        F.lit('}}], "dim_context": [{"data_type": {"oterm_ref": "ME:5", "oterm_name": "Row"}, "size": 8, "typed_values": {"value_type": {"oterm_ref": "ME:6", "oterm_name": "Even"}, '
              '"values": {"scalar_type": "boolean", "boolean_values": [true, false, true, false, true, false, true, null]}}}, '
              '{"data_type": {"oterm_ref": "ME:8", "oterm_name": "Column"}, "size": 8, "typed_values": []}], '
              '"typed_values": [{"value_type": {"oterm_ref": "ME:2", "oterm_name": "Component"}, "value_units": {"oterm_ref": "UO:1", "oterm_name": "unit"}, '
              '"value_context": [{"value_type": {"oterm_ref": "ME:3", "oterm_name": "Norm"}, "value": {"scalar_type": "oterm_ref", "oterm_ref": "N:2"}}], "values": {"scalar_type": "float", "float_values": '),
        nested, F.lit("}}]}"),
    )
    broken = F.when(F.col("vec_id") % 200 == 0, F.substring(text, 1, 300)).when(F.col("vec_id") % 200 == 50, F.lit("[1, 2]"))
    broken = broken.when(F.col("vec_id") % 200 == 100, F.replace(text, F.lit('"name"'), F.lit('"title"'))).when(F.col("vec_id") % 200 == 150, F.replace(text, F.lit('"size": 8'), F.lit('"size": "many"')))
    path = scratch_path(t.spark, "foreign")
    t.embeddings.select(F.coalesce(broken, text).alias("value")).write.text(path)
    return brick_json.scan_documents(t.spark, path, whole_files=False)


@query("scan_brick_nested", "SELECT 'vec ' || vec_id AS name, ((k - 1) // 8)::INT AS i1, ((k - 1) % 8)::INT AS i2, embedding[k]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS k) WHERE vec_id % 50 <> 0")
def scan_brick_nested(t):
    """Cells of nested and of flat lists."""
    docs = brick_json.accepted(foreign_documents(t))
    out = brick_json.cells(docs, brick_json.variables(docs))
    return out.select("name", F.col("idx")[0].alias("i1"), F.col("idx")[1].alias("i2"), F.col("value").cast("double").alias("value"))


@query("rejected_documents", "SELECT CASE vec_id % 200 WHEN 0 THEN 'not JSON' WHEN 50 THEN 'not an object' WHEN 100 THEN 'no name' ELSE 'a dimension without a size' END AS fault, count(*) AS n FROM embeddings WHERE vec_id % 50 = 0 GROUP BY 1")
def rejected_documents(t):
    return brick_json.rejected(foreign_documents(t)).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "brick_json_context",
    """SELECT 'vec ' || vec_id AS name, 'DA:9' AS type_id, '8,8' AS shape, 'Checked=' || (label > 4) || ' , Length=' || label || ' m' AS attributes,
         'Component unit Norm=N:2' AS variable, 'true,false,true,false,true,false,true,' AS even FROM embeddings WHERE vec_id % 50 <> 0""",
)
def brick_json_context(t):
    """Attributes, units and value context of the arrays, and a dimension of booleans with a gap."""
    docs = brick_json.accepted(foreign_documents(t))
    found = brick_json.variables(docs)
    shown = lambda a: F.concat_ws(" ", F.concat_ws("=", a["type_name"], a["value"]), F.coalesce(a["units_name"], F.lit("")))
    data = found.where("dim IS NULL").select("name", F.concat_ws(" ", "type_name", "units_name", F.array_join(F.transform("context", lambda a: F.concat_ws("=", a["type_name"], a["value"])), ",")).alias("variable"))
    even = brick_json.dimension_values(found).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v"))
    even = even.select("name", F.array_join(F.transform("v", lambda x: F.coalesce(x["value"], F.lit(""))), ",").alias("even"))
    heads = brick_json.headers(docs).select("name", "type_id", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"), F.array_join(F.transform("attributes", shown), ", ").alias("attributes"))
    return heads.join(data, "name").join(even, "name")


@query("unravel_index", "SELECT vec_id, (k - 1) // 32 AS i1, (k - 1) // 8 % 4 AS i2, (k - 1) % 8 AS i3, k - 1 AS pos FROM embeddings, (SELECT unnest(range(1, 65)) AS k)")
def unravel_index(t):
    """Positions to indices and back to positions."""
    flat = t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v"))
    out = flat.select("vec_id", *bricks.unravel_index("p", [2, 4, 8]))
    return out.withColumn("pos", bricks.ravel_index(["i1", "i2", "i3"], [2, 4, 8]))


SUPPLIER_CELLS = """sc AS (SELECT brick_id, CASE v1 WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS i1, CASE v2 WHEN 'F' THEN 0 ELSE 1 END AS i2,
   v3 - CASE WHEN v3 < 1000 THEN 1 ELSE 1995 END AS i3, v1, v2, v3, quantity, price FROM brick_cell)"""


def supplier_cells(t):
    i1 = F.when(F.col("v1") == "A", 0).when(F.col("v1") == "N", 1).otherwise(2)
    i2 = F.when(F.col("v2") == "F", 0).otherwise(1)
    i3 = F.col("v3") - F.when(F.col("v3") < 1000, 1).otherwise(1995)
    return t.brick_cells.select("brick_id", i1.alias("i1"), i2.alias("i2"), i3.alias("i3"), "v1", "v2", "v3", "quantity", "price")


@query(
    "brick_to_json",
    with_(BRICKS, SUPPLIER_CELLS)
    + """SELECT brick_id, 'quantity' AS key, ((i1 * 2 + i2) * 12 + i3)::BIGINT AS pos, quantity AS value FROM sc
         UNION ALL SELECT brick_id, 'price', (i1 * 2 + i2) * 12 + i3, price FROM sc""",
)
def brick_to_json(t):
    """Arrays written as JSON blocks and read back: nothing is lost. Small blocks are used on purpose."""
    pos = bricks.ravel_index(["i1", "i2", "i3"], [3, 2, 12])
    cells = supplier_cells(t).select("brick_id", pos.alias("pos"), "quantity", "price").unpivot(["brick_id", "pos"], ["quantity", "price"], "data_var", "value")
    dims = supplier_cells(t).select("brick_id", F.lit(1).alias("dim"), F.lit("flag").alias("var"), F.col("i1").alias("idx"), F.col("v1").alias("value")).distinct()
    texts = brick_files.brick_to_json(t.bricks.select("brick_id", "name", "dim_types"), dims, cells, block=10)
    path = scratch_path(t.spark, "blocks")
    texts.write.parquet(path)
    return brick_files.scan_json_blocks(t.spark.read.parquet(path), "data", "double")


@query("brick_to_csv", SALES_SQL + "SELECT i1 + 1 AS c1, i2 + 1 AS c2, i3 + 1 AS c3, quantity, price, n FROM sales_cell")
def brick_to_csv(t):
    """Long CSV with 1-based indices, read back."""
    path = scratch_path(t.spark, "csv")
    brick_files.brick_to_csv(t.sales_cells, ["i1", "i2", "i3"], ["quantity", "price", "n"], path)
    return t.spark.read.csv(path, schema="c1 bigint, c2 int, c3 int, quantity double, price double, n bigint")


def sectioned_text(t):
    """Every vector as a sectioned CSV array; one row of text holds all its lines."""
    labels = lambda p: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.concat(x.cast("string"), F.lit("," + p), x.cast("string"))), "\n")
    data = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda v, k: F.concat_ws(",", (F.floor(k / 8) + 1).cast("string"), (k % 8 + 1).cast("string"), v.cast("string")),
    )
    return t.embeddings.select(
        F.concat_ws(
            "\n",
            F.format_string("name,vec %d", "vec_id"), F.lit('description,"a vector, whole"'), F.lit("type,Vector <DA:9>"),
            F.format_string("meta,Label <ME:4>,%d", "label"), F.lit("values,Component <ME:2>,norm <ME:3>,l2 <ME:4>,unit <UO:1>"), F.lit("size,8,8"),
            F.lit("dmeta,1,Row <ME:5>,Row name <ME:6>"), labels("r"), F.lit("dmeta,2,Column <ME:7>,Column name <ME:8>"), labels("c"),
            F.lit("data"), F.array_join(data, "\n"),
        ).alias("value")
    )


@query(
    "scan_brick_csv",
    """SELECT 'vec ' || vec_id AS name, 'a vector, whole' AS description, 'DA:9' AS type_term_id, 'r' || ((k - 1) // 8 + 1) AS row_name, 'c' || ((k - 1) % 8 + 1) AS col_name, embedding[k]::DOUBLE AS value
       FROM embeddings, (SELECT unnest(range(1, 65)) AS k)""",
)
def scan_brick_csv(t):
    path = scratch_path(t.spark, "sectioned")
    sectioned_text(t).write.text(path)
    lines = materialize(brick_files.scan_brick_csv(t.spark, path), "sections")
    head = brick_files.sectioned_headers(lines).select("brick_key", "name", "description", "type_term_id")
    dims = brick_files.sectioned_dims(lines)
    cells = brick_files.sectioned_cells(lines).select(
        "brick_key", F.col("idx")[0].alias("i1"), F.col("idx")[1].alias("i2"), F.col("vals")[0].cast("double").alias("value")
    )
    rows = dims.filter("dim = 1").select("brick_key", F.col("idx").alias("i1"), F.col("value").alias("row_name"))
    cols = dims.filter("dim = 2").select("brick_key", F.col("idx").alias("i2"), F.col("value").alias("col_name"))
    out = cells.join(rows, ["brick_key", "i1"]).join(cols, ["brick_key", "i2"]).join(head, "brick_key")
    return out.select("name", "description", "type_term_id", "row_name", "col_name", "value")


# ---- sectioned CSV: context, column definitions and wide tables ----

#: Terms of the fields below: how their values are typed.
FIELD_TERMS = [
    ("ME:2", "component", None, "float"), ("ME:6", "row label", None, "text"), ("ME:8", "column kind", "oref", "oterm_ref"),
    ("ME:10", "made by", "sdt_vector_name", "object_ref"), ("UO:1", "unit vector", None, None),
]


def field_terms(t):
    return t.spark.createDataFrame(FIELD_TERMS, "term_id string, term_name string, target string, scalar_type string")


def described_text(t):
    """Every vector as a sectioned CSV array. Those of odd labels have no ``values`` line: their first dimension, one line for
    the even components and one for the odd ones, becomes two columns."""
    plain = F.col("label") % 2 == 0
    number = lambda k: (F.floor(k / 8) + 1).cast("string")
    values = F.col("embedding").cast("array<double>")
    rows = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.concat(x.cast("string"), F.lit(',"r, '), x.cast("string"), F.lit('"'))), "\n")
    kinds = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.concat(x.cast("string"), F.lit(",k"), x.cast("string"), F.lit(" <K:"), x.cast("string"), F.lit(">"))), "\n")
    full = F.transform(values, lambda v, k: F.concat_ws(",", number(k), (k % 8 + 1).cast("string"), v.cast("string"), F.concat(F.lit("vec"), F.col("vec_id").cast("string"), F.lit(" <V:1>"))))
    half = F.transform(values, lambda v, k: F.concat_ws(",", (k % 2 + 1).cast("string"), (F.floor(k / 2) % 8 + 1).cast("string"), (F.floor(k / 16) + 1).cast("string"), v.cast("string")))
    middle = F.when(plain, F.concat_ws(
        "\n", F.lit("values,Component <ME:2>,Norm <ME:3>,L2 <ME:4>,Unit <UO:1>"), F.lit("values,Maker <ME:10>"), F.lit("size,8,8"),
        F.lit("dmeta,1,Row <ME:5>,Row name <ME:6>,Order <ME:11>,ascending"), rows, F.lit("dmeta,2,Column <ME:8>,Kind <ME:8>"), kinds, F.lit("data"), F.array_join(full, "\n"),
    )).otherwise(F.concat_ws(
        "\n", F.lit("size,2,8,4"), F.lit("dmeta,1,Part <ME:12>,Side <ME:13>"), F.lit("1,Component <ME:2>,Side <ME:13>,even"), F.lit("2,Component <ME:2>,Unit <UO:1>"),
        F.lit("dmeta,2,Row <ME:5>,Row name <ME:6>"), rows, F.lit("dmeta,3,Group <ME:14>,Group <ME:14>"), F.lit("1,g1\n2,g2\n3,g3\n4,g4"), F.lit("data"), F.array_join(half, "\n"),
    ))
    return t.embeddings.select(F.concat_ws(
        "\n", F.format_string("name,vec %d", "vec_id"), F.lit('description,"a vector, whole"'), F.lit("type,Vector <DA:9>"),
        F.format_string("meta,Label <ME:4>,%d", "label"), F.lit("meta,Source,made,here"), middle).alias("value"))


def described(t):
    """Lines, variables and columns of the arrays, and the terms of their fields."""
    def made():
        path = scratch_path(t.spark, "described")
        described_text(t).write.text(path)
        lines = materialize(brick_files.scan_brick_csv(t.spark, path), "sections")
        terms = field_terms(t)
        found = materialize(sectioned.variables(lines, terms), "variables")
        below = t.spark.createDataFrame([("ME:6", "ME:5", False), ("ME:14", "ME:14", False)], "child_id string, parent_id string, is_below boolean")
        return lines, found, materialize(sectioned.columns(found, below), "columns"), terms

    if "_described" not in t.__dict__:  # shared by the queries below, as stored tables would be
        t.__dict__["_described"] = made()
    return t.__dict__["_described"]


def with_name(t, df):
    names = brick_files.sectioned_headers(described(t)[0]).select("brick_key", F.col("name").alias("array"))
    return df.join(names, "brick_key").drop("brick_key")


@query(
    "sectioned_wide",
    """SELECT 'vec ' || vec_id AS "array", 'r, ' || ((k - 1) // 8 + 1) AS row_row_label_order_ascending, 'K:' || ((k - 1) % 8 + 1) AS column_kind_sys_oterm_id,
         'k' || ((k - 1) % 8 + 1) AS column_kind_sys_oterm_name, NULL AS row_row_label, NULL AS "group", embedding[k]::DOUBLE AS component_norm_l2_unit_vector,
         'vec' || vec_id AS sdt_vector_name, NULL::DOUBLE AS component_side_even, NULL::DOUBLE AS component_unit_vector
       FROM embeddings, (SELECT unnest(range(1, 65)) AS k) WHERE label % 2 = 0
       UNION ALL
       SELECT 'vec ' || vec_id, NULL, NULL, NULL, 'r, ' || (j % 8 + 1), 'g' || (j // 8 + 1), NULL, NULL, embedding[2 * j + 1]::DOUBLE, embedding[2 * j + 2]::DOUBLE
       FROM embeddings, (SELECT unnest(range(0, 32)) AS j) WHERE label % 2 = 1""",
)
def sectioned_wide(t):
    """From CSV text to one wide table of all arrays, of both forms."""
    lines, _, cols, _ = described(t)
    out = sectioned.wide(lines, cols)
    numbers = ("component_norm_l2_unit_vector", "component_side_even", "component_unit_vector")
    return with_name(t, out.withColumns({c: F.col(c).cast("double") for c in numbers}))


@query(
    "sectioned_typedef",
    """WITH c(odd, column_name, column_type, scalar_type, foreign_key, comment, unit_id, unit_name, dimension_number, dim_id, dim_name, variable_number, var_id, var_name) AS (VALUES
         (false, 'component_norm_l2_unit_vector', 'variable', 'float', NULL, 'component, Norm=L2', 'UO:1', 'Unit', NULL, NULL, NULL, 1, 'ME:2', 'component'),
         (false, 'sdt_vector_name', 'variable', 'object_ref', 'sdt_vector.sdt_vector_name', 'made by', NULL, NULL, NULL, NULL, NULL, 2, 'ME:10', 'made by'),
         (false, 'row_row_label_order_ascending', 'dimension_variable', 'text', NULL, 'row label, Order=ascending', NULL, NULL, 1, 'ME:5', 'Row', 1, 'ME:6', 'row label'),
         (false, 'column_kind_sys_oterm_id', 'dimension_variable', 'oterm_ref', 'sys_oterm.sys_oterm_id', 'column kind, ontology term CURIE', NULL, NULL, 2, 'ME:8', 'column kind', 1, 'ME:8', 'column kind'),
         (false, 'column_kind_sys_oterm_name', 'dimension_variable', 'oterm_ref', NULL, 'column kind', NULL, NULL, 2, 'ME:8', 'column kind', 1, 'ME:8', 'column kind'),
         (true, 'component_side_even', 'variable', 'float', NULL, 'component, Side=even', NULL, NULL, NULL, NULL, NULL, 1, 'ME:2', 'component'),
         (true, 'component_unit_vector', 'variable', 'float', NULL, 'component', 'UO:1', 'Unit', NULL, NULL, NULL, 2, 'ME:2', 'component'),
         (true, 'row_row_label', 'dimension_variable', 'text', NULL, 'row label', NULL, NULL, 1, 'ME:5', 'Row', 1, 'ME:6', 'row label'),
         (true, 'group', 'dimension_variable', NULL, NULL, 'Group', NULL, NULL, 2, 'ME:14', 'Group', 1, 'ME:14', 'Group'))
       SELECT 'vec ' || vec_id AS "array", c.* EXCLUDE odd FROM embeddings JOIN c ON odd = (label % 2 = 1)""",
)
def sectioned_typedef(t):
    """Column definitions of all arrays; without a ``values`` line dimensions count from one less."""
    return with_name(t, sectioned.typedef_rows(described(t)[2])).drop("line")


@query(
    "sectioned_arrays",
    """SELECT 'vec ' || vec_id AS "array", 'a vector, whole' AS description, 'DA:9' AS type_id, 'Vector' AS type_name,
         CASE label % 2 WHEN 0 THEN '8,8' ELSE '8,4' END AS shape, CASE label % 2 WHEN 0 THEN 'ME:5,ME:8' ELSE 'ME:5,ME:14' END AS dim_ids,
         CASE label % 2 WHEN 0 THEN 'Row,column kind' ELSE 'Row,Group' END AS dim_names, CASE label % 2 WHEN 0 THEN 'row label;column kind' ELSE 'row label;Group' END AS dim_variables,
         CASE label % 2 WHEN 0 THEN 'ME:2,ME:10' ELSE 'ME:2,ME:2' END AS value_ids, CASE label % 2 WHEN 0 THEN 'component,made by' ELSE 'component,component' END AS value_names,
         'ME:4:' || label || '|Source:made,here' AS context FROM embeddings""",
)
def sectioned_arrays(t):
    """Headers of all arrays, with their context lines."""
    lines, found, _, terms = described(t)
    joined = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)
    rest = F.array_join(F.slice("line", F.lit(2), F.size("line")), ",")
    context = sectioned.meta(lines).select("brick_key", "n", F.concat_ws(":", F.coalesce("property_id", "property_name"), rest).alias("text"))
    context = context.groupBy("brick_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "|").alias("context"))
    out = sectioned.headers(lines, found, terms).join(context, "brick_key")
    variables = F.array_join(F.transform("dim_variables", lambda v: F.array_join(v, ",")), ";").alias("dim_variables")
    return out.select(F.col("name").alias("array"), "description", "type_id", "type_name", *map(joined, ("shape", "dim_ids", "dim_names")), variables, *map(joined, ("value_ids", "value_names")), "context")


@query("brick_to_wide", SALES_SQL + "SELECT supplier_name, nation, balance, flag, month, year, quantity, price FROM sales_cell JOIN sales_d1 USING (i1) JOIN sales_d2 USING (i2) JOIN sales_d3 USING (i3)")
def brick_to_wide(t):
    return t.sales.wide().select("supplier_name", "nation", "balance", "flag", "month", "year", "quantity", "price")


@query("het_split", SALES_SQL + "SELECT i1, i2, i3, unnest(['quantity', 'price']) AS i0, unnest([quantity, price]) AS value FROM sales_cell")
def het_split(t):
    """Two value columns become the first dimension."""
    return bricks.wide_to_long(t.sales_cells.select("i1", "i2", "i3", "quantity", "price"), ["i1", "i2", "i3"], ["quantity", "price"])


@query("het_merge", SALES_SQL + "SELECT i1, i2, i3, quantity, price FROM sales_cell")
def het_merge(t):
    """The first dimension back to columns: undoes the split."""
    long = bricks.wide_to_long(t.sales_cells.select("i1", "i2", "i3", "quantity", "price"), ["i1", "i2", "i3"], ["quantity", "price"])
    return bricks.long_to_wide(long, ["i1", "i2", "i3"], "i0", ["quantity", "price"])


@query(
    "expand_term_values",
    """SELECT p_partkey AS id, 'BRAND:' || split_part(p_brand, '#', 2) AS term_id, p_brand AS term_name, p_type AS ref_name, p_name AS plain FROM part""",
)
def expand_term_values(t):
    term = F.concat("p_brand", F.lit(" <BRAND:"), F.split("p_brand", "#")[1], F.lit(">"))
    ref = F.concat("p_type", F.lit(" <Type>"))
    ids = brick_files.expand_term_values(term, "oref")
    return t.part.select(
        F.col("p_partkey").alias("id"), ids[0].alias("term_id"), ids[1].alias("term_name"),
        brick_files.expand_term_values(ref, "ref")[0].alias("ref_name"), brick_files.expand_term_values("p_name", None)[0].alias("plain"),
    )


@query(
    "brick_column_names",
    """WITH v AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)
       SELECT 'PNAME:' || replace(p_name, ' ', '_') AS var_id,
         CASE WHEN w2 = 'gear' THEN replace(p_name, ' ', '_') || '_size_id|' || replace(p_name, ' ', '_') || '_size_name'
              WHEN w2 = 'ring' THEN 'size_sdt_part_name'
              WHEN w1 = 'blue' THEN replace(p_name, ' ', '_') || '_size'
              ELSE 'blue_' || replace(p_name, ' ', '_') || '_size' END AS columns
       FROM v WHERE NOT (w2 = 'gear' AND w1 = 'blue') UNION ALL SELECT 'PNAME:blue_gear', 'size_id|size_name' FROM v WHERE p_name = 'blue gear'""",
)
def brick_column_names(t):
    """Part names as variables of the dimension ``blue``: names under it drop the prefix, gears are terms, rings references."""
    w = F.split("p_name", " ")
    kind = F.when(w[1] == "gear", "oref").when(w[1] == "ring", "ref")
    variables = t.part.select("p_name").distinct().select(
        F.lit("WORD:blue").alias("dim_id"), F.lit("Blue").alias("dim_name"),
        F.concat(F.lit("PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("var_id"), F.initcap("p_name").alias("var_name"),
        F.array(F.lit("Size")).alias("extra"), kind.alias("kind"),
        F.when(kind == "oref", "id,name").when(kind == "ref", "sdt_part_name").alias("target"),
    )
    below = is_descendant(variables.select(F.col("var_id").alias("child_id"), F.col("dim_id").alias("parent_id")).distinct(), t.closure)
    out = brick_files.brick_column_names(variables, below)
    return out.select("var_id", F.array_join("columns", "|").alias("columns"))


@query(
    "brick_typedef_rows",
    with_(BRICKS)
    + """, v(brick_id, seq, dim, name) AS (SELECT brick_id, 1, 1, 'flag' FROM brick UNION ALL SELECT brick_id, 2, 1, 'flag name' FROM brick UNION ALL SELECT brick_id, 3, 2, 'status' FROM brick
           UNION ALL SELECT brick_id, 4, 3, 'time' FROM brick UNION ALL SELECT brick_id, 5, NULL, 'quantity' FROM brick UNION ALL SELECT brick_id, 6, NULL, 'price' FROM brick)
         SELECT brick_id, seq, v.name, CASE WHEN dim IS NULL THEN 'variable' ELSE 'dimension_variable' END AS data_type, dim - CASE WHEN monthly THEN 1 ELSE 0 END AS dimension_number,
           row_number() OVER (PARTITION BY brick_id, dim ORDER BY seq)::INT AS variable_number FROM v JOIN brick USING (brick_id)""",
)
def brick_typedef_rows(t):
    """Arrays by month count as having no values line, so their dimensions shift."""
    items = [(1, 1, "flag"), (2, 1, "flag name"), (3, 2, "status"), (4, 3, "time"), (5, None, "quantity"), (6, None, "price")]
    structs = F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(d).cast("int").alias("dim"), F.lit(n).alias("name")) for s, d, n in items])
    variables = t.bricks.select("brick_id", F.explode(structs).alias("v")).select("brick_id", "v.*")
    return brick_files.brick_typedef_rows(variables, t.bricks.select("brick_id", (~F.col("monthly")).alias("has_values")))


@query(
    "build_ndarray_table",
    with_(BRICKS)
    + """SELECT brick_id, name, count(DISTINCT v1) || ',' || count(DISTINCT v2) || ',' || count(DISTINCT v3) AS shape,
           'flag|status|' || CASE WHEN monthly THEN 'month' ELSE 'year' END AS dim_types, 'price|quantity' AS value_types FROM brick_cell JOIN brick USING (brick_id) GROUP BY brick_id, name, monthly""",
)
def build_ndarray_table(t):
    """Shapes counted from the cells of every array."""
    c = t.brick_cells
    sizes = c.groupBy("brick_id").agg(F.count_distinct("v1").alias("s1"), F.count_distinct("v2").alias("s2"), F.count_distinct("v3").alias("s3"))
    dims = sizes.join(t.bricks.select("brick_id", "dim_types"), "brick_id").select(
        "brick_id", F.explode(F.array(*[F.struct(F.lit(n + 1).alias("dim"), F.col("dim_types")[n].alias("dim_type"), F.col(f"s{n + 1}").alias("size")) for n in range(3)])).alias("d")
    ).select("brick_id", "d.*")
    names = t.bricks.select("brick_id", F.posexplode(F.array_sort("value_types")).alias("seq", "name"))
    used = t.bricks.select("brick_id", "name").join(sizes.select("brick_id"), "brick_id", "left_semi")
    out = brick_files.build_ndarray_table(used, dims, names)
    return out.select("brick_id", "name", "shape", F.array_join("dim_types", "|").alias("dim_types"), F.array_join("value_types", "|").alias("value_types"))


@query("union_brick_metadata", with_(BRICKS) + "SELECT brick_id, name, data_type_term_name AS data_type FROM brick")
def union_brick_metadata(t):
    """Metadata written in two places, read as one table."""
    rows = t.bricks.select("brick_id", "name", F.col("data_type_term_name").alias("data_type"), "monthly")
    paths = [scratch_path(t.spark, "meta1"), scratch_path(t.spark, "meta2")]
    rows.filter("monthly").drop("monthly").write.csv(paths[0], header=True)
    rows.filter("NOT monthly").drop("monthly").write.csv(paths[1], header=True)
    return brick_files.union_brick_metadata(t.spark, paths, "brick_id string, name string, data_type string")


@query(
    "brick_summary",
    SALES_SQL + """SELECT 1 AS dim, 'Supplier' AS name, count(*) AS size, 4 AS n_vars FROM sales_d1 UNION ALL SELECT 2, 'Flag', count(*), 1 FROM sales_d2 UNION ALL SELECT 3, 'Month', count(*), 2 FROM sales_d3""",
)
def brick_summary(t):
    return t.sales.summary()


@query(
    "comment_json",
    """SELECT p_partkey AS id, '{"description":"' || p_name || '"' || CASE WHEN p_size > 25 THEN ',"unit":"inch"' ELSE '' END || '}' AS comment, CASE WHEN p_size > 25 THEN 'inch' END AS unit FROM part""",
)
def comment_json_query(t):
    comment = comment_json(description="p_name", unit=F.when(F.col("p_size") > 25, F.lit("inch")))
    out = t.part.select(F.col("p_partkey").alias("id"), comment.alias("comment"))
    return out.withColumn("unit", F.get_json_object("comment", "$.unit"))
