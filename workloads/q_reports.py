"""Aggregates, the type graph, numbering and row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.text import truncate_list, words
from gridloom.operators import numbering, reports, rowsets
from gridloom.operators.links import lookup_last
from gridloom.operators import type_graph as tg
from workloads.recast import num_id
from workloads.registry import query
from workloads.sqlparts import BRICKS, CLOSURE_SQL, EDGES, ISA, LINEAGE_SQL, PROCESS, SALES_SQL, TERM, TERMS_SQL, with_


@query(
    "term_stat",
    TERMS_SQL
    + """SELECT term_id, term_name, count(*) AS n FROM (
           SELECT 'PTYPE:' || p_type AS term_id FROM part UNION ALL SELECT 'BRAND:' || lpad(split_part(p_brand, '#', 2), 7, '0') FROM part)
         LEFT JOIN term USING (term_id) GROUP BY ALL""",
)
def term_stat(t):
    """An array property is exploded first."""
    return reports.term_stat(t.part_entity, "feature_term_ids", t.terms, exploded=True)


@query("report_brick_types", with_(BRICKS) + "SELECT data_type_term_id AS term_id, data_type_term_name AS term_name, count(*) AS n FROM brick GROUP BY ALL")
def report_brick_types(t):
    return reports.term_stat(t.bricks, "data_type_term_id", t.terms)


def brick_value_terms(t):
    names = t.bricks.select(F.explode(F.concat("dim_types", "value_types")).alias("term_name")).distinct()
    return names.select(F.col("term_name").alias("term_id"), "term_name")


@query("report_dim_types", with_(BRICKS) + "SELECT dim_type AS term_id, dim_type AS term_name, count(*) AS n FROM brick_dimtype GROUP BY ALL")
def report_dim_types(t):
    return reports.term_stat(t.bricks, "dim_types", brick_value_terms(t), exploded=True)


@query(
    "report_value_types",
    with_(BRICKS) + "SELECT v AS term_id, v AS term_name, count(*) AS n FROM (SELECT unnest(['quantity', 'price']) AS v FROM brick) GROUP BY ALL",
)
def report_value_types(t):
    return reports.term_stat(t.bricks, "value_types", brick_value_terms(t), exploded=True)


PROC_SQL = with_(ISA, TERM, PROCESS)


@query("report_process_types", PROC_SQL + "SELECT process_term_id AS term_id, term_name, count(*) AS n FROM proc LEFT JOIN term ON term_id = process_term_id GROUP BY ALL")
def report_process_types(t):
    return reports.term_stat(t.process, "process_term_id", t.terms)


ROLLUP = """, own AS (SELECT person_term_id AS term_id, count(*) AS n FROM proc GROUP BY 1),
  both_ AS (SELECT * FROM own UNION ALL SELECT parent, n FROM own JOIN isa ON child = own.term_id WHERE parent <> 'REGION:0000000')
  SELECT term_id, term_name, sum(n)::BIGINT AS n FROM both_ LEFT JOIN term USING (term_id) GROUP BY ALL"""


@query("report_process_persons", PROC_SQL.rstrip() + ROLLUP)
def report_process_persons(t):
    return reports.lab_rollup(reports.term_stat(t.process, "person_term_id", t.terms), t.terms, "REGION:0000000")


@query("report_process_campaigns", PROC_SQL + "SELECT campaign_term_id AS term_id, term_name, count(*) AS n FROM proc LEFT JOIN term ON term_id = campaign_term_id GROUP BY ALL")
def report_process_campaigns(t):
    return reports.term_stat(t.process, "campaign_term_id", t.terms)


@query(
    "lab_rollup",
    TERMS_SQL.rstrip()
    + """, own AS (SELECT 'PNAME:' || replace(p_name, ' ', '_') AS term_id, count(*) AS n FROM part GROUP BY 1
                   UNION ALL SELECT 'WORD:' || split_part(p_name, ' ', 1), count(*) FROM part GROUP BY 1),
      both_ AS (SELECT * FROM own UNION ALL SELECT parent, n FROM own JOIN isa ON child = own.term_id WHERE parent <> 'PART:0000000')
      SELECT term_id, term_name, sum(n)::BIGINT AS n FROM both_ LEFT JOIN term USING (term_id) GROUP BY ALL""",
)
def lab_rollup(t):
    """Terms with two parents credit both; the root gets nothing."""
    full = F.concat(F.lit("PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_")))
    first = F.concat(F.lit("WORD:"), F.split("p_name", " ")[0])
    counts = t.part.select(F.explode(F.array(full, first)).alias("term_id")).groupBy("term_id").agg(F.count("*").alias("n"))
    return reports.lab_rollup(counts, t.terms, "PART:0000000")


@query(
    "brick_full_types",
    with_(BRICKS)
    + """, typed AS (SELECT brick_id, data_type_term_name AS data_type, string_agg(dim_type, ',' ORDER BY pos) AS dims
                     FROM brick JOIN brick_dimtype USING (brick_id) GROUP BY ALL)
      SELECT data_type, sum(count(*)) OVER (PARTITION BY data_type)::BIGINT AS total, dims, count(*) AS n FROM typed GROUP BY data_type, dims""",
)
def brick_full_types(t):
    return reports.brick_full_types(t.bricks.select(F.col("data_type_term_name").alias("data_type"), "dim_types"))


@query("brick_type_counts", with_(BRICKS) + "SELECT data_type_term_name AS b_type, count(*) AS b_count FROM brick GROUP BY 1")
def brick_type_counts(t):
    return t.bricks.groupBy(F.col("data_type_term_name").alias("b_type")).agg(F.count("*").alias("b_count"))


@query(
    "types_stat",
    with_(BRICKS)
    + """SELECT 'Customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier
         UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'LargePart', count(*) FROM part WHERE p_size > 1000
         UNION ALL SELECT data_type_term_name, count(*) FROM brick GROUP BY 1""",
)
def types_stat(t):
    tables = {"Customer": t.customer, "Supplier": t.supplier, "Part": t.part, "LargePart": t.part.filter("p_size > 1000")}
    return reports.types_stat(tables, t.bricks.select(F.col("data_type_term_name").alias("name")))


# ---- type graph ----

IN_FILTER = """flt(id) AS (SELECT id FROM proc WHERE (campaign_term_id = 'CAMP:F' OR campaign_term_id = 'CAMP:P')
   AND (person_term_id = 'NATION:0000004' OR person_term_id IN (SELECT format('PERSON:{:07d}', c_custkey) FROM customer WHERE c_nationkey = 4)))"""


def in_filter(t):
    lab = t.terms.filter("term_id = 'NATION:0000004' OR array_contains(parents, 'NATION:0000004')")
    chosen = t.process.filter(F.col("campaign_term_id").isin("CAMP:F", "CAMP:P")).join(
        lab.select(F.col("term_id").alias("person_term_id")), "person_term_id", "left_semi"
    )
    hit = chosen.select("id", F.lit(True).alias("_hit"))
    return t.process.select("id", "process_term_name").join(hit, "id", "left").select(
        "id", "process_term_name", F.coalesce("_hit", F.lit(False)).alias("in_filter")
    )


PTYPES = with_(EDGES, PROCESS, IN_FILTER).rstrip() + """,
  fromt AS (SELECT process_id, string_agg(DISTINCT obj_type, '+' ORDER BY obj_type) AS f FROM pin WHERE obj_type NOT LIKE 'Brick-%' GROUP BY 1),
  tot AS (SELECT process_id, string_agg(DISTINCT obj_type, '+' ORDER BY obj_type) AS t FROM pout GROUP BY 1),
  ptype AS (SELECT fromt.process_id, process_term_name AS name, proc.id IN (SELECT id FROM flt) AS in_filter,
                   f || '>' || coalesce(t, '') AS edge_key FROM fromt JOIN proc ON proc.id = fromt.process_id LEFT JOIN tot USING (process_id))
"""


def groups(t):
    g = tg.process_type_edges(t.process_input, t.process_output, in_filter(t))
    return g.withColumn("edge", tg.group_key())


@query("process_type_edges", PTYPES + "SELECT process_id, name, in_filter, edge_key AS edge FROM ptype")
def process_type_edges(t):
    return groups(t).select("process_id", "name", "in_filter", "edge")


CHOSEN = "person_term_id = 'NATION:0000004' AND campaign_term_id = 'CAMP:SETUP'"
AROUND = with_(
    EDGES, PROCESS,
    f"""hit(v) AS (SELECT 'Process:' || id FROM proc WHERE {CHOSEN}),
    up(v) AS (SELECT v FROM hit UNION SELECT src FROM up JOIN edge ON dst = v),
    dn(v) AS (SELECT dst FROM hit JOIN edge ON src = v UNION SELECT dst FROM dn JOIN edge ON src = v),
    mark AS (SELECT id, process_term_name AS name, CASE WHEN 'Process:' || id IN (SELECT v FROM hit) THEN 'match' WHEN 'Process:' || id IN (SELECT v FROM up) THEN 'above' ELSE 'below' END AS mark
      FROM proc WHERE 'Process:' || id IN (SELECT v FROM up UNION ALL SELECT v FROM dn)),
    fromt AS (SELECT process_id, string_agg(DISTINCT obj_type, '+' ORDER BY obj_type) AS f FROM pin WHERE obj_type NOT LIKE 'Brick-%' GROUP BY 1),
    tot AS (SELECT process_id, string_agg(DISTINCT obj_type, '+' ORDER BY obj_type) AS t FROM pout GROUP BY 1)""",
    recursive=True,
)


@query(
    "process_type_edges_filtered",
    AROUND + "SELECT id AS process_id, name, mark, mark = 'match' AS in_filter, f || '>' || coalesce(t, '') AS edge FROM mark JOIN fromt ON fromt.process_id = id LEFT JOIN tot ON tot.process_id = id",
)
def process_type_edges_filtered(t):
    """The type graph of one person's set-up, what led to it and what came of it."""
    around = tg.processes_around(t.process, t.process.filter(CHOSEN).select("id"), t.edges)
    g = tg.process_type_edges(t.process_input, t.process_output, around).withColumn("edge", tg.group_key())
    return g.join(around.select(F.col("id").alias("process_id"), "mark"), "process_id").select("process_id", "name", "mark", "in_filter", "edge")


@query(
    "type_graph_edges_filtered",
    AROUND + """SELECT f || '>' || coalesce(t, '') AS edge, count(*) AS num, string_agg(DISTINCT name, ', ' ORDER BY name) AS names, bool_or(mark = 'match') AS in_filter
      FROM mark JOIN fromt ON fromt.process_id = id LEFT JOIN tot ON tot.process_id = id GROUP BY 1""",
)
def type_graph_edges_filtered(t):
    around = tg.processes_around(t.process, t.process.filter(CHOSEN).select("id"), t.edges)
    g = tg.process_type_edges(t.process_input, t.process_output, around).withColumn("edge", tg.group_key())
    return tg.type_graph_edges(g).withColumn("names", F.array_join("names", ", "))


GRAPH = PTYPES.rstrip() + """,
  ge AS (SELECT edge_key AS edge, count(*) AS num, string_agg(DISTINCT name, ', ' ORDER BY name) AS names, bool_or(in_filter) AS in_filter FROM ptype GROUP BY 1),
  side AS (SELECT edge_key AS edge, 'from' AS side, obj_type, count(DISTINCT obj) AS n_type FROM ptype JOIN pin USING (process_id)
             WHERE obj_type NOT LIKE 'Brick-%' GROUP BY ALL
           UNION ALL SELECT edge_key, 'to', obj_type, count(DISTINCT obj) FROM ptype JOIN pout USING (process_id) GROUP BY ALL)
"""


@query("type_graph_edges", GRAPH + "SELECT edge, num, names, in_filter FROM ge")
def type_graph_edges(t):
    return tg.type_graph_edges(groups(t)).withColumn("names", F.array_join("names", ", "))


SEGMENTED = """
  sin(process_id, obj_type) AS (SELECT format('ProcessO{:07d}', o_orderkey), 'Customer_' || c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey),
  sout(process_id, obj_type) AS (SELECT DISTINCT format('ProcessO{:07d}', l_orderkey), 'Part_' || p_type FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(
    "type_graph_merge",
    with_(PROCESS, SEGMENTED, recursive=True).rstrip()
    + """, shape AS (SELECT i.process_id, any_value(i.obj_type) AS f, string_agg(DISTINCT o.obj_type, '+' ORDER BY o.obj_type) AS t, any_value(process_term_name) AS name
                     FROM sin i LEFT JOIN sout o USING (process_id) JOIN proc ON proc.id = i.process_id GROUP BY 1),
      node AS (SELECT DISTINCT f || '>' || t AS g, name, f, unnest(string_split(t, '+')) AS tt FROM shape WHERE t IS NOT NULL),
      link AS (SELECT DISTINCT a.g AS a, b.g AS b FROM node a JOIN node b USING (name, f, tt)),
      comp(a, b) AS (SELECT a, b FROM link UNION SELECT comp.a, link.b FROM comp JOIN link ON link.a = comp.b),
      label AS (SELECT a AS g, min(b) AS label FROM comp GROUP BY 1),
      named AS (SELECT label, string_agg(DISTINCT f, '+' ORDER BY f) || '>' || string_agg(DISTINCT tt, '+' ORDER BY tt) AS edge FROM label JOIN node USING (g) GROUP BY 1)
      SELECT coalesce(edge, f || '>') AS edge, count(*) AS num, string_agg(DISTINCT name, ', ' ORDER BY name) AS names
      FROM shape LEFT JOIN label ON label.g = f || '>' || t LEFT JOIN named USING (label) GROUP BY 1""",
)
def type_graph_merge(t):
    """Orders by customer segment and part type: edges of one segment overlap and merge."""
    by_segment = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        num_id("ProcessO", "o_orderkey").alias("process_id"), F.concat(F.lit("Customer_"), "c_mktsegment").alias("obj_type")
    )
    by_ptype = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        num_id("ProcessO", "l_orderkey").alias("process_id"), F.concat(F.lit("Part_"), "p_type").alias("obj_type")
    )
    shaped = tg.process_type_edges(by_segment, by_ptype, in_filter(t)).withColumn("edge", tg.group_key())
    merged = tg.type_graph_edges(tg.type_graph_merge(shaped))
    return merged.select("edge", "num", F.array_join("names", ", ").alias("names"))


COUNTS = GRAPH.rstrip() + """,
  total AS (SELECT edge, side, sum(n_type) AS n_side, count(*) AS n_types FROM side GROUP BY ALL),
  label AS (SELECT edge, num || ' ' || names || '<br>' || coalesce((SELECT string_agg(n_type || ' ' || obj_type, ', ' ORDER BY obj_type) FROM side s WHERE s.edge = ge.edge AND side = 'from'), '')
     || ' &rarr; ' || coalesce((SELECT string_agg(n_type || ' ' || obj_type, ', ' ORDER BY obj_type) FROM side s WHERE s.edge = ge.edge AND side = 'to'), '') AS text FROM ge),
  sized AS (SELECT s.*, n_side, n_types, in_filter, text, (round_even(log10(num), 0) + 1)::INT AS whole,
     round_even(n_type / n_side * (round_even(log10(num), 0) + 1), 0)::INT AS share
     FROM side s JOIN total USING (edge, side) JOIN ge USING (edge) JOIN label USING (edge)),
  cnt AS (SELECT edge, side, obj_type, n_type, CASE WHEN n_types = 1 THEN whole WHEN share = whole THEN greatest(whole - 1, 1) WHEN share = 0 THEN 1 ELSE share END AS thickness,
     in_filter, text FROM sized)
"""


def counts(t):
    return tg.graph_counts(t.process_input, t.process_output, in_filter(t))


@query("type_graph_counts", COUNTS + "SELECT * FROM cnt")
def type_graph_counts(t):
    return counts(t)


LINKS = COUNTS.rstrip() + """,
  sz AS (SELECT edge, count(*) FILTER (side = 'from') AS nf, count(*) FILTER (side = 'to') AS nt, min(obj_type) FILTER (side = 'from') AS only_from FROM cnt GROUP BY 1),
  lnk AS (SELECT obj_type AS source, 'edge:' || edge AS target, thickness, in_filter, text FROM cnt JOIN sz USING (edge) WHERE nt > 0 AND side = 'from' AND (nf > 1 OR nt > 1)
    UNION ALL SELECT CASE WHEN nf > 1 OR nt > 1 THEN 'edge:' || edge ELSE only_from END,
      CASE WHEN obj_type LIKE 'Brick-%' THEN 'array:' || edge || ':' || obj_type ELSE obj_type END, thickness, in_filter, text
      FROM cnt JOIN sz USING (edge) WHERE nt > 0 AND side = 'to')
"""


@query(
    "type_graph_links",
    LINKS + "SELECT l.*, EXISTS (SELECT 1 FROM lnk b WHERE b.source = l.target AND b.target = l.source AND l.source <> l.target) AS reversible FROM lnk l",
)
def type_graph_links(t):
    return tg.reversible_links(tg.type_graph_links(counts(t))).select("source", "target", "thickness", "in_filter", "text", "reversible")


@query(
    "type_graph_nodes",
    LINKS.rstrip()
    + """, st(name, n) AS (SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
                           UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Page', count(*) FROM pages),
      nd AS (SELECT name, 'SDT_' AS category, n FROM st
             UNION ALL SELECT 'array:' || edge || ':' || obj_type, 'DDT_', n_type FROM cnt WHERE side = 'to' AND obj_type LIKE 'Brick-%'
             UNION ALL SELECT DISTINCT v, 'hub', 0 FROM (SELECT source AS v FROM lnk UNION SELECT target FROM lnk) WHERE v LIKE 'edge:%')
      SELECT name, category, n, name NOT IN (SELECT target FROM lnk) AS is_root, name NOT IN (SELECT source FROM lnk UNION SELECT target FROM lnk) AS unused,
        name IN (SELECT target FROM lnk WHERE target LIKE 'array:%' AND source IN
          (SELECT source FROM lnk WHERE target LIKE 'array:%' AND source NOT LIKE 'edge:%' GROUP BY 1 HAVING count(*) > 2)) AS clustered FROM nd""",
)
def type_graph_nodes(t):
    tables = {"Region": t.region, "Nation": t.nation, "Customer": t.customer, "Supplier": t.supplier, "Part": t.part, "Page": t.pages}
    statics = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("obj_type"), "n")
        statics = row if statics is None else statics.unionByName(row)
    c = counts(t)
    return tg.type_graph_nodes(statics, c, tg.type_graph_links(c))


# ---- other aggregates ----


@query(
    "keep_latest_process",
    LINEAGE_SQL
    + """, latest AS (SELECT obj, max(process_id) AS id FROM pout GROUP BY 1)
      SELECT id, process_term_name FROM proc WHERE id IN (SELECT id FROM latest) OR id NOT IN (SELECT process_id FROM pout)""",
)
def keep_latest_process(t):
    return reports.keep_latest_process(t.process.select("id", "process_term_name"), t.process_output)


@query(
    "multi_producer_objects",
    with_(EDGES) + "SELECT obj, count(DISTINCT process_id) AS producers FROM pout GROUP BY 1 HAVING count(DISTINCT process_id) > 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def multi_producer_objects(t):
    return reports.multi_producer_objects(t.process_output)


TEXTY = """texty AS (SELECT CAST(o_orderkey AS VARCHAR) AS whole, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS num, o_orderpriority AS txt,
  CASE WHEN o_orderstatus = 'F' THEN 'Yes' WHEN o_orderstatus = 'O' THEN 'no' ELSE '' END AS flag, ' ' AS blank FROM orders)"""


def texty(t):
    flag = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "no").otherwise("")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("whole"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("num"),
        F.col("o_orderpriority").alias("txt"),
        flag.alias("flag"),
        F.lit(" ").alias("blank"),
    )


def kind_sql(c: str) -> str:
    v = f"nullif(trim({c}), '')"
    return f"""SELECT '{c}' AS "column", CASE WHEN count({v}) = 0 THEN NULL
      WHEN bool_and(lower({v}) IN ('true', 'false', 'yes', 'no', '1', '0', 't', 'f')) THEN 'boolean'
      WHEN bool_and(regexp_full_match({v}, '[+-]?[0-9]+')) THEN 'integer'
      WHEN bool_and(try_cast({v} AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS inferred FROM texty"""


TEXT_COLS = ["whole", "num", "txt", "flag", "blank"]
INFER = f"WITH {TEXTY}, inf AS (" + " UNION ALL ".join(kind_sql(c) for c in TEXT_COLS) + ")\n"


@query("infer_column_types", INFER + "SELECT * FROM inf")
def infer_column_types(t):
    return reports.infer_column_types(texty(t), TEXT_COLS)


@query(
    "check_declared_types",
    INFER
    + """, dec AS (SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'whole' WHEN '2-HIGH' THEN 'num' WHEN '3-MEDIUM' THEN 'txt' WHEN '5-LOW' THEN 'flag' ELSE 'blank' END AS "column",
             CASE o_orderpriority WHEN '1-URGENT' THEN 'int' WHEN '2-HIGH' THEN 'integer' WHEN '3-MEDIUM' THEN 'oterm_ref' WHEN '5-LOW' THEN 'text' ELSE 'float' END AS declared FROM orders)
      SELECT "column", declared, inferred, CASE "column" WHEN 'whole' THEN 'int' WHEN 'num' THEN 'double' WHEN 'txt' THEN 'oterm_ref' WHEN 'flag' THEN 'boolean' ELSE 'float' END AS final,
        "column" IN ('num', 'flag') AS warning FROM inf LEFT JOIN dec USING ("column")""",
)
def check_declared_types(t):
    """One declaration per order priority, for the five columns inferred from all orders."""
    p = F.col("o_orderpriority")
    column = F.when(p == "1-URGENT", "whole").when(p == "2-HIGH", "num").when(p == "3-MEDIUM", "txt").when(p == "5-LOW", "flag").otherwise("blank")
    declared = F.when(p == "1-URGENT", "int").when(p == "2-HIGH", "integer").when(p == "3-MEDIUM", "oterm_ref").when(p == "5-LOW", "text").otherwise("float")
    rows = t.orders.select(column.alias("column"), declared.alias("declared")).distinct()
    return reports.check_declared_types(reports.infer_column_types(texty(t), TEXT_COLS), rows)


@query(
    "validation_counts",
    """SELECT 'balance' AS variable, count(*) AS total_count, count(*) FILTER (c_acctbal >= 0) AS valid_count, count(*) FILTER (NOT c_acctbal >= 0) AS invalid_count FROM customer
       UNION ALL SELECT 'segment', count(*), count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')), count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer""",
)
def validation_counts(t):
    return reports.validation_counts(
        t.customer, {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    )


@query(
    "mapped_ref_count",
    """SELECT 'Part.id' AS property, count(*) FILTER (l_partkey::VARCHAR IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size <= 25)) AS n FROM lineitem
       UNION ALL SELECT 'Supplier.id', count(*) FILTER (l_partkey::VARCHAR IN (SELECT s_suppkey::VARCHAR FROM supplier)) FROM lineitem
       UNION ALL SELECT 'Customer.name', 0 FROM region WHERE r_regionkey = 0""",
)
def mapped_ref_count(t):
    cells = t.lineitem.select(F.col("l_partkey").cast("string").alias("v"))
    return reports.mapped_ref_count(
        cells,
        "v",
        {"Part.id": (t.part.filter("p_size <= 25"), "p_partkey"), "Supplier.id": (t.supplier, "s_suppkey"), "Customer.name": (t.customer, "c_name")},
    )


@query(
    "brick_index_rows",
    CLOSURE_SQL.rstrip()
    + "," + BRICKS
    + """, bt AS (SELECT brick_id, data_type_term_id AS term_id, NULL::VARCHAR AS value FROM brick
                  UNION SELECT format('Brick{:07d}', l_suppkey), 'PTYPE:' || p_type, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
      SELECT DISTINCT brick_id, 'term' AS kind, term_id, NULL::VARCHAR AS value FROM bt
      UNION ALL SELECT DISTINCT brick_id, 'value', term_id, value FROM bt WHERE value IS NOT NULL
      UNION ALL SELECT DISTINCT brick_id, 'ancestor', ancestor_id, NULL FROM bt JOIN closure USING (term_id)""",
)
def brick_index_rows(t):
    """The data type of each array, and part types with part names as their values."""
    own = t.bricks.select("brick_id", F.col("data_type_term_id").alias("term_id"), F.lit(None).cast("string").alias("value"))
    used = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        num_id("Brick", "l_suppkey").alias("brick_id"), F.concat(F.lit("PTYPE:"), "p_type").alias("term_id"), F.col("p_name").alias("value")
    )
    return reports.brick_index_rows(own.unionByName(used.distinct()), t.closure)


@query(
    "dim_unique_check",
    """SELECT 'part' AS dim, count(*) AS size, count(DISTINCT (p_name, p_brand, p_size)) = count(*) AS is_unique FROM part
       UNION ALL SELECT 'customer', count(*), count(DISTINCT (c_name, c_mktsegment, c_nationkey)) = count(*) FROM customer""",
)
def dim_unique_check(t):
    dim = t.part.select(F.lit("part").alias("dim"), F.col("p_name").alias("v1"), F.col("p_brand").alias("v2"), F.col("p_size").alias("v3")).union(
        t.customer.select(F.lit("customer"), "c_name", "c_mktsegment", "c_nationkey")
    )
    return reports.dim_unique_check(dim, ["dim"], ["v1", "v2", "v3"])


@query("distinct_dim_values", "SELECT p_name AS value, min(p_partkey) AS first_idx FROM part GROUP BY 1")
def distinct_dim_values(t):
    return reports.distinct_dim_values(t.part, "p_partkey", "p_name")


@query(
    "map_stats",
    """SELECT round(avg(s_acctbal), 6) AS mean_latitude, round(avg(s_nationkey), 6) AS mean_longitude, min(s_nationkey) AS lowest, max(s_nationkey) AS highest,
         min(s_nationkey) FILTER (s_nationkey <> 0) AS lowest_non_zero, round(sum(s_nationkey) / count(*), 6) AS average FROM supplier""",
)
def map_stats(t):
    points = t.supplier.select(F.col("s_acctbal").alias("latitude"), F.col("s_nationkey").alias("longitude"), F.col("s_nationkey").alias("color"))
    out = reports.map_stats(points)
    return out.select(*[F.round(c, 6).alias(c) if c.startswith(("mean", "average")) else c for c in out.columns])


# ---- numbering ----


@query(
    "assign_ids",
    """WITH new AS (SELECT 'Customer' AS type, c_name AS upk FROM customer UNION ALL SELECT 'Supplier', s_name FROM supplier),
            off AS (SELECT 'Customer' AS type, max(o_custkey) AS last_no FROM orders)
       SELECT type, upk, type || format('{:07d}', coalesce(last_no, 0) + row_number() OVER (PARTITION BY type ORDER BY upk)) AS id FROM new LEFT JOIN off USING (type)""",
)
def assign_ids(t):
    """Customers continue after the greatest customer number in use, suppliers start at 1."""
    new = t.customer.select(F.lit("Customer").alias("type"), F.col("c_name").alias("upk")).union(t.supplier.select(F.lit("Supplier"), "s_name"))
    offsets = t.orders.agg(F.max("o_custkey").alias("last_no")).select(F.lit("Customer").alias("type"), "last_no")
    return numbering.assign_ids(new, "type", "upk", offsets)


@query(
    "renumber_index",
    SALES_SQL + """, kept AS (SELECT DISTINCT i1, i3 FROM sales_cell WHERE quantity > 20)
      SELECT i1, i3, dense_rank() OVER (PARTITION BY i1 ORDER BY i3) - 1 AS pos FROM kept""",
)
def renumber_index(t):
    """Months left per supplier after a filter, numbered densely again."""
    return numbering.dense_positions(t.sales_cells.filter("quantity > 20"), ["i1"], "i3")


@query(
    "smallest_gap",
    """SELECT min(gap) AS gap, 0 AS digits FROM (SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT floor(o_totalprice) AS v FROM orders))""",
)
def smallest_gap(t):
    """Gap of whole prices; decimals are covered by the tests, where float noise is in hand."""
    return numbering.smallest_gap(t.orders.select(F.floor("o_totalprice").cast("double").alias("v")), "v")


@query(
    "first_last_lookup",
    "SELECT p_name, max(p_partkey) AS p_partkey, arg_max(p_size, p_partkey) AS p_size FROM part GROUP BY 1",
)
def first_last_lookup(t):
    return lookup_last(t.part.select("p_name", "p_partkey", "p_size"), "p_name", "p_partkey")


# ---- row sets ----


@query("sort_desc_count", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name")
def sort_desc_count(t):
    return rowsets.sort_desc_count(t.part.groupBy("p_name").agg(F.count("*").alias("n")), "n", "p_name")


@query(
    "labs_first_sort",
    "SELECT n_name || ' Lab' AS name FROM nation UNION ALL SELECT c_name FROM customer",
)
def labs_first_sort(t):
    names = t.customer.select(F.col("c_name").alias("name")).union(t.nation.select(F.concat("n_name", F.lit(" Lab"))))
    return rowsets.labs_first(names, "name")


@query("head_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def head_n(t):
    return rowsets.head_n(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 100)


@query(
    "preview_values",
    SALES_SQL + """, ranked AS (SELECT i1, i3, sum(quantity) AS q, dense_rank() OVER (PARTITION BY i1 ORDER BY i3) - 1 AS pos FROM sales_cell GROUP BY i1, i3)
      SELECT i1, count(*) AS size, string_agg(q::BIGINT, '|' ORDER BY pos) FILTER (pos < 5) || CASE WHEN count(*) > 5 THEN '|...' ELSE '' END AS preview FROM ranked GROUP BY 1""",
)
def preview_values(t):
    """First five monthly quantities of each supplier."""
    monthly = t.sales_cells.groupBy("i1", "i3").agg(F.sum("quantity").cast("bigint").alias("q"))
    ranked = numbering.number_rows(monthly, ["i1"], ["i3"])
    return rowsets.preview_values(ranked, ["i1"], "pos", "q", 5).select("i1", "size", F.array_join("preview", "|").alias("preview"))


@query(
    "truncate_list",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS l FROM documents)
       SELECT doc_id, CASE WHEN len(l) > 10 THEN array_to_string(l[1:9], '|') || '|and ' || (len(l) - 9) || ' more' ELSE array_to_string(l, '|') END AS shown FROM w""",
)
def truncate_list_query(t):
    return t.documents.select("doc_id", F.array_join(truncate_list(words("text")), "|").alias("shown"))


@query("union_distinct", "SELECT doc_id FROM documents WHERE source = 'src3' UNION SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def union_distinct(t):
    d = t.documents
    return rowsets.union_distinct(
        d.filter("source = 'src3'").select("doc_id"), d.filter("lang = 'fr'").select("doc_id"), t.labels.filter("toxic = 1").select("doc_id")
    )


@query("append_unique", LINEAGE_SQL + "SELECT process_id FROM pin WHERE obj_type = 'Supplier' UNION SELECT process_id FROM pout WHERE obj_type = 'Supplier'")
def append_unique(t):
    """Processes above and below suppliers, each once."""
    up = t.process_output.filter("obj_type = 'Supplier'").select("process_id")
    down = t.process_input.filter("obj_type = 'Supplier'").select("process_id")
    return rowsets.union_distinct(up, down)


@query(
    "intersection_rows",
    """SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
       AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0) AND p_size < 10""",
)
def intersection_rows(t):
    l = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    parts = t.part.filter("p_size < 10").select("p_partkey", "p_name")
    return rowsets.intersect_rows(parts, [l.filter("l_returnflag = 'R'"), l.filter("l_discount = 0")], "p_partkey")


@query("distinct_rows", "SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_tax > 0.05")
def distinct_rows(t):
    return rowsets.distinct_rows(t.lineitem.filter("l_tax > 0.05").select(F.col("l_suppkey").alias("id")), "id")


@query("table_view", "SELECT format('Customer{:07d}', c_custkey) AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def table_view(t):
    return rowsets.table_view(t.customer_entity, ["name", "segment"])


@query("drop_term_ids", "SELECT format('Part{:07d}', p_partkey) AS id, p_type AS type, p_brand AS brand, p_size AS size FROM part")
def drop_term_ids(t):
    cols = ["id", "type_term_id", "type_term_name", "brand_term_id", "brand_term_name", "size"]
    return rowsets.drop_term_ids(t.part_entity.select(*cols))
