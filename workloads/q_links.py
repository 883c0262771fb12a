"""Joins along provenance and by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.text import split_object_list
from gridloom.operators import links, lineage
from gridloom.operators.reach import reach
from workloads.recast import num_id
from workloads.registry import query
from workloads.sqlparts import BRICKS, EDGES, EDGES_SQL, LINEAGE_SQL, PROCESS, SALES, SALES_SQL, TERMS_SQL, with_

URGENT_NATION = """SELECT DISTINCT replace(obj, 'Part:', '') AS id FROM pout JOIN proc ON proc.id = process_id
  WHERE obj_type = 'Part' AND process_term_name = '1-URGENT'
  AND (person_term_id = 'NATION:0000004' OR person_term_id IN (SELECT format('PERSON:{:07d}', c_custkey) FROM customer WHERE c_nationkey = 4))"""


@query("output_of_process", LINEAGE_SQL + URGENT_NATION)
def output_of_process(t):
    """Parts made by urgent orders of the people of one nation, both given as terms."""
    ws = t.workspace
    people = ws.ontology.terms.filter("term_id = 'NATION:0000004' OR array_contains(parents, 'NATION:0000004')")
    q = ws.query("Part").is_output_of_process({"process": "1-URGENT"}).is_output_of_process({"person": {"=": people}})
    return q.find().select("id")


@query(
    "input_of_process",
    LINEAGE_SQL
    + """SELECT DISTINCT replace(obj, 'Customer:', '') AS id FROM pin JOIN proc ON proc.id = process_id
         WHERE obj_type = 'Customer' AND date_start >= '1999-06' AND date_start < '1999-07'
           AND obj IN (SELECT format('Customer:Customer{:07d}', c_custkey) FROM customer WHERE c_acctbal > 1000)""",
)
def input_of_process(t):
    q = t.workspace.query("Customer").has({"balance": {">": 1000.0}})
    return q.is_input_of_process({"date_start": {">=": "1999-06", "<": "1999-07"}}).find().select("id")


PROC_COLS = "proc.id, process_term_name, person_term_name, date_start"


@query(
    "up_processes",
    LINEAGE_SQL + f"SELECT DISTINCT obj, {PROC_COLS} FROM pout JOIN proc ON proc.id = process_id",
)
def up_processes(t):
    objects = t.process_output.select("obj").distinct()
    return links.processes_of(objects, t.process_output, t.process).select(
        "obj", "id", "process_term_name", "person_term_name", "date_start"
    )


@query(
    "down_processes",
    LINEAGE_SQL + f"SELECT DISTINCT obj, {PROC_COLS} FROM pin JOIN proc ON proc.id = process_id",
)
def down_processes(t):
    objects = t.process_input.select("obj").distinct()
    return links.processes_of(objects, t.process_input, t.process).select(
        "obj", "id", "process_term_name", "person_term_name", "date_start"
    )


KEYS = """keys(obj, user_key) AS (
  SELECT format('Customer:Customer{:07d}', c_custkey), c_name FROM customer
  UNION ALL SELECT format('Supplier:Supplier{:07d}', s_suppkey), s_name FROM supplier
  UNION ALL SELECT format('Nation:Nation{:07d}', n_nationkey), n_name FROM nation
  UNION ALL SELECT format('Region:Region{:07d}', r_regionkey), r_name FROM region
  UNION ALL SELECT format('Part:Part{:07d}', p_partkey), format('part-{:07d}', p_partkey) FROM part
)"""


def keys(t):
    ws = t.workspace
    out = None
    for name in ("Customer", "Supplier", "Nation", "Region", "Part"):
        e = ws.types[name]
        rows = e.df.select(F.col("vertex").alias("obj"), F.col(e.upk).alias("user_key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "up_process_docs",
    with_(EDGES, KEYS)
    + """SELECT pout.obj, pout.process_id, pin.obj AS other, pin.obj_type AS other_type, user_key
         FROM pout JOIN pin USING (process_id) LEFT JOIN keys ON keys.obj = pin.obj""",
)
def up_process_docs(t):
    objects = t.process_output.select("obj").distinct()
    return links.process_docs(objects, t.process_output, t.process_input, keys(t))


@query(
    "down_process_docs",
    with_(EDGES, KEYS)
    + """SELECT pin.obj, pin.process_id, pout.obj AS other, pout.obj_type AS other_type, user_key
         FROM pin JOIN pout USING (process_id) LEFT JOIN keys ON keys.obj = pout.obj""",
)
def down_process_docs(t):
    objects = t.process_input.select("obj").distinct()
    return links.process_docs(objects, t.process_input, t.process_output, keys(t))


@query(
    "process_io_by_type",
    EDGES_SQL
    + """SELECT process_id, side, obj_type, count(*) AS n, min(obj) AS first_obj FROM
         (SELECT 'in' AS side, * FROM pin UNION ALL SELECT 'out', * FROM pout) GROUP BY ALL""",
)
def process_io_by_type(t):
    io = links.io_by_type(t.process_input, t.process_output)
    return io.groupBy("process_id", "side", "obj_type").agg(F.count("*").alias("n"), F.min("obj").alias("first_obj"))


def reach_sql(start: str, edge: str = "edge") -> str:
    return f""", start(v) AS ({start}),
      down(v) AS (SELECT dst FROM {edge} JOIN start ON src = v UNION SELECT dst FROM {edge} JOIN down ON src = v)
    """


EDGES_REC = with_(EDGES, recursive=True).rstrip()
BACK = ", back(src, dst) AS (SELECT dst, src FROM edge)"
POOR = "SELECT format('Customer:Customer{:07d}', c_custkey) FROM customer WHERE c_acctbal < -900"


@query("linked_up_to", EDGES_REC + reach_sql(POOR) + "SELECT replace(v, 'Part:', '') AS id FROM down WHERE v LIKE 'Part:%'")
def linked_up_to(t):
    return t.workspace.query("Part").linked_up_to("Customer", {"balance": {"<": -900.0}}).find().select("id")


@query(
    "linked_down_to",
    EDGES_REC
    + BACK
    + reach_sql("SELECT format('Part:Part{:07d}', p_partkey) FROM part WHERE p_size = 50", "back")
    + "SELECT replace(v, 'Customer:', '') AS id FROM down WHERE v LIKE 'Customer:%'",
)
def linked_down_to(t):
    return t.workspace.query("Customer").linked_down_to("Part", {"size": 50}).find().select("id")


@query(
    "intersect_links",
    EDGES_REC
    + BACK
    + reach_sql("SELECT format('Part:Part{:07d}', p_partkey) FROM part WHERE p_size = 50", "back")
    + """, nat(v) AS (SELECT format('Customer:Customer{:07d}', c_custkey) FROM customer WHERE c_nationkey = 6)
      SELECT replace(v, 'Customer:', '') AS id FROM down JOIN nat USING (v)""",
)
def intersect_links(t):
    q = t.workspace.query("Customer").linked_down_to("Part", {"size": 50}).linked_up_to("Nation", {"name": "NATION_6"})
    return q.find().select("id")


@query(
    "linked_with_props",
    """SELECT DISTINCT format('Part{:07d}', l_partkey) AS id, c_acctbal AS balance, c_mktsegment AS segment
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""",
)
def linked_with_props(t):
    """Parts with the balance and segment of every customer they come from."""
    q = t.workspace.query("Part").linked_up_to_item_with_properties(["balance", "segment"], add_properties=True)
    return q.find().select("id", "balance", "segment")


ALL = """, sel(id) AS (SELECT id FROM proc WHERE process_term_name = '2-HIGH' AND campaign_term_name = 'P'),"""


@query(
    "search_all_up",
    EDGES_REC + "," + PROCESS + BACK + ALL
    + """ start(v) AS (SELECT 'Process:' || id FROM sel),
        up(v) AS (SELECT v FROM start UNION SELECT dst FROM back JOIN up ON src = v)
        SELECT DISTINCT replace(obj, 'Nation:', '') AS id FROM (SELECT * FROM pin UNION ALL SELECT * FROM pout)
        WHERE obj_type = 'Nation' AND 'Process:' || process_id IN (SELECT v FROM up)""",
)
def search_all_up(t):
    q = t.workspace.query("Nation").is_output_of_process({"process": "2-HIGH"}).is_output_of_process({"campaign": "P"})
    return q.search_all_up(True).find().select("id")


@query(
    "search_all_down",
    EDGES_REC
    + ","
    + PROCESS
    + """, start(v) AS (SELECT 'Process:' || id FROM proc WHERE person_term_name = 'NATION_2'),
        down(v) AS (SELECT dst FROM edge JOIN start ON src = v UNION SELECT dst FROM edge JOIN down ON src = v)
        SELECT DISTINCT replace(obj, 'Part:', '') AS id FROM (SELECT * FROM pin UNION ALL SELECT * FROM pout)
        WHERE obj_type = 'Part' AND 'Process:' || process_id IN (SELECT v FROM down)""",
)
def search_all_down(t):
    q = t.workspace.query("Part").is_output_of_process({"person": "NATION_2"})
    return q.search_all_down(True).find().select("id")


@query(
    "immediate_parent",
    """SELECT format('Brick{:07d}', s_suppkey) AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey
       JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' AND s_acctbal > 0""",
)
def immediate_parent(t):
    """Arrays of one data type made from a supplier alone, of suppliers with a positive balance."""
    q = t.workspace.query("Brick").immediate_parent({"processInputs": "Supplier", "processOutputs": "DDT_europe sales"})
    return q.linked_up_to("Supplier", {"balance": {">": 0.0}}).find().select("id")


@query(
    "upstream_props",
    """SELECT format('Brick-{:07d}:Brick{:07d}', n_regionkey + 1, s_suppkey) AS obj, unnest(['balance', 'name']) AS prop,
         unnest([format('Supplier:Supplier{:07d}', s_suppkey), format('Supplier:Supplier{:07d}', s_suppkey)]) AS source,
         2::BIGINT AS hops, unnest([CAST(CAST(s_acctbal AS DECIMAL(18, 2)) AS VARCHAR), s_name]) AS value
       FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def upstream_props(t):
    """Name and balance of the nearest upstream object of every array; nations above have a name too."""
    objects = t.process_output.filter("obj_type LIKE 'Brick-%'").select("obj")
    ws = t.workspace
    sup, nat = ws.types["Supplier"].df, ws.types["Nation"].df
    values = (
        sup.select("vertex", F.lit("name").alias("prop"), F.col("name").alias("value"))
        .unionByName(sup.select("vertex", F.lit("balance").alias("prop"), F.col("balance").cast("decimal(18,2)").cast("string").alias("value")))
        .unionByName(nat.select("vertex", F.lit("name").alias("prop"), F.col("name").alias("value")))
    )
    out = links.upstream_props(objects, t.edges, values)
    return out.withColumn("hops", F.col("hops").cast("bigint"))


UPSTREAM_SQL = with_(
    EDGES,
    """up(vertex) AS (
      SELECT obj FROM pout WHERE obj_type LIKE 'Brick-%' OR obj_type = 'Part'
      UNION SELECT src FROM up JOIN edge ON dst = vertex)""",
    recursive=True,
)


@query("upstream_intermediates", UPSTREAM_SQL + "SELECT DISTINCT src, dst FROM edge WHERE dst IN (SELECT vertex FROM up)")
def upstream_intermediates(t):
    """What lies above any array or part, each edge once."""
    objects = t.process_output.filter("obj_type LIKE 'Brick-%' OR obj_type = 'Part'").select("obj")
    return links.upstream_graph(objects, t.edges)


@query(
    "upstream_props_together",
    """SELECT format('Customer:Customer{:07d}', c_custkey) AS obj, unnest(['name', 'region']) AS prop,
         format('Nation:Nation{:07d}', n_nationkey) AS source, 2::BIGINT AS hops,
         unnest([n_name, format('Region{:07d}', n_regionkey)]) AS value
       FROM customer JOIN nation ON n_nationkey = c_nationkey
       UNION ALL
       SELECT DISTINCT format('Part:Part{:07d}', part), p, format('Nation:Nation{:07d}', n_nationkey), 4, CASE p WHEN 'name' THEN n_name ELSE format('Region{:07d}', n_regionkey) END
       FROM (SELECT lineitem.l_partkey AS part, min(least(c_nationkey, s_nationkey)) AS n_nationkey
             FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
             JOIN lineitem l2 USING (l_orderkey) JOIN supplier ON s_suppkey = l2.l_suppkey GROUP BY 1)
       JOIN nation USING (n_nationkey), unnest(['name', 'region']) AS u(p)""",
)
def upstream_props_together(t):
    """Name and region of the nearest upstream object that has both, of every customer and part; suppliers have a name only."""
    objects = t.process_output.filter(F.col("obj_type").isin("Customer", "Part")).select("obj")
    ws = t.workspace
    sup, nat = ws.types["Supplier"].df, ws.types["Nation"].df

    def value(df, name):
        return df.select("vertex", F.lit(name).alias("prop"), F.col(name).alias("value"))

    values = value(sup, "name").unionByName(value(nat, "name")).unionByName(value(nat, "region"))
    out = links.upstream_props(objects, t.edges, values, together=True)
    return out.withColumn("hops", F.col("hops").cast("bigint"))


@query(
    "upk_to_pk",
    """WITH want AS (SELECT p_name AS user_key FROM part UNION SELECT c_name FROM customer),
            names AS (SELECT p_name AS k, format('Part{:07d}', p_partkey) AS id FROM part WHERE p_size <= 1
                      UNION ALL SELECT c_name, format('Customer{:07d}', c_custkey) FROM customer WHERE c_acctbal > 0)
       SELECT user_key, CASE WHEN count(id) = 1 THEN min(id) END AS pk,
              CASE count(id) WHEN 0 THEN 'unknown' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status
       FROM want LEFT JOIN names ON k = user_key GROUP BY 1""",
)
def upk_to_pk(t):
    wanted = t.part.select(F.col("p_name").alias("user_key")).union(t.customer.select("c_name")).distinct()
    parts = t.part.filter("p_size <= 1").select(F.col("p_name").alias("k"), num_id("Part", "p_partkey").alias("id"))
    people = t.customer.filter("c_acctbal > 0").select(F.col("c_name").alias("k"), num_id("Customer", "c_custkey").alias("id"))
    return links.upk_to_pk(wanted, parts.union(people), "k", "id")


@query("pk_exists", "SELECT DISTINCT l_partkey AS pk FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def pk_exists(t):
    wanted = t.lineitem.select(F.col("l_partkey").alias("pk")).distinct()
    return links.pk_exists(wanted, t.part.filter("p_size <= 25"), "p_partkey")


# an order line as a process with its references as one text
LINE_PROCESS = """lineproc AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey,
         l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS id,
         'Order: ' || l_orderkey || ', Supplier: ' || l_suppkey || ', "Part: ' || l_partkey || '", Generic: b,x' AS input_objects
  FROM lineitem)"""


def line_process(t):
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("id"),
        F.format_string('Order: %d, Supplier: %d, "Part: %d", Generic: b,x', "l_orderkey", "l_suppkey", "l_partkey").alias("input_objects"),
        "l_partkey",
    )


@query(
    "key_rewrite",
    f"""WITH {LINE_PROCESS} SELECT id, 'Order: ' || l_orderkey || '|' || s_name || '|Part: ' || l_partkey || '|Generic: b|x' AS refs
        FROM lineproc JOIN supplier ON s_suppkey = l_suppkey""",
)
def key_rewrite(t):
    """Supplier references become names; the rest of each list and its order stay."""
    rows = line_process(t).select("id", split_object_list("input_objects").alias("refs"))
    names = t.supplier.select(F.concat(F.lit("Supplier: "), F.col("s_suppkey").cast("string")).alias("ref"), F.col("s_name").alias("other"))
    return links.key_rewrite(rows, "id", "refs", names).select("id", F.array_join("refs", "|").alias("refs"))


@query(
    "normalize_process_io",
    f"""WITH {LINE_PROCESS}, refs AS (
          SELECT id AS sys_process_id, l_orderkey::VARCHAR AS sdt_order_id, NULL AS sdt_supplier_id, NULL AS sdt_part_id FROM lineproc
          UNION ALL SELECT id, NULL, l_suppkey::VARCHAR, NULL FROM lineproc
          UNION ALL SELECT id, NULL, NULL, l_partkey::VARCHAR FROM lineproc JOIN part ON p_partkey = l_partkey WHERE p_size <= 25)
        SELECT * FROM refs""",
)
def normalize_process_io(t):
    """References to parts above size 25 dangle and are dropped, as are references to unknown types."""
    known = (
        t.orders.select(F.lit("sdt_order").alias("table"), F.col("o_orderkey").cast("string").alias("key"))
        .union(t.supplier.select(F.lit("sdt_supplier"), F.col("s_suppkey").cast("string")))
        .union(t.part.filter("p_size <= 25").select(F.lit("sdt_part"), F.col("p_partkey").cast("string")))
    )
    refs = links.normalize_process_io(line_process(t), "input_objects", known)
    return links.io_columns(refs, ["sdt_order", "sdt_supplier", "sdt_part"])


@query(
    "map_to_core_type",
    SALES_SQL + """SELECT i1, nation, n.id AS nation_id FROM sales_d1
      LEFT JOIN (SELECT n_name, format('Nation{:07d}', max(n_nationkey)) AS id FROM nation WHERE n_regionkey < 3 GROUP BY 1) n ON n_name = nation""",
)
def map_to_core_type(t):
    """Nations of some regions only, so that other rows of the dimension stay null."""
    known = t.nation.filter("n_regionkey < 3").select("n_name", num_id("Nation", "n_nationkey").alias("id"))
    return links.map_to_core_type(t.sales_dims[0].select("i1", "nation"), "nation", known, "n_name", "id", "nation_id")


@query(
    "add_core_type_var",
    SALES_SQL + """SELECT i1, supplier, s_acctbal AS balance, n_name AS home FROM sales_d1
      LEFT JOIN supplier ON format('Supplier{:07d}', s_suppkey) = supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
)
def add_core_type_var(t):
    entity = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        num_id("Supplier", "s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("n_name").alias("home")
    )
    return links.add_core_type_var(t.sales_dims[0].select("i1", "supplier"), "supplier", entity, "id", ["balance", "home"])


@query(
    "add_brick_var",
    SALES_SQL + """SELECT i3, month, o.orders AS orders FROM sales_d3 LEFT JOIN
      (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS orders FROM orders GROUP BY 1) o ON m = month""",
)
def add_brick_var(t):
    """Orders per month, a 1-d array of its own, looked up by equal month."""
    other = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.count("*").alias("n"))
    return links.add_brick_var(t.sales_dims[2].select("i3", "month"), "month", other, "m", "n", "orders")


@query("add_var", SALES_SQL + "SELECT i1, i2, i3, quantity, price / quantity AS unit_price, upper(flag) AS flag FROM sales_cell JOIN sales_d2 USING (i2)")
def add_var(t):
    """An aligned data variable computed in place and a dimension variable joined on its index."""
    cells = t.sales_cells.withColumn("unit_price", F.col("price") / F.col("quantity"))
    return cells.join(t.sales_dims[1], "i2").select("i1", "i2", "i3", "quantity", "unit_price", F.upper("flag").alias("flag"))


@query(
    "add_up_props",
    SALES_SQL + """SELECT i1, supplier, n.n_name AS name, format('Region{:07d}', n.n_regionkey) AS region
      FROM sales_d1 JOIN supplier ON format('Supplier{:07d}', s_suppkey) = supplier JOIN nation n ON n_nationkey = s_nationkey""",
)
def add_up_props(t):
    """Each supplier of the dimension gets the name and region of the nation it comes from."""
    dim = links.map_to_core_type(
        t.sales_dims[0].select("i1", "supplier_name"), "supplier_name", t.supplier_entity, "name", "id", "supplier"
    )
    linked = t.workspace.query("Supplier").linked_up_to_item_with_properties(["name", "region"], True, "Nation").find()
    props = linked.select(F.col("id").alias("supplier"), "name", "region")
    return dim.join(props, "supplier", "left").select("i1", "supplier", "name", "region")


@query(
    "connects_up",
    """SELECT format('Brick{:07d}', s_suppkey) AS brick_id, n_name IN ('NATION_1', 'NATION_2', 'NATION_3') AS connects
       FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def connects_up(t):
    """Does the supplier named by an array come from one of three nations."""
    refs = t.bricks.select("brick_id", F.format_string("Supplier:Supplier%07d", "s_suppkey").alias("vertex"))
    start = t.workspace.types["Nation"].df.filter(F.col("name").isin("NATION_1", "NATION_2", "NATION_3")).select("vertex")
    return links.connects_up(refs, start, t.edges)


@query(
    "brick_fk_refs",
    """SELECT DISTINCT format('Brick{:07d}', l_suppkey) AS brick_id, format('Part:Part{:07d}', l_partkey) AS ref FROM lineitem
       UNION SELECT format('Brick{:07d}', s_suppkey), format('Nation:Nation{:07d}', s_nationkey) FROM supplier""",
)
def brick_fk_refs(t):
    """Part ids from dimension values and nation names from attributes."""
    parts = t.lineitem.select(
        num_id("Brick", "l_suppkey").alias("brick_id"), F.lit("Part").alias("type"), num_id("Part", "l_partkey").alias("value"), F.lit(True).alias("is_pk")
    ).distinct()
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        num_id("Brick", "s_suppkey").alias("brick_id"), F.lit("Nation").alias("type"), F.col("n_name").alias("value"), F.lit(False).alias("is_pk")
    )
    known = t.nation_entity.select(F.lit("Nation").alias("type"), F.col("name").alias("user_key"), "id")
    return links.brick_fk_refs(parts.unionByName(named), known)


@query("fk_check", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def fk_check(t):
    return links.fk_check(t.lineitem.select("l_orderkey", "l_partkey"), "l_partkey", t.part.filter("p_size <= 40"), "p_partkey")


@query(
    "resolve_name",
    """SELECT DISTINCT 'sdt_part:' || l_partkey AS token, 'sdt_part:' || l_partkey || coalesce('  (' || p_name || ')', '') AS label
       FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey
       UNION SELECT 'sdt_supplier:' || s_suppkey, 'sdt_supplier:' || s_suppkey || '  (' || s_name || ')' FROM supplier""",
)
def resolve_name(t):
    tokens = t.lineitem.select(F.concat(F.lit("sdt_part:"), F.col("l_partkey").cast("string")).alias("token")).union(
        t.supplier.select(F.concat(F.lit("sdt_supplier:"), F.col("s_suppkey").cast("string")))
    )
    names = t.part.filter("p_size <= 25").select(
        F.lit("sdt_part").alias("table"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")
    ).union(t.supplier.select(F.lit("sdt_supplier"), F.col("s_suppkey").cast("string"), "s_name"))
    return links.resolve_name(tokens.distinct(), names)


@query(
    "token_from_name",
    """SELECT 'sdt_customer' AS table, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'sdt_customer:' || c_custkey END AS token FROM customer
       UNION ALL SELECT 'sdt_part', p_name, 'sdt_part:' || min(p_partkey::VARCHAR) FROM part GROUP BY p_name""",
)
def token_from_name(t):
    names = t.customer.filter("c_acctbal > 0").select(
        F.lit("sdt_customer").alias("table"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("id")
    ).union(t.part.select(F.lit("sdt_part"), "p_name", F.col("p_partkey").cast("string")))
    wanted = t.customer.select(F.lit("sdt_customer").alias("table"), F.col("c_name").alias("name")).union(
        t.part.select(F.lit("sdt_part"), "p_name").distinct()
    )
    return links.token_from_name(names, wanted)


@query("forward_map", EDGES_SQL + "SELECT DISTINCT pin.obj, pout.obj AS output FROM pin JOIN pout USING (process_id)")
def forward_map(t):
    """Every input with every output: as many rows as there are pairs. ``forward_relation`` holds the same without them."""
    return links.forward_map(t.process_input, t.process_output)


@query(
    "forward_relation",
    EDGES_SQL + """SELECT 'in' AS side, process_id, obj FROM pin WHERE process_id IN (SELECT process_id FROM pout)
      UNION ALL SELECT 'out', process_id, obj FROM pout WHERE process_id IN (SELECT process_id FROM pin)""",
)
def forward_relation(t):
    return lineage.Through(t.process_input, t.process_output).rows()


@query("forward_sizes", EDGES_SQL + "SELECT pin.obj, count(DISTINCT process_id) AS n_processes, count(*) AS n_pairs FROM pin JOIN pout USING (process_id) GROUP BY 1")
def forward_sizes(t):
    """How many outputs each input leads to, counted without making the pairs."""
    return lineage.Through(t.process_input, t.process_output).sizes()


@query("backward_sizes", EDGES_SQL + "SELECT pout.obj, count(DISTINCT process_id) AS n_processes, count(*) AS n_pairs FROM pin JOIN pout USING (process_id) GROUP BY 1")
def backward_sizes(t):
    return lineage.Through(t.process_output, t.process_input).sizes()


@query("forward_pairs", EDGES_SQL + "SELECT pin.obj, process_id, pout.obj AS other FROM pin JOIN pout USING (process_id) WHERE pin.obj_type IN ('Nation', 'Region')")
def forward_pairs(t):
    """The pairs of chosen inputs alone: places and what was set up there."""
    places = t.process_input.filter(F.col("obj_type").isin("Nation", "Region")).select("obj")
    return lineage.Through(t.process_input, t.process_output).pairs(places)


@query(
    "processes_of_object",
    f"""WITH {LINE_PROCESS} SELECT id, input_objects FROM lineproc WHERE l_partkey = 17""",
)
def processes_of_object(t):
    """The list-contains form: reference lists are searched for one object, whatever its type prefix."""
    rows = line_process(t).withColumn("outputs", F.array(F.concat(F.lit("Part:"), F.col("l_partkey").cast("string"))))
    return links.processes_of_object(rows, "outputs", "17").select("id", "input_objects")


# ---- reachability and lineage ----


@query(
    "reach",
    EDGES_REC
    + """, walk(v, hops) AS (SELECT 'Region:Region0000002', 0 UNION SELECT dst, hops + 1 FROM walk JOIN edge ON src = v)
      SELECT v AS vertex, min(hops)::BIGINT AS hops FROM walk WHERE hops > 0 GROUP BY v""",
)
def reach_query(t):
    start = t.region.filter("r_regionkey = 2").select(F.lit("Region:Region0000002").alias("vertex"))
    return reach(start, t.edges).select("vertex", F.col("hops").cast("bigint").alias("hops"))


@query(
    "provenance_tree",
    EDGES_REC
    + BACK
    + """, walk(v, hops) AS (SELECT format('Part:Part{:07d}', p_partkey), 0 FROM part WHERE p_size = 13
                             UNION SELECT dst, hops + 1 FROM walk JOIN back ON src = v),
      found AS (SELECT v AS obj, min(hops) // 2 AS depth FROM walk WHERE v NOT LIKE 'Process:%' GROUP BY v)
      SELECT depth::BIGINT AS depth, f.obj, pout.process_id, pin.obj AS input, pin.obj NOT IN (SELECT obj FROM pout) AS is_leaf
      FROM found f JOIN pout USING (obj) LEFT JOIN pin ON pin.process_id = pout.process_id""",
)
def provenance_tree(t):
    start = t.part.filter("p_size = 13").select(F.format_string("Part:Part%07d", "p_partkey").alias("obj"))
    return lineage.provenance_tree(start, t.process_input, t.process_output, t.edges)


@query(
    "build_producer_lookup",
    LINEAGE_SQL
    + """SELECT pout.obj, proc.id, process_term_name, date_end, pin.obj AS input FROM pout JOIN proc ON proc.id = pout.process_id
         LEFT JOIN pin ON pin.process_id = proc.id""",
)
def build_producer_lookup(t):
    out = lineage.producer_lookup(t.process_input, t.process_output, t.process)
    return out.select("obj", "id", "process_term_name", "date_end", "input")


@query(
    "coassembly",
    EDGES_REC
    + """, many AS (SELECT process_id FROM pin WHERE obj_type = 'Supplier' GROUP BY 1 HAVING count(DISTINCT obj) > 9)
      SELECT DISTINCT obj AS vertex FROM pout JOIN many USING (process_id) WHERE obj_type = 'Part'""",
)
def coassembly(t):
    """Parts from orders with more than nine suppliers; nothing is made from parts here."""
    return lineage.coassembled(t.process_input, t.process_output, t.edges, "Part", "Supplier", more_than=9).select("vertex")


@query("add_data_var", SALES_SQL + "SELECT i1, i2, i3, quantity, price, CASE WHEN quantity > 100 THEN 'high' ELSE 'low' END AS level FROM sales_cell")
def add_data_var(t):
    """A data variable of text beside the numeric ones."""
    level = F.when(F.col("quantity") > 100, "high").otherwise("low")
    b = t.sales.add_data_var("level", level)
    return b.cells.select("i1", "i2", "i3", "quantity", "price", "level")
