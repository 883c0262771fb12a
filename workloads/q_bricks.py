"""Array operations and plot data, on one array over all suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.text import concat_dim_values, series_label
from gridloom.operators import bricks, catalog
from gridloom.operators.pca import CellPca, PcaModel, rows_to_arrays
from gridloom.operators.reports import term_stat
from gridloom.plans import slices
from gridloom.plans.search import search
from workloads.registry import query
from workloads.sqlparts import BRICKS, LINEAGE_SQL, PROCESS, SALES_SQL, with_


def r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- masks and selection ----


@query(
    "dim_filter_compare",
    SALES_SQL + "SELECT i1 AS idx, nation, balance FROM sales_d1 WHERE balance >= 2500 OR lower(nation) = 'nation_3' OR balance < -500",
)
def dim_filter_compare(t):
    b = t.sales
    mask = b.dim_mask(0, "balance", ">=", 2500.0) | b.term_mask(0, "supplier", "nation", "Nation_3") | b.dim_mask(0, "balance", "<", -500.0)
    return b.dims[0].df.filter(mask.test).select("idx", "nation", "balance")


@query("dim_filter_logic", SALES_SQL + "SELECT i3 AS idx, month FROM sales_d3 WHERE year >= 1997 AND (month < '1998-04' OR month = '2000-02') AND year <> 1999")
def dim_filter_logic(t):
    b = t.sales
    late = b.dim_mask(2, "month", "<", "1998-04") | b.dim_mask(2, "month", "==", "2000-02")
    mask = b.dim_mask(2, "year", ">=", 1997) & late & b.dim_mask(2, "year", "!=", 1999)
    return b.dims[2].df.filter(mask.test).select("idx", "month")


@query("data_filter_logic", SALES_SQL + "SELECT i1, i2, i3, quantity, price FROM sales_cell WHERE quantity > 100 AND price < 300000 OR quantity = 1")
def data_filter_logic(t):
    b = t.sales
    mask = (b.data_mask("quantity", ">", 100.0) & b.data_mask("price", "<", 300000.0)) | b.data_mask("quantity", "==", 1.0)
    return b.where(mask).cells.select("i1", "i2", "i3", "quantity", "price")


@query(
    "dim_where",
    SALES_SQL + """, kept AS (SELECT i1, dense_rank() OVER (ORDER BY i1) - 1 AS new FROM sales_d1 WHERE balance > 0)
      SELECT new AS i1, i2, i3, quantity FROM sales_cell JOIN kept USING (i1)""",
)
def dim_where(t):
    b = t.sales
    return b.where(b.dim_mask(0, "balance", ">", 0.0)).cells.select("i1", "i2", "i3", "quantity")


@query("null_mask", SALES_SQL + "SELECT i1, i2, CASE WHEN quantity > 50 THEN price END IS NULL AS is_none, count(*) AS n FROM sales_cell GROUP BY ALL")
def null_mask(t):
    b = t.sales
    b = b.add_data_var("big_price", F.when(F.col("quantity") > 50, F.col("price")))
    none = b.where(b.none_mask("big_price")).cells.withColumn("is_none", F.lit(True))
    some = b.where(b.not_none_mask("big_price")).cells.withColumn("is_none", F.lit(False))
    return none.unionByName(some).groupBy("i1", "i2", "is_none").agg(F.count("*").alias("n"))


@query(
    "brick_select",
    SALES_SQL + """, k1 AS (SELECT i1, row_number() OVER (ORDER BY i1) - 1 AS new FROM sales_d1 WHERE nation_key < 9),
      k3 AS (SELECT i3, row_number() OVER (ORDER BY i3) - 1 AS new FROM sales_d3 WHERE year = 1998)
      SELECT k1.new AS i1, k3.new AS i2, quantity FROM sales_cell JOIN k1 USING (i1) JOIN k3 USING (i3) JOIN sales_d2 USING (i2) WHERE flag = 'R'""",
)
def brick_select(t):
    """One flag, one year; the flag dimension is then of size 1 and becomes an attribute."""
    b = t.sales
    b = b.where(b.dim_mask(0, "nation_key", "<", 9))
    return b.select(None, "R", {"year": 1998}).cells.select("i1", "i2", "quantity")


@query(
    "drop_unit_dims",
    SALES_SQL + "SELECT i1, i2, price, 'month=1997-05; year=1997' AS attrs FROM sales_cell JOIN sales_d3 USING (i3) WHERE month = '1997-05'",
)
def drop_unit_dims(t):
    b = t.sales
    b = b.where(b.dim_mask(2, "month", "==", "1997-05")).drop_unit_dims()
    attrs = "; ".join(f"{a.type_term}={a.value}" for a in b.attrs)
    return b.cells.select("i1", "i2", "price", F.lit(attrs).alias("attrs"))


@query("dim_value_search", SALES_SQL + "SELECT i1 AS idx, supplier_name AS value FROM sales_d1 WHERE contains(supplier_name, '7')")
def dim_value_search(t):
    return bricks.value_search(t.sales.dims[0].df, "supplier_name", "7")


@query(
    "slider_filter",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS color FROM events
       WHERE event_type = 'error' OR value BETWEEN 5 AND 12""",
)
def slider_filter(t):
    points = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("color"))
    return bricks.slider_filter(points, "color", 5, 12)


# ---- averages ----


@query("dim_mean", SALES_SQL + "SELECT i1, i3 AS i2, round(avg(quantity), 6) AS quantity, round(avg(price), 6) AS price FROM sales_cell GROUP BY 1, 2")
def dim_mean(t):
    """Mean over the flags; the month dimension moves up one place."""
    return r6(t.sales.mean(1).cells.select("i1", "i2", "quantity", "price"), "quantity", "price")


SLICE = SALES_SQL + """, c AS (SELECT * FROM sales_cell JOIN sales_d1 USING (i1) JOIN sales_d2 USING (i2) JOIN sales_d3 USING (i3)),
  nat AS (SELECT nation, min(i1) AS pos FROM sales_d1 GROUP BY 1), yr AS (SELECT year, min(i3) AS pos FROM sales_d3 GROUP BY 1),
  nth AS (SELECT nation, row_number() OVER (ORDER BY pos) AS k FROM nat)
"""


@query(
    "slice_mean_sd",
    SLICE + """SELECT nation, nat.pos AS nation_pos, flag, i2 AS flag_pos, round(avg(quantity), 6) AS mean, round(stddev_samp(quantity), 6) AS sd
      FROM c JOIN nat USING (nation) JOIN yr USING (year) WHERE yr.pos = (SELECT min(pos) FROM yr) GROUP BY ALL""",
)
def slice_mean_sd(t):
    """The first year fixed; means by nation and flag over suppliers and months."""
    out = slices.slice_mean_sd(t.sales, {"3/2": 1}, ["1/2", "2/1"])
    return r6(
        out.select(
            F.col("d1_nation").alias("nation"), F.col("d1_nation_pos").alias("nation_pos"),
            F.col("d2_flag").alias("flag"), F.col("d2_flag_pos").alias("flag_pos"), F.col("value").alias("mean"), "sd",
        ),
        "mean", "sd",
    )


@query(
    "series_xy",
    SLICE + """SELECT 'nation = ' || nation || '; flag ' || flag AS label, year AS x, yr.pos AS x_pos, round(avg(quantity), 6) AS y, round(stddev_samp(quantity), 6) AS error_y
      FROM c JOIN yr USING (year) GROUP BY ALL""",
)
def series_xy(t):
    out = slices.filter_brick(t.sales, {"variable": ["3/2", "1/2", "2/1"], "label-format": {"2/1": "flag #VAR1"}})
    return r6(out, "y", "error_y")


@query(
    "grid_z",
    SLICE + """SELECT nation AS y, nat.pos AS y_pos, year AS x, yr.pos AS x_pos, avg(quantity) AS z
      FROM c JOIN nat USING (nation) JOIN yr USING (year) WHERE i2 = 1 GROUP BY ALL""",
)
def grid_z(t):
    out = slices.filter_brick(t.sales, {"variable": ["3/2", "1/2"], "constant": {"2": 2}, "z": True, "data": "quantity"})
    return out.select("y", "y_pos", "x", "x_pos", "z")


@query(
    "scatter_same_dim",
    SLICE + """SELECT i1 AS idx, balance AS x, nation_key AS y, supplier_name AS label, round(q.z, 6) AS z FROM sales_d1
      LEFT JOIN (SELECT i1, avg(quantity) AS z FROM c WHERE i2 = 0 GROUP BY 1) q USING (i1)""",
)
def scatter_same_dim(t):
    request = {"variable": ["1/3", "1/4"], "constant": {"2/1": 1}, "z": True, "data": "quantity", "point-labels": "1/1"}
    out = slices.filter_brick(t.sales, request)
    return r6(out.select("idx", "x", "y", "label", "z"), "z")


@query(
    "fix_indices",
    SLICE + """SELECT i1 AS idx, 1 AS dim FROM sales_d1 JOIN nth USING (nation) WHERE k = 3 AND balance = (SELECT arg_min(balance, i1) FROM sales_d1 JOIN nth USING (nation) WHERE k = 3)
      UNION ALL SELECT i3, 3 FROM sales_d3 WHERE i3 = 13""",
)
def fix_indices(t):
    """Third nation and, in the same dimension, the balance of its first supplier; a month by its index."""
    b = t.sales
    nation = slices.unique_values(b.dims[0], "nation").filter("pos = 2").select(F.col("value").alias("nation"))
    first = b.dims[0].df.join(nation, "nation", "left_semi").agg(F.min_by("balance", "idx").alias("value"))
    nth = slices.unique_values(b.dims[0], "balance").join(first, "value", "left_semi").first()["pos"] + 1
    fixed = slices.fix_indices(b, {"1/2": 3, "1/3": nth, "3": 14})
    return fixed[0].select("idx", F.lit(1).alias("dim")).union(fixed[2].select(F.col("idx").cast("bigint"), F.lit(3)))


@query(
    "validate_dim_ids",
    "SELECT id, CASE WHEN id IN ('1', '3', '1/4', '2/1') THEN 'ok' ELSE 'Dimension index ' || id || ' invalid' END AS message, count(*) AS n FROM "
    "(SELECT unnest(['1', '3', '7', '1/4', '1/5', '2/1']) AS id FROM supplier) GROUP BY ALL",
)
def validate_dim_ids(t):
    """Each id checked once against the array's metadata, then joined to the requests that use it."""
    b = t.sales
    ids = ["1", "3", "7", "1/4", "1/5", "2/1"]

    def message(i):
        try:
            slices.parse_dim_id(b, i)
        except ValueError as e:
            return str(e)
        return "ok"

    requests = t.supplier.select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("id"))
    messages = F.create_map(*[F.lit(x) for i in ids for x in (i, message(i))])
    return requests.groupBy("id").agg(F.count("*").alias("n")).select("id", messages[F.col("id")].alias("message"), "n")


# ---- labels ----


@query(
    "concat_dim_values",
    SALES_SQL + "SELECT i1 AS idx, supplier_name || ', ' || CASE WHEN balance > 0 THEN nation ELSE 'N/A' END || ', ' || nation_key AS label FROM sales_d1",
)
def concat_dim_values_query(t):
    nation = F.when(F.col("balance") > 0, F.col("nation"))
    return t.sales.dims[0].df.select("idx", concat_dim_values("supplier_name", nation, "nation_key").alias("label"))


@query("dim_labels", SALES_SQL + "SELECT i3 AS idx, year || ': ' || month || ' (' || year || ')' AS label FROM sales_d3")
def dim_labels(t):
    d = t.sales.dims[2]
    return d.df.select("idx", slices.dim_label("#V2: #V1 (#V2)", d).alias("label"))


@query("series_label", SALES_SQL + "SELECT i1, i2, 'nation = ' || nation || '; flag = ' || flag AS label, count(*) AS n FROM sales_cell JOIN sales_d1 USING (i1) JOIN sales_d2 USING (i2) GROUP BY ALL")
def series_label_query(t):
    wide = t.sales.wide(0, 1).groupBy("i1", "i2", "nation", "flag").agg(F.count("*").alias("n"))
    return wide.select("i1", "i2", series_label([("nation", "nation"), ("flag", "flag")]).alias("label"), "n")


MATRIX = SALES_SQL + """, m AS (SELECT i1, i3, round(avg(quantity), 6) AS value FROM sales_cell GROUP BY 1, 2)
"""


@query("plot_matrix", MATRIX + "SELECT month AS x, i3 AS x_pos, nation || '/' || supplier_name AS z, i1 AS z_pos, value FROM m JOIN sales_d1 USING (i1) JOIN sales_d3 USING (i3)")
def plot_matrix(t):
    out = slices.plot_matrix(t.sales, [1], 1, {0: "#V2/#V1", 1: "#V1"})
    return r6(out, "value")


@query("plot_traces", MATRIX + "SELECT supplier_name AS trace, i1 AS trace_pos, month AS x, i3 AS x_pos, value AS y FROM m JOIN sales_d1 USING (i1) JOIN sales_d3 USING (i3)")
def plot_traces(t):
    return r6(slices.plot_traces(slices.plot_matrix(t.sales, [1], 1, {0: "#V1", 1: "#V1"})), "y")


@query(
    "core_plot",
    "SELECT c_name AS x, c_acctbal AS y FROM customer WHERE c_acctbal >= 4000 AND c_mktsegment = 'BUILDING'",
)
def core_plot(t):
    params = [
        {"attribute": "balance", "matchType": "gte", "keyword": "4000", "scalarType": "float"},
        {"attribute": "segment", "matchType": "=", "keyword": "BUILDING", "scalarType": "text"},
    ]
    found = search(t.workspace, {"queryMatch": {"dataModel": "Customer", "dataType": "Customer", "params": params}})
    return found.select(F.col("name").alias("x"), F.col("balance").alias("y"))


@query(
    "brick_map",
    SALES_SQL + """SELECT balance AS latitude, nation_key AS longitude, quantity AS color, supplier_name AS label_text FROM sales_d1
      LEFT JOIN (SELECT i1, quantity FROM sales_cell WHERE i2 = 1 AND i3 = 40) USING (i1)""",
)
def brick_map(t):
    return slices.brick_map(t.sales, {1: 1, 2: 40}, "balance", "nation_key", "quantity", "supplier_name")


@query("static_map", "SELECT c_acctbal AS latitude, c_nationkey AS longitude, c_mktsegment AS color, c_name AS label_text FROM customer")
def static_map(t):
    c = t.customer
    return c.select(
        F.col("c_acctbal").alias("latitude"), F.col("c_nationkey").alias("longitude"), F.col("c_mktsegment").alias("color"), F.col("c_name").alias("label_text")
    )


@query("report_plot", LINEAGE_SQL + "SELECT process_term_name AS x, count(*) AS y FROM proc GROUP BY 1")
def report_plot(t):
    return term_stat(t.process, "process_term_id", t.terms).select(F.col("term_name").alias("x"), F.col("n").alias("y"))


# ---- decomposition ----


def pca_model(t):
    cells = t.embeddings.select(F.col("vec_id").alias("i1"), F.posexplode("embedding").alias("i2", "value"))
    return PcaModel(rows_to_arrays(cells, "i1", "i2", "value"), "i1")


@query("pca_scores")
def pca_scores(t):
    """Checked against a dense decomposition in the tests."""
    return r6(pca_model(t).scores(), "score")


@query(
    "pca_whitened",
    "SELECT unnest([1, 2, 3]) AS component, count(*) AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS variance FROM embeddings",
)
def pca_whitened(t):
    """Whitened scores have mean 0 and variance 1 in every component."""
    s = pca_model(t).scores().groupBy("component").agg(
        F.count("*").alias("n"), F.abs(F.round(F.avg("score"), 6)).alias("mean"), F.round(F.var_samp("score"), 6).alias("variance")
    )
    return s


@query("pca_components")
def pca_components(t):
    return r6(pca_model(t).components(), "loading")


def full_model(t):
    """All components, unwhitened, straight from the cells."""
    if "_full_pca" not in t.__dict__:  # shared by the two queries below
        cells = t.embeddings.select(F.col("vec_id").alias("i1"), F.posexplode("embedding").alias("i2", "value"))
        t.__dict__["_full_pca"] = CellPca(cells, "i1", "i2", "value", n_components=64, whiten=False)
    return t.__dict__["_full_pca"]


@query(
    "pca_spectrum",
    """WITH c AS (SELECT vec_id, unnest(range(1, 65)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
       s AS (SELECT a.j AS x, b.j AS y, covar_samp(a.v, b.v) AS c FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2)
       SELECT count(DISTINCT x) AS n, round(sum(c) FILTER (x = y), 4) AS total, round(sum(c * c), 4) AS squares FROM s""",
)
def pca_spectrum(t):
    """The variances of all scores add up to the trace of the covariances, their squares to the sum of all squares."""
    per = full_model(t).scores().groupBy("component").agg(F.var_samp("score").alias("v"))
    return per.agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.sum(F.col("v") * F.col("v")), 4).alias("squares"))


@query(
    "pca_rebuilt",
    "SELECT vec_id, (j - 1)::INT AS i2, round(embedding[j]::DOUBLE - m, 4) + 0 AS value FROM embeddings, (SELECT j, avg(embedding[j]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS j) GROUP BY 1)",
)
def pca_rebuilt(t):
    """Scores times loadings give the centred array back."""
    model = full_model(t)
    both = model.scores().join(model.components(), "component")
    out = both.groupBy(F.col("i1").alias("vec_id"), "i2").agg(F.sum(F.col("score") * F.col("loading")).alias("v"))
    return out.select("vec_id", "i2", (F.round("v", 4) + 0).alias("value"))


# ---- making and storing ----


@query(
    "create_brick",
    """SELECT a.i AS i1, b.i AS i2, c.i AS i3 FROM (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i) a,
       (SELECT unnest(range((SELECT count(DISTINCT l_returnflag) FROM lineitem))) AS i) b, (SELECT unnest(range((SELECT count(DISTINCT year(l_shipdate)) FROM lineitem))) AS i) c""",
)
def create_brick(t):
    """Every cell of supplier x flag x year, from the sizes of the three."""
    sizes = t.lineitem.agg(F.count_distinct("l_returnflag"), F.count_distinct(F.year("l_shipdate"))).first()
    return bricks.create_cells(t.spark, [t.supplier.count(), *sizes])


@query(
    "add_attr",
    with_(BRICKS) + "SELECT brick_id, 'type=' || data_type_term_name || ' ;status=' || CASE WHEN monthly THEN 'monthly' ELSE 'yearly' END || ' calendar' AS attrs FROM brick",
)
def add_attr(t):
    first = F.array(F.struct(F.lit("type").alias("type_term"), F.col("data_type_term_name").alias("value"), F.lit("").alias("units")))
    rows = t.bricks.withColumn("attrs", first)
    status = F.when(F.col("monthly"), "monthly").otherwise("yearly")
    out = catalog.add_attr(rows, "attrs", "status", status, "calendar")
    text = F.transform("attrs", lambda a: F.concat(a["type_term"], F.lit("="), a["value"], F.lit(" "), a["units"]))
    return out.select("brick_id", F.array_join(text, ";").alias("attrs"))


@query(
    "save_brick",
    with_(BRICKS)
    + """SELECT brick_id AS id, name, data_type_term_name AS data_type, NULL::VARCHAR AS made_by FROM brick
         UNION ALL SELECT format('Brick{:07d}', max(s_suppkey) + 1), 'sales', 'Sales', (SELECT format('Process{:07d}', max(o_orderkey) + 1) FROM orders) FROM brick""",
)
def save_brick(t):
    """The sales array joins the catalog with its process record after the orders."""
    old = t.bricks.select(F.col("brick_id").alias("id"), "name", F.col("data_type_term_name").alias("data_type"))
    none = F.lit(None).cast("string")
    text = lambda c: F.lit(c)
    process = t.orders.select(
        F.format_string("Process%07d", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("process"), none.alias("person"), none.alias("campaign"),
        none.alias("date_start"), none.alias("date_end"), F.array(text("Customer:x")).alias("input_objects"), F.array().cast("array<string>").alias("output_objects"),
    )
    b = t.sales
    rows, made = catalog.save_brick(old, process, b.type_term, "0000009", b.name, "sum", "person", "campaign", ["Supplier:all"])
    link = made.select(F.explode("output_objects").alias("ref"), F.col("id").alias("made_by"))
    link = link.select(F.split("ref", ":", 2)[1].alias("id"), "made_by")
    return rows.join(link, "id", "left").select("id", "name", "data_type", "made_by")


@query(
    "ops_log",
    SALES_SQL + """SELECT 'load(brick:sales); where(dim_index:0,dim_name:Supplier); mean(dim_index:1,dim_name:Flag)' AS ops, count(*) AS n_cells
      FROM (SELECT DISTINCT i1, i3 FROM sales_cell JOIN sales_d1 USING (i1) WHERE balance > 0)""",
)
def ops_log(t):
    b = t.sales
    b = b.where(b.dim_mask(0, "balance", ">", 0.0)).mean(1)
    log = b.ops_table("sales", t.spark)
    text = F.transform("brick_ops", lambda o: F.concat(o["op"], F.lit("("), F.array_join(o["args"], ","), F.lit(")")))
    shown = log.select("brick_id", F.array_join(text, "; ").alias("ops"))
    size = b.cells.agg(F.count("*").alias("n_cells")).withColumn("brick_id", F.lit("sales"))
    return shown.join(size, "brick_id").select("ops", "n_cells")
