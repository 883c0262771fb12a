"""SQL pieces shared by the check queries: the same recasts as in recast.py."""

from __future__ import annotations

ISA = """
isa(child, parent) AS (
  SELECT format('REGION:{:07d}', r_regionkey), 'PLACE:0000000' FROM region
  UNION ALL SELECT format('NATION:{:07d}', n_nationkey), format('REGION:{:07d}', n_regionkey) FROM nation
  UNION ALL SELECT format('PERSON:{:07d}', c_custkey), format('NATION:{:07d}', c_nationkey) FROM customer
  UNION ALL SELECT DISTINCT 'PTYPE:' || p_type, 'PART:0000000' FROM part
  UNION ALL SELECT DISTINCT 'BRAND:' || lpad(split_part(p_brand, '#', 2), 7, '0'), 'PART:0000000' FROM part
  UNION ALL SELECT DISTINCT 'WORD:' || unnest(string_split(p_name, ' ')), 'PART:0000000' FROM part
  UNION ALL SELECT DISTINCT 'PNAME:' || replace(p_name, ' ', '_'), 'WORD:' || unnest(string_split(p_name, ' ')) FROM part
  UNION ALL SELECT format('DA:{:07d}', r_regionkey + 1), 'DA:0000000' FROM region
  UNION ALL SELECT DISTINCT 'PRIO:' || o_orderpriority, 'PRIO:0000000' FROM orders
  UNION ALL SELECT DISTINCT 'PRIO:' || unnest(['SETUP', 'MEASURE']), 'PRIO:0000000' FROM region
  UNION ALL SELECT DISTINCT 'CAMP:' || o_orderstatus, 'CAMP:0000000' FROM orders
  UNION ALL SELECT DISTINCT 'CAMP:SETUP', 'CAMP:0000000' FROM region
)"""

TERM = """
term_base(term_id, term_name, ontology_id) AS (
  SELECT DISTINCT 'PLACE:0000000', 'place', 'geo' FROM region
  UNION ALL SELECT format('REGION:{:07d}', r_regionkey), r_name, 'geo' FROM region
  UNION ALL SELECT format('NATION:{:07d}', n_nationkey), n_name, 'geo' FROM nation
  UNION ALL SELECT format('PERSON:{:07d}', c_custkey), c_name, 'person' FROM customer
  UNION ALL SELECT DISTINCT 'PART:0000000', 'part feature', 'part' FROM part
  UNION ALL SELECT DISTINCT 'PTYPE:' || p_type, p_type, 'part' FROM part
  UNION ALL SELECT DISTINCT 'BRAND:' || lpad(split_part(p_brand, '#', 2), 7, '0'), p_brand, 'part' FROM part
  UNION ALL SELECT DISTINCT 'WORD:' || unnest(string_split(p_name, ' ')), unnest(string_split(p_name, ' ')), 'part' FROM part
  UNION ALL SELECT DISTINCT 'PNAME:' || replace(p_name, ' ', '_'), p_name, 'part' FROM part
  UNION ALL SELECT DISTINCT 'DA:0000000', 'data type', 'data_type' FROM region
  UNION ALL SELECT format('DA:{:07d}', r_regionkey + 1), lower(r_name) || ' sales', 'data_type' FROM region
  UNION ALL SELECT DISTINCT unnest(['PRIO:0000000', 'CAMP:0000000']), unnest(['process', 'campaign']), 'process' FROM region
  UNION ALL SELECT DISTINCT 'PRIO:' || o_orderpriority, o_orderpriority, 'process' FROM orders
  UNION ALL SELECT DISTINCT 'PRIO:' || unnest(['SETUP', 'MEASURE']), unnest(['SETUP', 'MEASURE']), 'process' FROM region
  UNION ALL SELECT DISTINCT 'CAMP:' || o_orderstatus, o_orderstatus, 'process' FROM orders
  UNION ALL SELECT DISTINCT 'CAMP:SETUP', 'SETUP', 'process' FROM region
),
term AS (
  SELECT *, split_part(term_id, ':', 1) = 'WORD' AS is_hidden,
         split_part(term_id, ':', 1) IN ('PTYPE', 'BRAND', 'PNAME') AS is_microtype,
         split_part(term_id, ':', 1) = 'PTYPE' AS is_dimension,
         split_part(term_id, ':', 1) IN ('PTYPE', 'BRAND') AS is_dimension_variable,
         split_part(term_id, ':', 1) IN ('BRAND', 'REGION') AS is_property
  FROM term_base
)"""

CLOSURE = """
closure(term_id, ancestor_id) AS (
  SELECT child, parent FROM isa
  UNION SELECT c.term_id, i.parent FROM closure c JOIN isa i ON i.child = c.ancestor_id
)"""

EDGES = """
pin(process_id, obj_type, obj) AS (
  SELECT format('ProcessO{:07d}', o_orderkey), 'Customer', format('Customer:Customer{:07d}', o_custkey) FROM orders
  UNION ALL SELECT DISTINCT format('ProcessO{:07d}', l_orderkey), 'Supplier', format('Supplier:Supplier{:07d}', l_suppkey) FROM lineitem
  UNION ALL SELECT format('ProcessN{:07d}', n_nationkey), 'Region', format('Region:Region{:07d}', n_regionkey) FROM nation
  UNION ALL SELECT format('ProcessC{:07d}', c_custkey), 'Nation', format('Nation:Nation{:07d}', c_nationkey) FROM customer
  UNION ALL SELECT format('ProcessS{:07d}', s_suppkey), 'Nation', format('Nation:Nation{:07d}', s_nationkey) FROM supplier
  UNION ALL SELECT format('ProcessB{:07d}', s_suppkey), 'Supplier', format('Supplier:Supplier{:07d}', s_suppkey) FROM supplier
),
pout(process_id, obj_type, obj) AS (
  SELECT DISTINCT format('ProcessO{:07d}', l_orderkey), 'Part', format('Part:Part{:07d}', l_partkey) FROM lineitem
  UNION ALL SELECT format('ProcessN{:07d}', n_nationkey), 'Nation', format('Nation:Nation{:07d}', n_nationkey) FROM nation
  UNION ALL SELECT format('ProcessC{:07d}', c_custkey), 'Customer', format('Customer:Customer{:07d}', c_custkey) FROM customer
  UNION ALL SELECT format('ProcessS{:07d}', s_suppkey), 'Supplier', format('Supplier:Supplier{:07d}', s_suppkey) FROM supplier
  UNION ALL SELECT format('ProcessB{:07d}', s_suppkey), format('Brick-{:07d}', n_regionkey + 1),
                   format('Brick-{:07d}:Brick{:07d}', n_regionkey + 1, s_suppkey)
            FROM supplier JOIN nation ON n_nationkey = s_nationkey
),
edge(src, dst) AS (
  SELECT obj, 'Process:' || process_id FROM pin UNION ALL SELECT 'Process:' || process_id, obj FROM pout
)"""

PROCESS = """
proc(id, process_term_id, process_term_name, person_term_id, person_term_name,
     campaign_term_id, campaign_term_name, date_start, date_end) AS (
  SELECT format('ProcessO{:07d}', o_orderkey), 'PRIO:' || o_orderpriority, o_orderpriority,
         format('PERSON:{:07d}', o_custkey), c_name, 'CAMP:' || o_orderstatus, o_orderstatus,
         strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m')
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT format('ProcessN{:07d}', n_nationkey), 'PRIO:SETUP', 'SETUP',
         format('NATION:{:07d}', n_nationkey), n_name, 'CAMP:SETUP', 'SETUP', '1995', '1995' FROM nation
  UNION ALL SELECT format('ProcessC{:07d}', c_custkey), 'PRIO:SETUP', 'SETUP',
         format('NATION:{:07d}', c_nationkey), n_name, 'CAMP:SETUP', 'SETUP', '1995', '1995'
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT format('ProcessS{:07d}', s_suppkey), 'PRIO:SETUP', 'SETUP',
         format('NATION:{:07d}', s_nationkey), n_name, 'CAMP:SETUP', 'SETUP', '1995', '1995'
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT format('ProcessB{:07d}', s_suppkey), 'PRIO:MEASURE', 'MEASURE',
         format('NATION:{:07d}', s_nationkey), n_name, 'CAMP:SETUP', 'SETUP', '1996', '1996'
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
)"""

# one array per supplier: returnflag x linestatus x (year, or month when the balance is negative)
BRICKS = """
brick(brick_id, name, data_type_term_id, data_type_term_name, s_suppkey, monthly) AS (
  SELECT format('Brick{:07d}', s_suppkey), s_name, format('DA:{:07d}', n_regionkey + 1),
         lower(r_name) || ' sales', s_suppkey, s_acctbal < 0
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
),
brick_dimtype(brick_id, pos, dim_type) AS (
  SELECT brick_id, 1, 'flag' FROM brick UNION ALL SELECT brick_id, 2, 'status' FROM brick
  UNION ALL SELECT brick_id, 3, CASE WHEN monthly THEN 'month' ELSE 'year' END FROM brick
),
brick_cell(brick_id, v1, v2, v3, quantity, price) AS (
  SELECT brick_id, l_returnflag, l_linestatus,
         CASE WHEN monthly THEN month(l_shipdate) ELSE year(l_shipdate) END,
         sum(l_quantity), round(sum(l_extendedprice), 2)
  FROM lineitem JOIN brick ON s_suppkey = l_suppkey GROUP BY ALL
)"""

# one array over all suppliers: supplier x returnflag x ship month, 0-based indices
SALES = """
sales_cell(i1, i2, i3, quantity, price, n) AS (
  SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END,
         ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT,
         sum(l_quantity), round(sum(l_extendedprice), 2), count(*)
  FROM lineitem GROUP BY 1, 2, 3
),
sales_d1(i1, supplier, supplier_name, nation, balance, nation_key) AS (
  SELECT s_suppkey, format('Supplier{:07d}', s_suppkey), s_name, n_name, s_acctbal, s_nationkey
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
),
sales_d2(i2, flag) AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_returnflag FROM lineitem),
sales_d3(i3, month, year) AS (
  SELECT DISTINCT ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT, strftime(l_shipdate, '%Y-%m'), year(l_shipdate)::INT FROM lineitem
)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"


TERMS_SQL = with_(ISA, TERM)
CLOSURE_SQL = with_(ISA, TERM, CLOSURE, recursive=True)
EDGES_SQL = with_(EDGES)
LINEAGE_SQL = with_(EDGES, PROCESS)
BRICKS_SQL = with_(BRICKS)
SALES_SQL = with_(SALES)
