"""The driver tables seen as entities, terms, processes and arrays.

Customers, suppliers, parts, nations and regions are entities. An order is a process
that uses a customer and its suppliers and makes parts; set-up processes make nations
from regions, customers and suppliers from nations, and one array per supplier.
Terms are places (region > nation > customer as person) and part features.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.bricks import Brick, Dim
from gridloom.operators.filters import EntityType, Ontology, Prop
from gridloom.operators.reach import EdgeTable, term_closure
from gridloom.plans.query import Workspace
from gridloom.session import materialize

_OPEN: dict[tuple[str, str], "Tables"] = {}


def num_id(prefix: str, col: str):
    return F.format_string(prefix + "%07d", F.col(col))


class Tables:
    # Terms, processes, edges and arrays are written once per application and read from there:
    # they stand for the stored tables a user would have. The queries themselves stay lazy.

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        """Recasts are shared within one application, as loaded tables would be."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _OPEN:
            _OPEN[key] = cls(spark, sf_dir)
        return _OPEN[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.sf_dir}/{name}.parquet"
        schemas = self.__dict__.setdefault("_schemas", {})
        if name not in schemas:  # the footer is read once per table
            schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(schemas[name]).parquet(path)

    # ---- terms ----

    @cached_property
    def terms(self) -> DataFrame:
        """term_id, term_name, ontology_id, parents and flags."""
        no_parent = F.array().cast("array<string>")
        words = self.part.select(F.split("p_name", " ").alias("w"), "p_name").distinct()

        def rows(df, term_id, name, ontology, parents):
            return df.select(
                term_id.alias("term_id"), name.alias("term_name"), F.lit(ontology).alias("ontology_id"), parents.alias("parents")
            )

        part_root = F.array(F.lit("PART:0000000"))
        parts = [
            rows(self.region.limit(1), F.lit("PLACE:0000000"), F.lit("place"), "geo", no_parent),
            rows(self.region, num_id("REGION:", "r_regionkey"), F.col("r_name"), "geo", F.array(F.lit("PLACE:0000000"))),
            rows(self.nation, num_id("NATION:", "n_nationkey"), F.col("n_name"), "geo", F.array(num_id("REGION:", "n_regionkey"))),
            rows(self.customer, num_id("PERSON:", "c_custkey"), F.col("c_name"), "person", F.array(num_id("NATION:", "c_nationkey"))),
            rows(self.region.limit(1), F.lit("PART:0000000"), F.lit("part feature"), "part", no_parent),
            rows(self.part.select("p_type").distinct(), F.concat(F.lit("PTYPE:"), "p_type"), F.col("p_type"), "part", part_root),
            rows(
                self.part.select("p_brand").distinct(),
                F.concat(F.lit("BRAND:"), F.lpad(F.split("p_brand", "#")[1], 7, "0")),
                F.col("p_brand"),
                "part",
                part_root,
            ),
            rows(words.select(F.explode("w").alias("w")).distinct(), F.concat(F.lit("WORD:"), "w"), F.col("w"), "part", part_root),
            rows(
                words,
                F.concat(F.lit("PNAME:"), F.replace("p_name", F.lit(" "), F.lit("_"))),
                F.col("p_name"),
                "part",
                F.transform("w", lambda x: F.concat(F.lit("WORD:"), x)),
            ),
            rows(self.region.limit(1), F.lit("DA:0000000"), F.lit("data type"), "data_type", no_parent),
            rows(
                self.region,
                F.format_string("DA:%07d", F.col("r_regionkey") + 1),
                F.concat(F.lower("r_name"), F.lit(" sales")),
                "data_type",
                F.array(F.lit("DA:0000000")),
            ),
        ]
        one = self.region.limit(1)
        for space, root, col, extra in (
            ("PRIO:", "process", "o_orderpriority", ["SETUP", "MEASURE"]),
            ("CAMP:", "campaign", "o_orderstatus", ["SETUP"]),
        ):
            named = self.orders.select(F.col(col).alias("t")).distinct().unionByName(
                one.select(F.explode(F.array(*[F.lit(e) for e in extra])).alias("t"))
            )
            parts.append(rows(one, F.lit(space + "0000000"), F.lit(root), "process", no_parent))
            parts.append(rows(named, F.concat(F.lit(space), "t"), F.col("t"), "process", F.array(F.lit(space + "0000000"))))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        space = F.substring_index("term_id", ":", 1)
        out = out.select(
            "*",
            (space == "WORD").alias("is_hidden"),
            space.isin("PTYPE", "BRAND", "PNAME").alias("is_microtype"),
            (space == "PTYPE").alias("is_dimension"),
            space.isin("PTYPE", "BRAND").alias("is_dimension_variable"),
            space.isin("BRAND", "REGION").alias("is_property"),
        )
        return materialize(out, "terms")

    @cached_property
    def isa(self) -> DataFrame:
        return self.terms.select(F.col("term_id").alias("child"), F.explode("parents").alias("parent"))

    @cached_property
    def closure(self) -> DataFrame:
        """term_id, ancestor_id, hops."""
        return term_closure(self.isa)

    # ---- entities ----

    @property
    def region_entity(self) -> DataFrame:
        return self.region.select(num_id("Region", "r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @property
    def nation_entity(self) -> DataFrame:
        return self.nation.select(
            num_id("Nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), num_id("Region", "n_regionkey").alias("region")
        )

    @property
    def customer_entity(self) -> DataFrame:
        return self.customer.select(
            num_id("Customer", "c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            num_id("NATION:", "c_nationkey").alias("nation_term_id"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"),
        )

    @property
    def supplier_entity(self) -> DataFrame:
        return self.supplier.select(
            num_id("Supplier", "s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            num_id("NATION:", "s_nationkey").alias("nation_term_id"),
            F.col("s_acctbal").alias("balance"),
        )

    @property
    def part_entity(self) -> DataFrame:
        """A part's features are an array of term ids, its words an array of texts."""
        brand = F.concat(F.lit("BRAND:"), F.lpad(F.split("p_brand", "#")[1], 7, "0"))
        ptype = F.concat(F.lit("PTYPE:"), "p_type")
        return self.part.select(
            num_id("Part", "p_partkey").alias("id"),
            num_id("part-", "p_partkey").alias("key"),
            F.col("p_name").alias("description"),
            ptype.alias("type_term_id"),
            F.col("p_type").alias("type_term_name"),
            brand.alias("brand_term_id"),
            F.col("p_brand").alias("brand_term_name"),
            F.array(ptype, brand).alias("feature_term_ids"),
            F.split("p_name", " ").alias("words"),
            F.col("p_size").alias("size"),
            F.col("p_retailprice").alias("price"),
        )

    # ---- lineage ----

    @cached_property
    def process_input(self) -> DataFrame:
        """process_id, obj_type, obj."""
        return materialize(self._edges_in(), "process_input")

    @cached_property
    def process_output(self) -> DataFrame:
        return materialize(self._edges_out(), "process_output")

    def _edges_in(self) -> DataFrame:
        def side(df, kind, key, obj_type, obj_key):
            return df.select(
                num_id("Process" + kind, key).alias("process_id"),
                F.lit(obj_type).alias("obj_type"),
                num_id(f"{obj_type}:{obj_type}", obj_key).alias("obj"),
            )

        lines = self.lineitem.select("l_orderkey", "l_suppkey").distinct()
        return (
            side(self.orders, "O", "o_orderkey", "Customer", "o_custkey")
            .unionByName(side(lines, "O", "l_orderkey", "Supplier", "l_suppkey"))
            .unionByName(side(self.nation, "N", "n_nationkey", "Region", "n_regionkey"))
            .unionByName(side(self.customer, "C", "c_custkey", "Nation", "c_nationkey"))
            .unionByName(side(self.supplier, "S", "s_suppkey", "Nation", "s_nationkey"))
            .unionByName(side(self.supplier, "B", "s_suppkey", "Supplier", "s_suppkey"))
        )

    def _edges_out(self) -> DataFrame:
        def side(df, kind, key, obj_type):
            return df.select(
                num_id("Process" + kind, key[0]).alias("process_id"),
                F.lit(obj_type).alias("obj_type"),
                num_id(f"{obj_type}:{obj_type}", key[1]).alias("obj"),
            )

        lines = self.lineitem.select("l_orderkey", "l_partkey").distinct()
        bricks = self.bricks.select(
            F.replace("brick_id", F.lit("Brick"), F.lit("ProcessB")).alias("process_id"),
            "obj_type",
            F.concat_ws(":", "obj_type", "brick_id").alias("obj"),
        )
        return (
            side(lines, "O", ("l_orderkey", "l_partkey"), "Part")
            .unionByName(side(self.nation, "N", ("n_nationkey", "n_nationkey"), "Nation"))
            .unionByName(side(self.customer, "C", ("c_custkey", "c_custkey"), "Customer"))
            .unionByName(side(self.supplier, "S", ("s_suppkey", "s_suppkey"), "Supplier"))
            .unionByName(bricks)
        )

    @cached_property
    def process(self) -> DataFrame:
        """One row per process; all other columns are its metadata."""
        return materialize(self._process(), "process")

    def _process(self) -> DataFrame:
        nation = self.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("person_term_name"))

        def row(df, kind, key, term, person_id, campaign, start, end):
            return df.select(
                num_id("Process" + kind, key).alias("id"),
                F.concat(F.lit("PRIO:"), term).alias("process_term_id"),
                term.alias("process_term_name"),
                person_id.alias("person_term_id"),
                "person_term_name",
                F.concat(F.lit("CAMP:"), campaign).alias("campaign_term_id"),
                campaign.alias("campaign_term_name"),
                start.alias("date_start"),
                end.alias("date_end"),
            )

        def setup(df, kind, key, nation_key, term="SETUP", year="1995"):
            df = df.join(nation, F.col(nation_key) == F.col("nk"), "left")
            return row(
                df, kind, key, F.lit(term), num_id("NATION:", nation_key), F.lit("SETUP"), F.lit(year), F.lit(year)
            )

        named = self.orders.join(
            self.customer.select(F.col("c_custkey").alias("ck"), F.col("c_name").alias("person_term_name")),
            F.col("o_custkey") == F.col("ck"),
            "left",
        )
        orders = row(
            named,
            "O",
            "o_orderkey",
            F.col("o_orderpriority"),
            num_id("PERSON:", "o_custkey"),
            F.col("o_orderstatus"),
            F.date_format("o_orderdate", "yyyy-MM-dd"),
            F.date_format("o_orderdate", "yyyy-MM"),
        )
        return (
            orders.unionByName(setup(self.nation, "N", "n_nationkey", "n_nationkey"))
            .unionByName(setup(self.customer, "C", "c_custkey", "c_nationkey"))
            .unionByName(setup(self.supplier, "S", "s_suppkey", "s_nationkey"))
            .unionByName(setup(self.supplier, "B", "s_suppkey", "s_nationkey", "MEASURE", "1996"))
        )

    @property
    def edges(self) -> EdgeTable:
        return self.workspace.edges

    @property
    def ontology(self) -> Ontology:
        return Ontology(lambda: self.terms, lambda: self.closure)

    @cached_property
    def workspace(self) -> Workspace:
        def etype(type_name, df, upk, vertex_type=None, **props):
            vertex_type = F.lit(type_name) if vertex_type is None else F.col(vertex_type)
            df = df.withColumn("vertex", F.concat(vertex_type, F.lit(":"), "id"))
            return EntityType(type_name, df, {k: Prop(*v) for k, v in props.items()}, upk=upk)

        text, number = "text", "float"
        types = [
            etype("Region", self.region_entity, "name", name=(text, "name")),
            etype("Nation", self.nation_entity, "name", name=(text, "name"), region=(text, "region")),
            etype(
                "Customer",
                self.customer_entity,
                "name",
                name=(text, "name"),
                nation=("term", "nation_term_id"),
                balance=(number, "balance"),
                segment=(text, "segment"),
            ),
            etype(
                "Supplier",
                self.supplier_entity,
                "name",
                name=(text, "name"),
                nation=("term", "nation_term_id"),
                balance=(number, "balance"),
            ),
            etype(
                "Part",
                self.part_entity,
                "key",
                key=(text, "key"),
                description=(text, "description"),
                type=("term", "type_term_id"),
                brand=("term", "brand_term_id"),
                features=("[term]", "feature_term_ids"),
                words=("[text]", "words"),
                size=("int", "size"),
                price=(number, "price"),
            ),
            etype(
                "Brick",
                self.bricks.withColumn("id", F.col("brick_id")),
                "name",
                "obj_type",
                name=(text, "name"),
                data_type=("term", "data_type_term_id"),
                dim_types=("[text]", "dim_types"),
            ),
        ]
        process = EntityType(
            "Process",
            self.process.withColumn("vertex", F.concat(F.lit("Process:"), "id")),
            {
                "process": Prop("term", "process_term_id"),
                "person": Prop("term", "person_term_id"),
                "campaign": Prop("term", "campaign_term_id"),
                "date_start": Prop(text, "date_start"),
                "date_end": Prop(text, "date_end"),
            },
        )
        return Workspace({t.name: t for t in types}, process, lambda: self.process_input, lambda: self.process_output, self.ontology)

    # ---- arrays ----

    @cached_property
    def bricks(self) -> DataFrame:
        """One array per supplier: returnflag x linestatus x (year, or month when the balance is negative)."""
        return materialize(self._bricks(), "bricks")

    def _bricks(self) -> DataFrame:
        nation = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        monthly = F.col("s_acctbal") < 0
        return self.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            num_id("Brick", "s_suppkey").alias("brick_id"),
            F.col("s_name").alias("name"),
            F.format_string("DA:%07d", F.col("n_regionkey") + 1).alias("data_type_term_id"),
            F.concat(F.lower("r_name"), F.lit(" sales")).alias("data_type_term_name"),
            F.format_string("Brick-%07d", F.col("n_regionkey") + 1).alias("obj_type"),
            F.array(F.lit("flag"), F.lit("status"), F.when(monthly, "month").otherwise("year")).alias("dim_types"),
            F.array(F.lit("quantity"), F.lit("price")).alias("value_types"),
            "s_suppkey",
            monthly.alias("monthly"),
        )

    @cached_property
    def brick_cells(self) -> DataFrame:
        """brick_id, v1, v2, v3 (dimension values), quantity, price."""
        return materialize(self._brick_cells(), "brick_cells")

    def _brick_cells(self) -> DataFrame:
        time = F.when(F.col("monthly"), F.month("l_shipdate")).otherwise(F.year("l_shipdate"))
        return (
            self.lineitem.join(self.bricks, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("brick_id", F.col("l_returnflag").alias("v1"), F.col("l_linestatus").alias("v2"), time.alias("v3"))
            .agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
        )

    @cached_property
    def sales_cells(self) -> DataFrame:
        """supplier x returnflag x ship month, 0-based i1, i2, i3."""
        return materialize(self._sales_cells(), "sales_cells")

    def _sales_cells(self) -> DataFrame:
        return (
            self.lineitem.groupBy(
                F.col("l_suppkey").alias("i1"), flag_index("l_returnflag").alias("i2"), month_index("l_shipdate").alias("i3")
            )
            .agg(
                F.sum("l_quantity").alias("quantity"),
                F.round(F.sum("l_extendedprice"), 2).alias("price"),
                F.count("*").alias("n"),
            )
        )

    @cached_property
    def sales_dims(self) -> list[DataFrame]:
        """One table per dimension: its index and its variables."""
        return [materialize(d, f"sales_dim{n}") for n, d in enumerate(self._sales_dims(), 1)]

    def _sales_dims(self) -> list[DataFrame]:
        d1 = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("i1"),
            num_id("Supplier", "s_suppkey").alias("supplier"),
            F.col("s_name").alias("supplier_name"),
            F.col("n_name").alias("nation"),
            F.col("s_acctbal").alias("balance"),
            F.col("s_nationkey").alias("nation_key"),
        )
        d2 = self.lineitem.select(flag_index("l_returnflag").alias("i2"), F.col("l_returnflag").alias("flag")).distinct()
        d3 = self.lineitem.select(
            month_index("l_shipdate").alias("i3"),
            F.date_format("l_shipdate", "yyyy-MM").alias("month"),
            F.year("l_shipdate").alias("year"),
        ).distinct()
        return [d1, d2, d3]


    @property
    def sales(self) -> Brick:
        d1, d2, d3 = self.sales_dims
        dims = (
            Dim("Supplier", d1.withColumnRenamed("i1", "idx"), ("supplier_name", "nation", "balance", "nation_key")),
            Dim("Flag", d2.withColumnRenamed("i2", "idx"), ("flag",)),
            Dim("Month", d3.withColumnRenamed("i3", "idx"), ("month", "year")),
        )
        return Brick("sales", "Sales", dims, self.sales_cells, ("quantity", "price", "n"), ops=(("load", ("brick:sales",)),))


def flag_index(col):
    return F.when(F.col(col) == "A", 0).when(F.col(col) == "N", 1).otherwise(2)


def month_index(col):
    return (F.year(col) - 1995) * 12 + F.month(col) - 1
