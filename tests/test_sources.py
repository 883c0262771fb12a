import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import scratch_root
from gridloom.sources import brick_files as bf
from gridloom.sources import obo, tables, typedef

SECTIONED = """name,Jars on shelves
description,"First, second"
type,Jar count <JC:17>
meta,Cellar <Q:1>,north
values,Fill <Q:2>,Liquid <Q:3>,Juice <L:1>,cl <V:1>
size,2,3
dmeta,1,Shelf <Q:5>,Shelf label <Q:6>
1,s1
2,"s,2"
dmeta,2,Week <Q:7>,Week label <Q:8>
1,d1
2,d2
3,d3
data
"""


def test_sectioned_csv_in_many_splits(spark, tmp_path):
    """The file is cut into splits of a few lines, so most splits begin inside a section."""
    rows = "".join(f"{i},{j},{i * 10 + j}\n" for i in (1, 2) for j in (1, 2, 3))
    (tmp_path / "one.csv").write_text(SECTIONED + rows + "x,1,9\n1\n")
    (tmp_path / "two.csv").write_text("name,second\nsize,1\ndata\n1,5,6\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        lines = bf.scan_brick_csv(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    heads = {r["name"]: r for r in bf.sectioned_headers(lines).collect()}
    assert heads["Jars on shelves"]["description"] == "First, second"
    assert heads["Jars on shelves"]["type_term_id"] == "JC:17"
    assert heads["Jars on shelves"]["shape"] == [2, 3]
    assert heads["second"]["n_values_lines"] == 0
    dims = {(r["dim"], r["dim_type"], r["var_type"], r["idx"], r["value"]) for r in bf.sectioned_dims(lines).collect()}
    assert dims == {(1, "Shelf", "Shelf label", 0, "s1"), (1, "Shelf", "Shelf label", 1, "s,2")} | {(2, "Week", "Week label", k, f"d{k + 1}") for k in range(3)}
    key = heads["Jars on shelves"]["brick_key"]
    cells = {(tuple(r["idx"]), tuple(r["vals"])) for r in bf.sectioned_cells(lines).filter(F.col("brick_key") == key).collect()}
    assert cells == {((i - 1, j - 1), (str(i * 10 + j),)) for i in (1, 2) for j in (1, 2, 3)}
    other = bf.sectioned_cells(lines).filter(F.col("brick_key") == heads["second"]["brick_key"]).collect()
    assert [(r["idx"], r["vals"]) for r in other] == [([0], ["5", "6"])]


def test_array_document(spark, tmp_path):
    def term(i, n):
        return {"oterm_ref": i, "oterm_name": n, "term_name": n}

    doc = {
        "name": "shelf file", "description": "d", "n_dimensions": 1, "data_type": term("JC:2", "Jars"),
        "array_context": [{"value_type": term("Q:9", "What is counted"), "value": {"scalar_type": "oterm_ref", "oterm_ref": "Q:2", "string_value": "Fill"}}],
        "dim_context": [{"data_type": term("Q:5", "Shelf"), "size": 2, "typed_values": [{"value_type": term("Q:6", "Label"), "values": {"scalar_type": "object_ref", "object_refs": ["a", "b"]}}]}],
        "typed_values": [
            {"value_type": term("Q:2", "Fill"), "value_units": term("V:1", "cl"), "values": {"scalar_type": "float", "float_values": [0.5, None]}},
            {"value_type": term("Q:10", "Remark"), "values": {"scalar_type": "string", "string_values": ["x", "y"]}},
        ],
    }
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=1))
    docs = bf.scan_brick_json(spark, str(path))
    head = bf.brick_headers(docs).first()
    assert (head["type_term_id"], head["shape"], head["attrs"]) == ("JC:2", [2], ["What is counted=Fill"])
    assert {(r["dim"], r["idx"], r["value"]) for r in bf.brick_dims(docs).collect()} == {(1, 0, "a"), (1, 1, "b")}
    cells = {(r["data_var"], tuple(r["idx"]), r["value"]) for r in bf.brick_cells(docs).collect()}
    assert cells == {("Fill", (0,), "0.5"), ("Fill", (1,), None), ("Remark", (0,), "x"), ("Remark", (1,), "y")}


def test_json_blocks_lose_nothing(spark):
    cells = spark.createDataFrame([("b", "v", p, float(p) if p != 3 else None) for p in range(25)], "brick_id string, data_var string, pos bigint, value double")
    dims = spark.createDataFrame([("b", 1, "name", i, str(i)) for i in range(25)], "brick_id string, dim int, var string, idx int, value string")
    texts = bf.brick_to_json(spark.createDataFrame([("b", "n")], "brick_id string, name string"), dims, cells, block=10)
    assert texts.filter("kind = 'data'").count() == 3
    back = {(r["pos"], r["value"]) for r in bf.scan_json_blocks(texts, "data", "double").collect()}
    assert back == {(p, float(p) if p != 3 else None) for p in range(25)}
    assert bf.scan_json_blocks(texts, "dim", "string").count() == 25


def test_obo_keeps_every_parent(spark, tmp_path):
    (tmp_path / "a.obo").write_text(
        'format-version: 1.2\n\n[Term]\nid: A:1\nname: one\ndef: "the first" []\n\n[Term]\nid: A:2\nname: two words\n'
        'synonym: "deux" EXACT []\nsynonym: "zwei" EXACT []\nis_a: A:1 ! one\nis_a: B:9 ! other\nxref: Ref: X.Shelf.label\nxref: ORef: A:1\n'
        'property_value: data_type "oterm_ref" xsd:string\nproperty_value: is_microtype "true" xsd:boolean\nproperty_value: valid_units "UO:1 UO:2" xsd:string\n'
        'property_value: note "a" xsd:string\nproperty_value: note "b" xsd:string\n\n[Typedef]\nid: rel\nname: rel\n'
    )
    rows = {r["term_id"]: r for r in obo.scan_obo(spark, str(tmp_path / "a.obo"), "test").collect()}
    assert set(rows) == {"A:1", "A:2"}
    two = rows["A:2"]
    assert two["parents"] == ["A:1", "B:9"] and two["parent_first"] == "A:1"
    assert two["synonyms"] == ["deux", "zwei"] and two["ref"] == "X.Shelf.label" and two["oref"] == "A:1"
    assert two["scalar_type"] == "oterm_ref" and two["is_microtype"] and not two["is_hidden"]
    assert two["valid_units"] == ["UO:1", "UO:2"] and two["properties"]["note"] == "a;b"
    assert rows["A:1"]["definition"] == "the first" and rows["A:1"]["parents"] == []


def test_type_definitions(spark, tmp_path):
    doc = {
        "system_types": [],
        "static_types": [
            {"name": "Crate", "fields": [{"name": "crate_id", "scalar_type": "text", "required": True, "UPK": True}, {"name": "length", "scalar_type": "int", "units_term": "V:3"}]},
            {
                "name": "Harvest",
                "fields": [
                    {"name": "id", "scalar_type": "text", "required": True, "PK": True},
                    {"name": "follows", "scalar_type": "text", "FK": "Harvest.name"},
                    {"name": "crates_filled", "scalar_type": "[text]", "FK": "[Crate.crate_id]"},
                    {"name": "Orchard Kind", "scalar_type": "term", "type_term": "Q:11"},
                    {"name": "description", "scalar_type": "text"},
                ],
            },
        ],
    }
    path = tmp_path / "typedef.json"
    path.write_text(json.dumps(doc))
    terms = spark.createDataFrame([("V:3", "hand width"), ("Q:11", "kind")], "term_id string, term_name string")
    cols = typedef.column_rows(typedef.scan_typedefs(spark, str(path)), terms)
    harvest = typedef.schema_of(cols, "Harvest")
    assert harvest.names == ["sdt_harvest_id", "follows_sdt_harvest_name", "sdt_crate_names_filled", "orchard_kind_sys_oterm_id", "orchard_kind_sys_oterm_name", "sdt_harvest_description"]
    assert isinstance(harvest["sdt_crate_names_filled"].dataType, T.ArrayType) and not harvest["sdt_harvest_id"].nullable
    assert harvest["orchard_kind_sys_oterm_id"].metadata["fk"] == "sys_oterm.id"
    assert typedef.schema_of(cols, "Crate").names == ["sdt_crate_id", "sdt_crate_name", "length_hand_width"]
    rows = {r["cdm_column_name"]: r for r in typedef.build_typedef_table(cols, terms).collect()}
    assert rows["length_hand_width"]["units_sys_oterm_name"] == "hand width" and rows["orchard_kind_sys_oterm_id"]["type_sys_oterm_name"] == "kind"


def test_entity_tsv_with_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "e.tsv").write_text('name\tnote\na\t"two\nlines ""q"""\nb\tnull\n')
    assert [tuple(r) for r in tables.scan_entity_tsv(spark, str(tmp_path), ["name", "note"]).collect()] == [("a", 'two\nlines "q"'), ("b", "null")]


def test_process_tsv_with_a_trailing_tab_and_bare_quotes(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('process\tinputs\t\npicking <P:1>\t"Crate: a, b", Cellar: c\t\n')
    assert [tuple(r) for r in tables.scan_process_tsv(spark, str(tmp_path), ["process", "inputs"]).collect()] == [("picking <P:1>", '"Crate: a, b", Cellar: c')]


def test_conform_keeps_metadata_and_nulls_what_does_not_cast(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType(), True, {"is_pk": True}), T.StructField("gone", T.StringType())])
    out = tables.conform_schema(spark.createDataFrame([("1",), ("x",)], "old string"), schema, {"old": "n"})
    assert [tuple(r) for r in out.collect()] == [(1, None), (None, None)]
    assert out.schema["n"].metadata == {"is_pk": True}


def test_wide_file_attributes(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("__dim1_var1\t__data_var1\na\t1\n")
    (tmp_path / "a.tsv").write_text("__name\t__dim1_var1___type_term\t__dim1_var1___attr1\nx\tShelf <Q:5>\theight [m]: 3\n")
    _, attrs = tables.scan_wide_tsv_attrs(spark, str(tmp_path / "d.tsv"), str(tmp_path / "a.tsv"))
    assert {tuple(r) for r in attrs.collect()} == {("array", "name", "x"), ("dim1_var1", "type_term", "Shelf <Q:5>"), ("dim1_var1", "attr1", "height [m]: 3")}


def test_records_keep_nulls(spark):
    schema, rows = tables.records_json(spark.createDataFrame([(1, None)], "a int, b string"))
    assert json.loads(rows.first()["record"]) == {"a": 1, "b": None}
    assert [f["name"] for f in json.loads(schema)["fields"]] == ["a", "b"]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    assert scratch_root(spark)

    class Far:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"
            applicationId = "far"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Far())
