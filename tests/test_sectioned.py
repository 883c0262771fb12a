"""What sectioned CSV arrays say about themselves, in both forms, cut into small splits."""

from gridloom.sources import brick_files as bf
from gridloom.sources import sectioned

FULL = r'''name,Pump log
type,Log <T:1>
meta,Site <P:1>,north,"a, b"
meta
values,Flow <P:2>,Rate <P:3>,l per s <U:1>
values,Operator <P:4>
size,2,2
dmeta,1,Hour <P:5>,Hour <P:5>,Zone <P:6>
1,h1
2,"h ""two"""
dmeta,1,Hour <P:5>,Flow <P:2>
1,9
dmeta,2,Pump <P:7>,Pump name <P:8>
1,big <X:1>
2,small
7,beyond <X:7>
data
1,1,0.5,ann <O:1>
1,2,0.6
2,2,,bob <O:2>
x,1,5
2
'''
MERGED = r'''name,Two kinds
size,2,3
dmeta,1,Kind <P:9>,Kind <P:9>
1,Flow <P:2>,m <U:2>
2,Flow <P:2>,m <U:2>
dmeta,2,Hour <P:5>,Label <P:10>
1,a
2,b
3,c
data
1,1,10
2,1,20
1,3,30
'''


def read(spark, tmp_path):
    (tmp_path / "full.csv").write_text(FULL)
    (tmp_path / "merged.csv").write_text(MERGED)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "96")
    try:
        lines = bf.scan_brick_csv(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    terms = spark.createDataFrame(
        [("P:2", "flow rate", None, "float"), ("P:4", "Operator", "sdt_person_name", "object_ref"), ("P:8", "Pump name", "oref", "oterm_ref"), ("P:6", "area", None, None)],
        "term_id string, term_name string, target string, scalar_type string",
    )
    found = sectioned.variables(lines, terms)
    below = spark.createDataFrame([("P:8", "P:7", True)], "child_id string, parent_id string, is_below boolean")
    return lines, found, sectioned.columns(found, below), terms


def test_both_forms(spark, tmp_path):
    lines, found, cols, terms = read(spark, tmp_path)
    names = {r.brick_key: r.name for r in bf.sectioned_headers(lines).collect()}
    rows = [(names[r.brick_key], *list(r)[1:-1]) for r in sectioned.typedef_rows(cols).collect()]
    assert sorted(rows, key=repr) == sorted([
        ("Pump log", "flow_rate_rate_l_per_s", "variable", "float", None, "flow rate, Rate=l per s", None, None, None, None, None, 1, "P:2", "flow rate"),
        ("Pump log", "sdt_person_name", "variable", "object_ref", "sdt_person.sdt_person_name", "Operator", None, None, None, None, None, 2, "P:4", "Operator"),
        ("Pump log", "hour_area", "dimension_variable", None, None, "Hour", "P:6", "Zone", 1, "P:5", "Hour", 1, "P:5", "Hour"),
        ("Pump log", "hour_flow_rate", "dimension_variable", "float", None, "flow rate", None, None, 1, "P:5", "Hour", 2, "P:2", "flow rate"),
        ("Pump log", "pump_name_sys_oterm_id", "dimension_variable", "oterm_ref", "sys_oterm.sys_oterm_id", "Pump name, ontology term CURIE", None, None, 2, "P:7", "Pump", 1, "P:8", "Pump name"),
        ("Pump log", "pump_name_sys_oterm_name", "dimension_variable", "oterm_ref", None, "Pump name", None, None, 2, "P:7", "Pump", 1, "P:8", "Pump name"),
        ("Two kinds", "flow_rate_m", "variable", "float", None, "flow rate", "U:2", "m", None, None, None, 1, "P:2", "flow rate"),
        ("Two kinds", "flow_rate_m_2", "variable", "float", None, "flow rate", "U:2", "m", None, None, None, 2, "P:2", "flow rate"),
        ("Two kinds", "hour_label", "dimension_variable", None, None, "Label", None, None, 1, "P:5", "Hour", 1, "P:10", "Label"),
    ], key=repr)
    out = sectioned.wide(lines, cols)
    got = {tuple(r) for r in out.drop("brick_key").filter("hour_label IS NOT NULL").select("hour_label", "flow_rate_m", "flow_rate_m_2").collect()}
    assert got == {("a", "10", "20"), ("c", "30", None)}
    full = out.filter("hour_label IS NULL").select("hour_area", "hour_flow_rate", "pump_name_sys_oterm_id", "pump_name_sys_oterm_name", "flow_rate_rate_l_per_s", "sdt_person_name")
    assert {tuple(r) for r in full.collect()} == {
        ("h1", "9", "X:1", "big", "0.5", "ann"), ("h1", "9", None, "small", "0.6", None), ('h "two"', None, None, "small", "", "bob"),
    }
    heads = {r.name: r for r in sectioned.headers(lines, found, terms).collect()}
    assert heads["Pump log"].shape == [2, 2] and heads["Pump log"].dim_ids == ["P:5", "P:7"] and heads["Pump log"].value_ids == ["P:2", "P:4"]
    assert heads["Pump log"].dim_variables == [["Hour", "flow rate"], ["Pump name"]]
    assert heads["Two kinds"].shape == [3] and heads["Two kinds"].dim_names == ["Hour"] and heads["Two kinds"].value_names == ["flow rate"] * 2
    assert [(r.n, r.property_id, r.line) for r in sectioned.meta(lines).collect()] == [(1, "P:1", ["Site <P:1>", "north", "a, b"])]


def test_wide_is_dealt_by_the_number_of_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sectioned, "CELLS_OF_TASK", 1)
    lines, _, cols, _ = read(spark, tmp_path)
    out = sectioned.wide(lines, cols)
    columns = ["hour_area", "pump_name_sys_oterm_id", "flow_rate_rate_l_per_s", "sdt_person_name", "hour_label", "flow_rate_m", "flow_rate_m_2"]
    assert sorted(map(tuple, out.select(columns).collect()), key=repr) == sorted([
        ("h1", "X:1", "0.5", "ann", None, None, None), ("h1", None, "0.6", None, None, None, None), ('h "two"', None, "", "bob", None, None, None),
        (None, None, None, None, "a", "10", "20"), (None, None, None, None, "c", "30", None),
    ], key=repr)
    assert "_share" in out._jdf.queryExecution().toString() and out.rdd.getNumPartitions() >= 5  # one task to a cell
