"""Foreign line ends in ontology files, and texts that only look like numbers."""

from gridloom.functions.text import number
from gridloom.operators.reach import term_closure
from gridloom.sources.obo import scan_obo


def test_obo_line_ends(spark, tmp_path):
    text = "format-version: 1.2\r\n\r\n[Term]\r\nid: Q:1\r\nname: one\r\n \r\n[Term]\r\nid: Q:2\r\nname: two\r\nis_a: Q:1 ! one\r\n\r\n[Typedef]\r\nid: rel\r\n\r\n[Term]\r\nid: Q:3\r\nname: three"
    (tmp_path / "a.obo").write_bytes(text.encode())
    got = scan_obo(spark, str(tmp_path / "a.obo"), "q").select("term_id", "term_name").collect()
    assert sorted(map(tuple, got)) == [("Q:1", "one"), ("Q:2", "two"), ("Q:3", "three")]


def test_numbers(spark):
    rows = [(x,) for x in ("1", "-2.5", "1e3", ".5", "1d", "2F", "10D", "x", "", "NaN")]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(number("v")).collect()]
    assert got[:4] == [1.0, -2.5, 1000.0, 0.5] and got[4:9] == [None] * 5 and got[9] != got[9]


def test_closure_has_no_depth_limit(spark):
    isa = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(5)], "child string, parent string")
    assert term_closure(isa).count() == 15
