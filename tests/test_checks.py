import re

from pyspark.sql import functions as F

from gridloom.operators import ingest, links, reports, validate
from gridloom.operators.validate import Rule


def test_every_broken_rule_is_listed(spark):
    df = spark.createDataFrame([(1, "ab", 5.0, "x"), (2, "null", 50.0, "y"), (3, None, None, None)], "id int, name string, n double, ref string")
    target = spark.createDataFrame([("x",)], "name string")
    rules = [Rule("name", required=True, regex="a"), Rule("n", range=(0, 10)), Rule("ref", target=(target, "name"))]
    out = {(r["id"], r["property"], r["message"]) for r in validate.validate_entity(df, "id", rules).collect()}
    assert out == {
        (2, "name", "required"), (2, "name", "does not follow the constraint"), (2, "n", "not in the range [0, 10]"),
        (2, "ref", "reference not found"), (3, "name", "required"),
    }


def test_regex_is_tied_to_the_start_only(spark):
    df = spark.createDataFrame([("2020-01",), ("x2020",), ("2020x",)], "v string")
    assert [r[0] for r in df.select(validate.matches("v", r"\d\d\d\d")).collect()] == [True, False, True]


def test_term_format_is_really_checked(spark):
    df = spark.createDataFrame([("iron <CHEBI:1>",), ("iron",), ("<CHEBI:1>",), ("iron <CHEBI>",)], "v string")
    assert [r[0] for r in df.select(validate.is_term_form("v")).collect()] == [True, False, True, False]


def test_terms_of_cells(spark):
    terms = spark.createDataFrame([("A:1", "Root"), ("A:2", "Iron"), ("B:1", "Iron dust")], "term_id string, term_name string")
    closure = spark.createDataFrame([("A:2", "A:1")], "term_id string, ancestor_id string")
    cells = spark.createDataFrame([(1, "A:2"), (2, "IRON"), (3, "B:1"), (4, "?"), (5, None)], "i int, v string")
    out = {(r["i"], r["term_id"], r["error"]) for r in validate.cast_terms(cells, "v", terms, closure, "A:1").collect()}
    assert out == {(1, "A:2", None), (2, "A:2", None), (3, None, "Term without valid parent A:1"), (4, None, "Can not find term: ?"), (5, None, None)}


def test_classify_is_null_safe(spark):
    new = spark.createDataFrame([("a", None, 1), ("b", "x", 1), ("c", None, 2), ("d", "y", 1)], "k string, t string, n int")
    old = spark.createDataFrame([("a", None, 1), ("b", None, 1), ("d", "y", 1)], "k string, t string, n int")
    out = {r["k"]: (r["status"], r["changed"]) for r in ingest.upsert_classify(new, old, "k", F.col("k") != "d").collect()}
    assert out == {"a": ("unchanged", []), "b": ("changed", ["t"]), "c": ("new", []), "d": ("invalid", [])}


def test_one_bad_sibling_fails_the_process(spark):
    entities = spark.createDataFrame([("a", "new"), ("b", "invalid"), ("c", "unchanged")], "k string, status string")
    outputs = spark.createDataFrame([("P1", "a"), ("P1", "b"), ("P2", "c"), ("P3", "a"), ("P4", "zz")], "process_id string, user_key string")
    inputs = spark.createDataFrame([("P2", "w"), ("P3", "gone")], "process_id string, ref string")
    known = spark.createDataFrame([("w",)], "ref string")
    out = {r["process_id"]: (r["n_bad_outputs"], r["n_missing_inputs"], r["ok"]) for r in ingest.upload_with_processes(entities, "k", outputs, inputs, known).collect()}
    assert out == {"P1": (1, 0, False), "P2": (0, 0, True), "P3": (0, 1, False), "P4": (1, 0, False)}


def test_conflict_looks_at_the_first_existing_output(spark):
    cols = "id string, person string, input_objects array<string>, output_objects array<string>"
    stored = spark.createDataFrame([("old1", "x", ["W:1"], ["S:a", "S:b"]), ("old2", "y", ["W:2"], ["S:c"])], cols)
    incoming = spark.createDataFrame(
        [("n1", "x", ["W:1"], ["S:new", "S:a"]), ("n2", "y", ["W:2"], ["S:c"]), ("n3", "z", ["W:9"], ["S:other"])], cols
    )
    out = [tuple(r) for r in ingest.process_conflicts(incoming, stored, ["person"]).collect()]
    assert out == [("n1", "old1", 1, [], False, True)]


def test_units(spark):
    rows = spark.createDataFrame([(1, "T", "U1"), (2, "T", "U2"), (3, "T", "U9"), (4, "N", "U1"), (5, "T", None)], "row_id int, term_id string, units_id string")
    micro = spark.createDataFrame([("T", ["U1"], ["UP"]), ("N", None, None)], "term_id string, valid_units array<string>, valid_units_parents array<string>")
    closure = spark.createDataFrame([("U2", "UP")], "term_id string, ancestor_id string")
    out = {(r["row_id"], r["error"]) for r in validate.validate_units(rows, micro, closure).collect()}
    assert out == {(3, "units not below a valid parent"), (4, "type has no units")}


def test_shape(spark):
    dims = spark.createDataFrame([("a", 1, "x", 0), ("a", 1, "x", 1), ("a", 2, "y", 0), ("b", 1, "x", 0), ("b", 1, "z", 0), ("b", 1, "z", 1)], "brick_id string, dim int, var string, idx int")
    cells = spark.createDataFrame([("a",), ("a",)], "brick_id string")
    out = {r["brick_id"]: (r["vars_ok"], r["n_expected"], r["n_cells"], r["shape_ok"]) for r in validate.validate_shape(dims, cells).collect()}
    assert out == {"a": (True, 2, 2, True), "b": (False, 2, 0, False)}


def test_inferred_types(spark):
    df = spark.createDataFrame([("1", "1", "1.5", "x", " ", "t"), ("0", "12", "2", "1", "", "f"), ("", "-3", "1e3", "", None, "no")], "b string, i string, d string, s string, e string, f string")
    out = {r["column"]: r["inferred"] for r in reports.infer_column_types(df, df.columns).collect()}
    assert out == {"b": "boolean", "i": "integer", "d": "double", "s": "string", "e": None, "f": "boolean"}


def test_latest_process_and_those_without_outputs(spark):
    process = spark.createDataFrame([("P1",), ("P2",), ("P3",), ("P4",)], "id string")
    outputs = spark.createDataFrame([("P1", "a"), ("P2", "a"), ("P1", "b"), ("P3", "c"), ("P2", "c")], "process_id string, obj string")
    assert sorted(r["id"] for r in reports.keep_latest_process(process, outputs).collect()) == ["P1", "P2", "P3", "P4"]
    # without b, P1 and its only output a are superseded by P2; it still makes something, so it goes
    fewer = outputs.filter("obj <> 'b'")
    assert sorted(r["id"] for r in reports.keep_latest_process(process, fewer).collect()) == ["P2", "P3", "P4"]


def test_lab_rollup_skips_the_root_and_adds_parents(spark):
    terms = spark.createDataFrame([("root", "r", []), ("lab", "Lab", ["root"]), ("p1", "P1", ["lab"]), ("p2", "P2", ["lab"])], "term_id string, term_name string, parents array<string>")
    counts = spark.createDataFrame([("p1", 3), ("p2", 2), ("lab", 1)], "term_id string, n int")
    assert [(r["term_id"], r["n"]) for r in reports.lab_rollup(counts, terms, "root").collect()] == [("lab", 6), ("p1", 3), ("p2", 2)]


REFS = [("p", 'Part: 1, Thing: 7, "Generic: 2", none, Part: 3'), ("q", "Thing: 8"), ("r", None), ("s", "Part: 1")]


def exchanges(df):
    """What the rows of each shuffle of the plan are dealt by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_references_are_never_dealt_by_table_alone(spark):
    rows = spark.createDataFrame(REFS, "id string, io string")
    known = spark.createDataFrame([("sdt_part", "1"), ("ddt_ndarray", "2")], "table string, key string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        out = links.normalize_process_io(rows, "io", known)
        assert exchanges(out) and set(exchanges(out)) == {"table, key"}
        assert {tuple(r) for r in out.collect()} == {("p", "sdt_part", "1"), ("p", "ddt_ndarray", "2"), ("s", "sdt_part", "1")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_loaded_references_are_joined_by_key_once(spark):
    rows = spark.createDataFrame(REFS, "id string, io string")
    keys = spark.createDataFrame([("sdt_part", "1", "P1"), ("sdt_thing", "7", "T7")], "table string, key string, id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        out = ingest.load_processes(rows, "io", keys, ["sdt_thing"])
        assert exchanges(out) == ["table, key", "table, key"]
        assert {tuple(r) for r in out.collect()} == {("p", "sdt_part", "P1"), ("s", "sdt_part", "P1")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_references_of_mapped_types_leave_their_list(spark):
    rows = [("p", ["A: 1", "B: 2", "A: 1", None, "x"]), ("q", []), ("r", None), ("s", ["B: 3", "A: 9"])]
    rows = spark.createDataFrame(rows, "id string, refs array<string>")
    keys = spark.createDataFrame([("A: 1", "one"), ("A: 2", "two"), (None, "none"), ("C: 1", "c")], "ref string, other string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        out = links.key_rewrite(rows, "id", "refs", keys)
        assert exchanges(out).count("ref") == 2 and "kind" not in exchanges(out)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [kind" in plan  # before the references are dealt
        assert {r.id: r.refs for r in out.collect()} == {"p": ["one", "B: 2", "one", None, "x"], "q": [], "r": [], "s": ["B: 3", "A: 9"]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
