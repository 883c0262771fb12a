import pytest
from pyspark.sql import functions as F

from gridloom.operators import filters as fl
from gridloom.operators.filters import EntityType, Ontology, Prop
from gridloom.operators.ontology import build_terms, search_microtypes
from gridloom.plans.objects import ObjectSet
from gridloom.plans.query import Workspace
from gridloom.plans.terms import TermFinder


@pytest.fixture(scope="module")
def ws(spark):
    terms = spark.createDataFrame(
        [("DA:0000000", "data type", []), ("DA:0000001", "counts", ["DA:0000000"]), ("ME:0000001", "counts", []), ("ME:0000002", "soil rich", ["ME:0000001"])],
        "term_id string, term_name string, parents array<string>",
    )
    closure = terms.select("term_id", F.explode("parents").alias("ancestor_id"))
    rows = spark.createDataFrame(
        [("S1", "Red soil", 1, "ME:0000001", ["ME:0000001", "ME:0000002"], "S:S1"), ("S2", "blue rock", 2, "ME:0000002", [], "S:S2"), ("S3", None, None, None, None, "S:S3")],
        "id string, name string, depth int, kind_term_id string, tags array<string>, vertex string",
    )
    props = {"name": Prop("text", "name"), "depth": Prop("int", "depth"), "kind": Prop("term", "kind_term_id"), "tags": Prop("[term]", "tags")}
    sample = EntityType("Sample", rows, props)
    process = EntityType("Process", spark.createDataFrame([("P1", "x")], "id string, note string"), {"note": Prop("text", "note")})
    io = "process_id string, obj_type string, obj string"
    pin = spark.createDataFrame([("P1", "Sample", "S:S1")], io)
    pout = spark.createDataFrame([("P1", "Sample", "S:S2")], io)
    return Workspace({"Sample": sample}, process, pin, pout, Ontology(terms, closure))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_each_spelling_compares_rightly(ws):
    for op, want in {"=": ["S1"], "gt": ["S2"], ">=": ["S1", "S2"], "gte": ["S1", "S2"], "lt": [], "<=": ["S1"]}.items():
        assert ids(ws.find("Sample", {"depth": {op: 1}})) == want


def test_same_comparison_is_or_and_others_and(ws):
    assert ids(ws.query("Sample").has({"depth": 1}).has({"depth": 2}).find()) == ["S1", "S2"]
    assert ids(ws.query("Sample").has({"depth": 1}).has({"depth": {">": 1}}).find()) == []
    assert ids(ws.query("Sample").has({"depth": {"in": [1, 2]}}).has({"depth": {"in": 2}}).find()) == ["S2"]


def test_terms_by_id_name_list_and_pattern(ws):
    assert ids(ws.find("Sample", {"kind": "ME:0000001"})) == ["S1"]
    assert ids(ws.find("Sample", {"kind": "soil rich"})) == ["S2"]
    assert ids(ws.find("Sample", {"kind": ["counts", "soil rich"]})) == ["S1", "S2"]
    assert ids(ws.find("Sample", {"kind": {"like": "rich"}})) == ["S2"]
    assert ids(ws.find("Sample", {"tags": ["ME:0000002"]})) == ["S1"]


def test_names_are_scoped_for_the_data_type(ws):
    o = ws.ontology
    assert {r[0] for r in fl.resolve_terms(o, "counts").collect()} == {"DA:0000001", "ME:0000001"}
    assert {r[0] for r in fl.resolve_terms(o, "counts", fl.DATA_TYPE_ROOT).collect()} == {"DA:0000001"}


def test_full_text_needs_all_words_in_any_order(ws):
    assert ids(ws.find("Sample", {"name": {"match": "SOIL red"}})) == ["S1"]
    assert ids(ws.find("Sample", {"name": {"match": "soil blue"}})) == []
    assert ids(ws.find("Sample", {"name": {"match": fl.prefix_pattern("blue ro")}})) == ["S2"]


def test_errors(ws):
    with pytest.raises(ValueError, match="Unknown property"):
        ws.find("Sample", {"colour": 1})
    with pytest.raises(ValueError, match="Unknown operation"):
        ws.find("Sample", {"depth": {"~": 1}})
    with pytest.raises(ValueError, match="no meaning"):
        ws.find("Sample", {"kind": {"<": "counts"}})
    with pytest.raises(ValueError, match="output-of-process"):
        ws.query("Sample").search_all_up(True).find()
    with pytest.raises(ValueError, match="at least one"):
        ws.query("Sample").immediate_parent({"processInputs": "Sample"})


def test_process_filters(ws):
    assert ids(ws.query("Sample").is_output_of_process({"note": "x"}).find()) == ["S2"]
    assert ids(ws.query("Sample").is_input_of_process({"note": "x"}).find()) == ["S1"]
    assert ids(ws.query("Sample").immediate_parent({"processInputs": ["Sample"], "processOutputs": ["Sample"]}).find()) == ["S2"]
    assert ids(ws.query("Sample").linked_up_to("Sample", {"depth": 1}).find()) == ["S2"]
    assert ids(ws.query("Sample").linked_down_to("Sample", {"depth": 2}).find()) == ["S1"]


def test_find_one_is_the_least_key(ws):
    assert ids(ws.find_one("Sample", {"depth": {">=": 1}})) == ["S1"]


def test_exact_hits_come_before_prefix_hits(spark):
    terms = spark.createDataFrame([("1", "red", False), ("2", "redder", False), ("3", "red hidden", True)], "term_id string, term_name string, is_hidden boolean")
    assert {(r["term_id"], r["rank"]) for r in search_microtypes(terms, "red").collect()} == {("1", 1), ("2", 2)}
    assert {r["term_id"] for r in search_microtypes(terms, "re").collect()} == set()


def test_first_source_wins_on_repeated_ids(spark):
    a = spark.createDataFrame([("1", "one")], "term_id string, term_name string")
    b = spark.createDataFrame([("1", "uno"), ("2", "dos")], "term_id string, term_name string")
    assert {tuple(r) for r in build_terms([a, b]).collect()} == {("1", "one"), ("2", "dos")}


def test_found_objects_know_their_processes(ws):
    s1 = ObjectSet.find(ws, "Sample", {"depth": 1})
    assert [r["id"] for r in s1.down_processes().collect()] == ["P1"]
    assert s1.up_processes().count() == 0
    s2 = ObjectSet.find(ws, "Sample", {"depth": 2})
    assert [(r["depth"], r["input"], r["is_leaf"]) for r in s2.provenance().collect()] == [(0, "S:S1", True)]
    assert s2.to_df().columns == ["id", "name", "depth", "kind_term_id", "tags"]
    assert [r["id"] for r in ObjectSet.find(ws, "Sample").head(2).collect()] == ["S1", "S2"]


def test_term_finder(ws):
    f = TermFinder(ws.ontology)
    names = lambda df: sorted(r["term_id"] for r in df.collect())
    assert names(f.find_root()) == ["DA:0000000", "ME:0000001"]
    assert names(f.find_name("COUNTS", ignore_case=True)) == ["DA:0000001", "ME:0000001"]
    assert names(f.find_name("counts", "DA:0000000")) == ["DA:0000001"]
    assert names(f.find_name_prefix("soil ri")) == ["ME:0000002"]
    assert names(f.find_parent_id("ME:0000001")) == ["ME:0000002"]
    assert names(f.find_parent_path_id("DA:0000000")) == ["DA:0000001"]
    assert names(f.parents(f.find_id("ME:0000002"))) == ["ME:0000001"]


def test_index_finds_what_a_scan_finds(spark):
    import random

    from gridloom.operators.filters import has_words
    from gridloom.operators.fulltext import FullTextIndex

    rng = random.Random(3)
    texts = ["", None, "Ärger, über-all!", "x" * 50, "a.b-a"] + [" ".join(rng.choice(["ab", "abc", "Abd", "b1", "c,", "über"]) for _ in range(rng.randrange(6))) for _ in range(60)]
    rows = spark.createDataFrame([(k, x, "t" + str(k % 3)) for k, x in enumerate(texts)] + [(None, "ab", "t0")], "id long, text string, tag string").repartition(4)
    index = FullTextIndex.store(rows, "id", ["text", "tag"])
    for query in ("ab", "+ab,+abc", "prefix:ab", "ab prefix:b", "ÜBER", "prefix:abc,b1,c", "none", "", "ab ab", "prefix:a,prefix:ab"):
        want = sorted(r.id for r in rows.filter(has_words("text", query) & F.col("id").isNotNull()).collect())
        assert sorted(r.id for r in index.rows(rows, "id", [("text", query)]).collect()) == want, query
    assert {r.id for r in index.rows(rows, "id", [("text", "über"), ("tag", "t1")]).collect()} == {k for k, x in enumerate(texts) if k % 3 == 1 or "über" in (x or "")}
    plan = index.search("text", "ab")._jdf.queryExecution().toString()
    assert "EqualTo(token,ab)" in plan and "EqualTo(prop,text)" in plan
