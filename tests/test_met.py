"""What a walk goes along, and where its steps look."""

from gridloom.operators import links, type_graph
from gridloom.operators import reach as rc
from gridloom.operators.links import upstream_graph


def test_edges_met_are_kept_by_their_step(spark, monkeypatch):
    monkeypatch.setattr(rc, "RANGE_EDGES", 2)
    pairs = [("a1", "p1"), ("a1", "p1"), ("p1", "b1"), ("b1", "p2"), ("p2", "a1"), ("x1", "p9"), ("b1", None), (None, "b1"), ("p1", "b1")]
    table = spark.createDataFrame(pairs, "src string, dst string")
    start = spark.createDataFrame([("a1",), ("a1",), (None,)], "vertex string")
    want = [("a1", "p1"), ("b1", "None"), ("b1", "p2"), ("p1", "b1"), ("p2", "a1")]
    for edges in (table, rc.EdgeTable.store(table)):
        assert sorted((r.src, str(r.dst)) for r in rc.edges_met(start, edges).collect()) == want
    none = rc.edges_met(start.filter("vertex = 'zz'"), table)
    assert none.columns == ["src", "dst"] and none.count() == 0
    up = upstream_graph(spark.createDataFrame([("b1",)], "obj string"), rc.EdgeTable.store(table))
    assert sorted((str(r.src), r.dst) for r in up.collect()) == [("None", "b1"), ("a1", "p1"), ("b1", "p2"), ("p1", "b1"), ("p2", "a1")]


def test_a_step_looks_between_the_ends_of_each_kind(spark, monkeypatch):
    start = spark.createDataFrame([("A:A2",), ("A:A5",), ("S:S1",), ("S:S3",)], "vertex string")
    _, ends = rc.Steps(start, "kinds").store(start, 0)
    assert ends == [("A:A2", "A:A5"), ("S:S1", "S:S3")]
    edges = spark.createDataFrame([(v, "x") for v in ("A:A1", "A:A3", "M:M1", "S:S2", "S:S9")], "src string, dst string")
    assert {r.src for r in rc.edges_between(edges, ends).collect()} == {"A:A3", "S:S2"}
    monkeypatch.setattr(rc, "MAX_KINDS", 1)
    assert rc.Steps(start, "kinds").store(start, 0)[1] == [("A:A2", "S:S3")]


def test_few_rows_are_walked_up_from_first(spark, monkeypatch):
    pairs = [(f"S{n}", f"P{n}") for n in range(9)] + [(f"P{n}", f"B{n}") for n in range(9)] + [("P0", "P1")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    start = spark.createDataFrame([(f"S{n}",) for n in range(9) if n != 2], "vertex string")
    walked, reach = [], links.reach
    monkeypatch.setattr(links, "reach", lambda start, over: walked.append(over.count()) or reach(start, over))
    few = spark.createDataFrame([("B1",), ("B2",)], "vertex string")
    assert [r.vertex for r in links.linked_up_to(few, "vertex", start, edges).collect()] == ["B1"]
    many = spark.createDataFrame([(f"B{n}",) for n in range(9)], "vertex string")
    assert links.linked_up_to(many, "vertex", start, edges).count() == 8
    assert walked == [6, 19]  # above B1: S0, S1, P0, P1; above B2: S2, P2


def test_types_of_processes_are_dealt_once(spark):
    ins = spark.createDataFrame([("p1", "B", "B:1"), ("p1", "A", "A:1"), ("p1", "A", "A:2"), ("p2", "Brick-1", "x")], "process_id string, obj_type string, obj string")
    process = spark.createDataFrame([("p1", "cut", True)], "id string, process_term_name string, in_filter boolean")
    out = type_graph.process_type_edges(ins, ins.filter("process_id = 'p2'"), process)
    assert [(r.process_id, r["name"], r.from_types, r.to_types) for r in out.collect()] == [("p1", "cut", ["A", "B"], [])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
