import pytest
from pyspark.sql import functions as F

from gridloom.operators import reach as rc
from gridloom.operators.lineage import coassembled, provenance_tree
from gridloom.operators.links import intermediates, linked_with_props, nearest_sources, search_all, upstream_graph, upstream_props
from gridloom.operators.ontology import microtype_tree
from gridloom.operators import type_graph
from gridloom.operators.type_graph import components


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "vertex string")


def found(df):
    return {(r["vertex"], r["hops"]) for r in df.collect()}


def test_least_hops_on_a_diamond(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e"))
    assert found(rc.reach(start(spark, "a"), e)) == {("b", 1), ("c", 1), ("d", 2), ("e", 1)}


def test_cycle_ends_and_returns_its_start(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    assert found(rc.reach(start(spark, "a"), e)) == {("b", 1), ("c", 2), ("a", 3)}
    assert found(rc.reach(start(spark, "a"), e, include_start=True)) == {("a", 0), ("b", 1), ("c", 2)}


def test_start_reached_from_another_start_counts(spark):
    e = edges(spark, ("a", "b"), ("b", "c"))
    assert found(rc.reach(start(spark, "a", "b"), e)) == {("b", 1), ("c", 1)}


def test_nothing_to_reach(spark):
    assert found(rc.reach(start(spark, "z"), edges(spark, ("a", "b")))) == set()
    assert found(rc.reach(start(spark), edges(spark, ("a", "b")))) == set()


def test_depth_limit_counts_edges(spark):
    chain = edges(spark, *[(f"v{i}", f"v{i + 1}") for i in range(12)])
    out = found(rc.reach(start(spark, "v0"), chain, max_hops=5))
    assert out == {(f"v{i}", i) for i in range(1, 6)}


def test_roots_are_kept_apart(spark):
    e = edges(spark, ("a", "c"), ("b", "c"), ("c", "d"))
    roots = spark.createDataFrame([("a", "a"), ("b", "b")], "root string, vertex string")
    out = {tuple(r) for r in rc.reach_from_each(roots, e).collect()}
    assert out == {("a", "c", 1), ("a", "d", 2), ("b", "c", 1), ("b", "d", 2)}


def test_closure_is_transitive_and_cycle_safe(spark):
    isa = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "x"), ("x", "a"), ("p", "q"), ("q", "p")], "child string, parent string")
    pairs = {(r["term_id"], r["ancestor_id"]) for r in rc.term_closure(isa).collect()}
    assert pairs == {("c", "b"), ("c", "a"), ("c", "x"), ("b", "a"), ("x", "a"), ("p", "q"), ("p", "p"), ("q", "p"), ("q", "q")}
    for a, b in pairs:
        for c, d in pairs:
            assert b != c or (a, d) in pairs


@pytest.fixture(scope="module")
def lineage(spark):
    io = "process_id string, obj_type string, obj string"
    pin = spark.createDataFrame([("P1", "Reads", "Reads:R1"), ("P1", "Reads", "Reads:R2"), ("P2", "Assembly", "Assembly:A1"), ("P3", "Genome", "Genome:G1")], io)
    pout = spark.createDataFrame([("P1", "Assembly", "Assembly:A1"), ("P2", "Genome", "Genome:G1"), ("P3", "Gene", "Gene:X")], io)
    return pin, pout, rc.lineage_edges(pin, pout)


def test_provenance_tree_levels_and_leaves(spark, lineage):
    pin, pout, e = lineage
    top = spark.createDataFrame([("Genome:G1",)], "obj string")
    rows = {tuple(r) for r in provenance_tree(top, pin, pout, e).collect()}
    assert rows == {
        (0, "Genome:G1", "P2", "Assembly:A1", False),
        (1, "Assembly:A1", "P1", "Reads:R1", True),
        (1, "Assembly:A1", "P1", "Reads:R2", True),
    }


def test_coassembly_flags_everything_downstream(spark, lineage):
    pin, pout, e = lineage
    assert {r["vertex"] for r in coassembled(pin, pout, e, "Assembly", "Reads").collect()} == {"Assembly:A1", "Genome:G1", "Gene:X"}
    assert coassembled(pin, pout, e, "Assembly", "Reads", more_than=2).count() == 0


def test_search_all_up_counts_the_process_itself_and_down_does_not(spark, lineage):
    pin, pout, e = lineage
    rows = spark.createDataFrame([("Reads:R1",), ("Assembly:A1",), ("Genome:G1",), ("Gene:X",)], "vertex string")
    proc = spark.createDataFrame([("P2",)], "id string")
    up = {r[0] for r in search_all(rows, "vertex", proc, pin, pout, e, True, False).collect()}
    down = {r[0] for r in search_all(rows, "vertex", proc, pin, pout, e, False, True).collect()}
    assert up == {"Reads:R1", "Assembly:A1", "Genome:G1"}
    assert down == {"Genome:G1", "Gene:X"}


def test_linked_props_keep_null_values(spark):
    e = edges(spark, ("L:1", "p"), ("p", "S:1"), ("L:2", "q"), ("q", "S:1"))
    rows = spark.createDataFrame([("S:1", "s")], "vertex string, name string")
    src = spark.createDataFrame([("L:1", 1.0, None), ("L:2", 2.0, "x")], "vertex string, lat double, lon string")
    out = {tuple(r) for r in linked_with_props(rows, "vertex", src, "vertex", ["lat", "lon"], e).select("name", "lat", "lon").collect()}
    assert out == {("s", 1.0, None), ("s", 2.0, "x")}


def test_nearest_upstream_value_wins_then_least_id(spark):
    e = edges(spark, ("a", "p"), ("b", "p"), ("p", "x"), ("far", "a"))
    values = spark.createDataFrame([("a", "k", "1"), ("b", "k", "2"), ("far", "k", "3"), ("far", "m", "4")], "vertex string, prop string, value string")
    out = {(r["prop"], r["source"], r["hops"], r["value"]) for r in upstream_props(spark.createDataFrame([("x",)], "obj string"), e, values).collect()}
    assert out == {("k", "a", 2, "1"), ("m", "far", 3, "4")}


def test_components_join_over_shared_keys(spark):
    pairs = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3"), ("e", "4"), ("d", "5"), ("e", "5")], "node string, via string")
    assert {tuple(r) for r in components(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}


def test_microtype_tree_orders_each_term_once(spark):
    terms = spark.createDataFrame(
        [("r", "root", []), ("b", "bee", ["r"]), ("a", "ay", ["r"]), ("x", "ex", ["a", "b"]), ("h", "hid", ["r"])],
        "term_id string, term_name string, parents array<string>",
    )
    wanted = spark.createDataFrame([("r",), ("a",), ("b",), ("x",)], "term_id string")
    out = microtype_tree(terms, spark.createDataFrame([("r",)], "term_id string"), wanted).orderBy("path").collect()
    assert [(r["term_id"], r["depth"]) for r in out] == [("r", 0), ("a", 1), ("x", 2), ("b", 1)]


def test_stored_edges_give_the_same_walks(spark):
    plain = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y"))
    stored = rc.EdgeTable.store(plain)
    assert found(rc.reach(start(spark, "a"), stored)) == found(rc.reach(start(spark, "a"), plain))
    assert found(rc.reach(start(spark, "d"), rc.reverse(stored))) == {("b", 1), ("a", 2), ("c", 3)}


def test_walks_end_only_where_the_edges_end(spark):
    chain = edges(spark, *[(f"v{i:03d}", f"v{i + 1:03d}") for i in range(104)], (None, "v000"), ("v003", None))
    assert found(rc.reach(start(spark, "v000", None), chain)) == {(f"v{i:03d}", i) for i in range(1, 105)}


def nearest(edges, values, objects):
    """Walks back from each object by itself."""
    out = set()
    for obj in objects:
        level, seen, done, hops = {obj}, set(), set(), 0
        while level:
            level = {a for a, b in edges if b in level} - seen
            seen |= level
            hops += 1
            for p in {p for v, p, _ in values if v in level} - done:
                source = min(v for v, q, _ in values if v in level and q == p)
                out.add((obj, p, source, hops, min(x for v, q, x in values if v == source and q == p)))
                done.add(p)
    return out


def test_nearest_values_on_generated_graphs(spark):
    import random

    rng = random.Random(6)
    for n in (6, 12):
        names = [f"n{i:02d}" for i in range(n)]
        pairs = {(rng.choice(names), rng.choice(names)) for _ in range(2 * n)}
        values = [(rng.choice(names), p, f"{rng.randrange(9)}") for p in "kkm" for _ in range(2)]
        objects = rng.sample(names, n // 2)
        table = spark.createDataFrame(values + [("n00", "q", None)], "vertex string, prop string, value string")
        got = upstream_props(spark.createDataFrame([(o,) for o in objects], "obj string"), edges(spark, *pairs), table)
        assert {tuple(r) for r in got.collect()} == nearest(pairs, values, objects)


def test_values_of_one_vertex_together(spark):
    e = edges(spark, ("a", "p"), ("p", "x"), ("b", "q"), ("q", "a"))
    values = spark.createDataFrame([("a", "k", "1"), ("b", "k", "2"), ("b", "m", "3")], "vertex string, prop string, value string")
    objects = spark.createDataFrame([("x",), ("none",)], "obj string")
    assert {tuple(r) for r in upstream_props(objects, e, values, together=True).collect()} == {("x", "k", "b", 4, "2"), ("x", "m", "b", 4, "3")}


def test_a_hub_is_one_row_per_property(spark):
    """Many objects below one process of many inputs: no row per pair of them."""
    pairs = [(f"in{i:03d}", "hub") for i in range(200)] + [("hub", f"out{i:03d}") for i in range(200)]
    values = spark.createDataFrame([(f"in{i:03d}", "k", str(i)) for i in range(200)], "vertex string, prop string, value string")
    sources = values.select("vertex", F.col("prop").alias("label"))
    found = nearest_sources(sources, edges(spark, *pairs))
    assert found.count() == 201 and {r.source for r in found.collect()} == {"in000"}
    objects = spark.createDataFrame([(f"out{i:03d}",) for i in range(200)], "obj string")
    graph = upstream_graph(objects, edges(spark, *pairs, ("out000", "beyond")))
    assert graph.count() == 400
    assert {tuple(r) for r in intermediates(objects.limit(1), graph).select("hops").distinct().collect()} == {(1,), (2,)}
    assert upstream_props(objects, edges(spark, *pairs), values).count() == 200


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    rounds = []
    store = type_graph.materialize
    monkeypatch.setattr(type_graph, "materialize", lambda df, label: rounds.append(label) or store(df, label))
    n = 10_000
    pairs = spark.range(n).select(F.xxhash64("id").cast("string").alias("node"), F.explode(F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string"))).alias("via"))
    out = components(pairs)
    assert out.select("label").distinct().count() == 1 and out.count() == n
    assert rounds.count("stars") < 20


def test_components_of_generated_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(f"{rng.randrange(60)}", f"{rng.randrange(50)}") for _ in range(70)] + [("solo", "alone"), ("v1", "n1"), (None, "1"), ("9", None)]
    label = {n: n for n, _ in rows if n}
    for _ in rows:
        for a, x in rows:
            for b, y in rows:
                if x == y and a and b and x:
                    label[a] = label[b] = min(label[a], label[b])
    met = {n for n, v in rows if n and v}
    got = components(spark.createDataFrame(rows, "node string, via string"))
    assert {tuple(r) for r in got.collect()} == {(n, label[n]) for n in met}


def test_processes_around_matches(spark, lineage):
    pin, pout, e = lineage
    process = spark.createDataFrame([("P1", "a"), ("P2", "b"), ("P3", "c"), ("P4", "d")], "id string, process_term_name string")
    got = type_graph.processes_around(process, spark.createDataFrame([("P2",)], "id string"), e)
    assert {(r.id, r.mark, r.in_filter) for r in got.collect()} == {("P1", "above", False), ("P2", "match", True), ("P3", "below", False)}
    both = type_graph.processes_around(process, spark.createDataFrame([("P1",), ("P3",)], "id string"), e)
    assert {(r.id, r.mark) for r in both.collect()} == {("P1", "match"), ("P2", "above"), ("P3", "match")}
    assert type_graph.processes_around(process, process.filter("false").select("id"), e).count() == 0


def test_a_direction_is_stored_when_a_walk_needs_it(spark, monkeypatch):
    kept = []
    stored_by = rc.materialize
    monkeypatch.setattr(rc, "materialize", lambda df, label="t": kept.append(label) or stored_by(df, label))
    table = rc.EdgeTable.store(edges(spark, ("a", "b"), ("b", "c")))
    assert kept == []
    assert found(rc.reach(start(spark, "a"), table)) == found(rc.reach(start(spark, "a"), table)) == {("b", 1), ("c", 2)}
    assert kept == ["edges"]
    assert found(rc.reach(start(spark, "c"), rc.reverse(table))) == {("b", 1), ("a", 2)}
    assert found(rc.reach(start(spark, "b"), rc.reverse(rc.reverse(table)))) == {("c", 1)}
    assert kept == ["edges", "edges"]


def test_one_task_sorts_so_many_edges_at_most(spark, monkeypatch):
    monkeypatch.setattr(rc, "RANGE_EDGES", 50)
    pairs = spark.range(1000).select(F.lit("hub").alias("src"), F.format_string("v%04d", "id").alias("dst"))
    table = rc.EdgeTable.store(pairs)
    for stored in (table.forward, rc.reverse(table).forward):
        sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 1000 and len(sizes) >= 18 and max(sizes) <= 100
