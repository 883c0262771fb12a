"""Joins by process are dealt by the number of rows, with the same results."""

import pytest

from gridloom import session
from gridloom.operators import links


@pytest.fixture
def io(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 1)
    schema = "process_id string, obj_type string, obj string"
    ins = spark.createDataFrame([("p1", "A", "A:1"), ("p1", "A", "A:2"), ("p1", "A", "A:2"), ("p2", "A", "A:2"), ("p3", "B", "B:1"), (None, "B", "B:2")], schema)
    outs = spark.createDataFrame([("p1", "B", "B:1"), ("p2", "B", "B:1"), ("p2", "B", "B:2"), ("p4", "B", "B:3"), (None, "B", "B:4")], schema)
    return ins, outs


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_forward_map(io):
    out = links.forward_map(*io)
    assert rows(out, "obj", "output") == [("A:1", "B:1"), ("A:2", "B:1"), ("A:2", "B:2")]
    assert out.rdd.getNumPartitions() == 5  # pairs, with those that repeat


def test_process_docs(spark, io):
    keys = spark.createDataFrame([("B:1", "first"), ("B:9", "none")], "obj string, user_key string")
    out = links.process_docs(io[0].filter("obj <> 'A:1'").select("obj").distinct(), *io, keys)
    assert rows(out, "obj", "process_id", "other", "other_type", "user_key") == [
        ("A:2", "p1", "B:1", "B", "first"), ("A:2", "p2", "B:1", "B", "first"), ("A:2", "p2", "B:2", "B", None),
    ]
    assert out.rdd.getNumPartitions() == 11  # one task to a reference


def test_processes_of(spark, io):
    process = spark.createDataFrame([("p1", "cut"), ("p2", "dry"), ("p9", "none")], "id string, name string")
    out = links.processes_of(io[0].select("obj"), io[0], process)
    assert rows(out, "obj", "id", "name") == [("A:1", "p1", "cut"), ("A:2", "p1", "cut"), ("A:2", "p2", "dry")]
    assert "6), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_linked_with_props(spark, io):
    edges = spark.createDataFrame([("S1", "P1"), ("S2", "P1"), ("S3", "P2"), ("P1", "B1"), ("P2", "B1"), ("P2", "B2")], "src string, dst string")
    start = spark.createDataFrame([("S1", "x", None), ("S2", "x", None), ("S3", "y", 1.5)], "v string, a string, b double")
    out = links.linked_with_props(spark.createDataFrame([("B1",), ("B2",)], "v string"), "v", start, "v", ["a", "b"], edges)
    assert rows(out, "v", "a", "b") == [("B1", "x", None), ("B1", "y", 1.5), ("B2", "y", 1.5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "to_json" not in plan
