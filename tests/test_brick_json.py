"""Array documents of any nesting, and those that can't be read."""

import json

from gridloom.sources import brick_json as bj


def term(i):
    return {"oterm_ref": i, "oterm_name": i.lower()}


def doc(name, sizes, values, kind="float", **more):
    dims = [{"data_type": term(f"D:{k}"), "size": s, "typed_values": []} for k, s in enumerate(sizes)]
    listed = {"oterm_ref": "oterm_refs", "object_ref": "object_refs"}.get(kind, f"{kind}_values")
    return {"name": name, "dim_context": dims, "typed_values": [{"value_type": term("V:1"), "values": {"scalar_type": kind, listed: values}}], **more}


def test_nested_lists(spark, tmp_path):
    docs = [
        doc("flat", [2, 3], [1, 2, 3, 4, 5, 6]), doc("deep", [2, 2, 2], [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]), doc("half", [2, 2, 2], [[1, 2, 3, 4], [5, 6, 7, 8]]),
        doc("ragged", [2, 2], [[1], [2, None]]), doc("text", [2], ["x", ""], "string"), doc("refs", [2], ["O:1", None], "oterm_ref"), doc("none", [0], []),
        doc("flags", [2], [True, False], "boolean"),
    ]
    for d in docs:
        (tmp_path / f"{d['name']}.json").write_text(json.dumps(d, indent=1))
    rows = bj.accepted(bj.scan_documents(spark, str(tmp_path)))
    got = {}
    for r in bj.cells(rows, bj.variables(rows)).collect():
        got.setdefault(r.name, {})[tuple(r.idx)] = r.value
    cube = {(i, j, k): str(4 * i + 2 * j + k + 1) for i in (0, 1) for j in (0, 1) for k in (0, 1)}
    assert got == {
        "flat": {(i, j): str(3 * i + j + 1) for i in (0, 1) for j in (0, 1, 2)}, "deep": cube, "half": cube, "ragged": {(0, 0): "1", (1, 0): "2", (1, 1): None},
        "text": {(0,): "x", (1,): ""}, "refs": {(0,): "O:1", (1,): None}, "flags": {(0,): "true", (1,): "false"},
    }


def test_what_is_rejected(spark, tmp_path):
    lines = [json.dumps(doc("good", [1], [1])), "{broken", "3", "", json.dumps({**doc("x", [1], [1]), "name": None}), json.dumps({**doc("y", [1], [1]), "typed_values": []}), json.dumps(doc("z", [None], [1]))]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    rows = bj.scan_documents(spark, str(tmp_path), whole_files=False)
    assert [r.name for r in bj.accepted(rows).collect()] == ["good"]
    faults = {r.text: r.fault for r in bj.rejected(rows).collect()}
    assert [faults[x] for x in (lines[1], lines[2], lines[4], lines[5], lines[6])] == ["not JSON", "not an object", "no name", "no values", "a dimension without a size"]
    assert len(faults) == 5


def test_attributes(spark, tmp_path):
    context = [
        {"value_type": term("A:1"), "value": {"scalar_type": "boolean", "boolean_value": False}}, {"value_type": term("A:2"), "value_units": term("U:1"), "value": {"scalar_type": "float", "float_value": 1.5}},
        {"value_type": term("A:3"), "value": {"scalar_type": "object_ref", "object_ref": "S1"}}, {"value_type": term("A:4"), "value": {"scalar_type": "string", "string_value": None}}, {"value_type": term("A:5")},
    ]
    (tmp_path / "a.json").write_text(json.dumps(doc("a", [1], [1], description="d", data_type=term("T:1"), array_context=context)))
    head = bj.headers(bj.accepted(bj.scan_documents(spark, str(tmp_path)))).first()
    assert (head.description, head.type_id, head.type_name, head["shape"], head.dim_ids) == ("d", "T:1", "t:1", [1], ["D:0"])
    assert [(a.type_id, a.units_id, a.value) for a in head.attributes] == [("A:1", None, "false"), ("A:2", "U:1", "1.5"), ("A:3", None, "S1"), ("A:4", None, None), ("A:5", None, None)]
