"""The JSON search request, turned into calls on the chainable query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.operators.filters import coerce_value
from gridloom.operators.ontology import person_or_lab
from gridloom.plans.query import Query, Workspace


def _criterion(param: dict) -> dict:
    value = coerce_value(param["keyword"], param.get("scalarType", "text"))
    return {param["attribute"]: {param["matchType"]: value}}


def _process_criterion(ws: Workspace, param: dict) -> dict:
    """``person = X`` given with its term also accepts every direct child term of X."""
    if param["attribute"] == "person" and param["matchType"] == "=" and param.get("term"):
        return {"person": {"=": person_or_lab(ws.ontology.terms, param["term"])}}
    return _criterion(param)


def search(ws: Workspace, request: dict) -> DataFrame:
    match = request["queryMatch"]
    query: Query = ws.query(match["dataModel"])
    if match["dataModel"] == "Brick" and match.get("dataType", "NDArray") != "NDArray":
        query.has({"data_type": {"=": match["dataType"]}})
    for param in match.get("params", []):
        query.has(_criterion(param))
    for param in request.get("processesUp", []):
        query.is_output_of_process(_process_criterion(ws, param))
    for param in request.get("processesDown", []):
        query.is_input_of_process(_criterion(param))
    query.search_all_up(request.get("searchAllProcessesUp") is True)
    query.search_all_down(request.get("searchAllProcessesDown") is True)
    for key, link in (("connectsUpTo", query.linked_up_to), ("connectsDownTo", query.linked_down_to)):
        if key in request:
            merged: dict = {}
            for param in request[key].get("params", []):
                merged.update(_criterion(param))
            link(request[key]["dataModel"], merged)
    if "parentProcesses" in request:
        query.immediate_parent(request["parentProcesses"])
    return query.find()
