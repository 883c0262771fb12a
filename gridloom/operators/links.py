"""Joins along provenance: objects, the processes that made or used them, and keys.

Edge tables are long: ``process_input`` and ``process_output`` hold (process_id, obj_type,
obj), one row per object, so a process with very many objects never becomes one large row.
"""

from __future__ import annotations

import itertools
import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import ref_key, ref_type, split_object_list, table_of
from gridloom.operators.reach import Edges, Steps, edges_between, edges_met, reach, reach_from_each, reverse
from gridloom.session import materialize, materialize_counted, tasks_for, tasks_of


def io_of_process(rows: DataFrame, vertex: str, io: DataFrame, processes: DataFrame) -> DataFrame:
    """Rows whose ``vertex`` is an input (or output) of any of ``processes(id)``."""
    hit = io.join(processes.select(F.col("id").alias("process_id")), "process_id", "left_semi")
    return rows.join(hit.select(F.col("obj").alias(vertex)), vertex, "left_semi")


def _own_io(objects: DataFrame, io: DataFrame, tasks: int) -> DataFrame:
    """The distinct references (obj, process_id) of ``objects(obj)``, dealt by object."""
    chosen = objects.select("obj").repartition(tasks, "obj")
    return io.select("obj", "process_id").repartition(tasks, "obj").join(chosen, "obj", "left_semi").distinct()


def processes_of(objects: DataFrame, io: DataFrame, process: DataFrame) -> DataFrame:
    """The processes that made (io = outputs) or used (io = inputs) each of ``objects(obj)``."""
    tasks = tasks_for(io)
    own = _own_io(objects, io, tasks).withColumnRenamed("process_id", "id")
    return own.repartition(tasks, "id").join(process.repartition(tasks, "id"), "id")


def process_docs(objects: DataFrame, io: DataFrame, other_io: DataFrame, keys: DataFrame) -> DataFrame:
    """For each object, each of its processes with the objects on the other side.

    One row per (obj, process_id, other): its type and user key from ``keys(obj, user_key)``. References get their user
    key before they meet, since the pairs are many more.
    """
    tasks = tasks_for(io.select("obj").unionByName(other_io.select("obj")))
    own = _own_io(objects, io, tasks)
    other = other_io.select("process_id", F.col("obj").alias("other"), F.col("obj_type").alias("other_type"))
    named = keys.select(F.col("obj").alias("other"), "user_key")
    other = other.repartition(tasks, "other").join(named.repartition(tasks, "other"), "other", "left")
    out = own.repartition(tasks, "process_id").join(other.repartition(tasks, "process_id"), "process_id")
    return out.select("other", "process_id", "obj", "other_type", "user_key")


def io_by_type(process_input: DataFrame, process_output: DataFrame) -> DataFrame:
    """Objects of each process grouped by side and type, one row per object."""
    return process_input.select("process_id", F.lit("in").alias("side"), "obj_type", "obj").unionByName(
        process_output.select("process_id", F.lit("out").alias("side"), "obj_type", "obj")
    )


def linked_up_to(rows: DataFrame, vertex: str, start: DataFrame, edges: Edges) -> DataFrame:
    """Rows reachable downstream from ``start(vertex)`` along edges.

    If the rows are fewer than the start, what lies above them is found first, and the walk goes down over that alone.
    """
    wanted, n_wanted = materialize_counted(rows.select(F.col(vertex).alias("vertex")), "wanted")
    start, n_start = materialize_counted(start.select("vertex"), "start")
    if n_wanted < n_start:
        edges = reverse(edges_met(wanted, reverse(edges)))
    found = reach(start, edges).select(F.col("vertex").alias(vertex))
    return rows.join(found, vertex, "left_semi")


def linked_down_to(rows: DataFrame, vertex: str, start: DataFrame, edges: Edges) -> DataFrame:
    """Rows upstream of ``start(vertex)``."""
    return linked_up_to(rows, vertex, start, reverse(edges))


def linked_with_props(rows: DataFrame, vertex: str, start: DataFrame, start_vertex: str, props: list[str], edges: Edges) -> DataFrame:
    """Rows downstream of ``start`` with its properties copied on; distinct.

    Walks once per distinct combination of property values, not once per start object, and only
    over edges that lead to ``rows``: these are found first by one plain walk back.
    """
    targets = rows.select(F.col(vertex).alias("vertex"))
    edges = reverse(edges_met(targets, reverse(edges)))
    own = start.select(start_vertex, *[F.col(p).alias("_up_" + p) for p in props])
    values = own.drop(start_vertex).distinct().withColumn("root", F.monotonically_increasing_id())
    values = materialize(values, "values")  # fixes the numbers, which go along in place of the values
    same = reduce(operator.and_, [own["_up_" + p].eqNullSafe(values["_up_" + p]) for p in props])
    found = reach_from_each(own.join(values, same).select("root", F.col(start_vertex).alias("vertex")), edges)
    tasks = tasks_for(found)
    hit = found.select("root", F.col("vertex").alias(vertex)).join(values, "root").drop("root")
    keep = [c for c in rows.columns if c not in props]
    out = rows.repartition(tasks, vertex).join(hit.repartition(tasks, vertex), vertex)
    return out.select(*keep, *[F.col("_up_" + p).alias(p) for p in props]).distinct()


def search_all(
    rows: DataFrame,
    vertex: str,
    processes: DataFrame,
    process_input: DataFrame,
    process_output: DataFrame,
    edges: Edges,
    up: bool,
    down: bool,
) -> DataFrame:
    """Rows used or made by any ancestor (``up``) or descendant (``down``) of ``processes``.

    The processes themselves count for ``up`` and not for ``down``.
    """
    start = processes.select(F.concat(F.lit("Process:"), "id").alias("vertex"))
    found = None
    if up:
        found = reach(start, reverse(edges), include_start=True)
    if down:
        lower = reach(start, edges)
        found = lower if found is None else found.unionByName(lower)
    procs = (
        found.filter(F.col("vertex").startswith("Process:"))
        .select(F.split("vertex", ":", 2)[1].alias("process_id"))
        .distinct()
    )
    io = process_input.select("process_id", "obj").unionByName(process_output.select("process_id", "obj"))
    linked = io.join(procs, "process_id", "left_semi").select(F.col("obj").alias(vertex))
    return rows.join(linked, vertex, "left_semi")


def immediate_parent(
    rows: DataFrame,
    vertex: str,
    process_input: DataFrame,
    process_output: DataFrame,
    inputs: list[str],
    outputs: list[str],
) -> DataFrame:
    """Rows made by a process whose input and output type sets are of the stated size and hold each stated type.

    Only processes with the first stated type on each side are looked at further. Their types are few.
    """

    def holding(io: DataFrame, wanted: list[str]) -> DataFrame:
        return io.filter(F.col("obj_type") == wanted[0]).select("process_id")

    def fitting(io: DataFrame, wanted: list[str]) -> DataFrame:
        per = io.join(able, "process_id", "left_semi").groupBy("process_id").agg(F.collect_set("obj_type").alias("types"))
        held = [F.array_contains("types", t) for t in wanted]
        return per.filter(reduce(operator.and_, held, F.size("types") == len(wanted))).select("process_id")

    able = holding(process_output, outputs).join(holding(process_input, inputs), "process_id", "left_semi").distinct()
    able = materialize(able, "processes")
    procs = fitting(process_input, inputs).join(fitting(process_output, outputs), "process_id", "left_semi")
    made = process_output.join(procs, "process_id", "left_semi").select(F.col("obj").alias(vertex))
    return rows.join(made, vertex, "left_semi")


def upstream_graph(objects: DataFrame, edges: Edges) -> DataFrame:
    """All edges upstream of any of ``objects(obj)``: src, dst.

    This holds every object's intermediates once, however many objects share them; ``intermediates`` lists them for
    chosen objects.
    """
    met = edges_met(objects.select(F.col("obj").alias("vertex")), reverse(edges))
    return reverse(met)


def intermediates(objects: DataFrame, graph: DataFrame) -> DataFrame:
    """For each of ``objects(obj)`` every object upstream of it: obj, vertex, hops. As many rows as there are pairs."""
    start = objects.select(F.col("obj").alias("root"), F.col("obj").alias("vertex"))
    found = reach_from_each(start, reverse(graph)).filter(~F.col("vertex").startswith("Process:"))
    return found.select(F.col("root").alias("obj"), "vertex", "hops")


def nearest_sources(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """For every vertex below any of ``sources(vertex, label)`` and each label the nearest source: vertex, label, hops,
    source. Ties on distance go to the smallest source.

    The least (hops, source) goes down one edge at a time from all sources at once, so there is one row per vertex and
    label, not one per source and vertex. A source passes on itself; what comes to it from above is its own result
    only.
    """
    spark = sources.sparkSession
    first = materialize(sources.select("vertex", "label").filter(F.col("vertex").isNotNull()).distinct(), "sources")
    steps = Steps(first.withColumn("source", F.col("vertex")), "nearest")
    frontier, ends = steps.store(first.withColumn("source", F.col("vertex")), 0, keep=False)
    for hops in itertools.count(1):
        if ends is None:
            break
        near = edges_between(edges, ends)
        step = frontier.join(near, frontier["vertex"] == near["src"]).filter(F.col("dst").isNotNull())
        step = step.groupBy(F.col("dst").alias("vertex"), "label").agg(F.min("source").alias("source"))
        if steps.kept:
            step = step.join(steps.found().select("vertex", "label"), ["vertex", "label"], "left_anti")
        reached, ends = steps.store(step, hops)
        frontier = reached.join(first, ["vertex", "label"], "left_anti")
    if not steps.kept:
        return spark.createDataFrame([], steps.schema)
    return steps.found().select("vertex", "label", "hops", "source")


def upstream_props(objects: DataFrame, edges: Edges, values: DataFrame, together: bool = False) -> DataFrame:
    """For each of ``objects(obj)`` and each property, the nearest upstream value.

    ``values(vertex, prop, value)`` holds the properties of possible upstream objects; of several values of one vertex
    the least counts. Ties on distance go to the smallest vertex: obj, prop, source, hops, value. With ``together`` all
    properties come from one vertex, which has all of them.
    """
    values = values.filter(F.col("value").isNotNull()).groupBy("vertex", "prop").agg(F.min("value").alias("value"))
    if together:
        wanted = values.agg(F.count_distinct("prop").alias("wanted"))
        full = values.groupBy("vertex").agg(F.count("*").alias("n")).join(wanted, F.col("n") == F.col("wanted"))
        sources = full.select("vertex", F.lit("").alias("label"))
    else:
        sources = values.select("vertex", F.col("prop").alias("label"))
    graph = upstream_graph(objects, edges)
    sources = sources.join(graph.select(F.col("src").alias("vertex")), "vertex", "left_semi")
    found = nearest_sources(sources, graph).join(objects.select(F.col("obj").alias("vertex")), "vertex", "left_semi")
    own = values.select(F.col("vertex").alias("source"), "prop", "value")
    if together:
        found = found.drop("label").join(own, "source")
    else:
        found = found.withColumnRenamed("label", "prop").join(own, ["source", "prop"])
    return found.select(F.col("vertex").alias("obj"), "prop", "source", "hops", "value")


def lookup_last(df: DataFrame, key: str, pk: str) -> DataFrame:
    """One row per key value: of duplicates the one with the greatest primary key."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), pk).alias("r")).select("r.*")


def first_per_key(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row per key: of several combinations of values the least."""
    return df.groupBy(key).agg(F.min(F.struct(*values)).alias("v")).select(key, "v.*")


def upk_to_pk(wanted: DataFrame, entity: DataFrame, upk: str, pk: str) -> DataFrame:
    """``wanted(user_key)`` to ids. Status is ok, unknown or ambiguous; the id is null unless ok."""
    found = entity.groupBy(F.col(upk).alias("user_key")).agg(F.count("*").alias("n"), F.min(pk).alias("pk"))
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return wanted.join(found, "user_key", "left").select(
        "user_key", F.when(F.col("n") == 1, F.col("pk")).alias("pk"), status.alias("status")
    )


def pk_exists(wanted: DataFrame, entity: DataFrame, pk: str) -> DataFrame:
    return wanted.join(entity.select(F.col(pk).alias("pk")), "pk", "left_semi")


def key_rewrite(rows: DataFrame, row_id: str, list_col: str, keys: DataFrame) -> DataFrame:
    """Replace each reference of a list by its other key, order kept: row_id, list_col.

    ``row_id`` is unique. ``keys(ref, other)`` maps references; an unmapped one stays as it is. Only references of a type
    that the keys have leave their list; the keys found for them come back to it.
    """
    kind = F.substring_index("ref", ":", 1)
    kinds = materialize(keys.select(kind.alias("kind")).distinct(), "kinds")  # few; Spark sees their size
    mapped = keys.filter("ref IS NOT NULL").groupBy("ref").agg(F.sort_array(F.collect_list(F.coalesce("other", "ref"))).alias("others"))
    items = rows.select(row_id, F.explode(F.array_distinct(list_col)).alias("ref")).withColumn("kind", kind)
    items = items.join(kinds, "kind", "left_semi").drop("kind").join(mapped, "ref")
    found = items.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("ref", "others"))).alias("_found"))
    out = rows.select(row_id, F.coalesce(list_col, F.array().cast("array<string>")).alias(list_col)).join(found, row_id, "left")
    changed = F.flatten(F.transform(list_col, lambda ref: F.coalesce(F.try_element_at("_found", ref), F.array(ref))))
    return out.select(row_id, F.when(F.col("_found").isNull(), F.col(list_col)).otherwise(changed).alias(list_col))


def map_to_core_type(dim: DataFrame, var: str, entity: DataFrame, prop: str, pk: str, out: str) -> DataFrame:
    """Add the id of the entity whose ``prop`` equals the dimension variable; null when none."""
    found = entity.filter(F.col(prop).isNotNull()).groupBy(F.col(prop).alias(var)).agg(F.max(pk).alias(out))
    return dim.join(found, var, "left")


def add_core_type_var(dim: DataFrame, pk_var: str, entity: DataFrame, pk: str, props: list[str]) -> DataFrame:
    """With an id variable present, add properties of the entity it names."""
    return dim.join(entity.select(F.col(pk).alias(pk_var), *props), pk_var, "left")


def add_brick_var(dim: DataFrame, match_dim: str, other: DataFrame, match_other: str, value: str, out: str) -> DataFrame:
    """Add values of another 1-d array, looked up by an equal variable; of duplicates the greatest value."""
    found = other.groupBy(F.col(match_other).alias(match_dim)).agg(F.max(value).alias(out))
    return dim.join(found, match_dim, "left")


def fk_check(rows: DataFrame, fk: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference does not exist in the target; null references are not checked."""
    known = target.select(F.col(key).alias(fk))
    return rows.filter(F.col(fk).isNotNull()).join(known, fk, "left_anti")


def typed_refs(processes: DataFrame, list_col: str, known: DataFrame) -> DataFrame:
    """Reference lists to rows: sys_process_id, table, key; only references to a table that ``known(table)`` names.

    The tables are few. They are written first, so Spark sees their size and sends them to the rows: a join of the rows
    by table would put all references of a table into one task.
    """
    tables = materialize(known.select("table").distinct(), "tables")
    # named inside the list: a filter on the names would else move below the explode and make them again
    items = F.transform(split_object_list(list_col), lambda ref: F.struct(table_of(ref_type(ref)).alias("table"), ref_key(ref).alias("key")))
    refs = processes.select(F.col("id").alias("sys_process_id"), F.explode_outer(items).alias("ref"))
    return refs.select("sys_process_id", "ref.table", "ref.key").join(tables, "table", "left_semi")


def normalize_process_io(processes: DataFrame, list_col: str, known: DataFrame) -> DataFrame:
    """Reference lists to rows: sys_process_id, table, key; dangling references are dropped.

    ``known(table, key)`` lists what exists.
    """
    refs = typed_refs(processes, list_col, known)
    return refs.join(known, ["table", "key"], "left_semi").select("sys_process_id", "table", "key")


def io_columns(refs: DataFrame, tables: list[str]) -> DataFrame:
    """One nullable ``<table>_id`` column per table, one of them filled in each row."""
    cols = [F.when(F.col("table") == t, F.col("key")).alias(t + "_id") for t in tables]
    return refs.select("sys_process_id", *cols)


def resolve_name(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """``table:id`` tokens to ``table:id  (name)``; a token without a name stays as it is."""
    keyed = names.select(F.concat_ws(":", "table", "id").alias("token"), "name")
    shown = F.concat(F.col("token"), F.coalesce(F.concat(F.lit("  ("), "name", F.lit(")")), F.lit("")))
    return tokens.join(keyed, "token", "left").select("token", shown.alias("label"))


def token_from_name(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(table, name) to token; null when unknown, the smallest id when a name repeats."""
    first = names.groupBy("table", "name").agg(F.min("id").alias("id"))
    return wanted.join(first, ["table", "name"], "left").select(
        "table", "name", F.when(F.col("id").isNotNull(), F.concat_ws(":", "table", "id")).alias("token")
    )


def forward_map(process_input: DataFrame, process_output: DataFrame) -> DataFrame:
    """Input object to the distinct outputs of the processes that use it."""
    ins = process_input.select("process_id", "obj")
    outs = process_output.select("process_id", F.col("obj").alias("output"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = ins.select("process_id", one.alias("n"), none.alias("m")).unionByName(outs.select("process_id", none.alias("n"), one.alias("m")))
    widths = sides.groupBy("process_id").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).filter("process_id IS NOT NULL")
    pairs = widths.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]  # counted without making them
    tasks = tasks_for(ins.select("process_id").unionByName(outs.select("process_id")))
    met = ins.repartition(tasks, "process_id").join(outs.repartition(tasks, "process_id"), "process_id")
    return met.select("obj", "output").repartition(tasks_of(pairs), "obj", "output").distinct()


def connects_up(refs: DataFrame, start: DataFrame, edges: Edges) -> DataFrame:
    """For ``refs(brick_id, vertex)``: is any referenced object downstream of ``start(vertex)``, or one itself."""
    found = reach(start, edges, include_start=True).select("vertex", F.lit(True).alias("hit"))
    return refs.join(found, "vertex", "left").groupBy("brick_id").agg(
        F.coalesce(F.bool_or("hit"), F.lit(False)).alias("connects")
    )


def brick_fk_refs(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct ``Type:id`` per array over attributes and dimension variables.

    ``refs(brick_id, type, value, is_pk)``: ids are kept, user keys are mapped by
    ``keys(type, user_key, id)``; unmapped ones are dropped.
    """
    mapped = refs.join(keys.withColumnRenamed("user_key", "value"), ["type", "value"], "left")
    ident = F.when(F.col("is_pk"), F.col("value")).otherwise(F.col("id"))
    return (
        mapped.select("brick_id", F.concat(F.col("type"), F.lit(":"), ident).alias("ref"))
        .filter(F.col("ref").isNotNull())
        .distinct()
    )


def processes_of_object(process: DataFrame, outputs_col: str, object_id: str) -> DataFrame:
    """Processes whose output list names the object, whatever its type prefix."""
    return process.filter(F.exists(outputs_col, lambda x: x.endswith(":" + object_id)))
