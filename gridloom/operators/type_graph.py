"""The graph of types: which types are made from which, through which processes.

Processes are grouped by (set of input types -> set of output types). Types per process
are few, so the two sets are small arrays; the objects themselves stay in the edge tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import line_thickness
from gridloom.operators.reach import Edges, reach, reverse
from gridloom.session import materialize

MAX_ARRAYS_PER_TYPE = 2  # fixed value: more array types than this under one type are clustered


def is_array(col) -> Column:
    return F.col(col).startswith("Brick-") if isinstance(col, str) else col.startswith("Brick-")


def process_type_edges(process_input: DataFrame, process_output: DataFrame, process: DataFrame) -> DataFrame:
    """Per process with a static input: process_id, name, in_filter, from_types, to_types.

    ``process`` has id, process_term_name and in_filter.
    """
    from_types = process_input.filter(~is_array("obj_type")).groupBy("process_id").agg(F.array_sort(F.collect_set("obj_type")).alias("from_types"))
    to_types = process_output.groupBy("process_id").agg(F.array_sort(F.collect_set("obj_type")).alias("to_types"))
    names = process.select(F.col("id").alias("process_id"), F.col("process_term_name").alias("name"), "in_filter")
    empty = F.array().cast("array<string>")
    return (
        from_types.join(names, "process_id")
        .join(to_types, "process_id", "left")
        .withColumn("to_types", F.coalesce("to_types", empty))
    )


MATCH, ABOVE, BELOW = "match", "above", "below"


def processes_around(process: DataFrame, chosen: DataFrame, edges: Edges) -> DataFrame:
    """``process`` rows that match, lie above a match or lie below one, with ``mark`` (match before above before below) and
    ``in_filter`` (only the matches themselves).

    ``chosen(id)`` holds the matches. One walk each way from all of them at once; every vertex is met once.
    """
    start = chosen.select(F.concat(F.lit("Process:"), "id").alias("vertex")).distinct()

    def met(walk: Edges, mark: str) -> DataFrame:
        found = reach(start, walk, include_start=mark == ABOVE).filter(F.col("vertex").startswith("Process:"))
        return found.select(F.substring("vertex", len("Process:") + 1, 2**31 - 1).alias("id"), F.when(F.col("hops") == 0, MATCH).otherwise(mark).alias("mark"))

    marked = met(reverse(edges), ABOVE).unionByName(met(edges, BELOW))
    place = F.when(F.col("mark") == MATCH, 0).when(F.col("mark") == ABOVE, 1).otherwise(2)
    marked = marked.groupBy("id").agg(F.min_by("mark", place).alias("mark"))
    return process.join(marked, "id").withColumn("in_filter", F.col("mark") == MATCH)


def group_key() -> Column:
    return F.concat_ws(">", F.array_join("from_types", "+"), F.array_join("to_types", "+"))


def _side(groups: DataFrame, io: DataFrame, side: str, static_only: bool) -> DataFrame:
    """Distinct objects per (group, type) on one side."""
    if static_only:
        io = io.filter(~is_array("obj_type"))
    joined = io.select("process_id", "obj_type", "obj").join(groups.select("process_id", "edge"), "process_id")
    per = joined.select("edge", "obj_type", "obj").distinct().groupBy("edge", "obj_type").agg(F.count("*").alias("n_type"))
    return per.withColumn("side", F.lit(side))


def type_graph_sides(groups: DataFrame, process_input: DataFrame, process_output: DataFrame) -> DataFrame:
    """edge, side (from, to), obj_type, n_type for ``groups(process_id, edge)``."""
    return _side(groups, process_input, "from", True).unionByName(_side(groups, process_output, "to", False))


def type_graph_edges(groups: DataFrame) -> DataFrame:
    """One row per edge: num processes, their distinct names, any in filter."""
    return groups.groupBy("edge").agg(
        F.count("*").alias("num"),
        F.array_sort(F.collect_set("name")).alias("names"),
        F.bool_or("in_filter").alias("in_filter"),
    )


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours on the least vertex around each vertex u: the greater ones with ``large``, else all of lesser or
    equal label. Edges (u, v) run from the greater vertex to the lesser."""
    around = edges
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of ``pairs(node, via)``: nodes sharing a ``via`` belong together. Result: node, label (the least
    node of the component).

    Nodes hang on the shared key, never on each other, so a key of many nodes costs one row per
    node. Rounds of a large-star and a small-star step halve distances, so their number grows
    with the logarithm of the longest path.
    """
    pairs = pairs.filter("node IS NOT NULL AND via IS NOT NULL").select("node", "via").distinct()
    # a node sorts before every key, so the least vertex of a component is a node
    edges = materialize(pairs.select(F.concat(F.lit("v"), "via").alias("u"), F.concat(F.lit("n"), "node").alias("v")), "pairs")
    before = None
    while (now := _fingerprint(edges)) != before:
        before = now
        edges = materialize(_star(_star(edges, True), False), "stars")
    nodes = edges.filter(F.col("u").startswith("n")).unionByName(edges.select(F.col("v").alias("u"), "v")).distinct()
    plain = lambda c: F.substring(c, 2, 2**31 - 1)
    return nodes.select(plain("u").alias("node"), plain("v").alias("label"))


def type_graph_merge(groups: DataFrame) -> DataFrame:
    """Merge edges that share a process name, an input type and an output type: groups with a new ``edge``.

    Only edges with a static output type take part. Free of order: whole connected components
    are merged, and the merged edge is named by the union of its types.
    """
    groups = materialize(groups, "groups")  # read for the shapes and again for the result
    shapes = groups.select("edge", "name", "from_types", "to_types").distinct()
    able = shapes.filter(F.exists("to_types", lambda x: ~is_array(x)))
    pairs = able.select("edge", "name", "to_types", F.explode("from_types").alias("f"))
    pairs = pairs.select("edge", "name", "f", F.explode("to_types").alias("t"))
    pairs = pairs.select(F.col("edge").alias("node"), F.concat_ws("|", "name", "f", "t").alias("via"))
    label = components(pairs).select(F.col("node").alias("edge"), "label")
    labelled = groups.join(label, "edge", "left").withColumn("label", F.coalesce("label", "edge"))
    kinds = labelled.select("label", "from_types", "to_types").distinct()

    def union_of(col):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(col))))

    named = kinds.groupBy("label").agg(union_of("from_types").alias("from_types"), union_of("to_types").alias("to_types"))
    named = named.select("label", group_key().alias("edge"))
    return labelled.drop("edge", "from_types", "to_types").join(named, "label").drop("label")


def type_graph_counts(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """Per edge, side and type: objects, line thickness, and the label of the edge.

    The thickness is round(log10 n) + 1; with several types on a side each gets its share,
    at least 1 and less than the whole.
    """
    totals = sides.groupBy("edge", "side").agg(F.sum("n_type").alias("n_side"), F.count("*").alias("n_types"))
    whole = line_thickness("num")
    share = F.bround(F.col("n_type") / F.col("n_side") * whole, 0).cast("int")
    share = F.when(share == whole, F.greatest(whole - 1, F.lit(1))).when(share == 0, 1).otherwise(share)
    listed = F.array_sort(F.collect_list(F.struct("obj_type", "n_type")))
    shown = F.array_join(F.transform(listed, lambda s: F.concat_ws(" ", s["n_type"].cast("string"), s["obj_type"])), ", ")
    texts = sides.groupBy("edge").pivot("side", ["from", "to"]).agg(shown)
    label = F.concat(
        F.col("num").cast("string"), F.lit(" "), F.array_join("names", ", "), F.lit("<br>"),
        F.coalesce(F.col("from"), F.lit("")), F.lit(" &rarr; "), F.coalesce(F.col("to"), F.lit("")),
    )
    return (
        sides.join(totals, ["edge", "side"])
        .join(edges, "edge")
        .join(texts, "edge")
        .select(
            "edge", "side", "obj_type", "n_type",
            F.when(F.col("n_types") > 1, share).otherwise(whole).alias("thickness"),
            "in_filter",
            label.alias("text"),
        )
    )


def graph_counts(process_input: DataFrame, process_output: DataFrame, process: DataFrame) -> DataFrame:
    """The counts from the tables. Groups are written once as both sides need them; so is the small result."""
    groups = process_type_edges(process_input, process_output, process).withColumn("edge", group_key())
    groups = materialize(groups.select("process_id", "edge", "name", "in_filter"), "groups")
    sides = materialize(type_graph_sides(groups, process_input, process_output), "sides")
    return materialize(type_graph_counts(type_graph_edges(groups), sides), "counts")


def type_graph_links(counts: DataFrame) -> DataFrame:
    """Links between nodes: source, target, thickness, in_filter, text.

    An edge with several types on a side runs through a node of its own; each array type of an
    edge is a node of its own.
    """
    sizes = counts.groupBy("edge").agg(
        F.count_if(F.col("side") == "from").alias("n_from"), F.count_if(F.col("side") == "to").alias("n_to"),
        F.min(F.when(F.col("side") == "from", F.col("obj_type"))).alias("only_from"),
    )
    rows = counts.join(sizes, "edge").filter("n_to > 0")
    through = (F.col("n_from") > 1) | (F.col("n_to") > 1)
    hub = F.concat(F.lit("edge:"), "edge")
    array_node = F.concat(F.lit("array:"), "edge", F.lit(":"), "obj_type")
    into = rows.filter((F.col("side") == "from") & through).select(
        F.col("obj_type").alias("source"), hub.alias("target"), "thickness", "in_filter", "text"
    )
    out = rows.filter(F.col("side") == "to").select(
        F.when(through, hub).otherwise(F.col("only_from")).alias("source"),
        F.when(is_array("obj_type"), array_node).otherwise(F.col("obj_type")).alias("target"),
        "thickness", "in_filter", "text",
    )
    return into.unionByName(out)


def type_graph_nodes(static_counts: DataFrame, counts: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes: name, category, n, is_root (nothing leads to it), unused, clustered.

    ``static_counts(obj_type, n)``. More than two array nodes under one static type are clustered.
    """
    arrays = counts.filter((F.col("side") == "to") & is_array("obj_type")).select(
        F.concat(F.lit("array:"), "edge", F.lit(":"), "obj_type").alias("name"), F.lit("DDT_").alias("category"), F.col("n_type").alias("n")
    )
    statics = static_counts.select(F.col("obj_type").alias("name"), F.lit("SDT_").alias("category"), "n")
    hubs = links.select(F.explode(F.array("source", "target")).alias("name")).filter(F.col("name").startswith("edge:")).distinct()
    nodes = statics.unionByName(arrays).unionByName(hubs.select("name", F.lit("hub").alias("category"), F.lit(0).cast("bigint").alias("n")))
    entered = links.select(F.col("target").alias("name"), F.lit(True).alias("_in")).distinct()
    touched = links.select(F.explode(F.array("source", "target")).alias("name"), F.lit(True).alias("_used")).distinct()
    under = links.filter(F.col("target").startswith("array:") & ~F.col("source").startswith("edge:"))
    many = under.groupBy("source").agg(F.count("*").alias("k")).filter(F.col("k") > MAX_ARRAYS_PER_TYPE)
    clustered = under.join(many, "source", "left_semi").select(F.col("target").alias("name"), F.lit(True).alias("_many")).distinct()
    false = F.lit(False)
    return (
        nodes.join(entered, "name", "left").join(touched, "name", "left").join(clustered, "name", "left")
        .select(
            "name", "category", "n",
            (~F.coalesce("_in", false)).alias("is_root"),
            (~F.coalesce("_used", false)).alias("unused"),
            F.coalesce("_many", false).alias("clustered"),
        )
    )


def reversible_links(links: DataFrame) -> DataFrame:
    """Add whether a link between two different nodes also runs the other way."""
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("_back")).distinct()
    flag = F.coalesce("_back", F.lit(False)) & (F.col("source") != F.col("target"))
    return links.join(back, ["source", "target"], "left").withColumn("reversible", flag).drop("_back")
