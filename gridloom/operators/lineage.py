"""Provenance as rows: what made an object, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.reach import Edges, reach, reverse


class Through:
    """A relation of objects through processes, kept as two tables: (process, object) on either side.

    Its rows are as many as the references, however many pairs they stand for. Pairs are counted by multiplication, and
    listed for chosen objects only.
    """

    def __init__(self, near: DataFrame, far: DataFrame):
        self.near = near.select("process_id", "obj").distinct()
        self.far = far.select("process_id", "obj").distinct()

    def rows(self, near: str = "in", far: str = "out") -> DataFrame:
        """side, process_id, obj: the references of processes with both sides."""
        own = self.near.join(self.far.select("process_id"), "process_id", "left_semi").select(F.lit(near).alias("side"), "process_id", "obj")
        other = self.far.join(self.near.select("process_id"), "process_id", "left_semi").select(F.lit(far).alias("side"), "process_id", "obj")
        return own.unionByName(other)

    def sizes(self) -> DataFrame:
        """obj, n_processes, n_pairs (with process and object of the far side)."""
        width = self.far.groupBy("process_id").agg(F.count("*").alias("n"))
        found = self.near.join(width, "process_id")
        return found.groupBy("obj").agg(F.count("*").alias("n_processes"), F.sum("n").alias("n_pairs"))

    def pairs(self, objects: DataFrame) -> DataFrame:
        """obj, process_id, other: of ``objects(obj)`` alone."""
        chosen = self.near.join(objects.select("obj").distinct(), "obj", "left_semi")
        return chosen.join(self.far.withColumnRenamed("obj", "other"), "process_id").select("obj", "process_id", "other")


def producer_lookup(process_input: DataFrame, process_output: DataFrame, process: DataFrame) -> DataFrame:
    """Each object with each process that made it, the process metadata and its inputs, one row per input."""
    made = process_output.select("obj", F.col("process_id").alias("id")).distinct().join(process, "id")
    inputs = process_input.select(F.col("process_id").alias("id"), F.col("obj").alias("input")).distinct()
    return made.join(inputs, "id", "left")


def provenance_tree(start: DataFrame, process_input: DataFrame, process_output: DataFrame, edges: Edges) -> DataFrame:
    """Everything upstream of ``start(obj)``: depth, obj, process_id, input, is_leaf.

    Each (object, process) once, at its least depth in object steps. A leaf is an input
    that no process made.
    """
    found = reach(start.select(F.col("obj").alias("vertex")), reverse(edges), include_start=True)
    objects = found.filter(~F.col("vertex").startswith("Process:")).select(
        F.col("vertex").alias("obj"), F.floor(F.col("hops") / 2).cast("bigint").alias("depth")
    )
    steps = objects.join(process_output.select("obj", "process_id").distinct(), "obj")
    inputs = process_input.select("process_id", F.col("obj").alias("input")).distinct()
    made = process_output.select(F.col("obj").alias("input"), F.lit(False).alias("_leaf")).distinct()
    return (
        steps.join(inputs, "process_id", "left")
        .join(made, "input", "left")
        .select("depth", "obj", "process_id", "input", F.coalesce("_leaf", F.lit(True)).alias("is_leaf"))
    )


def coassembled(
    process_input: DataFrame,
    process_output: DataFrame,
    edges: Edges,
    assembly_type: str,
    reads_type: str,
    more_than: int = 1,
) -> DataFrame:
    """Objects with an upstream (or own) assembly whose process used more than one reads object: vertex, hops.

    Found forwards, from the co-assembled objects down, so one walk answers for every object.
    """
    many = (
        process_input.filter(F.col("obj_type") == reads_type)
        .groupBy("process_id")
        .agg(F.count_distinct("obj").alias("n"))
        .filter(F.col("n") > more_than)
    )
    start = process_output.filter(F.col("obj_type") == assembly_type).join(many, "process_id", "left_semi")
    found = reach(start.select(F.col("obj").alias("vertex")).distinct(), edges, include_start=True)
    return found.filter(~F.col("vertex").startswith("Process:"))
