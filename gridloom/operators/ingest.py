"""Loading rows into stored tables: classify, check against processes, overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import term_id_of, term_name_of
from gridloom.operators.links import typed_refs


def upsert_classify(incoming: DataFrame, stored: DataFrame, upk: str, valid: Column) -> DataFrame:
    """Each incoming row as new, unchanged, changed or invalid, with the changed columns.

    Rows match on the user key; all other columns are compared null-safe.
    """
    others = [c for c in incoming.columns if c != upk]
    old = stored.select(upk, *[F.col(c).alias("_old_" + c) for c in others], F.lit(True).alias("_stored"))
    both = incoming.join(old, upk, "left")
    differs = [F.when(~F.col(c).eqNullSafe(F.col("_old_" + c)), F.lit(c)) for c in others]
    changed = F.filter(F.array(*differs), lambda c: c.isNotNull())
    status = (
        F.when(~F.coalesce(valid, F.lit(False)), "invalid")
        .when(F.col("_stored").isNull(), "new")
        .when(F.size(changed) > 0, "changed")
        .otherwise("unchanged")
    )
    shown = F.when(status == "changed", changed).otherwise(F.array().cast("array<string>"))
    return both.select(*incoming.columns, status.alias("status"), shown.alias("changed"))


def check_core_vs_process(entities: DataFrame, upk: str, outputs: DataFrame) -> DataFrame:
    """Entities that are not in exactly one process output: upk, n, message.

    ``outputs(process_id, user_key)`` has one row per listed output.
    """
    counts = outputs.groupBy(F.col("user_key").alias(upk)).agg(F.count_distinct("process_id").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    message = F.when(n == 0, "not found in process file").when(n > 1, "conflicting input objects")
    return entities.join(counts, upk, "left").select(upk, n.alias("n"), message.alias("message")).filter("message is not null")


def upload_with_processes(entities: DataFrame, upk: str, outputs: DataFrame, inputs: DataFrame, known_inputs: DataFrame) -> DataFrame:
    """Whether each process can be loaded: process_id, n_outputs, n_bad_outputs, n_missing_inputs, ok.

    ``entities(upk, status)`` are the classified rows; one invalid or missing output, or one
    unknown input, fails the process with all its outputs. ``outputs(process_id, user_key)``,
    ``inputs(process_id, ref)``, ``known_inputs(ref)``.
    """
    status = entities.select(F.col(upk).alias("user_key"), "status")
    bad = F.col("status").isNull() | (F.col("status") == "invalid")
    per_output = outputs.join(status, "user_key", "left").groupBy("process_id").agg(
        F.count("*").alias("n_outputs"), F.count_if(bad).alias("n_bad_outputs")
    )
    missing = inputs.join(known_inputs.select("ref"), "ref", "left_anti").groupBy("process_id").agg(F.count("*").alias("n_missing_inputs"))
    out = per_output.join(missing, "process_id", "left").withColumn("n_missing_inputs", F.coalesce("n_missing_inputs", F.lit(0)))
    return out.withColumn("ok", (F.col("n_bad_outputs") == 0) & (F.col("n_missing_inputs") == 0))


def process_conflicts(incoming: DataFrame, stored: DataFrame, metadata: list[str]) -> DataFrame:
    """Incoming processes against the stored process of their first existing output.

    Both have id, ``metadata`` columns and the ordered lists input_objects and output_objects of
    ``Type:user_key`` texts. Rows: id, stored_id, missing_outputs (stored outputs that no incoming
    process lists), changed_metadata, changed_inputs, changed_outputs; only processes with a
    stored counterpart that differs.
    """
    placed = incoming.select("id", F.posexplode("output_objects").alias("pos", "obj"))
    owners = stored.select(F.explode("output_objects").alias("obj"), F.col("id").alias("stored_id"))
    owners = owners.groupBy("obj").agg(F.min("stored_id").alias("stored_id"))
    first = placed.join(owners, "obj").groupBy("id").agg(F.min_by("stored_id", "pos").alias("stored_id"))
    old = stored.select(F.col("id").alias("stored_id"), *[F.col(c).alias("_old_" + c) for c in [*metadata, "input_objects", "output_objects"]])
    both = incoming.join(first, "id").join(old, "stored_id")
    listed = placed.select("obj").distinct()
    gone = both.select("id", F.explode("_old_output_objects").alias("obj")).join(listed, "obj", "left_anti")
    gone = gone.groupBy("id").agg(F.count("*").alias("missing_outputs"))
    differs = [F.when(~F.col(c).eqNullSafe(F.col("_old_" + c)), F.lit(c)) for c in metadata]
    changed = F.filter(F.array(*differs), lambda c: c.isNotNull())
    out = both.join(gone, "id", "left").select(
        "id", "stored_id", F.coalesce("missing_outputs", F.lit(0)).alias("missing_outputs"), changed.alias("changed_metadata"),
        (F.col("input_objects") != F.col("_old_input_objects")).alias("changed_inputs"),
        (F.col("output_objects") != F.col("_old_output_objects")).alias("changed_outputs"),
    )
    return out.filter((F.col("missing_outputs") > 0) | (F.size("changed_metadata") > 0) | F.col("changed_inputs") | F.col("changed_outputs"))


def apply_overwrite(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows with incoming rows of the same key in their place, and the new ones added."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def replace_process_edges(edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Edges of replaced processes give way to the new ones."""
    return edges.join(new_edges.select("process_id").distinct(), "process_id", "left_anti").unionByName(new_edges)


def load_processes(processes: DataFrame, list_col: str, keys: DataFrame, not_for_provenance: list[str]) -> DataFrame:
    """Reference lists by user key to edges by id: sys_process_id, table, id; types outside provenance are skipped.

    ``keys(table, key, id)`` maps user keys.
    """
    keys = keys.filter(~F.col("table").isin(not_for_provenance))
    return typed_refs(processes, list_col, keys).join(keys, ["table", "key"]).select("sys_process_id", "table", "id")


def index_entities(df: DataFrame, term_columns: list[str]) -> DataFrame:
    """Rows as stored: each term column becomes an id and a name column."""
    out = []
    for c in df.columns:
        out += [term_id_of(c).alias(c + "_term_id"), term_name_of(c).alias(c + "_term_name")] if c in term_columns else [F.col(c)]
    return df.select(*out)
