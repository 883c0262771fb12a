"""Mixing sources to target weights by weighted sampling with exponential keys (Efraimidis and Spirakis).

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, ordered last; a source
of size 0 has target 0; equal keys go by doc_id, then size; repeated rows are separate documents. An empty table gives an
empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialize

#: Slices of each source by key. Only the slice in which a source's budget ends is sorted.
SLICES = 4096


def uniform(identity: Column) -> Column:
    """A number in (0, 1) that depends on the value alone, the same in every run."""
    hexes = F.substring(F.md5(F.coalesce(identity.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(hexes, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most_epochs: int) -> DataFrame:
    """Per source (src, source_size): its target.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes. No target is
    above ``most_epochs`` times its source; what is above goes to the others by weight. Sorted by size per weight, the
    capped sources come first, so one running sum finds where capping ends.
    """
    order = Window.orderBy(F.col("src").isNull(), "src")
    turn = (F.row_number().over(order) - 1) % F.lit(len(weights))
    weigh = F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1)
    s = sizes.select("src", "source_size", weigh.alias("w")).withColumn("cap", F.col("source_size") * most_epochs)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").isNull(), "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("w_all", F.sum("w").over(everything))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
    s = s.withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
    free = F.col("left") / F.col("w_left") * F.col("w") < F.col("cap")
    s = s.withColumn("free", free)
    # the first free source fixes the level for all after it
    level = F.max(F.when(F.col("free"), F.struct(F.col("w_left"), F.col("left")))).over(everything)
    s = s.withColumn("level", level)
    target = F.when(F.col("free"), F.col("level.left") / F.col("level.w_left") * F.col("w")).otherwise(F.col("cap").cast("double"))
    return s.select("src", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, size: Column, source: Column, identity: Column, quality: Column, weights: Sequence[float],
    share: float = 1.5, most_epochs: int = 2,
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_taken.

    Complete epochs come first: floor(target / source size) copies of everything. What is left of a budget goes to the
    documents with the least keys -ln(u) / quality; the last one is taken in part, so a source's sum is its target's floor.
    """
    keyed = docs.withColumns({"mix_src": source, "mix_size": size.cast("long"), "mix_id": identity})
    keyed = keyed.withColumn("mix_key", -F.log(uniform(F.col("mix_id"))) / quality)
    keyed = keyed.withColumn("mix_slice", F.least(F.lit(SLICES - 1), F.floor((1 - F.exp(-F.col("mix_key"))) * SLICES)).cast("int"))
    slices = materialize(keyed.groupBy(F.col("mix_src").alias("src"), F.col("mix_slice").alias("slice")).agg(F.sum("mix_size").alias("n")), "slices")
    plan = targets(slices.groupBy("src").agg(F.sum("n").alias("source_size")), weights, share, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("slice")) - F.col("n")
    ends = slices.withColumn("before", before).join(plan.withColumnRenamed("src", "p_src"), F.col("src").eqNullSafe(F.col("p_src")))
    last = F.max(F.when(F.col("before") < F.col("budget"), F.struct("slice", "before")))
    ends = ends.groupBy("src", "source_size", "target", "epochs", "budget").agg(last.alias("last"))
    ends = ends.select("src", "source_size", "target", "epochs", "budget", "last.slice", "last.before")
    ends = materialize(ends.toDF(*[f"mix_e_{c}" for c in ends.columns]), "ends")
    e = {c: F.col(f"mix_e_{c}") for c in ("src", "source_size", "target", "epochs", "budget", "slice", "before")}
    met = keyed.join(ends, F.col("mix_src").eqNullSafe(e["src"]))
    cut = F.coalesce(F.col("mix_slice") == e["slice"], F.lit(False))
    whole = met.where(~cut).withColumn("mix_part", F.when(F.col("mix_slice") < e["slice"], F.col("mix_size")).otherwise(F.lit(0)))
    order = Window.partitionBy("mix_src").orderBy("mix_key", "mix_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    held = e["before"] + F.coalesce(F.sum("mix_size").over(order), F.lit(0))
    part = met.where(cut).withColumn("mix_part", F.greatest(F.lit(0), F.least("mix_size", e["budget"] - held)))
    taken = e["epochs"] * F.col("mix_size") + F.col("mix_part")
    added = [F.col("mix_size"), e["source_size"].alias("mix_source_size"), e["target"].alias("mix_target"), taken.cast("long").alias("mix_taken")]
    return whole.unionByName(part).select(*docs.columns, *added)
