"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan inside each probed list.

Lists come from spherical k-means on a bounded sample; every row is indexed. Vectors are rotated by one random orthogonal
matrix and scanned in blocks of columns: after each block a hypothesis test on the partial distance abandons candidates
that are too far with high confidence (the scaled partial distance exceeds (1 + EPSILON / sqrt(dimensions seen)) times
the distance of the query's 20th best so far). What survives all blocks gets its exact score on the original vectors.

How many lists a query probes is set on the sample, so that the lists of that many nearest centres hold ``TARGET`` of the
sample's true neighbours. Defined results: a vector that is null, zero, or holds a null or non-finite component takes no
part, nor one whose dimension is not the most frequent, nor a row without id; rows with a query's id are its own; of
several rows with a query's id the greatest vector asks, of several with a found id the best counts; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import mix
from gridloom.session import materialize

#: Ids, first by hash, with a row each, on which centres are fitted: so many, or SAMPLE_PER_LIST for each list up to the
#: greater bound. Probes and first thresholds are fitted on SAMPLE_ROWS of them.
SAMPLE_ROWS, SAMPLE_PER_LIST, MOST_SAMPLE = 8_192, 8, 131_072
#: Lists are as many as the root of the rows, at least.
FEWEST_LISTS = 8
#: Rows and queries that one task holds at most, about.
PART_ROWS, PART_QUERIES = 8_192, 4_096
TARGET = 0.97
EPSILON = 2.1
BLOCK = 16
#: Queries and rows that are scanned together, and the share of pairs left at which they are scanned one by one.
QUERIES, CHUNK, FEW_LEFT = 128, 2_048, 0.2


def taking_part(v: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def centres_of(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centres = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, top: int, queries: int = 512) -> int:
    """The least number of lists that hold TARGET of the sample's true neighbours."""
    q = sample[:queries]
    scores = q @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(top, len(sample) - 1)]
    lists = (sample / np.linalg.norm(sample, axis=1, keepdims=True) @ centres.T).argmax(1)
    order = np.argsort(-(q @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape).copy(), 1)
    ranks = np.take_along_axis(place, lists[near], 1).reshape(-1)
    if not len(ranks):
        return len(centres)
    return int(np.quantile(ranks, TARGET, method="higher")) + 1


def best_of_each(asks: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of each query's ``top`` best ids, by the best row of each, best first; queries ascending."""
    order = np.lexsort((-scores, ids, asks))
    first = np.ones(len(order), bool)
    first[1:] = (asks[order][1:] != asks[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[first]
    order = order[np.lexsort((ids[order], -scores[order], asks[order]))]
    begin = np.searchsorted(asks[order], asks[order], "left")
    return order[np.arange(len(order)) - begin < top]


def scan(
    ids: np.ndarray, rows: np.ndarray, turned: np.ndarray, asks: np.ndarray, vectors: np.ndarray, floors: np.ndarray, top: int,
    rotation: np.ndarray, scale: float = 1.0,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: (its number, ids, exact scores) of the best rows of this list part.

    ``turned`` holds the rows divided by ``scale`` and rotated, in single precision; ``floors`` scores that each query's
    last place reaches for sure, divided by its square. Queries are scanned together: block by block as matrix products while many candidates
    are left, and pair by pair once few are.
    """
    dims = rows.shape[1]
    cuts = [*range(BLOCK, dims, BLOCK), dims]
    norms = np.einsum("ij,ij->i", turned, turned)
    by_block = [np.einsum("ij,ij->i", turned[:, x:y], turned[:, x:y]) for x, y in zip([0, *cuts], cuts, strict=False)]
    for first in range(0, len(asks), QUERIES):
        some = slice(first, min(first + QUERIES, len(asks)))
        own, q = asks[some], vectors[some]
        p = (q / scale).astype(np.float32) @ rotation
        pp = np.einsum("ij,ij->i", p, p)
        level = floors[some].copy()
        kept_asks, kept_ids, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for lo in range(0, len(rows), CHUNK):
            here = slice(lo, min(lo + CHUNK, len(rows)))
            most = np.maximum(pp[:, None] + norms[here][None, :] - 2 * level[:, None], 0)
            left = own[:, None] != ids[here][None, :]
            part = np.zeros(left.shape, np.float32)
            at: tuple | None = None  # pairs left, once they are few
            seen = 0
            for k, hi in enumerate(cuts):
                if at is None:
                    part += np.einsum("ij,ij->i", p[:, seen:hi], p[:, seen:hi])[:, None] + by_block[k][here][None, :]
                    part -= 2 * (p[:, seen:hi] @ turned[here, seen:hi].T)
                else:
                    gap = turned[at[1], seen:hi] - p[at[0], seen:hi]
                    part = part + np.einsum("ij,ij->i", gap, gap)
                seen = hi
                slack = 1 + EPSILON / np.sqrt(seen) if seen < dims else 1.0
                # what is rotated in single precision may be off by this much; it lets candidates pass, never drops one
                ok = part * (dims / seen) <= most * slack * slack + 2e-5 * dims / seen
                if at is not None:
                    at, part, most = (at[0][ok], at[1][ok]), part[ok], most[ok]
                else:
                    left &= ok
                    if seen == dims or left.mean() < FEW_LEFT:
                        x, y = np.nonzero(left)
                        at, part, most = (x, y + lo), part[left], most[left]
                if at is not None and not len(at[0]):
                    break
            if not len(at[0]):
                continue
            kept_asks, kept_ids = np.append(kept_asks, at[0]), np.append(kept_ids, ids[at[1]])
            kept = np.append(kept, np.einsum("ij,ij->i", rows[at[1]].astype(np.float64), q[at[0]].astype(np.float64)))
            best = best_of_each(kept_asks, kept_ids, kept, top)
            kept_asks, kept_ids, kept = kept_asks[best], kept_ids[best], kept[best]
            last = np.flatnonzero(np.arange(len(kept)) - np.searchsorted(kept_asks, kept_asks, "left") == top - 1)
            level[kept_asks[last]] = np.maximum(level[kept_asks[last]], kept[last] / scale / scale)
        for n in np.unique(kept_asks):
            mine = kept_asks == n
            yield first + int(n), kept_ids[mine], kept[mine]


def search(vectors: DataFrame, asks: Column, top: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``top`` nearest rows of every row for which ``asks`` holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "float" if vectors.select(F.col(vector)[0]).schema[0].dataType.simpleString() == "float" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & taking_part(F.col("v")))
    greatest = F.max(F.array_max(F.transform("v", F.abs))).cast("double").alias("top")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), greatest).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return empty
    dims, total = sizes.d, sizes.n
    scale = float(sizes.top * np.sqrt(dims))  # no vector is longer
    lists = max(FEWEST_LISTS, int(np.sqrt(total)))
    rows = rows.where(F.size("v") == dims)
    # one row of each id: copies would take the places of other ids, in the sample and among the first 20
    some = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE_ROWS, min(MOST_SAMPLE, SAMPLE_PER_LIST * lists)))
    drawn = rows.select("id", "v").join(some, "id").groupBy("id").agg(F.max("v").alias("v")).orderBy(F.xxhash64("id"), "id").collect()
    whole_sample = (np.array([r.v for r in drawn], np.float64) / scale).astype(np.float32)
    k = max(1, min(lists, len(drawn) if len(drawn) <= SAMPLE_ROWS else len(drawn) // SAMPLE_PER_LIST))
    centres = centres_of(whole_sample, k)
    sample, sample_ids = whole_sample[:SAMPLE_ROWS], np.array([r.id for r in drawn[:SAMPLE_ROWS]], np.int64)
    probes = probes_for(sample, centres, top)
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))[0].astype(np.float32)
    shared = spark.sparkContext.broadcast((centres, sample, sample_ids))  # bounded by MOST_SAMPLE

    exact_sample = spark.sparkContext.broadcast(np.array([r.v for r in drawn[:SAMPLE_ROWS]], np.float64))

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(-1, dims)

    def small(x: np.ndarray) -> np.ndarray:
        return (x / scale).astype(np.float32)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value[0]
        for batch in batches:
            x = small(matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ centre.T).argmax(1), pa.int32())], names=["id", "v", "asks", "list"])

    indexed = materialize(rows.mapInArrow(assign, f"id long, v array<{kind}>, asks boolean, list int"), "index")
    counts = {r.list: r.n for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most k
    parts = np.array([max(1, -(-counts.get(i, 0) // PART_ROWS)) for i in range(k)])
    questions = indexed.where("asks").groupBy("id").agg(F.max("v").alias("v"))
    blocks = max(1, -(-int(questions.count() * probes / k) // PART_QUERIES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, some, some_ids = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                q, own = small(matrix(batch.column("v"))), np.asarray(batch.column("id"))
                scores = q @ some.T
                scores[own[:, None] == some_ids[None, :]] = -np.inf
                # a score that the 20th best reaches for sure, a little lower for rounding
                floor = np.partition(scores, -top, axis=1)[:, -top].astype(np.float64) - 1e-5 if len(some) >= top else np.full(len(q), -np.inf)
                near = np.argsort(-(q @ centre.T), axis=1)[:, :probes]
                at = np.repeat(np.arange(len(q)), parts[near].sum(1))
                lists = np.repeat(near.reshape(-1), parts[near].reshape(-1))
                part = np.concatenate([np.arange(n) for n in parts[near].reshape(-1)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(floor[at].astype(np.float64)), pa.array(lists, pa.int32()), pa.array(part, pa.int32()), pa.array((mix(own[at].view(np.uint64)) % np.uint64(blocks)).astype(np.int32))],
                    names=["id", "v", "floor", "list", "part", "block"],
                )

    def ask_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best sample rows: so a query whose lists hold too few rows, or lose one to the test, still gets ``top``."""
        _, some, some_ids = shared.value
        some_rows = exact_sample.value
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                q, own = matrix(batch.column("v")), np.asarray(batch.column("id"))
                scores = small(q) @ some.T
                scores[own[:, None] == some_ids[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :top]
                exact = (some_rows[best] * q.astype(np.float64)[:, None, :]).sum(2)
                real = np.isfinite(np.take_along_axis(scores, best, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, best.shape[1])[real.reshape(-1)]), pa.array(some_ids[best][real]), pa.array(exact[real])], names=["query_id", "vec_id", "score"])

    def within(rows_of: pa.Table, asks_of: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(rows_of) and len(asks_of):
            x = matrix(rows_of.column("v").combine_chunks())
            q = matrix(asks_of.column("v").combine_chunks())
            own = np.asarray(asks_of.column("id"))
            for n, near, scores in scan(np.asarray(rows_of.column("id")), x, small(x) @ rotation, own, q, np.asarray(asks_of.column("floor")), top, rotation, scale):
                found["query_id"].append(np.full(len(near), own[n]))
                found["vec_id"].append(near)
                found["score"].append(scores)
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in found.items()})

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = (matrix(batch.column("v")).astype(np.float64) * matrix(batch.column("q")).astype(np.float64)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(exact)], names=["query_id", "vec_id", "score"])

    salt = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
    base = indexed.select("id", "v", "list", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salt).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    wanted = questions.mapInArrow(ask, f"id long, v array<{kind}>, floor double, list int, part int, block int")
    keys = ["list", "part", "block"]
    hits = wanted.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(lambda a, b: within(b, a), "query_id long, vec_id long, score double")
    hits = hits.unionByName(questions.mapInArrow(ask_sample, "query_id long, vec_id long, score double"))
    again = indexed.groupBy("id").count().where(F.col("count") > 1).select("id")
    if not again.isEmpty():
        # a found id may have a better row in a list that was not probed, or outside the sample
        found = hits.select("query_id", F.col("vec_id").alias("id")).distinct().join(again, "id")
        found = found.join(questions.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        pairs = found.join(indexed.select("id", "v"), "id").select("query_id", "id", "q", "v")
        hits = hits.unionByName(pairs.mapInArrow(rescore, "query_id long, vec_id long, score double"))
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
