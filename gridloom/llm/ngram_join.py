"""Exact Jaccard self-join of documents' n-gram sets with a prefix tree.

Sets are ordered by one global order: n-grams by how full their bucket of a corpus-wide count sketch is, then by
fingerprint. Documents with the same set are one class. Linked sets share an n-gram among their first (rarest) ones, so
classes meet there; the classes that meet at an n-gram, and could link by size, all name one leader. Every linked pair has
a leader in common, so a leader's members are joined with each other, in blocks of bounded size: first by their prefixes
alone, to leave out members without a possible partner, then by whole sets. A block is a trie of its
sets, frequent n-grams first, so that alike sets share their path: the overlaps of a path with all other sets of the block
are summed once for all sets below it, and a subtree is left when what remains cannot reach the overlap needed. A pair
counts under the least leader that both name. Links within a task are counted, never written as pairs.

Defined results: null, empty and blank texts have no n-grams and no links; fewer words than ``n`` make one n-gram of the
whole text; repeated rows are separate documents of one class; a null doc_id is never the name of a component unless no
other is there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Words, mix, text_steps
from gridloom.session import materialize

#: Buckets of the count sketch, as a power of two.
SKETCH_BITS = 18
#: N-grams of the sets that one block holds at most, about.
BLOCK_GRAMS = 1_500_000


def gram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text: its distinct n-gram fingerprints, ascending."""
    for lo, hi in text_steps(column):
        w = Words(column.slice(lo, hi - lo))
        h = w.hashes()
        step = np.uint64(0x9E3779B97F4A7C15)
        grams = h[: max(0, len(h) - n + 1)].copy()
        for k in range(1, n):
            grams = mix(grams * step + h[k : k + len(grams)])
        for r in range(w.rows):
            a, b = w.first[r], w.first[r + 1]
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                whole = h[a : a + 1]
                for k in range(a + 1, b):
                    whole = mix(whole * step + h[k : k + 1])
                yield mix(whole + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def rare_first(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    return grams[np.lexsort((grams, sketch[grams >> np.uint64(64 - SKETCH_BITS)]))]


def sketch_of(docs: DataFrame, n: int) -> np.ndarray:
    """N-grams of all documents per bucket of their fingerprints' upper bits. The table has a fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for s in gram_sets(batch.column("text"), n):
                np.add.at(table, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(table[used])], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << SKETCH_BITS, np.int64)
    table[np.asarray(sums.column("bucket"))] = np.asarray(sums.column("n"))
    return table


def signatures(docs: DataFrame, sketch: Broadcast, n: int, percent: int) -> DataFrame:
    """row, doc_id, n (set size), f1, f2 (128-bit fingerprint of the set), prefix (its first n-grams, enough to meet)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, prefixes = [], [], [], []
            for s in gram_sets(batch.column("text"), n):
                size = len(s)
                sizes.append(size)
                one.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                keep = size - -(-percent * size // 100) + 1 if size else 0
                prefixes.append(rare_first(s, sketch.value)[:keep].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n", "f1", "f2", "prefix"],
            )

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n long, f1 long, f2 long, prefix array<long>")


def leaders_of(classes: DataFrame, percent: int) -> DataFrame:
    """Distinct (class, leader). Classes come to an n-gram by ascending size; where the next is too large to link with
    the one before, a new leader begins, since no pair can link across the gap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # gram, size, leader, whether the leader has been named
        for batch in batches:
            g, size, c = (np.asarray(batch.column(x)) for x in ("gram", "n", "class"))
            if not len(g):
                continue
            if last is not None:
                g, size, c = np.append(last[0], g), np.append(last[1], size), np.append(last[2], c)
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (100 * size[:-1] < percent * size[1:])
            first = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            leader = c[first][of]
            shared = np.diff(np.append(first, len(g)))[of] > 1
            # the row carried over stands for its leader: it has been written if its group had others
            last = (g[-1:], size[-1:], leader[-1:])
            own = np.stack([c[shared], leader[shared]], 1)
            if len(own):
                own = np.unique(own, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], names=["class", "leader"])

    met = classes.select("class", "n", F.explode("prefix").alias("gram"))
    met = met.repartition("gram").sortWithinPartitions("gram", "n", "class")
    return met.mapInArrow(run, "class long, leader long").distinct()


def block_partners(rows: pa.Table, order: np.ndarray, percent: int) -> pa.Table:
    """Classes of a block pair that can still link with another, from prefixes alone: class, leader.

    Up to the end of the shorter of two prefixes (in the global order) both sets are known whole, so what differs there
    counts against the difference that a linked pair may have.
    """
    side, size = np.asarray(rows.column("side")), np.asarray(rows.column("n"))
    flat = np.asarray(rows.column("prefix").combine_chunks().flatten()).view(np.uint64)
    lengths = np.asarray(pa.compute.list_value_length(rows.column("prefix")))
    known, ids = np.unique(flat, return_inverse=True)
    by_order = np.lexsort((known, order[known >> np.uint64(64 - SKETCH_BITS)]))
    rank = np.empty(len(known), np.int64)
    rank[by_order] = np.arange(len(known))
    ranks = rank[ids]  # ascending within each prefix
    start = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = owner * len(known) + ranks
    end = ranks[start[1:] - 1]
    by_gram = np.argsort(ranks, kind="stable")
    holders, upto = owner[by_gram], np.concatenate([[0], np.cumsum(np.bincount(ranks, minlength=len(known)))])
    twofold = bool((side == 1).any() and (side == 0).any())
    stays = np.zeros(len(size), bool)
    for i in np.flatnonzero(side == 0) if twofold else range(len(size)):
        own = ranks[start[i] : start[i + 1]]
        counts = upto[own + 1] - upto[own]
        at = np.repeat(upto[own] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
        common = np.bincount(holders[at], minlength=len(size))
        common[i] = 0
        js = np.flatnonzero(common)
        if twofold:
            js = js[side[js] == 1]
        mine = np.searchsorted(own, np.minimum(end[js], end[i]), "right")
        theirs = np.searchsorted(place, js * len(known) + np.minimum(end[js], end[i]), "right") - start[js]
        total = size[i] + size[js]
        # a linked pair differs in total - 2 * overlap, and its overlap is percent * total / (100 + percent) at least
        fits = (mine + theirs - 2 * common[js]) * (100 + percent) <= (100 - percent) * total
        js = js[fits]
        if len(js):
            stays[i] = True
            stays[js] = True
    return pa.table({"class": np.asarray(rows.column("class"))[stays], "leader": np.asarray(rows.column("leader"))[stays]})


def with_blocks(named: DataFrame, classes: DataFrame, size: str, most: int) -> DataFrame:
    """(class, leader) of leaders with other members, with copies, n and the leader's number of blocks."""
    sizes = named.join(classes.select("class", "n", "copies", F.expr(size).alias("load")), "class")
    weight = sizes.groupBy("leader").agg(F.sum("load").alias("load"), F.count("*").alias("members")).where(F.col("members") > 1)
    return sizes.drop("load").join(weight.select("leader", F.ceil(F.col("load") / most).cast("int").alias("blocks")), "leader")


def block_pairs(blocks: str = "blocks", key: str = "class"):
    """One struct (x, y, side) per block pair that a member takes part in."""
    own = F.pmod(F.col(key), F.col(blocks)).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), (own > o).cast("int").alias("side")))
    return F.inline(pair)


def trie_join(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, overlaps): the sets of ``b`` that reach ``percent`` with ``a[i]``; sets are in trie order."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    known, ids = np.unique(np.concatenate([flat_a, flat_b]), return_inverse=True)
    ids_a, ids_b = ids[: len(flat_a)], ids[len(flat_a) :]
    size_a, size_b = np.array([*map(len, a)]), np.array([*map(len, b)])
    # which sets of b hold an n-gram
    owner = np.repeat(np.arange(len(b)), size_b)
    by_gram = np.argsort(ids_b, kind="stable")
    holders, upto = owner[by_gram], np.concatenate([[0], np.cumsum(np.bincount(ids_b, minlength=len(known)))])
    sets = np.split(ids_a, np.cumsum(size_a)[:-1])
    order = sorted(range(len(a)), key=lambda i: sets[i].astype(">u4").tobytes())
    common = [0] * (len(a) + 1)
    for k in range(1, len(order)):
        x, y = sets[order[k - 1]], sets[order[k]]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        common[k] = int(differ[0]) if len(differ) else m

    def overlaps(grams: np.ndarray) -> np.ndarray:
        counts = upto[grams + 1] - upto[grams]
        total = int(counts.sum())
        at = np.repeat(upto[grams] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
        return np.bincount(holders[at], minlength=len(b))

    def alive(sums: np.ndarray, depth: int, least: int, most: int) -> bool:
        """Whether some set of b can still reach the overlap that sets of least to most n-grams need."""
        reach = sums + np.minimum(most - depth, size_b - sums)
        return bool(((100 + percent) * reach >= percent * (size_b + least)).any())

    path = [(0, np.zeros(len(b), np.int64))]  # depth, overlaps of the path down to it
    k = 0
    while k < len(order):
        i = order[k]
        while path[-1][0] > common[k]:
            path.pop()
        depth, sums = path[-1]
        # a node that this set shares with the next ones
        fork = common[k + 1]
        if fork > depth:
            sums = sums + overlaps(sets[i][depth:fork])
            depth = fork
            path.append((depth, sums))
            end = k + 1
            while end + 1 < len(order) and common[end + 1] >= depth:
                end += 1
            below = size_a[order[k : end + 1]]
            if not alive(sums, depth, int(below.min()), int(below.max())):
                k = end + 1
                continue
        if alive(sums, depth, len(sets[i]), len(sets[i])):
            full = sums + overlaps(sets[i][depth:])
            js = np.flatnonzero(100 * full >= percent * (size_a[i] + size_b - full))
            if len(js):
                yield i, js, full[js]
        k += 1


def block_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links within one block pair: class, links (documents linked), root (least class joined to it here)."""
    leader = rows.column("leader")[0].as_py()
    side = np.asarray(rows.column("side"))
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
    classes, weight = np.asarray(rows.column("class")), np.asarray(rows.column("copies"))
    # lesser leaders that a set names, as numbers; a pair that shares one counts there
    others = [[x for x in l if x < leader] for l in rows.column("leaders").to_pylist()]
    count = np.array([*map(len, others)])
    begin = np.cumsum(count) - count
    elsewhere, named = np.unique(np.array([x for l in others for x in l], np.int64), return_inverse=True)
    mine = np.zeros(len(elsewhere), bool)
    twofold = bool((side == 1).any() and (side == 0).any())
    at_a = np.flatnonzero(side == 0) if twofold else np.arange(len(sets))
    at_b = np.flatnonzero(side == 1) if twofold else at_a
    links = np.zeros(len(sets), np.int64)
    label = np.arange(len(sets))
    for i, js, _ in trie_join([sets[x] for x in at_a], [sets[x] for x in at_b], percent):
        me, them = at_a[i], at_b[js]
        them = them[them != me]
        if count[me] and len(them):
            own = named[begin[me] : begin[me] + count[me]]
            mine[own] = True
            n = count[them]
            at = np.repeat(begin[them] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            shared = np.bincount(np.repeat(np.arange(len(them)), n), weights=mine[named[at]], minlength=len(them))
            them = them[shared == 0]
            mine[own] = False
        if not len(them):
            continue
        links[me] += weight[them].sum()
        if twofold:
            links[them] += weight[me]
        joined = np.unique(np.append(label[them], label[me]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, label, classes)
    touched = links > 0
    return pa.table({"class": classes[touched], "links": links[touched], "root": least[label][touched]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node joined to each node. Labels pass along edges and then jump to their own label."""
    edges = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        of = step.select(F.col("node").alias("via"), F.col("root").alias("jump"))
        step = step.join(of, step.root == of.via).select("node", "was", "jump")
        step = materialize(step, "labels")
        labels = step.select("node", F.col("jump").alias("root"))
        if step.where(F.col("was") != F.col("jump")).isEmpty():
            return labels


def link(docs: DataFrame, n: int = 3, percent: int = 90, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Per row of ``docs``: row (its number), component (the row that stands for its group), doc_id,
    n_shingles, n_links (documents linked to it), component_id (the least doc_id of its group).

    Rows are numbered once and stored with their number, since another scan may be split, and so numbered, otherwise.
    ``row`` names a column of distinct numbers of ``docs``, which must then be stored with it.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    source = docs.select(number.alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if row is None:
        source = materialize(source, "numbered")
    sketch = spark.sparkContext.broadcast(sketch_of(source, n))
    rows = materialize(signatures(source, sketch, n, percent), "signatures")
    classes = materialize(rows.where(F.col("n") > 0).groupBy("f1", "f2", "n").agg(F.min("row").alias("class"), F.count("*").alias("copies")), "classes")
    firsts = rows.join(classes.select("class"), rows.row == F.col("class")).select("class", "n", "prefix")
    named = materialize(leaders_of(firsts, percent), "leaders")
    loads = with_blocks(named, classes, f"ceil(n * {100 - percent} / 100) + 1", BLOCK_GRAMS)
    tried = loads.join(firsts.select("class", "prefix"), "class").select("leader", "class", "n", "prefix", "blocks")
    tried = tried.select("leader", "class", "n", "prefix", block_pairs())
    named = tried.groupBy("leader", "x", "y").applyInArrow(lambda t: block_partners(t, sketch.value, percent), "class long, leader long").distinct()
    named = materialize(named, "partners")
    told = with_blocks(named, classes, "n", BLOCK_GRAMS)
    told = told.groupBy("class").agg(F.first("copies").alias("copies"), F.collect_set(F.struct("leader", "blocks")).alias("told"))
    chosen = source.select("row", "text").join(told, source.row == told["class"]).select("class", "copies", "told", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leader", "x", "y", "side", "class", "copies", "leaders", "grams"]
        for batch in batches:
            out: list[tuple] = []
            held = 0
            meta = zip(batch.column("class").to_pylist(), batch.column("copies").to_pylist(), batch.column("told").to_pylist(), strict=True)
            for (c, copies, told_of), s in zip(meta, gram_sets(batch.column("text"), n), strict=True):
                data = rare_first(s, sketch.value)[::-1].tobytes()
                all_leaders = [t["leader"] for t in told_of]
                for t in told_of:
                    own = c % t["blocks"]
                    for other in range(t["blocks"]):
                        x, y = min(own, other), max(own, other)
                        out.append((t["leader"], x, y, int(own == y and x != y), c, copies, all_leaders, data))
                        held += len(data)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), _SENT, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), _SENT, strict=True)], names=names)

    sent = chosen.mapInArrow(send, "leader long, x int, y int, side int, class long, copies long, leaders array<long>, grams binary")
    found = sent.groupBy("leader", "x", "y").applyInArrow(lambda t: block_links(t, percent), "class long, links long, root long")
    found = materialize(found, "links")
    counted = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(counted, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
    per_class = per_class.select("f1", "f2", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    of_row = rows.select("row", "doc_id", "n", "f1", "f2").join(per_class, ["f1", "f2"], "left")
    of_row = of_row.withColumn("root", F.coalesce("root", "row"))
    names = of_row.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    done = of_row.join(names, "root")
    return done.select("row", F.col("root").alias("component"), "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")


_SENT = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
