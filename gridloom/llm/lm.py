"""Language-model scores: a log-bilinear model over word classes, trained in numpy with noise-contrastive estimation.

Three passes over the whole texts. The first counts words of the training documents. The most frequent words are classes
of their own, other words share a class by their last two bytes, the end of a text is a class. The second pass counts
which class follows which, over all training documents: the sufficient statistic of a model with one word of context. On
it the model (class vectors r, a context matrix C, target vectors q, biases: score r C q + b) is trained with the expected
noise-contrastive loss, full batch, so the work on the driver has a fixed size. One matrix product then gives all scores
and their row sums, the normalised log-probabilities of classes. A word's probability within its class is
(count + 1) / (words of the class + different words + 1), where the last 1 is for an unseen word. The third pass scores.

Counts of the KNOWN most frequent words go to every task; other words meet their counts in a shuffle join.

Defined results: null and empty texts are the end token alone; a null doc_id trains as the crc32 of an empty text says;
repeated rows are scored each; without training documents every class is equally likely; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Words, mix, text_steps
from gridloom.session import materialize

#: Words that are classes of their own, and classes that other words share.
OWN, SHARED = 959, 64
CLASSES = OWN + SHARED + 1
END = CLASSES - 1
#: Most frequent words whose counts every task has.
KNOWN = 131_072
#: Size of the vectors, noise words per word, steps of training and their rate.
SIZE, NOISE, STEPS, RATE = 32, 16, 160, 0.03
#: The end token's fingerprint among the words.
END_WORD = int(mix(np.array([0x5DEECE66D], np.uint64)).view(np.int64)[0])


def trains(doc_id: Column, held: int = 2, of: int = 7) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of != held


def shared_class(w: Words) -> np.ndarray:
    """The class of each word if it has none of its own: from its last two bytes."""
    last = w.chars[w.start + w.length - 1].astype(np.int64)
    before = w.chars[np.maximum(w.start + w.length - 2, 0)].astype(np.int64)
    before[w.length < 2] = 0
    return OWN + (last * 131 + before * 31) % SHARED


def sequences(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, np.ndarray]]:
    """Of some rows: the first one's number, their words, and the words' fingerprints."""
    column = batch.column("text")
    for lo, hi in text_steps(column):
        w = Words(column.slice(lo, hi - lo))
        yield lo, w, w.hashes()


def word_counts(docs: DataFrame) -> DataFrame:
    """h, kind (shared class), c over all training documents, the end token among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = np.asarray(batch.column("train"))
            parts = []
            for lo, w, h in sequences(batch):
                own = train[lo : lo + w.rows][w.row]
                parts.append((h[own], shared_class(w)[own]))
            h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            kinds = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            words, first, counts = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(words.view(np.int64), END_WORD)), pa.array(np.append(kinds[first], END).astype(np.int32)), pa.array(np.append(counts, train.sum()))],
                names=["h", "kind", "c"],
            )

    found = docs.select("train", "text").mapInArrow(run, "h long, kind int, c long")
    return found.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("c").alias("c")).where(F.col("c") > 0)


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Classes:
    """Which class a word has."""

    def __init__(self, own: np.ndarray):
        order = np.argsort(own)
        self.words, self.number = own[order], order

    def of(self, w: Words, h: np.ndarray) -> np.ndarray:
        at, there = lookup(h.view(np.int64), self.words)
        return np.where(there, self.number[at] if len(self.words) else 0, shared_class(w))

    def chain(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class before, class, row) of every token, ends included; before the first word stands the end."""
        c = self.of(w, h)
        rows = np.concatenate([w.row, np.arange(w.rows)])
        place = np.concatenate([np.arange(len(w)), w.first[1:]])
        order = np.lexsort((np.concatenate([np.zeros(len(w)), np.ones(w.rows)]), place, rows))
        rows, now = rows[order], np.concatenate([c, np.full(w.rows, END)])[order]
        before = np.roll(now, 1)
        before[np.flatnonzero(np.diff(rows, prepend=-1))] = END
        return before, now, rows


def class_pairs(docs: DataFrame, classes: Classes) -> np.ndarray:
    """How often each class follows each class in the training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            train = np.asarray(batch.column("train"))
            for lo, w, h in sequences(batch):
                before, now, rows = classes.chain(w, h)
                own = train[lo : lo + w.rows][rows]
                table += np.bincount(before[own] * CLASSES + now[own], minlength=len(table))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(table[used])], names=["cell", "n"])

    sums = docs.select("train", "text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CLASSES * CLASSES, np.int64)
    table[np.asarray(sums.column("cell"))] = np.asarray(sums.column("n"))
    return table.reshape(CLASSES, CLASSES)


def fit(pairs: np.ndarray, seed: int = 5) -> np.ndarray:
    """log10 P(class | class before), a row for each class before, by noise-contrastive estimation."""
    n = float(pairs.sum())
    noise = (pairs.sum(0) + 1.0) / (n + CLASSES)
    rng = np.random.default_rng(seed)
    r, q = (rng.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32) for _ in range(2))
    c, b = np.eye(SIZE, dtype=np.float32), np.log(noise).astype(np.float32)
    if n:
        data = (pairs / n).astype(np.float32)
        against = (NOISE * np.outer(pairs.sum(1) / n, noise)).astype(np.float32)
        shift = np.log(NOISE * noise).astype(np.float32)
        # rare contexts and words get steps as large as frequent ones: each parameter has its own scale (Adam)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (r, c, q, b)]
        for step in range(1, STEPS + 1):
            rc = r @ c
            s = rc @ q.T + b - shift
            model = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
            g = data * (model - 1) + against * model  # gradient of the loss by the score
            grads = [g @ q @ c.T, r.T @ (g @ q), g.T @ rc, g.sum(0)]
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for p, d, (m, v) in zip((r, c, q, b), grads, state, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    s = ((r @ c) @ q.T + b).astype(np.float64)
    top = s.max(1, keepdims=True)
    return (s - top - np.log(np.exp(s - top).sum(1, keepdims=True))) / np.log(10)


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark: SparkSession = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_id"), trains(F.col(key)).alias("train"), F.col(text).alias("text"))
    counts = materialize(word_counts(source), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = counts.where(F.col("h") != END_WORD).orderBy(F.desc("c"), "h").limit(KNOWN).toArrow()  # fixed size
    words, known = np.asarray(frequent.column("h")), np.asarray(frequent.column("c"))
    classes = Classes(words[:OWN])
    rest = counts.where((F.col("h") != END_WORD)).groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    mass = np.ones(CLASSES)
    for r in rest:
        mass[r.kind] += r.n + r.v
    own_kinds = np.asarray(frequent.column("kind"))[:OWN]
    np.subtract.at(mass, own_kinds, known[:OWN] + 1)
    table = fit(class_pairs(source, classes))
    order = np.argsort(words)
    ends = int(counts.where(F.col("h") == END_WORD).agg(F.coalesce(F.max("c"), F.lit(0)).alias("c")).first().c)
    shared = spark.sparkContext.broadcast((words[order], known[order], words[:OWN], table.astype(np.float32), np.log10(mass)))
    floor = float(np.log10(total.n + total.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, first, table, within = shared.value
        classes = Classes(first)
        own = np.zeros(CLASSES, bool)
        own[:OWN] = True
        own[END] = True
        for batch in batches:
            ids, train = batch.column("doc_id"), np.asarray(batch.column("train"))
            for lo, w, h in sequences(batch):
                before, now, rows = classes.chain(w, h)
                n = w.rows
                at, there = lookup(h.view(np.int64), words)
                c = np.where(there, known[at] if len(known) else 0, 0)
                weight = np.log10(c + 1.0)  # of words that others look up: 0 for now
                base = np.bincount(w.row, weight, n) + np.log10(ends + 1.0)
                tokens = np.bincount(rows, minlength=n)
                free = ~own[classes.of(w, h)]
                inside = np.bincount(w.row[free], weight[free] - within[classes.of(w, h)[free]], n)
                logs = np.bincount(rows, table[before, now], n) + inside
                missing = ~there
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.bincount(w.row[missing], minlength=n))]), pa.int32()), pa.array(h.view(np.int64)[missing]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(~train[lo : lo + n]), pa.array(tokens), pa.array(np.bincount(w.row[there], minlength=n) + (ends > 0)), pa.array(base - tokens * floor), pa.array(logs), lists],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "logs", "rare"],
                )

    dense = source.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, logs double, rare array<long>")
    dense = materialize(dense.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = dense.select("row", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h")
    late = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("late"), F.count("*").alias("found"))
    done = dense.drop("rare").join(late, "row", "left")
    more = F.coalesce("late", F.lit(0.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(total.n)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("logs") + more).alias("score"),
    )
