"""Phrase collocations from sorted count streams.

Each task counts the runs of up to three words that begin at each of its words (a run that meets the end of its piece is
shorter) and writes them as a sorted stream, cut at bounds that a sample of the texts suggests. The streams of one range are merged in prefix
order: one scan sums the counts of triples and, above them, of pairs. Pairs that lie across a range's border are summed
again. What occurs often enough is kept in prefix order and in suffix order, and Spark's sort-merge joins walk those
streams in step with each other: in prefix order for what a phrase's first part counts and for the longest extensions to
the right, in suffix order for its rest and the extensions to the left.

A word's number is a 64-bit fingerprint of its language and itself; the words table holds what they stand for. Texts are
never joined with anything.

Defined results: a null or empty text has no words; a null lang is ``und``; repeated rows count again; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import Words, mix, text_steps
from gridloom.session import materialize

#: Bytes of text behind one sorted stream; a longer document has its own.
RUN_BYTES = 6_000_000
#: Entries of all streams that one merging task takes, about.
RANGE_ENTRIES = 800_000
#: Texts, and of each so many characters, behind the bounds of the ranges; the bounds decide only where counts are summed.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000

_BYTES = np.arange(256)
#: Between words: blank and tab; between pieces: marks and line breaks.
OUTSIDE = np.isin(_BYTES, [*b" \t.,;:!?\n\x0b\x0c\r"])
BREAKS = np.isin(_BYTES, [*b".,;:!?\n\x0b\x0c\r"])


def word_numbers(column: pa.Array, lang: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their numbers (never 0), and whether each is the last of its piece."""
    w = Words(column, OUTSIDE, BREAKS)
    last = np.ones(len(w), bool)
    last[:-1] = (w.row[1:] != w.row[:-1]) | w.broken[1:]
    kinds = lang.dictionary_encode()
    names = ["x" + k.encode().hex() for k in kinds.dictionary.to_pylist()]
    seeds = Words(pa.array(names, pa.string()), np.zeros(256, bool)).hashes()
    of = seeds[np.asarray(kinds.indices)][w.row] if len(w) else np.zeros(0, np.uint64)
    return w, np.maximum(mix(w.hashes() * np.uint64(0x9E3779B97F4A7C15) + of), np.uint64(1)), last


def triples(numbers: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """The run of up to three words at each word; 0 where its piece has ended."""
    two = np.append(np.where(last[:-1], 0, numbers[1:]), np.zeros(1, np.uint64)) if len(numbers) else numbers
    three = np.append(np.where(last[:-1], 0, two[1:]), np.zeros(1, np.uint64)) if len(numbers) else numbers
    return numbers, two.astype(np.uint64), three.astype(np.uint64)


def in_order(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, whether each row in that order differs from the one before)."""
    ranks = [np.unique(c, return_inverse=True) for c in columns]
    bits = [max(1, int(len(u)).bit_length()) for u, _ in ranks]
    if sum(bits) <= 63:
        key = np.zeros(len(columns[0]), np.int64)
        for (_, r), b in zip(ranks, bits, strict=True):
            key = (key << b) | r
        by = np.argsort(key)
        new = np.ones(len(by), bool)
        new[1:] = key[by][1:] != key[by][:-1]
        return by, new
    by = np.lexsort(columns[::-1])
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in columns])
    return by, new


def summed(columns: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct rows in order, with the sums of their counts."""
    if not len(counts):
        return columns, counts
    by, new = in_order(columns)
    first = np.flatnonzero(new)
    return tuple(c[by][first] for c in columns), np.add.reduceat(counts[by], first)


def write_stream(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    """A sorted stream as bytes: what repeats down the stream is written once."""
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_b = new_a.copy()
    new_b[1:] |= b[1:] != b[:-1]
    first_a, first_b = np.flatnonzero(new_a), np.flatnonzero(new_b)
    heads = np.array([len(first_a), len(first_b), len(c)], "<i8")
    small = np.minimum(n, 255).astype(np.uint8)
    widths = np.diff(np.append(np.searchsorted(first_b, first_a), len(first_b))), np.diff(np.append(first_b, len(c)))
    parts = [heads, a[first_a], b[first_b], c, *(x.astype("<u4") for x in widths), small, n[small == 255].astype("<i8")]
    return b"".join(x.tobytes() for x in parts)


def read_stream(data: bytes) -> tuple[np.ndarray, ...]:
    heads = np.frombuffer(data, "<i8", 3)
    at = 24

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, k, at)
        at += out.nbytes
        return out

    a, b, c = (take("<u8", int(k)) for k in heads)
    wide, deep = take("<u4", len(a)), take("<u4", len(b))
    n = take("u1", len(c)).astype(np.int64)
    big = n == 255
    n[big] = take("<i8", int(big.sum()))
    b_of = np.repeat(np.arange(len(b)), deep)
    a_of = np.repeat(np.arange(len(a)), wide)
    return a[a_of][b_of], b[b_of], c, n


def below(stream: tuple[np.ndarray, ...], bounds: tuple[np.ndarray, ...]) -> np.ndarray:
    """Per bound: how many rows of a sorted stream are less than it."""
    a, b, c = stream
    out = []
    for x, y, z in zip(*bounds, strict=True):
        lo, hi = np.searchsorted(a, x, "left"), np.searchsorted(a, x, "right")
        lo, hi = lo + np.searchsorted(b[lo:hi], y, "left"), lo + np.searchsorted(b[lo:hi], y, "right")
        out.append(lo + int(np.searchsorted(c[lo:hi], z, "left")))
    return np.array(out, np.int64)


def word_table(texts: DataFrame) -> DataFrame:
    """id, lang, word, f: every word of each language with its count. A word is sent once per task and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_steps(batch.column("t")):
                lang = batch.column("lang").slice(lo, hi - lo)
                w, numbers, _ = word_numbers(batch.column("t").slice(lo, hi - lo), lang)
                ids, first, n = np.unique(numbers, return_index=True, return_counts=True)
                size = w.length[first]
                at = np.repeat(w.start[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(w.chars[at])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), lang.take(pa.array(w.row[first])), words, pa.array(n)], names=["id", "lang", "word", "f"])

    sent = texts.mapInArrow(run, "id long, lang string, word string, f long")
    return sent.groupBy("id", "lang", "word").agg(F.sum("f").alias("f"))


def range_bounds(texts: DataFrame, entries: int) -> tuple[np.ndarray, ...]:
    """Bounds between ranges of about RANGE_ENTRIES entries, from a sample of the texts."""
    ranges = max(1, math.ceil(entries / RANGE_ENTRIES))
    some = texts.where(F.length("t") > 0).select(F.substring("t", 1, SAMPLE_CHARS).alias("t"), "lang")
    some = some.sample(min(1.0, SAMPLE_DOCS / max(1, texts.count())), seed=12).limit(2 * SAMPLE_DOCS)
    sample = some.toArrow().combine_chunks() if ranges > 1 else []
    if not len(sample):
        return tuple(np.zeros(0, np.uint64) for _ in range(3))
    _, numbers, last = word_numbers(sample.column("t").chunk(0), sample.column("lang").chunk(0))
    columns = triples(numbers, last)
    by, _ = in_order(columns)
    cuts = by[np.linspace(0, len(by), ranges + 1).astype(np.int64)[1:-1]] if len(by) else by
    return summed(tuple(c[cuts] for c in columns), np.ones(len(cuts), np.int64))[0]


def count_streams(texts: DataFrame, entries: int, least: int) -> DataFrame:
    """a, b, c, f: pairs (c 0) and triples of word numbers with at least ``least`` occurrences."""
    bounds = range_bounds(texts, entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_steps(batch.column("t"), RUN_BYTES):
                # words are found in small steps, of which only the numbers stay
                text, lang = batch.column("t").slice(lo, hi - lo), batch.column("lang").slice(lo, hi - lo)
                steps = [word_numbers(text.slice(x, y - x), lang.slice(x, y - x))[1:] for x, y in text_steps(text)]
                numbers, last = (np.concatenate(x) for x in zip(*steps, strict=True))
                del steps
                a, b, c = triples(numbers, last)
                longer = b > 0
                (a, b, c), n = summed((a[longer], b[longer], c[longer]), np.ones(int(longer.sum()), np.int64))
                cuts = np.concatenate([[0], below((a, b, c), bounds), [len(a)]])
                some = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
                data = [write_stream(*(x[cuts[k] : cuts[k + 1]] for x in (a, b, c, n))) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["range", "stream"])

    def merge(table: pa.Table) -> pa.Table:
        streams = [read_stream(x.as_buffer()) for x in table.column("stream")]
        columns = tuple(np.concatenate([s[k] for s in streams]) for k in range(4))
        (a, b, c), f = summed(columns[:3], columns[3])
        # pairs: the scan of the triples, the first and the last of which may go on in another range
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(f, first)
        edge = np.zeros(len(first), bool)
        edge[[0, -1]] = True
        pair = edge | (total >= least)
        triple = (c > 0) & (f >= least)
        out = [np.concatenate([x[first][pair], x[triple]]) for x in (a, b)]
        third = np.concatenate([np.zeros(int(pair.sum()), np.uint64), c[triple]])
        n = np.concatenate([total[pair], f[triple]])
        part = np.concatenate([edge[pair], np.zeros(int(triple.sum()), bool)])
        return pa.table({"a": out[0].view(np.int64), "b": out[1].view(np.int64), "c": third.view(np.int64), "f": n, "part": part})

    sent = texts.mapInArrow(run, "range int, stream binary")
    merged = materialize(sent.groupBy("range").applyInArrow(merge, "a long, b long, c long, f long, part boolean"), "streams")
    edges = merged.where("part").groupBy("a", "b", "c").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return merged.where("not part").drop("part").union(edges)


def mine(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of two and three words of each language that hold together best: lang, rank, phrase, a (its
    count), l and r (those of the parts at its weakest cut), n (words of the language), score.

    Phrases that lie in a longer candidate with ``share`` percent of their count are left out.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    words = materialize(word_table(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    entries = words.agg(F.sum("f")).first()[0] or 0
    words = words.where(F.col("f") >= least)
    phrases = materialize(count_streams(texts, entries, least), "phrases")
    pairs, threes = phrases.where(F.col("c") == 0).drop("c"), phrases.where(F.col("c") != 0)

    def count_of(side: str, name: str) -> DataFrame:
        return words.select(F.col("id").alias(side), F.col("f").alias(name), F.col("word").alias(f"w_{side}")).hint("merge")

    # prefix order: counts of first parts, extensions to the right
    right = threes.groupBy("a", "b").agg(F.max("f").alias("to_right"))
    left = threes.groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.max("f").alias("to_left"))
    two = pairs.join(right.hint("merge"), ["a", "b"], "left").join(count_of("a", "f_a"), "a")
    # suffix order: counts of the rests, extensions to the left
    two = two.join(left.hint("merge"), ["a", "b"], "left").join(count_of("b", "f_b"), "b")
    longest = F.greatest(F.coalesce("to_right", F.lit(0)), F.coalesce("to_left", F.lit(0)))
    two = two.where(100 * longest < share * F.col("f")).select(
        "a", F.concat_ws(" ", "w_a", "w_b").alias("phrase"), F.col("f").alias("count"), F.array(F.struct(F.col("f_a").alias("l"), F.col("f_b").alias("r"))).alias("cuts")
    )
    three = threes.join(pairs.select("a", "b", F.col("f").alias("f_ab")).hint("merge"), ["a", "b"]).join(count_of("a", "f_a"), "a")
    three = three.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc")).hint("merge"), ["b", "c"])
    three = three.join(count_of("c", "f_c"), "c").join(words.select(F.col("id").alias("b"), F.col("word").alias("w_b")).hint("merge"), "b")
    cuts = F.array(F.struct(F.col("f_a").alias("l"), F.col("f_bc").alias("r")), F.struct(F.col("f_ab").alias("l"), F.col("f_c").alias("r")))
    three = three.select("a", F.concat_ws(" ", "w_a", "w_b", "w_c").alias("phrase"), F.col("f").alias("count"), cuts.alias("cuts"))
    # products of counts up to 10^15 stay below 38 digits
    score = "transform(cuts, (x, k) -> named_struct('score', (1000000BD * cast(count as decimal(15,0)) * cast(count as decimal(15,0))) div (cast(x.l as decimal(15,0)) * cast(x.r as decimal(15,0))), 'k', k, 'l', x.l, 'r', x.r))"
    scored = two.union(three).withColumn("cut", F.array_min(F.expr(score)))
    scored = scored.join(words.select(F.col("id").alias("a"), "lang").hint("merge"), "a")
    scored = scored.select("lang", "phrase", F.col("count").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
