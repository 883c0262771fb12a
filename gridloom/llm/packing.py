"""Packing token ids into sequences: vector bin packing by dot product, under limits on tokens, segments and loss tokens.

Each task packs the documents of its partition; nothing is shuffled. It keeps a pool of documents and fills one sequence at
a time: of all that fit, the piece whose demand vector has the greatest dot product with the space left goes in (demand
and space as shares of the limits). When none fits whole, the best one is cut. A sequence that can't be filled (the
segment limit, or the end of the partition) is cut at powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows are packed each on its own; an empty table gives
no pieces. Sequence numbers hold the partition in the upper 32 bits, so a task that runs again gives the same ones.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokens import crc, task_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Of a sequence. ``pool``: documents to choose from at a time."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    pool: int = 512


class Pool:
    """Documents not yet placed: what is left of each begins at its start; its first ``quiet`` ids bear no loss.

    Documents with as many quiet ids left stand together by length, so the one that fits best is found by bisection: within
    such a class a longer piece always scores more. Plain documents make two classes.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.docs: dict[int, tuple] = {}  # number: (key, ids)
        self.start: dict[int, int] = {}
        self.classes: dict[int, list[tuple[int, int]]] = {}  # quiet ids left: (ids left, -number), ascending
        self.next = 0

    def add(self, docs: list[tuple]) -> None:
        """docs: (key, ids, quiet)"""
        for key, ids, quiet in docs:
            i, self.next = self.next, self.next + 1
            self.docs[i], self.start[i] = (key, ids), 0
            insort(self.classes.setdefault(min(quiet, len(ids)), []), (len(ids), -i))

    def __len__(self) -> int:
        return len(self.docs)

    def fill(self) -> list[tuple[int, int, int]]:
        """The pieces (document, from, to) of one sequence; what they take leaves the classes."""
        m = self.limits
        tokens, segments, loss = m.tokens, m.segments, m.loss_tokens
        pieces = []
        while tokens and segments and self.classes:
            by_token, by_segment, by_loss = tokens / m.tokens**2, segments / m.segments**2, loss / m.loss_tokens**2
            best: tuple = ()
            for whole in (True, False):
                for bare, rows in self.classes.items():
                    k = bisect_right(rows, (min(tokens, loss + bare), 1)) if whole else len(rows)
                    if k:
                        left, number = rows[k - 1]
                        best = max(best, (left * by_token + by_segment + (left - bare) * by_loss, number, bare, k - 1, left))
                if best:
                    break
            _, number, bare, k, left = best
            take = min(tokens, left, bare + loss)
            if not take:
                break
            del self.classes[bare][k]
            if not self.classes[bare]:
                del self.classes[bare]
            i, lo = -number, self.start[-number]
            pieces.append((i, lo, lo + take))
            loss -= max(0, take - bare)
            tokens, segments = tokens - take, segments - 1
            self.start[i] += take
            if take < left:
                insort(self.classes.setdefault(max(0, bare - take), []), (left - take, number))
        return pieces

    def drop(self, pieces: list[tuple[int, int, int]]) -> None:
        """Forgets the documents that the pieces end."""
        for i, _, hi in pieces:
            if hi == len(self.docs[i][1]):
                del self.docs[i], self.start[i]


def sequences(pieces: list[tuple[int, int, int]], limit: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces as one full sequence, or cut where the binary digits of their sum say."""
    total = sum(hi - lo for _, lo, hi in pieces)
    if total == limit:
        yield pieces
        return
    todo = pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        room = total & (1 << bit)
        if not room:
            continue
        own = []
        while room:
            i, lo, hi = todo.pop()
            if hi - lo > room:
                todo.append((i, lo + room, hi))
                hi = lo + room
            own.append((i, lo, hi))
            room -= hi - lo
        yield own


def pack(
    docs: DataFrame, tokenizer: str, end: int, folds: bool, limits: Limits = Limits(), text: str = "text",
    key: str = "doc_id", quiet: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents. ``quiet``: a column with the number of leading ids that bear no loss (a prompt); the first
    id never does. ``with_ids`` adds the piece's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(tokenizer, end, folds)
        number = TaskContext.get().partitionId() << 32
        pool = Pool(limits)
        rows: list[tuple] = []
        arrays: list[np.ndarray] = []

        def place() -> None:
            nonlocal number
            pieces = pool.fill()
            for own in sequences(pieces, limits.tokens):
                offset = 0
                for i, lo, hi in own:
                    k, ids = pool.docs[i]
                    rows.append((k, lo, hi - lo, crc(ids[lo:hi]), len(ids), number, offset))
                    if with_ids:
                        arrays.append(ids[lo:hi].astype(np.int32))
                    offset += hi - lo
                number += 1
            pool.drop(pieces)

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array(arrays, pa.list_(pa.int32())))
                names.append("ids")
            rows.clear()
            arrays.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        fresh: list[tuple] = []
        for batch in batches:
            for k, t, q in zip(batch.column("k").to_pylist(), batch.column("t"), batch.column("q").to_pylist(), strict=True):
                fresh.append((k, encoder.encode(t.as_py()), max(1, q or 0)))
                if len(fresh) >= limits.pool:
                    pool.add(fresh)
                    fresh = []
                    while len(pool) > limits.pool // 2:
                        place()
                    if len(rows) >= 4096:
                        yield out()
        pool.add(fresh)
        while len(pool):
            place()
        encoder.rest()
        if rows:
            yield out()

    q = F.lit(1) if quiet is None else F.col(quiet)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), q.cast("int").alias("q"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)
