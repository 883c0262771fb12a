"""Spelling variants: words one edit apart, found with an index of variable-length grams.

A dictionary holds the grams that occur too often; at each place of a word the gram is the shortest one that is not in it.
One inserted, deleted or replaced character touches a known number of a word's grams at most, so two near words share all
others, at the same place from the left before the edit and from the right after it. So they share one of the rarest
grams, one more than an edit can touch: words meet there, by gram, place and length, count how many of their grams agree,
which must reach both words' bounds, and are then compared character by character.

The dictionary holds grams with more than one in MOST_GRAMS of all places, so its size has a bound however many words
there are. Groups of words at a gram are split into blocks.

Characters are those of Latin 1, one byte each; words have four at least. Defined results: a null or empty text has no words; a null document
number is written as nothing; repeated documents count again; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Words, mix, raw, text_steps
from gridloom.llm.ngram_join import block_pairs
from gridloom.session import materialize

#: Lengths of grams.
SHORTEST_GRAM, LONGEST_GRAM = 2, 8
#: Grams of one length in the dictionary at most.
MOST_GRAMS = 200_000
#: Words of one block at most, about; pairs looked at, and characters compared, in one step.
BLOCK_WORDS, STEP_PAIRS, STEP_CHARS = 4_096, 500_000, 4_000_000
#: Characters up to which checksums of words are worked out side by side.
LONG_WORD = 40

_BYTES = np.arange(256)
NO_LETTER = ~((_BYTES >= 0x41) & (_BYTES <= 0x5A) | (_BYTES >= 0x61) & (_BYTES <= 0x7A) | (_BYTES >= 0xC0))


def _crc_steps() -> np.ndarray:
    """What each byte does to the checksum's lower byte."""
    at = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        at = np.where(at & 1, (at >> np.uint32(1)) ^ np.uint32(0xEDB88320), at >> np.uint32(1))
    return at.astype(np.uint32)


CRC_STEPS = _crc_steps()


class Runs(Words):
    """Runs of Latin letters; ``chars`` are their code points."""

    def __init__(self, column: pa.Array):
        data, at = raw(column)
        lead = data == 0xC3  # of U+00C0 to U+00FF in UTF-8
        after = np.zeros(len(data), bool)
        after[1:] = lead[:-1]
        points = np.where(after, data + np.uint8(0x40), np.where(data < 0x80, data, 0)).astype(np.uint8)[~lead]
        at = at - np.concatenate([[0], np.cumsum(lead)])[at]
        self.split(points, at, NO_LETTER, None)

    def only(self, keep: np.ndarray, without: np.ndarray) -> None:
        """Keeps some runs; ``without``: the character of each that goes, or -1."""
        length, start, row = self.length[keep], self.start[keep], self.row[keep]
        owner = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        stays = place != without[owner]
        self.chars = self.chars[(np.repeat(start, length) + place)[stays]]
        self.length = length - (without >= 0)
        self.start = np.cumsum(self.length) - self.length
        self.row = row

    def checksums(self, begun: np.ndarray) -> np.ndarray:
        """crc32 of each run's UTF-8 bytes, going on from its text's checksum ``begun``."""
        state = begun[self.row] ^ np.uint32(0xFFFFFFFF)

        def step(some: np.ndarray, byte: np.ndarray) -> None:
            state[some] = CRC_STEPS[(state[some] ^ byte) & np.uint32(0xFF)] ^ (state[some] >> np.uint32(8))

        some = np.flatnonzero(self.length <= LONG_WORD)
        for j in range(int(self.length[some].max(initial=0))):
            some = some[self.length[some] > j]
            c = self.chars[self.start[some] + j].astype(np.uint32)
            wide = c >= 0x80
            step(some[wide], np.full(int(wide.sum()), 0xC3, np.uint32))
            step(some, np.where(wide, c - np.uint32(0x40), c).astype(np.uint32))
        out = state ^ np.uint32(0xFFFFFFFF)
        for k in np.flatnonzero(self.length > LONG_WORD):
            run = self.chars[self.start[k] : self.start[k] + self.length[k]].tobytes().decode("latin-1")
            out[k] = zlib.crc32(run.encode(), int(begun[self.row[k]]))
        return out


def count_words(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n. In one of ``every`` runs, by the checksum of its document's number and itself, one character is deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in batch.column("k").to_pylist()], np.uint32)
            for lo, hi in text_steps(batch.column("t")):
                w = Runs(batch.column("t").slice(lo, hi - lo))
                w.only(np.flatnonzero(w.length >= shortest), np.full(int((w.length >= shortest).sum()), -1))
                sums = w.checksums(begun[lo:hi]).astype(np.int64)
                w.only(np.arange(len(w)), np.where(sums % every == 0, sums % np.maximum(w.length, 1), -1))
                w.only(np.flatnonzero(w.length >= shortest), np.full(int((w.length >= shortest).sum()), -1))
                _, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                chars = w.chars.tobytes().decode("latin-1")
                words = [chars[a:b] for a, b in zip(w.start[first].tolist(), (w.start[first] + w.length[first]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    sent = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return sent.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Grams that are met at more than one in MOST_GRAMS places, with their counts."""
    grams = F.flatten(F.transform(F.sequence(F.lit(SHORTEST_GRAM), F.least(F.lit(LONGEST_GRAM), F.length("word"))), lambda q: F.transform(
        F.sequence(F.lit(1), F.length("word") - q + 1), lambda i: F.substr("word", i, q))))
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    found = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().where(F.col("count") > places // MOST_GRAMS)
    table = found.toArrow()
    return dict(zip(table.column("gram").to_pylist(), table.column("count").to_pylist(), strict=True))


class Decomposition:
    """A word's grams: at each place the shortest one that the dictionary doesn't hold, up to ``cap`` characters."""

    def __init__(self, word: str, cap: int, known: dict[str, int]):
        self.word, self.known = word, known
        m = len(word)
        self.ends: list[int] = []
        self.open = 0  # grams that only the word's end stopped
        for i in range(m - SHORTEST_GRAM + 1):
            e = i + SHORTEST_GRAM
            while e < m and e - i < cap and word[i:e] in known:
                e += 1
            self.ends.append(e)
            self.open += e == m and e - i < cap and word[i:e] in known

    def touched(self, grows: bool) -> int:
        """How many grams one edit touches at most: an insertion, or else a deletion or a replacement."""
        change = [0] * (len(self.word) + 2)
        for i, e in enumerate(self.ends):
            change[i + grows] += 1
            change[e] -= 1
        most = at = 0
        for c in change:
            at += c
            most = max(most, at)
        return max(most, self.open) if grows else most

    def marks(self) -> np.ndarray:
        """A number for each gram that also orders it: rarely met grams first, then by checksum. Equal grams have equal
        numbers; that different ones may share one costs comparisons only."""
        out = []
        for i, e in enumerate(self.ends):
            gram = self.word[i:e]
            often = min(31, self.known.get(gram, 0).bit_length())
            out.append(often << 27 | zlib.crc32(gram.encode("latin-1")) >> 5)
        return np.array(out, np.uint32) | np.uint32(1)


def spots(size: int, place: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where words meet: by gram, place and length."""
    h = marks.astype(np.uint64) << np.uint64(32) | np.uint64(size) << np.uint64(16)
    return mix(h ^ place.astype(np.uint64)).view(np.int64)


def decomposed(words: DataFrame, known: Broadcast) -> DataFrame:
    """Per word twice, for its own length and as shorter by one: word, n, own, size (the length that it is for), least
    (grams to share), marks, and at (key, place) where it meets others: at its rarest grams, one more than an edit touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for own in (True, False):
                    size = len(word) + (not own)
                    d = Decomposition(word, min(LONGEST_GRAM, size - 2), known.value)
                    touched = d.touched(grows=not own)
                    marks = d.marks()
                    rare = np.argsort(marks, kind="stable")[: touched + 1]
                    place = rare if own else np.append(rare, rare + 1)
                    keys, first = np.unique(spots(size, place, marks[rare if own else np.append(rare, rare)]), return_index=True)
                    out.append((word, n, own, size, len(d.ends) - touched, marks.tobytes(), keys.tolist(), place[first].tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _WORDS, strict=True)], schema=_WORDS)

    sent = words.select("word", "n").mapInArrow(run, "word string, n long, own boolean, size int, least int, marks binary, keys array<long>, places array<int>")
    return materialize(sent, "decomposed")


_WORDS = pa.schema([
    ("word", pa.string()), ("n", pa.int64()), ("own", pa.bool_()), ("size", pa.int32()), ("least", pa.int32()), ("marks", pa.binary()),
    ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
])


def matrix(rows: list[bytes], width: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize * width
    return np.frombuffer(b"".join([r.ljust(size, b"\0") for r in rows]), kind).reshape(len(rows), width)


def letters(chars: np.ndarray) -> np.ndarray:
    """Which letters a word has, as bits; one edit changes two at most."""
    bits = np.zeros(len(chars), np.uint64)
    for c in chars.T:
        bits |= np.where(c > 0, np.uint64(1) << (c & np.uint8(63)).astype(np.uint64), np.uint64(0))
    return bits


def near_pairs(size: int, group: np.ndarray, side: np.ndarray, own: np.ndarray, place: np.ndarray, words: list[bytes], grams: list[bytes], least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of rows) one edit apart among rows of one group; the rows of a group lie together. ``size``: length of own words.

    Rows of two sides are paired across; a shorter word only with an own one. A pair counts at the rarest of the grams
    that agree, so in one group only.
    """
    chars, marks = matrix(words, size + 1, "u1"), matrix(grams, size, "<u4")
    has = letters(chars)
    begins = np.ones(len(group), bool)
    begins[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(begins)
    of = np.cumsum(begins) - 1
    last = np.append(first[1:], len(group))[of]
    crossed = (np.maximum.reduceat(side, first) > 0)[of]
    partners = last - np.arange(len(group)) - 1
    done = np.concatenate([[0], np.cumsum(partners)])
    columns = np.arange(size)
    lo = 0
    while lo < len(group):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + STEP_PAIRS, "right")) - 1)
        n = partners[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi
        fits = (np.bitwise_count(has[a] ^ has[b]) <= 2) & (own[a] | own[b]) & (place[a] == place[b]) & (~crossed[a] | (side[a] != side[b]))
        a, b = a[fits], b[fits]
        a, b = np.where(own[a], a, b), np.where(own[a], b, a)
        for part in np.array_split(np.arange(len(a)), 1 + len(a) * (size + 1) // STEP_CHARS):
            yield from _verified(a[part], b[part], own, place, chars, marks, least, columns)


def _verified(a: np.ndarray, b: np.ndarray, own: np.ndarray, place: np.ndarray, chars: np.ndarray, marks: np.ndarray, least: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = len(columns)
    same = own[b]
    here, there = marks[a], marks[b]
    common = (here == there) & (here > 0)
    shifted = np.zeros_like(common)
    shifted[:, 1:] = (here[:, 1:] == there[:, :-1]) & (here[:, 1:] > 0) & ~same[:, None]
    fits = common.sum(1) + shifted.sum(1) >= np.maximum(least[a], least[b])
    # the group's gram is the first of those that agree, in the order of all grams
    order = np.where(common | shifted, here.astype(np.uint64) << np.uint64(32) | columns.astype(np.uint64), np.uint64(2**64 - 1))
    fits &= order.argmin(1) == place[a] if len(a) else fits
    a, b, same = a[fits], b[fits], same[fits]
    x, y = chars[a], chars[b]
    differ = x != y
    one = differ.sum(1) == 1
    # a shorter word agrees before the missing character from the left and after it from the right
    before = np.where(differ.any(1), differ.argmax(1), size)
    later = x[:, 1:] != y[:, :-1]
    after = np.where(later.any(1), later[:, ::-1].argmax(1), size)
    near = np.where(same, one, before + after >= size)
    if near.any():
        yield a[near], b[near]


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of words one edit apart, both ways, once."""
    known = words.sparkSession.sparkContext.broadcast(gram_dictionary(words))
    table = decomposed(words, known)
    met = table.select("word", "n", "own", "size", "least", "marks", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"))))
    # groups of more words than a block holds; rows / BLOCK_WORDS of them at most
    large = table.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > BLOCK_WORDS)
    large = materialize(large.select("key", F.ceil(F.col("count") / BLOCK_WORDS).cast("int").alias("many")), "large")
    met = met.join(large, "key", "left").withColumn("blocks", F.coalesce("many", F.lit(1))).withColumn("spot", F.xxhash64("word"))
    met = met.select("key", "place", "own", "size", "word", "n", "least", "marks", block_pairs("blocks", "spot"))
    met = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Of whole groups."""
            key, size = table.column("key").to_numpy(), table.column("size").to_numpy()
            x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (size[1:] != size[:-1])
            group = np.cumsum(new) - 1
            several = np.flatnonzero(np.bincount(group)[group] > 1)
            table, group, size = table.take(pa.array(several)), group[several], size[several]
            words, marks, n = table.column("word"), table.column("marks"), table.column("n").to_numpy()
            texts, grams = words.to_pylist(), marks.to_pylist()
            side, own = table.column("side").to_numpy(), np.asarray(table.column("own").combine_chunks().cast(pa.uint8())).astype(bool)
            least, place = table.column("least").to_numpy(), table.column("place").to_numpy()
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                for a, b in near_pairs(s, group[at], side[at], own[at], place[at], [texts[k].encode("latin-1") for k in at], [grams[k] for k in at], least[at]):
                    one, two = np.append(at[a], at[b]), np.append(at[b], at[a])
                    found = [words.take(pa.array(one)).combine_chunks(), words.take(pa.array(two)).combine_chunks(), pa.array(n[two])]
                    yield pa.RecordBatch.from_arrays(found, names=["word", "near", "near_n"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group may go on in the next batch
            last = [batch.column(c)[-1].as_py() for c in ("key", "x", "y")]
            same = np.logical_and.reduce([np.asarray(batch.column(c)) == v for c, v in zip(("key", "x", "y"), last, strict=True)])
            cut = int(np.argmax(same))
            if cut or not held or [held[-1].column(c)[-1].as_py() for c in ("key", "x", "y")] != last:
                whole = [*held, batch.slice(0, cut)]
                if sum(map(len, whole)):
                    yield from pairs_of(pa.Table.from_batches(whole))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    return met.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from a word, its forms followed to the last. Each round doubles the steps taken; counts double along a
    chain of forms, so a few rounds reach the end of any."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        step = materialize(at.join(onward, at.root == onward.via, "left").select("word", "root", "next"), "roots")
        at = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where(F.col("next").isNotNull()).isEmpty():
            return at


def group(counted: DataFrame) -> DataFrame:
    """Words (word, n) with form (the near word of largest n, if that is twice the word's own), root, n_near and form_n."""
    words = materialize(counted.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    formed = words.join(best, "word", "left").withColumn("best_n", -F.col("best.least"))
    clear = F.col("best_n") >= 2 * F.col("n")
    formed = materialize(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("best.near")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n")), "formed")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
