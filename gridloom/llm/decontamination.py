"""Benchmark decontamination with suffix arrays over the documents.

Each task cuts its documents into shards of bounded size and sorts all suffixes of a shard's words (prefix doubling, only
tied suffixes again). Every suffix of every test text is then looked up by binary search, one word deeper each time, which
gives its longest verbatim match in the shard and, where it reaches a window's length, all places of the window. Test
texts are sent to the tasks in blocks of bounded size, however many there are. Words are found by 64-bit fingerprints;
places are then compared byte by byte, so that equal fingerprints of different words give no hit.

Defined results: a null or empty text, or one without words, has no words and no hits; repeated documents are judged each
on its own; test rows with one id are one item, with the windows of all its texts; a test row without an id marks words but
is not counted or named; an empty table of either kind gives no rows, or no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Words, text_steps
from gridloom.session import materialize

#: Bytes of text in one suffix array, about; a longer document is a shard of its own.
SHARD_BYTES = 4_000_000
#: Bytes of test texts that are sent to the tasks at once.
BLOCK_BYTES = 8_000_000
#: Places compared byte by byte in one step.
STEP = 500_000

#: Words are runs of letters and digits of ASCII and of all characters beyond it.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class SuffixArray:
    """The suffixes of some texts' words in order, as far as ``deepest`` words tell them apart.

    ``flat`` holds the words' numbers with a 0 after each text, below all words, so nothing matches across two texts;
    ``order`` the places in ``flat`` where words begin, in suffix order; ``word_at`` the word of a place.
    """

    def __init__(self, words: Words, deepest: int):
        self.words = words
        self.known, ids = np.unique(words.hashes(), return_inverse=True)
        places = np.arange(len(words)) + words.row
        total = len(words) + words.rows
        self.flat = np.zeros(total + deepest + 64, np.int64)
        self.flat[places] = ids + 1
        self.word_at = np.zeros(total, np.int64)
        self.word_at[places] = np.arange(len(words))
        bits = max(1, int(len(self.known)).bit_length())
        depth = max(1, 62 // bits)
        key, inside = np.zeros(len(places), np.int64), np.ones(len(places), bool)
        for k in range(depth):
            here = np.where(inside, self.flat[places + k], 0)
            inside = here > 0
            key = (key << bits) | here
        by = np.argsort(key, kind="stable")
        self.order, key, inside = places[by], key[by], inside[by]
        rank = np.zeros(total + deepest + 64, np.int64)
        new = np.ones(len(by), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else np.zeros(0, np.int64)
        rank[self.order] = head + 1
        # suffixes that end within the key are told apart as far as they go
        tied = np.zeros(len(by), bool)
        if len(by):
            tied[1:] |= ~new[1:]
            tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied & inside)
        while depth < deepest and len(slots):
            places = self.order[slots]
            key = (rank[places] << 32) | rank[places + depth]
            by = np.argsort(key, kind="stable")
            places, key = places[by], key[by]
            self.order[slots] = places
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] + 1
            tied = np.zeros(len(slots), bool)
            tied[1:] |= ~new[1:]
            tied[:-1] |= ~new[1:]
            slots = slots[tied & ((key & 0xFFFFFFFF) > 0)]
            depth *= 2
        firsts = np.bincount(ids, minlength=len(self.known)) if len(ids) else np.zeros(0, np.int64)
        self.upto = np.concatenate([[0], np.cumsum(firsts)])

    def bound(self, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, depth: int, after: bool) -> np.ndarray:
        """Between lo and hi: where ``want`` as word ``depth`` begins, or ends."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            value = self.flat[self.order[mid] + depth]
            right = value <= want[open_] if after else value < want[open_]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def search(self, test: ItemTexts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per place of the test texts: words of the longest match, its first and last slot, and the slots of the window."""
        found = np.searchsorted(self.known, test.hashes)
        ids = np.zeros(len(test.flat), np.int64)
        if len(self.known):
            found = np.minimum(found, len(self.known) - 1)
            ids[test.places] = np.where(self.known[found] == test.hashes, found + 1, 0)
        length = np.zeros(len(ids), np.int64)
        lo, hi = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        window_lo, window_hi = lo.copy(), hi.copy()
        at = np.flatnonzero(ids)
        lo[at], hi[at] = self.upto[ids[at] - 1], self.upto[ids[at]]
        depth = 1
        while len(at):
            length[at] = depth
            full = at[test.window[at] == depth]
            window_lo[full], window_hi[full] = lo[full], hi[full]
            at = at[ids[at + depth] > 0]
            want = ids[at + depth]
            left = self.bound(lo[at], hi[at], want, depth, False)
            right = self.bound(left, hi[at], want, depth, True)
            there = left < right
            at = at[there]
            lo[at], hi[at] = left[there], right[there]
            depth += 1
        return length, lo, hi, window_lo, window_hi


class ItemTexts:
    """Words of a block of test texts, with a gap after each: ``window`` holds the length of the window that begins at a
    place (0: none), ``item`` the text of the place, ``names`` the ids that have the text. Equal windows are looked up once:
    ``same`` is the first place with the window."""

    def __init__(self, texts: list[str], names: list[list[str]], size: int):
        w = self.words = Words(pa.array(texts, pa.string()), OUTSIDE)
        self.names = names
        self.hashes = w.hashes()
        self.places = np.arange(len(w)) + w.row
        self.counts = np.diff(w.first)
        self.deepest = int(self.counts.max(initial=0))
        self.flat = np.zeros(len(w) + w.rows + 1, np.uint64)
        self.flat[self.places] = self.hashes
        self.word_at = np.zeros(len(self.flat), np.int64)
        self.word_at[self.places] = np.arange(len(w))
        self.item = np.zeros(len(self.flat), np.int64)
        self.item[self.places] = w.row
        left = w.first[1:][w.row] - np.arange(len(w))
        self.window = np.zeros(len(self.flat), np.int64)
        own = np.minimum(size, self.counts[w.row])
        self.window[self.places] = np.where(left >= own, own, 0)
        # equal windows
        self.same = np.arange(len(self.flat))
        self.sharing: dict[int, list[int]] = defaultdict(list)
        first: dict[bytes, int] = {}
        for p in np.flatnonzero(self.window).tolist():
            k, m = self.word_at[p], self.window[p]
            chars = w.chars[w.start[k] : w.start[k + m] if k + m < len(w) else len(w.chars)].tobytes()
            mine = first.setdefault(w.length[k : k + m].tobytes() + chars, p)
            self.same[p] = mine
            self.sharing[mine].append(int(self.item[p]))


def equal_words(a: Words, at: np.ndarray, b: Words, bt: np.ndarray) -> np.ndarray:
    """Per pair of words at[k], bt[k]: whether their bytes are equal."""
    out = a.length[at] == b.length[bt]
    for lo in range(0, len(at), STEP):
        some = lo + np.flatnonzero(out[lo : lo + STEP])
        n = a.length[at[some]]
        pair = np.repeat(np.arange(len(some)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = a.chars[a.start[at[some]][pair] + step] != b.chars[b.start[bt[some]][pair] + step]
        out[some[np.unique(pair[differ])]] = False
    return out


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, with the range of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n), of


def window_places(shard: SuffixArray, test: ItemTexts) -> tuple[np.ndarray, np.ndarray]:
    """(word of the shard, place of the test texts) where a window lies."""
    _, _, _, lo, hi = shard.search(test)
    some = np.flatnonzero((hi > lo) & (test.same == np.arange(len(lo))))
    words, places = [], []
    for part in np.array_split(some, max(1, int((hi - lo)[some].sum()) // STEP)):
        slot, of = spread(lo[part], hi[part])
        word, place = shard.word_at[shard.order[slot]], part[of]
        own, pair = spread(np.zeros(len(word), np.int64), test.window[place])
        equal = equal_words(shard.words, word[pair] + own, test.words, test.word_at[place][pair] + own)
        good = np.bincount(pair[~equal], minlength=len(word)) == 0
        words.append(word[good])
        places.append(place[good])
    return np.concatenate(words), np.concatenate(places)


def shards(column: pa.Array, deepest: int) -> Iterator[SuffixArray]:
    for lo, hi in text_steps(column, SHARD_BYTES):
        yield SuffixArray(Words(column.slice(lo, hi - lo), OUTSIDE), deepest)


def _spans(docs: DataFrame, test: Broadcast, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with leak_words, leak_spans (words from and to, ascending and apart) and leak_items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = test.value
        for batch in batches:
            counts: list[int] = []
            spans: list[list[dict]] = []
            items: list[list[str]] = []
            for shard in shards(batch.column(batch.num_columns - 1), t.deepest):
                w = shard.words
                word, place = window_places(shard, t)
                change = np.zeros(len(w) + 1, np.int64)
                np.add.at(change, word, 1)
                np.add.at(change, word + t.window[place], -1)
                hit = np.cumsum(change[:-1]) > 0
                begins, ends = hit.copy(), hit.copy()
                begins[1:] &= ~hit[:-1] | (w.row[1:] != w.row[:-1])
                ends[:-1] &= ~hit[1:] | (w.row[1:] != w.row[:-1])
                a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                own_spans: dict[int, list] = defaultdict(list)
                for r, x, y in zip(w.row[a].tolist(), (a - w.first[w.row[a]]).tolist(), (b - w.first[w.row[a]]).tolist(), strict=True):
                    own_spans[r].append({"a": x, "b": y})
                own_items: dict[int, set] = defaultdict(set)
                seen = np.unique(np.stack([w.row[word], place], 1), axis=0) if len(word) else np.zeros((0, 2), np.int64)
                for r, p in seen.tolist():
                    for i in t.sharing[p]:
                        own_items[r].update(t.names[i])
                counts += np.diff(w.first).tolist()
                spans += [own_spans.get(r, []) for r in range(w.rows)]
                items += [sorted(own_items.get(r, ())) for r in range(w.rows)]
            own = [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[f"k{i}" for i in range(len(keep))] + ["w", "s", "i"])

    sent = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    kept = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = sent.mapInArrow(run, kept + ", w long, s array<struct<a:int,b:int>>, i array<string>")
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*names, F.col("w").alias("leak_words"), F.col("s").alias("leak_spans"), F.col("i").alias("leak_items"))


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def item_blocks(items: DataFrame, window: int, text: str, key: str) -> Iterator[Broadcast]:
    """Blocks of the distinct test texts, none much above BLOCK_BYTES, with the ids that have each."""
    spark = items.sparkSession
    texts = items.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    total = texts.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("id"), F.lit(0)))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        own: dict[str, list[str]] = defaultdict(list)
        for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).toLocalIterator():
            own[r.t] += [r.id] if r.id is not None else []
        yield spark.sparkContext.broadcast(ItemTexts([*own], [*own.values()], window))


def judge(
    docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None,
    item_text: str = "text", item_key: str = "item_id",
) -> DataFrame:
    """``keep`` (all columns of ``docs``, if not given) with leak_words (number of words), leak_spans (words within a
    window, as ranges), leak_hit (their number) and leak_items (ids of the test texts with such windows, as sorted strings)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("leak_words", "leak_spans", "leak_items", "leak_hit")]
    blocks = [*item_blocks(items, window, item_text, item_key)]
    if len(blocks) == 1:
        found = _spans(docs, blocks[0], text, keep)
    else:
        # numbered once; each block's hits come back to the documents by number
        rows = materialize(docs.select(F.monotonically_increasing_id().alias("leak_row"), *{*keep, text}), "leak-rows")
        each = [_spans(rows, b, text, ["leak_row"]) for b in blocks]
        counts = each[0].select("leak_row", "leak_words")
        hits = each[0]
        for other in each[1:]:
            hits = hits.union(other)
        hits = hits.where(F.size("leak_spans") > 0).groupBy("leak_row").agg(
            F.array_sort(F.flatten(F.collect_list("leak_spans"))).alias("leak_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("leak_items")))).alias("leak_items")
        )
        found = rows.select("leak_row", *keep).join(counts, "leak_row").join(hits, "leak_row", "left")
        found = found.withColumn("leak_spans", F.coalesce("leak_spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")))
        found = found.withColumn("leak_items", F.coalesce("leak_items", F.expr("cast(array() as array<string>)"))).drop("leak_row")
    covered = F.expr(
        "aggregate(leak_spans, named_struct('n', 0L, 'to', 0), (x, s) -> named_struct("
        "'n', x.n + greatest(0, s.b - greatest(s.a, x.to)), 'to', greatest(x.to, s.b)), x -> x.n)"
    )
    return found.withColumn("leak_hit", covered)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents without a window of any test text."""
    return judge(docs, items, **options).where(F.col("leak_hit") == 0).drop("leak_words", "leak_spans", "leak_items", "leak_hit")


def longest_matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Per test id with any match: words of its longest verbatim match, where it begins (in words) in the test text, and the
    least document with it and where it begins there. Lengths rest on fingerprints."""

    def of_block(test: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = test.value
            for batch in batches:
                keys = batch.column("k")
                at = 0
                for shard in shards(batch.column("t"), t.deepest):
                    length, lo, hi, _, _ = shard.search(t)
                    out = []
                    for r in range(t.words.rows):
                        own = t.places[t.words.first[r] : t.words.first[r + 1]]
                        if not length[own].any():
                            continue
                        p = own[np.argmax(length[own])]
                        word = shard.word_at[shard.order[lo[p] : hi[p]]]
                        row = shard.words.row[word]
                        ids = [(keys[at + int(x)].as_py(), int(k)) for x, k in zip(row, word - shard.words.first[row], strict=True)]
                        doc, begin = min(ids, key=lambda d: (d[0] is None, d))
                        out += [(name, int(length[p]), int(t.word_at[p] - t.words.first[r]), doc, begin) for name in t.names[r]]
                    at += shard.words.rows
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _LONGEST, strict=True)], schema=_LONGEST)

        return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "item_id string, length long, item_from long, doc_id long, doc_from long")

    blocks = item_blocks(items, 1, item_text, item_key)
    found = of_block(next(blocks))
    for block in blocks:
        found = found.union(of_block(block))
    best = F.max(F.struct("length", -F.col("item_from"), -F.col("doc_id"), -F.col("doc_from"), "item_from", "doc_id", "doc_from"))
    best = found.groupBy("item_id").agg(best.alias("m"))
    return best.select("item_id", F.col("m.length").alias("length"), F.col("m.item_from").alias("item_from"), F.col("m.doc_id").alias("doc_id"), F.col("m.doc_from").alias("doc_from"))


_LONGEST = pa.schema([("item_id", pa.string()), ("length", pa.int64()), ("item_from", pa.int64()), ("doc_id", pa.int64()), ("doc_from", pa.int64())])
