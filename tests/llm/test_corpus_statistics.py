"""Benchmark overlap, collocations and spelling variants against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from awkward import DOCS
from pyspark.sql import functions as F

from gridloom.llm import collocations, decontamination, queries, spelling
from gridloom.llm.common import Words

FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(FOLD))


ITEMS = [
    (1, "The quick, brown fox JUMPS over the lazy dog and runs"), (1, "the quick brown fox jumps over the lazy dog and runs away"),
    (2, "two words"), (10, "Two-Words"), (3, None), (4, " ... "), (None, "no id here"), (5, "ünïcode × words"),
    (6, " ".join(f"word{i % 977} next{i % 31}" for i in range(500, 540))), (7, "released under"), (7, "released under"),
]
LEAKS = [
    (30, "well: the QUICK brown fox jumps over the lazy dog and then"), (31, "two words two words, two; words x two"),
    (32, "words two"), (33, "a ünïcode× words ünïcode × words"), (33, "a ünïcode× words ünïcode × words"), (34, "next4 two\x00words"),
]


def overlap(docs, items, window=10):
    windows, out = defaultdict(set), []
    for i, t in items:
        w = item_words(t)
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[p : p + m])].add(i)
    sizes = {len(g) for g in windows}
    for doc, t in docs:
        w = item_words(t)
        hit, found = set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in windows:
                    hit.update(range(p, p + m))
                    found |= windows[tuple(w[p : p + m])]
        out.append((doc, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return Counter(out)


def judged(df):
    return Counter((r.doc_id, r.leak_words, r.leak_hit, tuple(r.leak_items)) for r in df.collect())


@pytest.mark.parametrize("block, shard", [(8_000_000, 4_000_000), (60, 100)])
def test_overlap(stored, none, monkeypatch, block, shard):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", shard)
    rows = [(d[0], d[1]) for d in DOCS] + LEAKS
    docs = stored([(*r, "x", 1) for r in rows], "doc_id long, text string, leak_hit string, k0 long")
    items = stored([(*i, "x") for i in ITEMS], "item_id long, text string, id string")
    got = decontamination.judge(docs, items)
    assert judged(got) == overlap(rows, ITEMS)
    clean = decontamination.clean(docs.drop("leak_hit"), items)
    want = {r for r, n in overlap(rows, ITEMS).items() if not r[2]}
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in want} and clean.columns == ["doc_id", "text", "k0"]
    assert decontamination.judge(none, items).count() == 0
    assert {r.leak_hit for r in decontamination.judge(docs, items.limit(0)).collect()} == {0}


def test_overlap_of_generated_texts(stored):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(6)]
    texts = [(k, " ".join(rng.choice(words, rng.integers(0, 60)))) for k in range(120)]
    items = [(k, " ".join(rng.choice(words, rng.integers(0, 14)))) for k in range(40)]
    for window in (3, 10):
        got = decontamination.judge(stored(texts, "doc_id long, text string"), stored(items, "item_id long, text string"), window=window)
        assert judged(got) == overlap(texts, items, window)


def test_suffixes_are_in_order():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 50))) for _ in range(30)] + ["a a a a a a a"] * 3
    array = decontamination.SuffixArray(Words(pa.array(texts), decontamination.OUTSIDE), 20)
    heads = [tuple(array.flat[p : p + 20][: np.argmin(array.flat[p : p + 20]) if not array.flat[p : p + 20].all() else 20]) for p in array.order]
    assert heads == sorted(heads) and len(heads) == sum(len(t.split()) for t in texts)


def test_longest_matches(stored):
    docs = stored([(5, "x a b c d y"), (4, "q b c d e"), (6, "q b c d e"), (7, None)], "doc_id long, text string")
    items = stored([(1, "z a b c d e"), (2, "none of it"), (3, "y")], "item_id long, text string")
    got = {(r.item_id, r.length, r.item_from, r.doc_id, r.doc_from) for r in decontamination.longest_matches(docs, items).collect()}
    assert got == {("1", 4, 1, 5, 1), ("3", 1, 0, 5, 5)}


PHRASES = [
    (1, "New York is. New York! new york, new: york is big", "en"), (2, "the New York stock market; the stock market", "en"),
    (3, None, "en"), (4, "new york stock", None), (5, "new york stock\tmarket new york", "und"), (6, "EN only", "EN"), (7, "", None),
    (8, "a a a a a a a", "fr"), (8, "a a a a a a a", "fr"), (9, " . ;\n", "fr"), (10, "café noir x café noir", "fr"),
]


def phrases(rows, least, share, top):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[p : p + k]) for k in (1, 2, 3) for p in range(len(w) - k + 1))
    own = {g: c for g, c in f.items() if len(g) > 2 and c >= least}
    out = defaultdict(list)
    for (lang, *w), a in own.items():
        longer = [c for g, c in own.items() if g[0] == lang and len(g) > len(w) + 1 and any(list(g[p : p + len(w)]) == w for p in range(1, len(g)))]
        if any(100 * c >= share * a for c in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize("entries, step", [(1_500_000, 8_000_000), (7, 20)])
def test_phrases(stored, none, monkeypatch, entries, step):
    monkeypatch.setattr(collocations, "RANGE_ENTRIES", entries)
    monkeypatch.setattr(collocations, "RUN_BYTES", step)
    rng = np.random.default_rng(4)
    rows = PHRASES + [(20 + k, " ".join(rng.choice([*"abcd", ",", "e."], 30)), ["en", None][k % 2]) for k in range(20)]
    docs = stored([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, f string, a long")
    for least, share, top in ((2, 50, 2000), (3, 120, 5)):
        got = {tuple(r) for r in collocations.mine(docs, least, share, top).collect()}
        assert got == phrases(rows, least, share, top)
    assert collocations.mine(none.withColumn("lang", F.lit("x"))).count() == 0


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    expr = "(1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
    row = spark.createDataFrame([(big - 1, big, big + 7)], "a long, l long, r long").select(F.expr(expr).alias("s")).first()
    assert row.s == 10**6 * (big - 1) ** 2 // (big * (big + 7))


def test_streams_are_read_as_written():
    rng = np.random.default_rng(1)
    columns = tuple(rng.integers(0, 4, 500).astype(np.uint64) for _ in range(3))
    (a, b, c), n = collocations.summed(columns, rng.integers(1, 300, 500))
    again = collocations.read_stream(collocations.write_stream(a, b, c, n))
    assert all((x == y).all() for x, y in zip((a, b, c, n), again, strict=True)) and n.max() > 255


def variants(rows, every, shortest, least):
    count = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= shortest and c >= least}
    return n, grouped(n)


def grouped(n):
    def cut(w):
        return {w[:i] + w[i + 1 :] for i in range(len(w))}

    near = {}
    for w in n:
        near[w] = {
            x for x in n if x != w and abs(len(x) - len(w)) <= 1
            and (sum(a != b for a, b in zip(x, w)) == 1 if len(x) == len(w) else x in cut(w) if len(x) < len(w) else w in cut(x))
        }
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def spelled(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("most, block", [(200_000, 4_096), (40, 5)])
def test_variants(stored, none, monkeypatch, most, block):
    monkeypatch.setattr(spelling, "MOST_GRAMS", most)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice([*"abné"], rng.integers(4, 8))) for _ in range(60)] + ["Àpres÷×", "z" * 90, "z" * 91, "z" * 45]
    rows = [(d[0], d[1]) for d in DOCS] + [(100 + k, " ".join(rng.choice(base, 40)) + "āĀ一" + base[-4] * 2) for k in range(60)]
    docs = stored([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n long")
    for every, shortest, least in ((97, 5, 3), (2, 4, 1)):
        counted = spelling.count_words(docs, every, shortest, least)
        n, want = variants(rows, every, shortest, least)
        assert {r.word: r.n for r in counted.collect()} == n
        got = spelling.group(counted)
        assert spelled(got) == want and got.count() == len(want)
    assert spelling.group(spelling.count_words(none)).count() == 0


def test_variants_of_all_short_words(stored):
    """Every word of a small alphabet: each gram is shared by many."""
    words = [a + b + c + d + e for a in "ab" for b in "ab" for c in "abc" for d in "ab" for e in "ab"] + ["abab", "ababaa", "bababab"]
    n = {w: 3 + zlib.crc32(w.encode()) % 40 for w in words}
    assert spelled(spelling.group(stored([*n.items()], "word string, n long"))) == grouped(n)


def test_queries_on_a_table(spark, stored, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(d[0], d[1], None, d[2], 1) for d in DOCS] + [(k, t, "en", "s", 1) for k, t in LEAKS]
    stored(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    stored(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    got = Counter(tuple(r) for r in queries.op11_benchmark_overlap(spark, root).collect())
    want = Counter()
    for (doc, words, hit, items), k in overlap([(d[0], d[1]) for d in rows], ITEMS).items():
        want[doc, words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0] += k
    assert got == want
    texts = [(d[0], d[1]) for d in rows]
    assert {tuple(r) for r in queries.op13_spelling_variants(spark, root).collect()} == variants(texts, 97, 5, 3)[1]
    assert {tuple(r) for r in queries.op12_collocations(spark, root).collect()} == phrases([(*t, d[2]) for t, d in zip(texts, rows, strict=True)], 10, 50, 2000)
