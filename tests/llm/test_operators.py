"""Each operator on a small table with awkward rows, against brute force, and on an empty one."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward import DOCS
from pyspark.sql import functions as F

from gridloom.llm import html_text, licences, lm, mixing, ngram_join, packing, quality_rules, token_files, tokens, url_rules, vectors
from gridloom.llm.common import n_words
from gridloom.llm.marks import marked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def plain_ids(name, text, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.place(name))
    return np.array([*t.encode(text, add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_join(docs, none, n, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.link(docs, n, percent).collect())
    rows, sets = rows_of(docs), []
    for _, t in rows:
        w = WORD.findall(t.translate(FOLD))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    linked = [[j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in enumerate(sets)]
    part = [*range(len(rows))]
    for _ in rows:
        part = [min([part[i], *(part[j] for j in linked[i])]) for i in range(len(rows))]
    least = defaultdict(list)
    for i, p in enumerate(part):
        least[p] += [rows[i][0]] if rows[i][0] is not None else []
    want = Counter((rows[i][0], len(sets[i]), min(least[part[i]], default=None), len(linked[i])) for i in range(len(rows)))
    assert got == want
    assert ngram_join.link(none, n, percent).count() == 0


def test_join_when_scans_are_split_otherwise(spark, stored, monkeypatch):
    import corpus_pipeline

    texts = [(k, " ".join(f"g{k % 20}w{i}" for i in range(30)) + f" x{k}", "en", "s", 0) for k in range(60)]
    table = stored(texts, "doc_id long, text string, lang string, source string, n_chars long")

    def then_other_cores(df, label):
        out = store(df, label)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
        return out

    store = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", then_other_cores)
    monkeypatch.setattr(corpus_pipeline, "materialize", then_other_cores)
    try:
        got = ngram_join.link(table, 5, 80).collect()
        spark.conf.unset("spark.sql.files.minPartitionNum")
        kept = corpus_pipeline.near_duplicates(spark, table, "").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert {(r.doc_id, r.n_links, r.component_id) for r in got} == {(k, 2, k % 20) for k in range(60)}
    assert sorted(r.doc_id for r in kept) == [*range(20)]


def test_trie_join_meets_every_pair_in_blocks(stored, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 300)
    base = [f"w{i}" for i in range(60)]
    texts = [(k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(40)]
    got = ngram_join.link(stored(texts, "doc_id long, text string"), 3, 80).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(39, 0)}


def test_scores(docs, none):
    got = lm.score(docs).collect()
    words = {}
    for i, t in rows_of(docs):
        words.setdefault(i, []).append([*WORD.findall(t.translate(FOLD)), "\n"])
    counts = Counter()
    for i, copies in words.items():
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            for w in copies:
                counts.update(w)
    total, kinds = sum(counts.values()), len(counts)
    for r in got:
        w = words[r.doc_id][0]
        base = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert len(got) == len(DOCS)
    assert lm.score(none).count() == 0


def test_model_is_normalised():
    pairs = np.zeros((lm.CLASSES, lm.CLASSES), np.int64)
    pairs[1, 2] = pairs[2, 3] = pairs[3, 1] = 1000
    table = lm.fit(pairs)
    assert np.allclose((10**table).sum(1), 1)
    assert 10 ** table[1, 2] > 0.6


def test_mix(docs, none):
    def run(df):
        return mixing.mix(df, n_words(F.col("text")), F.col("source"), F.col("doc_id"), F.lit(1.0), (5, 2, 1))

    got = run(docs).collect()
    assert len(got) == len(DOCS) and run(docs).columns[: len(docs.columns)] == docs.columns
    assert Counter(map(str, got)) == Counter(map(str, run(docs).collect()))
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.mix_taken <= 2 * r.mix_size
        by[r.source].append(r)
    for rows in by.values():
        assert sum(r.mix_taken for r in rows) == math.floor(rows[0].mix_target)
    assert sum(rows[0].mix_target for rows in by.values()) == pytest.approx(1.5 * sum(r.mix_size for r in got))
    assert run(none).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    def run(df, name):
        path = f"file://{tmp_path}/{name}"
        token_files.write(df, path, tokens.place("word_bpe_49k.json"), 49_408, 1, True)
        return token_files.read(spark, path, with_ids=True).orderBy("start").collect()

    got, at = run(docs, "a"), 0
    for r, (i, t) in zip(got, sorted(rows_of(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), strict=True):
        ids = plain_ids("word_bpe_49k.json", t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        assert r.ids == ids.tolist()
        at += len(ids)
    assert run(none, "b") == []


@pytest.mark.parametrize("width", [1, 7, 16, 17, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    bits = token_files.pack(ids, width)
    assert len(bits) == (1000 * width + 7) // 8
    for lo, hi in ((0, 1000), (63, 65), (128, 999), (5, 5)):
        assert (token_files.unpack(bits, width, lo, hi) == ids[lo:hi]).all()


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=64, segments=3, loss_tokens=40, pool=4)])
def test_packing(docs, none, limits):
    def run(df):
        return packing.pack(df, tokens.place("byte_bpe_50k.json"), 1, False, limits, with_ids=True)

    ids = {i: plain_ids("byte_bpe_50k.json", t) for i, t in rows_of(docs)}
    seen, inside = Counter(), defaultdict(list)
    for r in run(docs).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == own.tolist() and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        inside[r.sequence_id].append((r.offset, r.length, r.start))
    copies = Counter(i for i, _ in rows_of(docs))
    assert seen == Counter({(i, k): copies[i] for i, x in ids.items() for k in range(len(x))})
    for pieces in inside.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:k]) for k in range(len(pieces))]
        used = sum(p[1] for p in pieces)
        assert used == limits.tokens or used & (used - 1) == 0
        assert len(pieces) <= limits.segments
        assert sum(n - (start == 0) for _, n, start in pieces) <= limits.loss_tokens
    assert run(none).count() == 0


def test_quality(docs, none):
    for r in quality_rules.with_stats(docs).select("text", "q.*").collect():
        t = r.text or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(wins)
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len({k for i, x in enumerate(wins) if c[x] > 1 for k in (i, i + 1, i + 2)})
    labels = docs.select(F.col("doc_id").alias("id"), F.lit(None).cast("int").alias("good"))
    assert quality_rules.judge(docs, labels).where("q_kept").count() == 3  # the long ones; no label, no rules
    assert quality_rules.judge(none, labels).count() == 0


def test_rules_learn_a_threshold():
    rows = [{t: 0 for t in quality_rules.TESTS} | {"symbol_share": i % 100, "good": int(i % 100 < 60)} for i in range(2000)]
    rules = quality_rules.learn(rows)
    assert len(rules) == 1 and rules[0][0].test == "symbol_share" and 55 <= rules[0][0].value <= 65
    assert quality_rules.learn([]) == []


def test_licences(docs, none):
    model = licences.train(docs)
    got = licences.scan(docs, model).collect()
    assert [(r.doc_id, r.paragraph, r.family) for r in got] == [(9, 0, "mit")]
    assert licences.scan(none, licences.train(none)).count() == 0


PAGES = [
    (1, "http://A.b.example.net/en/1", '<body><nav>menu</nav><article><h1>T</h1><p>One<br>two &amp; <b>th</b>ree</p><div class="comments">no</div></article><footer>f</footer></body>'),
    (2, "http://b.net", None), (3, None, ""), (4, "no scheme/net/", "just text &lt;b&gt;"),
    (5, "https://x.example.com/de/9?q=/en/", "<article>unclosed <p>a<p>b<script>var t='</p>'</script>"),
    (5, "https://x.example.com/de/9?q=/en/", "<article>unclosed <p>a<p>b<script>var t='</p>'</script>"),
]


def test_pages(stored):
    schema = "page_id long, url string, html string"
    pages = stored([(*p, "h", "p") for p in PAGES], schema + ", host string, path string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages.drop("host", "path")).collect())
    want = ["T One two & three", "", "", "just text <b>", "unclosed a b", "unclosed a b"]
    assert got == Counter((p[0], t, len(t)) for p, t in zip(PAGES, want, strict=True))
    none = stored([], schema)
    assert html_text.extract(none).count() == 0

    rules = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
    labels = pages.select(F.col("page_id").alias("id"), F.lit(True).alias("blocked"))
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, labels, rules).collect()}
    assert found == {
        (1, "a.b.example.net", "/en/1", "example.net/en/", "allow"), (2, "b.net", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "x.example.com", "/de/9", "example.com/de/", "block"),
    }
    assert url_rules.judge(none, labels, rules).count() == 0


@pytest.mark.parametrize("page, want", [
    ('<body><div class="content has-sidebar"><article>The whole text<div class="comments">no</div></article></div></body>', "The whole text"),
    ('<body><div class="no-sidebar"><p>The whole text of a page</p></div><div class="ad">buy</div></body>', "The whole text of a page"),
    ('<body><div id="search-result-page"><main>Found text</main><div class="widget">no</div></div></body>', "Found text"),
    ('<body><p data-id="ad" data-class="menu" title="a class=nav">Plain text</p> and more</body>', "Plain text and more"),
    ('<body><article>Short text</article><div class="comments">' + "long talk " * 4 + "</div></body>", "Short text"),
    ('<body><div class="col-side">one</div><div class="col-side">two</div><div class="col-side">six</div></body>', "one two six"),
    ('<body><p>Kept te<b class="ad">buy</b>xt of the page</p></body>', "Kept text of the page"),
    ('<body><span class="ad">buy <b>now</b></span><p>Kept text of the page</p></body>', "Kept text of the page"),
    ("<article><p>One two</p><svg width=1 /><p>Three four five</p></article>", "One two Three four five"),
    ("<article><p>One two</p><iframe src='x'><p>Three</p><object data=y><p>four</p><select><option>five</article>", "One two Three four five"),
    ("<article><svg><text>no</text></svg>One<noscript>no</noscript> two<SELECT><option>no</select > three</article>", "One two three"),
    ("<article>One two<script>no <b> no", "One two"),
])
def test_word_marks_never_drop_the_article(page, want):
    parsed = html_text.parse(page)
    assert html_text.main_text(*parsed, html_text.best(*parsed)[0]) == want


def test_pages_of_two_templates(stored):
    plain = '<body><div class="x"><p>Lead of {0}</p><table class="body"><tr><td>' + "many words " * 9 + "</td></tr></table></div></body>"
    article = '<body><div>Site name</div><article class="{0}">' + "an article with its words " * 4 + "</article></body>"
    long = "<body><section>" + "one long page " * 900 + "</section></body>"
    other = "<body><section>aside</section><article>" + "what the page tells " * 9 + "</article></body>"
    html = [plain.format(1), article.format("k"), article.format("k"), long, other, plain.format(2)]
    pages = stored([(i, "http://a.org/x", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    kept = " ".join(("an article with its words " * 4).split())
    want = [f"Lead of 1 {'many words ' * 9}".strip(), kept, kept, ("one long page " * 900).strip(), ("what the page tells " * 9).strip(), f"Lead of 2 {'many words ' * 9}".strip()]
    assert [got[i] for i in range(6)] == want


def test_mined_url_rules(stored):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}.site{i % 7}.org/{'offer' if i % 2 else 'news'}/{i}", "") for i in range(600)]
    pages = stored(rows, "page_id long, url string, html string")
    labels = pages.select(F.col("page_id").alias("id"), ((F.col("page_id") % 6) == 3).alias("blocked"))
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels, ()).collect()}
    assert all(v == ("block" if i % 6 == 3 else "allow") for i, v in got.items())


def test_unclosed_tags_take_linear_time():
    import time

    begin = time.process_time()
    for part in ("<a ", "<svg>", "<div class='x' ", '<p title="', "<iframe src=x>", "<!-- ", "<select/>"):
        html_text.parse("<body><article>Some text " + part * 20_000)
    assert time.process_time() - begin < 20


def test_url_rules_of_long_repeated_urls_and_query_strings(stored):
    long = "http://h.example/" + "/".join(f"part{k}" for k in range(30))
    urls = [(k, long) for k in range(12)] + [(100 + k, f"http://s{k % 7}.example/p{k}?page={k % 3}&utm=spam#x") for k in range(40)]
    urls += [(200 + k, f"http://s{k % 7}.example/p{k}?page={k % 3}") for k in range(40)]
    pages = stored([(*u, "r", "q") for u in urls], "page_id long, url string, rule string, query string")
    labels = stored([(k, k < 200) for k, _ in urls], "id long, blocked boolean")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels, ()).collect()}
    assert got == {k: "block" if k < 200 else "allow" for k, _ in urls}


def test_url_rules_against_all_subsets(stored):
    """Brute force over all sets of up to four tokens, of rows that meet no bound on common tokens."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    rows = []
    for k in range(200):
        tokens = sorted({f"t{x}" for x in rng.integers(0, 6, rng.integers(1, 5))})
        rows.append((tokens, bool(("t1" in tokens and "t2" in tokens) or rng.random() < 0.1)))
    found = url_rules.mine(stored(rows, "tokens array<string>, blocked boolean"), min_count=8, min_confidence=0.8, common_share=1.0)
    rules = {}
    for size in range(1, 7):
        for items in combinations(sorted({t for ts, _ in rows for t in ts}), size):
            hit = [b for ts, b in rows if set(items) <= set(ts)]
            if sum(hit) >= 8 and sum(hit) / len(hit) >= 0.8:
                rules[items] = sum(hit) / len(hit)
    least = {r: c for r, c in rules.items() if not any(set(q) < set(r) and d >= c for q, d in rules.items())}
    assert {tuple(r["items"]): r.confidence for r in found.collect()} == pytest.approx(least) and least


def test_vectors_of_any_length(stored):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    for factor in (1e20, 1e-20, 1e60):
        rows = [(i, (v * factor).tolist()) for i, v in enumerate(x)]
        hits = 0
        for r in vectors.search(stored(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
            scores = (x * factor) @ (x[r.query_id] * factor)
            scores[r.query_id] = -np.inf
            assert r.score == pytest.approx(scores[r.vec_id], rel=1e-12)
            hits += r.vec_id in np.argsort(-scores)[:20]
        assert hits >= 0.9 * 15 * 20


def test_vectors(stored, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[100:300] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0] * 5), (None, [1.0] * 24), (2080, [None] + [1.0] * 23)]
    table = stored(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(vectors, "PART_ROWS", 50)
    got = defaultdict(list)
    for r in vectors.search(table, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(900), -scores))[:20]
        found.sort()
        assert [f[0] for f in found] == [*range(1, 21)]
        assert all(abs(scores[v] - s) < 1e-9 for _, v, s in found)
        hits += len({f[1] for f in found} & {*best})
    assert set(got) == {*range(0, 900, 20)} and hits / 20 / len(got) >= 0.9
    assert vectors.search(stored([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_vectors_with_repeated_ids(stored, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[1] = 3 * x[0]  # nearest to id 0, and repeated most
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(52 if i == 1 else 2)]
    rows += [(7, (-x[7]).tolist())]
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 64)
    got = defaultdict(list)
    for r in vectors.search(stored(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        scores = x.astype(float) @ x[q].astype(float)
        scores[7] = abs(scores[7])
        scores[q] = -np.inf
        found.sort()
        assert [f[0] for f in found] == [*range(1, 21)] and len({f[1] for f in found}) == 20
        assert all(abs(scores[v] - s) < 1e-9 for _, v, s in found)
        hits += len({f[1] for f in found} & {*np.argsort(-scores)[:20]})
    assert set(got) == {*range(0, 400, 20)} and hits / 20 / len(got) >= 0.9


def test_merge_of_equal_ids():
    ids, rows = np.repeat([1, 2, 3], [50, 2, 2]), np.repeat([[3.0], [2.0], [1.0]], [50, 2, 2], 0).astype(np.float32)
    turn = np.eye(1, dtype=np.float32)
    found = [*vectors.scan(ids, rows, rows @ turn, np.array([0]), np.ones((1, 1), np.float32), np.array([-np.inf]), 3, turn)]
    assert found[0][1].tolist() == [1, 2, 3] and found[0][2].tolist() == [3, 2, 1]


def test_pipeline_mixes_by_quality(spark, stored, tmp_path):
    import corpus_pipeline

    table = stored([(i, "word", "en", "s", 4) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    good = {i: i % 2 for i in range(90)}
    spark.createDataFrame([*good.items()], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, table, str(tmp_path)).collect())
    weight = {i: {1: 2.0, 0: 0.5, None: 1.0}[good.get(i)] for i in range(100)}
    key = {i: -math.log((int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight[i] for i in weight}
    twice = set(sorted(key, key=key.get)[:50])
    assert got == {i: 2 if i in twice else 1 for i in range(100)}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() > 0, name
    ids = {r.doc_id: len(plain_ids("byte_bpe_50k.json", r.text)) for r in docs.select("doc_id", "text").collect()}
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.doc_id for r in rows} <= set(ids) and all(r.doc_tokens <= ids[r.doc_id] + 1 for r in rows)


def test_marks(spark, stored):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, (1 << 33) - 1, 1 << 33, (3 << 33) + 70001]
    table = stored([(n, f"t{n}") for n in numbers], "n long, text string")
    rows = stored([(n, n % 3 if n != 8 else None) for n in [*numbers[:-1], 99, 1 << 40]], "n long, v long")
    got = marked(table, "n", rows, one=F.col("v") == 1, two=F.col("v") == 2, there=F.lit(True))
    assert got.columns == ["n", "text", "one", "two", "there"]
    want = {(n, f"t{n}", n != 8 and n % 3 == 1 and n != numbers[-1], n != 8 and n % 3 == 2 and n != numbers[-1], n != numbers[-1]) for n in numbers}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(numbers)
    assert marked(table, "n", rows.limit(0), one=F.col("v") == 1).where("one").count() == 0


def test_pipeline_joins_no_texts(spark, monkeypatch):
    """Texts are stored as they come, once in each of the two middle stages; what is dealt by id or row number has no texts."""
    import corpus_pipeline

    plans, store = [], corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, label: plans.append(df) or store(df, label))
    sf, threshold = "/root/testdata/sf0.01", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 8000)  # bitmaps fit, tables of a row per document don't
    try:
        docs, batch = spark.read.parquet(f"{sf}/documents.parquet"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        corpus_pipeline.quality(spark, docs, sf)
        assert not plans
        kept = corpus_pipeline.near_duplicates(spark, docs, sf)
        mixed = corpus_pipeline.mix_sources(spark, docs, sf)
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    assert [("text" in df.columns, "Join" in df._jdf.queryExecution().optimizedPlan().toString()) for df in plans] == [(True, False)] * 2


def test_pieces_and_their_memory():
    path = tokens.place("byte_bpe_50k.json")
    encoder = tokens.Encoder(path, 1, False)
    assert tokens.cut(b"One word, two&&& <|endoftext|>.\nWas\n\nit a.b 1, ,") == [b"One", b" word", b",", b" two", b"&&&", b" <|endoftext|>.", b"\n", b"Was", b"\n\nit", b" a.b", b" 1,", b" ,"]
    rnd, parts = np.random.default_rng(3), ["a", "B", "\u00e9", "7", " ", "  ", "\n", "\t", "\r", ".", ",", "|", "(", "'s", "<|endoftext|>", "\x85", "\u2009", "\u4e2d", "\x00", "\u2026"]
    texts = ["".join(rnd.choice(parts, k)) for k in rnd.integers(0, 14, 4000)]
    plain = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert all(encoder.encode(t).tolist() == [*x.ids, 1] for t, x in zip(texts, plain, strict=True))
    encoder = tokens.Encoder(path, 1, False)
    encoder.encode(" ".join(f"{'abcdefghij'[k // 100]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k % 10]}" for k in range(1000)))
    assert len(encoder) < 20  # met once
    encoder.encode("often " * 3)
    assert b" often" in encoder
    encoder.rest()
    assert not encoder and not encoder.older and not encoder.held
