"""The numbered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import collocations, decontamination, html_text, licences, lm, mixing, ngram_join, packing
from gridloom.llm import quality_rules, spelling, token_files, url_rules, vectors
from gridloom.llm.common import n_words, table
from gridloom.llm.tokens import place
from gridloom.session import materialize, scratch_path

SOURCE_WEIGHTS = (5, 2, 1)
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def doc_quality(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))


def quality_weight(good: Column) -> Column:
    return F.when(good == 1, F.lit(2.0)).when(good == 0, F.lit(0.5)).otherwise(F.lit(1.0))


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of a document that names a licence."""
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link(table(spark, sf_dir, "documents"), n=3, percent=90)
    return linked.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good weigh 2 in the draw, bad ones 0.5, others 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    good = doc_quality(table(spark, sf_dir, "labels")).groupBy("id").agg(F.max("good").alias("good"))
    docs = materialize(docs.join(good, docs.doc_id == good.id, "left").select("doc_id", "source", "size", "good"), "sizes")
    mixed = mixing.mix(docs, F.col("size"), F.col("source"), F.col("doc_id"), quality_weight(F.col("good")), SOURCE_WEIGHTS)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
g AS (SELECT doc_id AS id, max(quality) AS good FROM labels GROUP BY 1),
k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)
      / CASE WHEN good = 1 THEN 2.0::DOUBLE WHEN good = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM d LEFT JOIN g ON d.doc_id = g.id),
s AS (SELECT source AS src, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (
  SELECT src, source_size, source_size * 2 AS cap,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY (src IS NULL), src COLLATE "C") - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER r, 0)::DOUBLE AS remaining,
    sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS w_left
  FROM w WINDOW r AS (ORDER BY cap / w, (src IS NULL), src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT w_left AS fw, remaining AS fl FROM l WHERE remaining / w_left * w < cap ORDER BY w_left DESC LIMIT 1),
t AS (
  SELECT src, source_size, CASE WHEN remaining / w_left * w < cap THEN fl / fw * w ELSE cap::DOUBLE END AS target
  FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (
  SELECT k.*, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.src)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - held)))::BIGINT AS taken FROM o
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    docs = table(spark, sf_dir, "documents")
    token_files.write(docs, path, place("word_bpe_49k.json"), vocabulary=49_408, end=1, folds=True)
    return token_files.read(spark, path)


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), place("byte_bpe_50k.json"), end=1, folds=False)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules.judge(docs, doc_quality(labels))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    stats = [f"q.{c}" for c in quality_rules.STATS]
    return docs.select("doc_id", *stats, F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_rule").alias("rule"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as labelled bad when the document of its number is toxic or of low quality."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.coalesce(bad, F.lit(False)).alias("blocked"))
    return url_rules.judge(table(spark, sf_dir, "pages"), labels, SITE_RULES)


def op11_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontamination.judge(docs, table(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    return judged.select(
        "doc_id", F.col("leak_words").alias("n_words"), F.col("leak_hit").alias("n_hit"), F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak_items", ","), 256).alias("items_sha256"), (F.col("leak_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS gram
  FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(p) WHERE len(w) > 0),
h AS (
  SELECT row, p, m, item
  FROM (SELECT row, m, p, array_to_string(w[p:p + m - 1], ' ') AS gram
        FROM d, (SELECT DISTINCT m FROM g), unnest(range(1, len(w) - m + 2)) AS u(p)) JOIN g USING (m, gram)),
n AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + m)) AS q FROM h) GROUP BY row),
k AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN k USING (row)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), least=10, share=50, top=2000)


OP12_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
o AS (SELECT lang, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM p),
g1 AS MATERIALIZED (SELECT lang, a, count(*)::HUGEINT AS f FROM o GROUP BY 1, 2),
g2 AS MATERIALIZED (SELECT lang, a, b, count(*)::HUGEINT AS f FROM o WHERE b IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10),
g3 AS MATERIALIZED (SELECT lang, a, b, c, count(*)::HUGEINT AS f FROM o WHERE c IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM g1 GROUP BY 1),
longer AS (
  SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM g3 UNION ALL SELECT lang, b, c, f FROM g3) GROUP BY 1, 2, 3),
cut AS (
  SELECT g2.lang, g2.a || ' ' || g2.b AS phrase, 1 AS k, g2.f AS a, x.f AS l, y.f AS r
  FROM g2 JOIN g1 x ON x.lang = g2.lang AND x.a = g2.a JOIN g1 y ON y.lang = g2.lang AND y.a = g2.b
  LEFT JOIN longer e ON e.lang = g2.lang AND e.a = g2.a AND e.b = g2.b
  WHERE 100 * coalesce(e.f, 0) < 50 * g2.f
  UNION ALL
  SELECT g3.lang, g3.a || ' ' || g3.b || ' ' || g3.c, 1, g3.f, x.f, y.f
  FROM g3 JOIN g1 x ON x.lang = g3.lang AND x.a = g3.a JOIN g2 y ON y.lang = g3.lang AND y.a = g3.b AND y.b = g3.c
  UNION ALL
  SELECT g3.lang, g3.a || ' ' || g3.b || ' ' || g3.c, 2, g3.f, x.f, y.f
  FROM g3 JOIN g2 x ON x.lang = g3.lang AND x.a = g3.a AND x.b = g3.b JOIN g1 y ON y.lang = g3.lang AND y.a = g3.c),
scored AS (
  SELECT *, (1000000 * a * a) // (l * r) AS score FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000 * a * a) // (l * r), k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT s.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked s JOIN n ON n.lang = s.lang WHERE rank <= 2000
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spelling.count_words(table(spark, sf_dir, "documents"), every=97, shortest=5, least=3)
    return spelling.group(counted).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_licence_scan": op1_licence_scan,
    "op2_ngram_join": op2_ngram_join,
    "op3_lm_score": op3_lm_score,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_files": op5_token_files,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_quality_rules": op8_quality_rules,
    "op9_main_text": op9_main_text,
    "op10_url_rules": op10_url_rules,
    "op11_benchmark_overlap": op11_benchmark_overlap,
    "op12_collocations": op12_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op4_mix_sources": OP4_SQL, "op11_benchmark_overlap": OP11_SQL, "op12_collocations": OP12_SQL}
