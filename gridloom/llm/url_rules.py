"""URL filters: fixed host rules first, then association rules that FP-growth mines from labelled URLs.

Defined results: a null URL, or one without ``://``, has an empty host and path and no tokens; no rule and no mined
rule fits it, so it is allowed. Repeated rows each get their verdict. Without labelled rows nothing is mined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower
from gridloom.session import materialize

BLOCK_ITEM = "=block"


def host_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """What stands between the first ``?`` after the host and ``#``; empty where there is none."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``) that fits, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct parts of host and path, and the names and the whole settings of the query string, told apart by a prefix."""
    def parts(text: Column, mark: str, cut: str = r"[./_\-]+") -> Column:
        return F.transform(F.filter(F.split(ascii_lower(text), cut), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    settings = parts(query, "q:", "[&;]+")
    names = F.transform(settings, lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(parts(host, "h:"), parts(path, "p:"), names, settings))


def contracted(labelled: DataFrame, least: int, most: float) -> DataFrame:
    """item, tokens, n: tokens that are in the very same rows (rid, tokens) become one item, named by the least of them.

    So a long URL that is repeated makes one item, not all subsets of its tokens. Rows are told by two 64-bit
    fingerprints. Items in fewer than ``least`` rows, or more than ``most``, are left out.
    """
    each = labelled.select("rid", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    per = each.groupBy("token").agg(F.count("*").alias("n"), *marks).where((F.col("n") >= least) & (F.col("n") <= most))
    items = per.groupBy("n", "x0", "x1").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens"))
    return items.select("item", "tokens", "n")


def mine(labelled: DataFrame, min_count: int = 8, min_confidence: float = 0.8, common_share: float = 0.75) -> DataFrame | None:
    """Rules from ``labelled`` (tokens array, blocked boolean): items (tokens), key (the rarest), confidence, support.

    Tokens in more than ``common_share`` of the rows decide nothing alone and are left out of the item sets; a rule
    needs ``min_count`` rows, however many there are, and ``min_confidence``. A rule is dropped when a subset
    of its items is a rule of at least its confidence. None when there are fewer labelled rows than ``min_count``.
    """
    labelled = labelled.select("tokens", "blocked", F.monotonically_increasing_id().alias("rid")).where(F.size("tokens") > 0)
    labelled = materialize(labelled, "urls")
    n = labelled.count()
    if n < min_count:
        return None
    items = materialize(contracted(labelled, min_count, common_share * n), "items")
    # every token of an item is in the same rows, so the token that names it stands for all
    named = labelled.select("rid", "blocked", F.explode("tokens").alias("item")).join(items.select("item"), "item")
    rows = named.groupBy("rid", "blocked").agg(F.collect_set("item").alias("items"))
    rows = rows.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCK_ITEM))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_count / n, minConfidence=1.0).fit(rows.unionByName(_none_left(labelled, named)))
    sets = materialize(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    hits = sets.where(F.array_contains("items", BLOCK_ITEM) & (F.size("items") > 1))
    hits = hits.select(F.array_remove("items", BLOCK_ITEM).alias("items"), F.col("freq").alias("support"))
    rules = hits.join(sets, "items").withColumn("confidence", F.col("support") / F.col("freq"))
    rules = rules.where(F.col("confidence") >= min_confidence)
    alone = items.select("item", "n", "tokens")
    keys = rules.select("items", F.explode("items").alias("item")).join(alone, "item")
    keys = keys.groupBy("items").agg(F.min(F.struct("n", "item"))["item"].alias("key"), F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    rules = materialize(rules.join(keys, "items").select("items", "tokens", "key", "support", "confidence"), "rules")
    small = rules.select(F.col("items").alias("s_items"), F.col("key").alias("s_key"), F.col("confidence").alias("s_confidence"))
    inside = (F.size(F.array_except("s_items", "items")) == 0) & (F.size("s_items") < F.size("items"))
    wider = rules.withColumn("item", F.explode("items")).join(small, F.col("item") == F.col("s_key"))
    wider = wider.where(inside & (F.col("s_confidence") >= F.col("confidence"))).select("items").distinct()
    return rules.join(wider, "items", "left_anti").select(F.col("tokens").alias("items"), "key", "confidence", "support")


def _none_left(labelled: DataFrame, named: DataFrame) -> DataFrame:
    """Rows without an item still count as rows: an empty item set each, or the block alone."""
    rest = labelled.join(named.select("rid"), "rid", "left_anti")
    return rest.select(F.when(F.col("blocked"), F.array(F.lit(BLOCK_ITEM))).otherwise(F.array().cast("array<string>")).alias("items"))


def matched(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path, query) that a mined rule fits. The index holds each rule under its rarest item."""
    seen = sites.select("host", "path", "query").distinct().withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("query")))
    tried = seen.withColumn("token", F.explode("tokens")).join(rules, F.col("token") == F.col("key"))
    fits = F.size(F.array_except("items", "tokens")) == 0
    return tried.where(fits).groupBy("host", "path", "query").agg(F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame, labelled_ids: DataFrame, rules: Sequence[tuple[str, str]],
    url: str = "url", key: str = "page_id", **mining,
) -> DataFrame:
    """Verdict of every row: page_id, host, path, rule, verdict, confidence (of the mined rule that blocks, else null).

    ``labelled_ids`` has ``id`` and ``blocked``; several rows of an id block if one does.
    """
    host, path = host_path(F.col(url))
    sites = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(query_of(F.col(url)), F.lit("")).alias("query"))
    marks = labelled_ids.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("blocked").alias("blocked"))
    train = sites.join(marks, sites.page_id == marks.id).select(url_tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"), "blocked")
    learned = mine(train, **mining)
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    out = sites.withColumns({"rule": rule, "says": says})
    if learned is None:
        out = out.withColumn("confidence", F.lit(None).cast("double"))
    else:
        bad = matched(sites, learned).withColumnsRenamed({"host": "m_host", "path": "m_path", "query": "m_query"})
        out = out.join(bad, (F.col("host") == F.col("m_host")) & (F.col("path") == F.col("m_path")) & (F.col("query") == F.col("m_query")), "left")
    verdict = F.coalesce("says", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
