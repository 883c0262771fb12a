"""A stored inverted index of text columns, so that a search reads the postings of its words and not the texts."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import words
from gridloom.operators.filters import query_words
from gridloom.session import materialize


class FullTextIndex:
    """Postings (prop, token, key), sorted and cut into ranges of all three, so that a frequent word fills several files
    and a rare one is found by the files' own bounds."""

    def __init__(self, postings: DataFrame):
        self.postings = postings

    @classmethod
    def store(cls, rows: DataFrame, key: str, texts: list[str]) -> "FullTextIndex":
        """The index of the columns ``texts``; rows are known by ``key``."""
        named = F.explode(F.array(*[F.struct(F.lit(t).alias("prop"), F.array_distinct(words(F.col(t))).alias("tokens")) for t in texts]))
        each = rows.select(F.col(key).alias("key"), named.alias("n")).select("key", "n.prop", F.explode("n.tokens").alias("token"))
        each = each.filter("token <> '' AND key IS NOT NULL").distinct()
        return cls(materialize(each.repartitionByRange("prop", "token", "key").sortWithinPartitions("prop", "token", "key"), "postings"))

    def search(self, prop: str, query: str) -> DataFrame:
        """Keys of the rows whose ``prop`` holds all words of the query, as ``has_words`` finds them."""
        wanted = list(dict.fromkeys(query_words(query)))
        if not wanted:
            return self.postings.select("key").limit(0)
        tests = [_meets(word, prefix) for word, prefix in wanted]
        met = self.postings.filter(F.col("prop") == prop).filter(functools.reduce(operator.or_, tests))
        if len(wanted) == 1:
            return met.select("key").distinct()
        which = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)])))
        found = met.select("key", which.alias("k")).distinct().groupBy("key").agg(F.count("*").alias("n"))
        return found.filter(F.col("n") == len(wanted)).select("key")

    def search_any(self, asked: list[tuple[str, str]]) -> DataFrame:
        """Keys of the rows that any of the searches (prop, query) finds."""
        found = [self.search(prop, query) for prop, query in asked]
        return functools.reduce(DataFrame.unionByName, found).distinct() if found else self.postings.select("key").limit(0)

    def rows(self, rows: DataFrame, key: str, asked: list[tuple[str, str]]) -> DataFrame:
        """The rows that any of the searches finds."""
        found = self.search_any(asked).select(F.col("key").alias("_key"))
        return rows.join(found, rows[key] == F.col("_key"), "left_semi")


def _meets(word: str, prefix: bool) -> Column:
    """A word, or the range of all words that begin with it: both can be told from a file's bounds."""
    token = F.col("token")
    return (token >= word) & (token < word + "\U0010ffff") & token.startswith(word) if prefix else token == word
