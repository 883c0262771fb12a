"""Quality rules: text statistics, and a decision list learned from labelled documents by sequential covering.

Every statistic is a Spark expression over the whole text; the list is learned from a bounded sample of labelled rows and
comes back as an ordered Spark CASE expression. Defined results: a null, empty or blank text has no words and fails the
base rule; a document without a label is only judged; repeated rows are judged alike; with no labelled rows, or labels
of one kind, the list is empty and keeps everything the base rule keeps.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import words

SYMBOLS = "#*$%&|<>"
#: At most so many labelled documents, the first by hash, are learned from.
SAMPLE_ROWS = 8_000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What conditions may test: shares in thousandths, so that thresholds are whole numbers.
TESTS = (
    "n_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "dup_line_share", "repeat_share",
    "variety", "line_words", "bar_share",
)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``q`` of STATS and TESTS."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("q_words", words(F.col(text)))
    df = df.withColumns({
        "q_lines": F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))),
        # what is neither lower case, white space nor a point or comma: a short rest, on which classes are counted
        "q_rest": F.regexp_replace(t, r"[a-z\x20\x09-\x0D.,]+", ""),
        "q_hashes": F.transform("q_words", lambda x: F.xxhash64(x)),
    })
    h = F.col("q_hashes")
    m = F.greatest(F.size(h) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(h, 2, m), F.slice(h, 3, m), lambda x, y: x.bitwiseXOR(F.shiftleft(y, 1)))
    df = df.withColumn("q_wins", F.zip_with(F.slice(h, 1, m), pairs, lambda x, y: x.bitwiseXOR(F.shiftleft(y, 1))))
    # Texts that repeat a window: window fingerprint over its place in one long, sorted, so that repeats are neighbours;
    # the place leads back to the whole fingerprint for the comparison.
    wins = F.col("q_wins")
    df = df.withColumn("q_bits", F.ceil(F.log2(F.size(wins) + 2)).cast("int"))
    packed = F.transform(wins, lambda x, i: F.call_function("shiftleft", x, F.col("q_bits")).bitwiseOR(i.cast("long")))
    df = df.withColumn("q_packed", F.when(F.size(F.array_distinct("q_wins")) < F.size("q_wins"), F.sort_array(packed)))
    v, bits = F.col("q_packed"), F.col("q_bits")

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    def window_of(x: Column) -> Column:
        return F.get(wins, place(x))

    def repeated(x: Column, i: Column) -> Column:
        after = F.get(v, i + 1)
        near = F.call_function("shiftright", x, bits) == F.call_function("shiftright", after, bits)
        return near & (window_of(x) == window_of(after))

    # each repeat names its window and the next one in order; together they name all of a run
    places = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(v) - 2), lambda i: repeated(F.get(v, i), i)),
                                   lambda i: F.array(place(F.get(v, i)), place(F.get(v, i + 1)))))
    covered = F.flatten(F.transform(F.array_distinct(places), lambda i: F.array(i, i + 1, i + 2)))
    rest = F.col("q_rest")

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(rest, pattern, "")).cast("long")

    lines = F.size("q_lines")
    df = df.withColumn("q_base", F.struct(
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        (lines - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(v.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long").alias("n_repeat_words"),
        count(r"[^A-Z]+").alias("upper"), count(r"[^0-9]+").alias("digits"), count(r"[^!?]+").alias("marks"),
        count(r"[^|]+").alias("bars"), lines.cast("long").alias("lines"), F.size(F.array_distinct(h)).cast("long").alias("kinds"),
    ))
    b = {c: F.col(f"q_base.{c}") for c in (*STATS, "upper", "digits", "marks", "bars", "lines", "kinds")}

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(F.lit(0)).cast("long")

    tests = {
        "word_length": F.when(b["n_words"] > 0, F.floor(b["word_chars"] * 100 / b["n_words"])).otherwise(F.lit(0)).cast("long"),
        "symbol_share": share(b["n_symbols"], b["word_chars"]),
        "upper_share": share(b["upper"], b["word_chars"]),
        "digit_share": share(b["digits"], b["word_chars"]),
        "mark_share": share(b["marks"], b["word_chars"]),
        "bar_share": share(b["bars"], b["n_words"]),
        "dup_line_share": share(b["n_dup_lines"], b["lines"]),
        "repeat_share": share(b["n_repeat_words"], b["n_words"]),
        # the number of different words grows as a power of the length, so their logarithms are compared
        "variety": F.when(b["n_words"] > 1, share(F.log(b["kinds"]), F.log(b["n_words"]))).otherwise(F.lit(1000)).cast("long"),
        "line_words": F.when(b["lines"] > 0, F.floor(b["n_words"] / b["lines"])).otherwise(F.lit(0)).cast("long"),
    }
    q = F.struct(*[b[c].alias(c) for c in STATS], *[v.alias(k) for k, v in tests.items()])
    return df.withColumn("q", q).select(*[c for c in docs.columns if c != "q"], "q")  # a column q is replaced


def base_failed(q: str = "q", least_words: int = 50, most_repeated: int = 50) -> Column:
    """Too few words, or too many of them in repeated windows (percent)."""
    return (F.col(f"{q}.n_words") < least_words) | (100 * F.col(f"{q}.n_repeat_words") > most_repeated * F.col(f"{q}.n_words"))


@dataclass(frozen=True)
class Condition:
    test: str
    at_least: bool
    value: int

    def column(self, q: str = "q") -> Column:
        c = F.col(f"{q}.{self.test}")
        return c >= self.value if self.at_least else c <= self.value

    def __str__(self) -> str:
        return f"{self.test} {'>=' if self.at_least else '<='} {self.value}"


Rule = tuple[Condition, ...]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> list:
    """Statistics and label (0 or 1) of at most ``rows`` labelled documents, the first by hash of the id.

    ``labels`` has ``id`` and ``good``; of several labels of an id the greatest counts.
    """
    chosen = labels.where(F.col("id").isNotNull() & F.col("good").isNotNull()).groupBy("id").agg(F.max("good").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows)
    few = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # bounded by rows
    sample = with_stats(few).select("id", "good", *[f"q.{c}" for c in TESTS]).orderBy(F.xxhash64("id"), "id").limit(rows)
    return sample.collect()


def _bits(flags: Iterable[bool]) -> int:
    """One bit per row, the first row lowest."""
    return int("".join("1" if f else "0" for f in flags)[::-1] or "0", 2)


def learn(
    sample: Sequence, min_precision: float = 0.9, min_rows: int = 5, most_conditions: int = 4, most_rules: int = 40,
    cuts: int = 24,
) -> list[Rule]:
    """Rules for rejection, in order. Each grows on two thirds of the rows and is pruned on the other third.

    A rule grows by the threshold with the most information gain (good rows still let in against bad rows kept). Pruning
    drops last conditions while the held-out (bad - good) / (bad + good) does not fall. A rule stays if it is precise
    enough on both parts and covers ``min_rows``; its bad rows then leave the set. Rows are bits of integers, so that
    a count is an AND and a bit count.
    """
    n = len(sample)
    grow = _bits(i % 3 > 0 for i in range(n))
    everything = (1 << n) - 1
    hold = everything ^ grow
    bad = _bits(r["good"] == 0 for r in sample)
    good = everything ^ bad
    masks: dict[Condition, int] = {}
    for test in TESTS:
        values = sorted(r[test] for r in sample)
        bads = sorted(r[test] for r in sample if r["good"] == 0)
        marks = {values[len(values) * k // cuts] for k in range(cuts)} | {bads[len(bads) * k // cuts] for k in range(cuts)} if bads else set()
        for mark in sorted(marks):
            low = _bits(r[test] <= mark for r in sample)
            under = _bits(r[test] < mark for r in sample)
            for c, m in ((Condition(test, False, mark), low), (Condition(test, True, mark), everything ^ under)):
                if m not in (0, everything):
                    masks[c] = m
    rules: list[Rule] = []
    left = bad
    for _ in range(most_rules):
        rule: list[Condition] = []
        at = grow
        while len(rule) < most_conditions:
            p0, n0 = (at & left).bit_count(), (at & good).bit_count()
            if not p0 or not n0:
                break
            base, best = log2(p0 / (p0 + n0)), (0.0, None)
            for c, m in masks.items():
                p1 = (at & m & left).bit_count()
                if p1:
                    gain = p1 * (log2(p1 / (p1 + (at & m & good).bit_count())) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, c)
            if best[1] is None:
                break
            rule.append(best[1])
            at &= masks[best[1]]
        if not rule:
            break

        def cover(conditions: Sequence[Condition], part: int) -> tuple[int, int]:
            for c in conditions:
                part &= masks[c]
            return (part & left).bit_count(), (part & good).bit_count()

        def worth(conditions: Sequence[Condition]) -> float:
            p, g = cover(conditions, hold)
            return (p - g) / (p + g) if p + g else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        (gp, gn), (hp, hn) = cover(rule, grow), cover(rule, hold)
        if gp + hp < min_rows or gp < min_precision * (gp + gn) or hp < min_precision * (hp + hn):
            break
        rules.append(tuple(rule))
        at = everything
        for c in rule:
            at &= masks[c]
        left &= ~at
    return rules


def rejecting_rule(rules: Sequence[Rule], q: str = "q") -> Column:
    """The number (from 1) of the first rule that fits, null if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        fits = rule[0].column(q)
        for c in rule[1:]:
            fits = fits & c.column(q)
        out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``q`` (statistics), ``q_base_failed``, ``q_rule`` (the rule that rejects, or null) and ``q_kept``.

    Store the result before filtering by these columns: a filter pushed down repeats the statistics, nested in each other.
    """
    rules = learn(labelled_sample(docs, labels, text=text, key=key))
    df = with_stats(docs, text).withColumn("q_base_failed", base_failed()).withColumn("q_rule", rejecting_rule(rules))
    return df.withColumn("q_kept", ~F.col("q_base_failed") & F.col("q_rule").isNull())
