"""Shared pieces: table reading, word rules, and vectorised word hashing over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank and the five ASCII control breaks.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def n_words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE))).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes every output bit with even odds."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_steps(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``step`` bytes each."""
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)) if len(column) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, "right")) - 1)
        yield lo, hi
        lo = hi


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    chars = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return chars[at[0] : at[-1]], at - at[0]


class Words:
    """Words of some texts: ``row`` (text of each word), ``length``, ``chars`` (bytes, A-Z lower-cased,
    without white space), ``start`` (of each word in ``chars``), ``first`` (per text: its first word)."""

    def __init__(self, column: pa.Array, space: np.ndarray = _IS_SPACE, breaks: np.ndarray | None = None):
        """``space``: per byte, whether it lies outside words; with ``breaks`` (bytes among them), ``broken`` tells whether
        one lies between a word and the word before it."""
        self.split(*raw(column), space, breaks)

    def split(self, data: np.ndarray, at: np.ndarray, space: np.ndarray, breaks: np.ndarray | None) -> None:
        inside = ~space[data]
        opens = np.ones(len(data) + 1, bool)
        opens[1:-1] = ~inside[:-1]
        opens[at] = True
        begins = np.flatnonzero(inside & opens[:-1])
        self.chars = _FOLD[data[inside]]
        self.start = (np.cumsum(inside) - 1)[begins] if len(data) else np.zeros(0, np.int64)
        self.length = np.diff(np.append(self.start, len(self.chars)))
        self.row = np.searchsorted(at, begins, "right") - 1
        self.rows = len(at) - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        if breaks is not None:
            met = np.concatenate([[0], np.cumsum(breaks[data])])[begins]
            self.broken = np.diff(met, prepend=0) > 0

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.chars)) - np.repeat(self.start, self.length)
        powers = np.cumprod(np.full(int(self.length.max()), _ODD))
        return mix(np.add.reduceat((self.chars.astype(np.uint64) + np.uint64(1)) * powers[place], self.start))
