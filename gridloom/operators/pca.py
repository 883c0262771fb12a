"""Centred, whitened principal components of 2-d arrays given as cells, by a randomized range finder.

The matrix is only ever multiplied: by a few random vectors, then by what comes of them, cell by cell in joins on the row or
the column index. Rows and columns stay tables of any length; what reaches the driver are square matrices as wide as the
number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.bricks import Brick, Dim
from gridloom.session import materialize

N_COMPONENTS = 3  # fixed value: default number of components
#: Vectors that the range is searched with, at least; arrays of fewer columns are decomposed in one round.
VECTORS = 64
#: Rounds go on until no variance changes by more than this share, or they are this many.
TOLERANCE, MOST_ROUNDS = 1e-12, 40


def rows_to_arrays(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """One array per row of a 2-d array, ordered by the column index."""
    ordered = F.array_sort(F.collect_list(F.struct(col, F.col(value).cast("double").alias("v"))))
    return cells.groupBy(row).agg(F.transform(ordered, lambda s: s["v"]).alias("features"))


def _normal(key: str, c: int) -> Column:
    """A normally distributed number that depends on the key and ``c`` alone."""
    even = lambda n: (F.shiftrightunsigned(F.xxhash64(key, F.lit(c), F.lit(n)), 11) + 0.5) / F.lit(2.0**53)
    return F.sqrt(-2 * F.log(even(1))) * F.cos(2 * np.pi * even(2))


def _times(x: DataFrame, key: str, m: np.ndarray, shift: np.ndarray | None = None) -> DataFrame:
    """The table (key, x array) with each x, less ``shift``, multiplied by a small matrix."""
    off = np.zeros(len(m)) if shift is None else shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1) - off) @ m
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=[key, "x"])

    return x.select(key, "x").mapInArrow(run, f"{key} {x.schema[key].dataType.simpleString()}, x array<double>")


def _gram(x: DataFrame, shift: np.ndarray | None = None) -> np.ndarray:
    """The products of the columns of x (less ``shift``) with each other, summed over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                y = y if shift is None else y - shift
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.reshape(-1))], names=["at", "s"])

    sums = x.select("x").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    flat = np.zeros(sums.num_rows)
    flat[np.asarray(sums.column("at"))] = np.asarray(sums.column("s"))
    return flat.reshape(int(np.sqrt(len(flat))), -1)


class CellPca:
    """Scores and components of the matrix of ``cells(row, col, value)``. Signs are fixed so that the greatest loading of each
    component is positive.

    Rows and columns without any cell take no part. Where other cells are absent, the array is refused, unless ``fill`` says
    what they stand for; absent cells are not written out then. Null values count as absent, repeated cells are refused.
    """

    def __init__(self, cells: DataFrame, row: str, col: str, value: str, n_components: int = N_COMPONENTS, whiten: bool = True, fill: float | None = None):
        self._row, self._col, self._whiten = row, col, whiten
        # moved by ``fill``, an absent cell is 0; centring takes the move away again
        moved = F.col(value).cast("double") - F.lit(float(fill or 0))
        base = cells.where(F.col(value).isNotNull()).select(F.col(row).alias("i"), F.col(col).alias("j"), moved.alias("v"))
        base = materialize(base, "cells")
        size = base.agg(F.count("*").alias("n"), F.count_distinct("i").alias("rows"), F.count_distinct("j").alias("cols"), F.count_distinct("i", "j").alias("cells")).first()
        if size["n"] > size["cells"]:
            raise ValueError("a cell occurs more than once")
        if fill is None and size["n"] < size["rows"] * size["cols"]:
            raise ValueError("the array has absent cells: say what they stand for")
        self.n_rows, self._k = size["rows"], min(n_components, size["rows"], size["cols"])
        self._width = width = min(size["cols"], max(VECTORS, 2 * n_components))
        means = materialize(base.groupBy("j").agg((F.sum("v") / self.n_rows).alias("mean")), "means")
        self._base, self._means = base, means
        right = means.select("j", F.array(*[_normal("j", c) for c in range(width)]).alias("x"))
        before = np.zeros(self._k)
        for _ in range(MOST_ROUNDS):
            left = self._onto_rows(right)
            right = self._onto_columns(left)
            # right = A'Q with orthonormal Q: its own decomposition is that of A within the range
            values, turn = np.linalg.eigh(_gram(right))
            values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
            variances = values[: self._k] / max(1, self.n_rows - 1)
            if width == size["cols"] or (np.abs(variances - before) <= TOLERANCE * max(variances.max(initial=0), 1e-300)).all():
                break
            before = variances
        self.variances = variances
        root = np.sqrt(values[: self._k])
        small = np.where(root > 1e-12 * max(root.max(initial=0), 1e-300), root, np.inf)
        self._loadings = materialize(_times(right, "j", turn[:, : self._k] / small), "loadings")
        tops = self._loadings.select("j", F.posexplode("x").alias("c", "v")).groupBy("c").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("c"))).alias("v")).collect()
        signs = np.ones(self._k)
        for r in tops:
            signs[r["c"]] = -1.0 if r["v"] < 0 else 1.0
        spread = np.where(np.isfinite(small), np.sqrt(max(1, self.n_rows - 1)), 0) if whiten else np.where(np.isfinite(small), root, 0)
        self._scores = materialize(_times(left, "i", turn[:, : self._k] * signs * spread), "scores")
        self._signs = signs

    def _product(self, x: DataFrame, on: str, to: str) -> DataFrame:
        width = self._width
        sums = [F.sum(F.col("v") * F.get("x", F.lit(c))).alias(f"s{c}") for c in range(width)]
        return self._base.join(x, on).groupBy(to).agg(*sums).select(to, F.array(*[f"s{c}" for c in range(width)]).alias("x"))

    def _onto_rows(self, right: DataFrame) -> DataFrame:
        """An orthonormal basis (i, x) of the centred matrix times ``right`` (j, x)."""
        sums = self._means.join(right, "j").select(F.posexplode("x").alias("c", "v"), "mean").groupBy("c").agg(F.sum(F.col("v") * F.col("mean")).alias("s")).collect()
        shift = np.array([r["s"] for r in sorted(sums, key=lambda r: r["c"])])
        out = materialize(self._product(right, "j", "i"), "range")
        for _ in range(2):  # the second time removes what the first leaves by rounding
            values, turn = np.linalg.eigh(_gram(out, shift))
            good = values > 1e-14 * values.max(initial=0)
            scaled = turn * np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)
            out, shift = materialize(_times(out, "i", scaled, shift), "range"), None
        return out

    def _onto_columns(self, left: DataFrame) -> DataFrame:
        """The transposed centred matrix times ``left`` (i, x), as (j, x)."""
        width = self._width
        total = left.agg(*[F.sum(F.get("x", F.lit(c))).alias(f"t{c}") for c in range(width)]).first()
        raw = self._product(left, "i", "j").join(self._means, "j")
        less = [F.get("x", F.lit(c)) - F.col("mean") * F.lit(float(total[c])) for c in range(width)]
        return materialize(raw.select("j", F.array(*less).alias("x")), "range")

    def scores(self) -> DataFrame:
        """row, component (1-based), score."""
        return self._scores.select(F.col("i").alias(self._row), F.posexplode("x").alias("c", "score")).select(self._row, (F.col("c") + 1).alias("component"), "score")

    def components(self) -> DataFrame:
        """column, component (1-based), loading."""
        signs = F.array(*[F.lit(float(s)) for s in self._signs])
        rows = self._loadings.select(F.col("j").alias(self._col), F.posexplode("x").alias("c", "v"))
        return rows.select(self._col, (F.col("c") + 1).alias("component"), (F.col("v") * F.get(signs, F.col("c"))).alias("loading"))


class PcaModel(CellPca):
    """The same for rows with an array of features each; all arrays must be of one length."""

    def __init__(self, matrix: DataFrame, row: str, n_components: int = N_COMPONENTS, whiten: bool = True):
        cells = matrix.select(row, F.posexplode(F.col("features").cast("array<double>")).alias("feature", "v"))
        super().__init__(cells, row, "feature", "v", n_components, whiten)


class Pca:
    """``fit`` turns a 2-d array into one of scores; ``components_`` is then the array of loadings.

    Every data variable is decomposed by itself. ``fill``: what absent cells stand for.
    """

    def __init__(self, n_components: int = N_COMPONENTS, whiten: bool = True, fill: float | None = None):
        self.n_components, self.whiten, self.fill = n_components, whiten, fill
        self.components_: Brick | None = None

    def fit(self, brick: Brick, name: str = "PCA") -> Brick:
        if len(brick.dims) != 2:
            raise ValueError("the array must have 2 dimensions")
        models = {v: CellPca(brick.cells, "i1", "i2", v, self.n_components, self.whiten, self.fill) for v in brick.data_vars}

        def of_all(parts: dict[str, DataFrame], column: str) -> DataFrame:
            """One column per data variable: i1, i2, variables."""
            rows = [df.select("i1", (F.col("component") - 1).alias("i2"), F.lit(v).alias("var"), F.col(column).alias("value")) for v, df in parts.items()]
            whole = rows[0]
            for other in rows[1:]:
                whole = whole.unionByName(other)
            return whole.groupBy("i1", "i2").pivot("var", list(parts)).agg(F.first("value"))

        loadings = {v: m.components().withColumnRenamed("i2", "i1") for v, m in models.items()}
        spark = brick.cells.sparkSession
        names = spark.range(self.n_components).select(
            F.col("id").alias("idx"), F.concat(F.lit("PCA"), (F.col("id") + 1).cast("string")).alias("component")
        )
        components = Dim("Component", names, ("component",))
        self.components_ = Brick(
            "PCA components", "PCA", (brick.dims[1], components),
            of_all(loadings, "loading"), brick.data_vars, ops=brick.log("pca", f"n_components:{self.n_components}", "dim_index:1"),
        )
        scores = of_all({v: m.scores() for v, m in models.items()}, "score")
        return Brick(
            name, "PCA", (brick.dims[0], components), scores, brick.data_vars,
            ops=brick.log("pca", f"n_components:{self.n_components}", "dim_index:0"),
        )
