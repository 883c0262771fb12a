"""Plot slices of an array: fixed indices, axes, averages over everything else.

A dimension id is ``"2"`` (a dimension, by index) or ``"2/1"`` (one of its variables, by
unique value), both 1-based; fixed values are 1-based too.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import concat_dim_values, nan_to_null
from gridloom.operators.bricks import Brick, Dim
from gridloom.operators.numbering import number_rows


@dataclass(frozen=True)
class DimId:
    dim: int
    var: str | None

    @property
    def key(self) -> str:
        return f"d{self.dim + 1}" + (f"_{self.var}" if self.var else "")


def parse_dim_id(brick: Brick, text: str) -> DimId:
    head, _, tail = str(text).partition("/")
    n = int(head)
    if not 1 <= n <= len(brick.dims):
        raise ValueError(f"Dimension index {n} invalid")
    if not tail:
        return DimId(n - 1, None)
    variables = brick.dims[n - 1].variables
    if not 1 <= int(tail) <= len(variables):
        raise ValueError(f"Dimension index {text} invalid")
    return DimId(n - 1, variables[int(tail) - 1])


def unique_values(dim: Dim, var: str) -> DataFrame:
    """Unique values of a variable in first-seen order with a 0-based position."""
    first = dim.df.groupBy(F.col(var).alias("value")).agg(F.min("idx").alias("first_idx"))
    return number_rows(first, [], ["first_idx"])


def fix_indices(brick: Brick, constant: dict[str, int]) -> dict[int, DataFrame]:
    """Allowed indices per fixed dimension; several fixed variables of one dimension intersect."""
    allowed: dict[int, DataFrame] = {}
    for text, number in constant.items():
        d = parse_dim_id(brick, text)
        df = brick.dims[d.dim].df
        if d.var is None:
            hit = df.filter(F.col("idx") == number - 1).select("idx")
        else:
            chosen = unique_values(brick.dims[d.dim], d.var).filter(F.col("pos") == number - 1)
            hit = df.join(chosen, F.col(d.var).eqNullSafe(F.col("value")), "left_semi").select("idx")
        allowed[d.dim] = allowed[d.dim].join(hit, "idx", "left_semi") if d.dim in allowed else hit
    return allowed


def _axis(brick: Brick, d: DimId) -> DataFrame:
    """idx to axis label and position: per index for a dimension, per unique value for a variable."""
    dim = brick.dims[d.dim]
    if d.var is None:
        only = dim.variables[0] if len(dim.variables) == 1 else None
        label = F.col(only) if only else concat_dim_values(*dim.variables)
        return dim.df.select("idx", label.alias(d.key), F.col("idx").alias(d.key + "_pos"))
    first = dim.df.groupBy(d.var).agg(F.min("idx").alias(d.key + "_pos"))
    first = first.withColumnRenamed(d.var, d.key)
    joined = dim.df.select("idx", d.var).join(first, F.col(d.var).eqNullSafe(F.col(d.key)))  # null is a value of its own
    return joined.select("idx", d.key, d.key + "_pos")


def _fixed_cells(brick: Brick, constant: dict[str, int]) -> DataFrame:
    cells = brick.cells
    for n, idx in fix_indices(brick, constant).items():
        cells = cells.join(idx.withColumnRenamed("idx", brick.idx_cols[n]), brick.idx_cols[n], "left_semi")
    return cells


def _averaged(brick: Brick, constant: dict, axes: list[DimId], value: str) -> DataFrame:
    """Average and sample deviation per combination of axes, over all that is neither fixed nor an axis."""
    out = _fixed_cells(brick, constant)
    for d in axes:
        out = out.join(_axis(brick, d).withColumnRenamed("idx", brick.idx_cols[d.dim]), brick.idx_cols[d.dim])
    v = nan_to_null(F.col(value).try_cast("double"))
    keys = [c for d in axes for c in (d.key, d.key + "_pos")]
    return out.groupBy(*keys).agg(F.avg(v).alias("value"), F.stddev_samp(v).alias("sd"))


def slice_mean_sd(brick: Brick, constant: dict, variable: list[str], value: str | None = None) -> DataFrame:
    axes = [parse_dim_id(brick, v) for v in variable]
    return _averaged(brick, constant, axes, value or brick.data_vars[0])


def series_xy(brick: Brick, constant: dict, variable: list[str], value: str | None = None, label_format: dict | None = None) -> DataFrame:
    """label, x, x_pos, y, error_y: the first variable dimension is x, the others make the series.

    Points without x or y are left out. A label is ``name = value`` or the given pattern with
    ``#VAR1`` in place of the value, joined with ``; ``.
    """
    axes = [parse_dim_id(brick, v) for v in variable]
    rows = _averaged(brick, constant, axes, value or brick.data_vars[0])
    parts = []
    for text, d in zip(variable[1:], axes[1:]):
        pattern = (label_format or {}).get(text, f"{d.var or brick.dims[d.dim].name} = #VAR1")
        parts.append(F.replace(F.lit(pattern), F.lit("#VAR1"), F.coalesce(F.col(d.key).cast("string"), F.lit("null"))))
    label = F.concat_ws("; ", *parts) if parts else F.lit("")
    x = axes[0].key
    return rows.filter(F.col(x).isNotNull() & F.col("value").isNotNull()).select(
        label.alias("label"), F.col(x).alias("x"), F.col(x + "_pos").alias("x_pos"), F.col("value").alias("y"), F.col("sd").alias("error_y")
    )


def grid_z(brick: Brick, constant: dict, variable: list[str], value: str | None = None) -> DataFrame:
    """Cells of the z matrix: y, y_pos, x, x_pos, z, sd; the first variable dimension is x, the second y."""
    x, y = (parse_dim_id(brick, v) for v in variable[:2])
    rows = _averaged(brick, constant, [x, y], value or brick.data_vars[0])
    return rows.filter(F.col(x.key).isNotNull() & F.col(y.key).isNotNull()).select(
        F.col(y.key).alias("y"), F.col(y.key + "_pos").alias("y_pos"),
        F.col(x.key).alias("x"), F.col(x.key + "_pos").alias("x_pos"),
        F.col("value").alias("z"), "sd",
    )


def scatter_same_dim(brick: Brick, x: str, y: str, point_label: str | None = None, z: str | None = None, constant: dict | None = None) -> DataFrame:
    """x and y are variables of one dimension: one point per index; z from the data (averaged) or a variable."""
    ids = [parse_dim_id(brick, v) for v in (x, y, point_label, z) if v and "/" in v]
    if len({d.dim for d in ids}) != 1:
        raise ValueError("point labels and data must be in the same dimension as X and Y variables")
    n = ids[0].dim
    col = brick.idx_cols[n]
    points = brick.dims[n].df.select(
        F.col("idx").alias(col), F.col(ids[0].var).alias("x"), F.col(ids[1].var).alias("y"),
        *([F.col(ids[2].var).alias("label")] if point_label else []),
        *([F.col(ids[-1].var).alias("z")] if z and "/" in z else []),
    )
    if z and "/" not in z:
        v = nan_to_null(F.col(z).try_cast("double"))
        means = _fixed_cells(brick, constant or {}).groupBy(col).agg(F.avg(v).alias("z"), F.stddev_samp(v).alias("sd"))
        points = points.join(means, col, "left")
    return points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumnRenamed(col, "idx")


def filter_brick(brick: Brick, request: dict) -> DataFrame:
    """The JSON slice request: constant, variable, z, data, point-labels, label-format."""
    constant = {str(k): int(v) for k, v in request.get("constant", {}).items()}
    variable = [str(v) for v in request["variable"]]
    for text in [*constant, *variable]:
        parse_dim_id(brick, text)
    same = len(variable) > 1 and variable[0].partition("/")[0] == variable[1].partition("/")[0]
    if request.get("z"):
        if len(variable) < 2:
            raise ValueError("There must be at least two variable dimensions when returning Z values")
        if same:
            return scatter_same_dim(
                brick, variable[0], variable[1], request.get("point-labels"), request.get("data", brick.data_vars[0]), constant
            )
        return grid_z(brick, constant, variable, request.get("data"))
    return series_xy(brick, constant, variable, request.get("data"), request.get("label-format"))


def plot_matrix(brick: Brick, means: list[int], x_dim: int, labels: dict[int, str]) -> DataFrame:
    """After means over some dimensions, the 1-d or 2-d values with axis labels: x, x_pos, (z, z_pos), value.

    Label patterns hold ``#V1 .. #Vn`` for the variables of a dimension. ``x_dim`` names the
    dimension on the x axis, counted after the means.
    """
    for n in sorted(means, reverse=True):
        brick = brick.mean(n)
    if len(brick.dims) > 2:
        raise ValueError("only 1-d and 2-d arrays can be plotted")
    out = brick.cells
    names = ["x" if n == x_dim else "z" for n in range(len(brick.dims))]
    for n, (dim, name) in enumerate(zip(brick.dims, names)):
        text = dim_label(labels[n], dim)
        axis = dim.df.select(F.col("idx").alias(brick.idx_cols[n]), text.alias(name))
        out = out.join(axis, brick.idx_cols[n], "left").withColumn(name + "_pos", F.col(brick.idx_cols[n]))
    cols = [c for name in names for c in (name, name + "_pos")]
    return out.select(*cols, F.col(brick.data_vars[0]).alias("value"))


def dim_label(pattern: str, dim: Dim):
    out = F.lit(pattern)
    for k in range(len(dim.variables), 0, -1):
        out = F.replace(out, F.lit(f"#V{k}"), F.coalesce(F.col(dim.variables[k - 1]).cast("string"), F.lit("None")))
    return out


def plot_traces(matrix: DataFrame) -> DataFrame:
    """One trace per z label, or one unnamed trace: trace, x, y, in trace and x order."""
    if "z" in matrix.columns:
        return matrix.select(F.col("z").alias("trace"), F.col("z_pos").alias("trace_pos"), "x", "x_pos", F.col("value").alias("y"))
    return matrix.select(F.lit("").alias("trace"), F.lit(0).alias("trace_pos"), "x", "x_pos", F.col("value").alias("y"))


def brick_map(brick: Brick, fixed: dict[int, int], lat: str, lon: str, color: str, label: str) -> DataFrame:
    """latitude, longitude, color, label per index of the first dimension, other dimensions fixed (0-based)."""
    dim = brick.dims[0]
    tests = [F.col(brick.idx_cols[n]) == i for n, i in fixed.items()]
    cells = brick.cells.filter(functools.reduce(lambda a, b: a & b, tests)) if tests else brick.cells
    out = dim.df.select(F.col("idx").alias("i1"), *dim.variables)
    if color in brick.data_vars or label in brick.data_vars:
        out = out.join(cells.select("i1", *brick.data_vars), "i1", "left")
    return out.select(
        F.col(lat).alias("latitude"), F.col(lon).alias("longitude"), F.col(color).alias("color"), F.col(label).cast("string").alias("label_text")
    )
