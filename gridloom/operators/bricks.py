"""N-dimensional arrays as tables.

A dimension is a table with an ``idx`` column (0-based) and one column per variable; the
cells are one table with index columns ``i1 .. iN`` and one column per data variable.
Absent cells are null values. Every operation returns a new lazy Brick and logs itself.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import nan_to_null
from gridloom.operators import links
from gridloom.operators.filters import compare as compare_value
from gridloom.operators.numbering import number_rows


@dataclass(frozen=True)
class Attr:
    """A context attribute."""

    type_term: str
    value: object
    units: str | None = None


@dataclass(frozen=True)
class Dim:
    name: str
    df: DataFrame
    variables: tuple[str, ...]


@dataclass(frozen=True)
class Mask:
    """A predicate on one dimension (``dim`` set) or on the cells (``dim`` None) of one array."""

    brick: "Brick"
    dim: int | None
    test: Column

    def _join(self, other: "Mask", combined: Column) -> "Mask":
        if self.brick is not other.brick:
            raise ValueError("masks of different arrays can not be combined")
        if self.dim != other.dim:
            raise ValueError("masks of different dimensions can not be combined")
        return Mask(self.brick, self.dim, combined)

    def __and__(self, other: "Mask") -> "Mask":
        return self._join(other, self.test & other.test)

    def __or__(self, other: "Mask") -> "Mask":
        return self._join(other, self.test | other.test)


@dataclass(frozen=True)
class Brick:
    name: str
    type_term: str
    dims: tuple[Dim, ...]
    cells: DataFrame
    data_vars: tuple[str, ...]
    attrs: tuple[Attr, ...] = ()
    ops: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    @property
    def idx_cols(self) -> list[str]:
        return [f"i{n + 1}" for n in range(len(self.dims))]

    def log(self, name: str, *args: str) -> tuple:
        return (*self.ops, (name, args))

    # ---- masks ----

    def dim_mask(self, dim: int, var: str, op: str, value) -> Mask:
        return Mask(self, dim, compare_value(var, op, value))

    def term_mask(self, dim: int, id_var: str, name_var: str, value: str) -> Mask:
        """A term equals its id, or its name ignoring case."""
        return Mask(self, dim, (F.col(id_var) == value) | (F.lower(F.trim(name_var)) == value.strip().lower()))

    def data_mask(self, var: str, op: str, value) -> Mask:
        return Mask(self, None, compare_value(var, op, value))

    def none_mask(self, var: str, dim: int | None = None) -> Mask:
        return Mask(self, dim, F.col(var).isNull())

    def not_none_mask(self, var: str, dim: int | None = None) -> Mask:
        return Mask(self, dim, F.col(var).isNotNull())

    # ---- selection ----

    def where(self, mask: Mask) -> "Brick":
        """Keep the indices of one dimension where the mask holds; they are numbered densely again.

        The index before the filter stays in the dimension table as ``orig_idx``.
        """
        if mask.dim is None:
            return replace(self, cells=self.cells.filter(mask.test), ops=self.log("where", "cells"))
        dim = self.dims[mask.dim]
        kept = number_rows(dim.df.filter(mask.test), [], ["idx"], "_new")
        col = self.idx_cols[mask.dim]
        map_ = kept.select(F.col("idx").alias(col), F.col("_new"))
        cells = self.cells.join(map_, col).drop(col).withColumnRenamed("_new", col).select(*self.cells.columns)
        orig = F.col("orig_idx") if "orig_idx" in kept.columns else F.col("idx")
        df = kept.select(F.col("_new").alias("idx"), *dim.variables, orig.alias("orig_idx"))
        dims = tuple(replace(d, df=df) if n == mask.dim else d for n, d in enumerate(self.dims))
        return replace(self, dims=dims, cells=cells, ops=self.log("where", f"dim_index:{mask.dim}", f"dim_name:{dim.name}"))

    def select(self, *selectors) -> "Brick":
        """One selector per dimension: None, a value of the first variable, or ``{variable: value}`` (AND)."""
        out = self
        for n, sel in enumerate(selectors):
            if sel is None:
                continue
            pairs = sel if isinstance(sel, dict) else {self.dims[n].variables[0]: sel}
            masks = [out.dim_mask(n, var, "==", value) for var, value in pairs.items()]
            out = out.where(functools.reduce(lambda a, b: a & b, masks))
        return out.drop_unit_dims()

    def drop_unit_dims(self) -> "Brick":
        """Dimensions of size 1 become context attributes and are dropped."""
        keep, attrs = [], list(self.attrs)
        for n, dim in enumerate(self.dims):
            first = dim.df.select(*dim.variables).limit(2).collect()  # at most two rows of metadata
            if len(first) == 1:
                attrs += [Attr(v, first[0][v]) for v in dim.variables]
            else:
                keep.append(n)
        if len(keep) == len(self.dims):
            return self
        idx = [F.col(self.idx_cols[n]).alias(f"i{k + 1}") for k, n in enumerate(keep)]
        cells = self.cells.select(*idx, *self.data_vars)
        return replace(self, dims=tuple(self.dims[n] for n in keep), cells=cells, attrs=tuple(attrs))

    def mean(self, dim: int) -> "Brick":
        """Mean over one dimension of every data variable; null and NaN are skipped."""
        rest = [n for n in range(len(self.dims)) if n != dim]
        keys = [F.col(self.idx_cols[n]).alias(f"i{k + 1}") for k, n in enumerate(rest)]
        aggs = [F.avg(nan_to_null(F.col(v).try_cast("double"))).alias(v) for v in self.data_vars]
        return replace(
            self,
            dims=tuple(self.dims[n] for n in rest),
            cells=self.cells.groupBy(*keys).agg(*aggs),
            ops=self.log("mean", f"dim_index:{dim}", f"dim_name:{self.dims[dim].name}"),
        )

    # ---- additions ----

    def add_attr(self, type_term: str, value, units: str | None = None) -> "Brick":
        return replace(self, attrs=(*self.attrs, Attr(type_term, value, units)))

    def add_data_var(self, name: str, value: Column) -> "Brick":
        return replace(
            self, cells=self.cells.withColumn(name, value), data_vars=(*self.data_vars, name), ops=self.log("add_data_var", name)
        )

    def add_dim_var(self, dim: int, df: DataFrame, name: str) -> "Brick":
        """``df`` is the dimension table with the new variable in it."""
        d = self.dims[dim]
        new = replace(d, df=df, variables=(*d.variables, name))
        dims = tuple(new if n == dim else x for n, x in enumerate(self.dims))
        return replace(self, dims=dims, ops=self.log("add_var", f"dim_index:{dim}", name))

    def map_to_core_type(self, dim: int, var: str, entity: DataFrame, prop: str, pk: str, name: str) -> "Brick":
        """Add the id of the entity whose property equals a dimension variable."""
        return self.add_dim_var(dim, links.map_to_core_type(self.dims[dim].df, var, entity, prop, pk, name), name)

    def add_core_type_var(self, dim: int, pk_var: str, entity: DataFrame, pk: str, prop: str) -> "Brick":
        """Add a property of the entity an id variable names."""
        return self.add_dim_var(dim, links.add_core_type_var(self.dims[dim].df, pk_var, entity, pk, [prop]), prop)

    def add_brick_var(self, dim: int, match: str, other: "Brick", match_other: str, value: str) -> "Brick":
        """Add values of a 1-d array by an equal variable."""
        flat = other.wide().select(match_other, value)
        return self.add_dim_var(dim, links.add_brick_var(self.dims[dim].df, match, flat, match_other, value, value), value)

    def add_up_props(self, dim: int, pk_var: str, linked: DataFrame, pk: str, props: list[str]) -> "Brick":
        """Add properties of provenance ancestors; ``linked`` holds them per entity id."""
        out = self
        values = links.first_per_key(linked.select(F.col(pk).alias(pk_var), *props), pk_var, props)
        for p in props:
            out = out.add_dim_var(dim, out.dims[dim].df.join(values.select(pk_var, p), pk_var, "left"), p)
        return out

    # ---- views ----

    def wide(self, *dims: int) -> DataFrame:
        """One row per cell with the variables of the given (default: all) dimensions looked up by index."""
        out = self.cells
        for n in dims or range(len(self.dims)):
            d = self.dims[n]
            out = out.join(d.df.select(F.col("idx").alias(self.idx_cols[n]), *d.variables), self.idx_cols[n], "left")
        return out

    def summary(self) -> DataFrame:
        """Dimension list: position, name, size, number of variables."""
        parts = [
            d.df.agg(F.count("*").alias("size")).select(
                F.lit(n + 1).alias("dim"), F.lit(d.name).alias("name"), "size", F.lit(len(d.variables)).alias("n_vars")
            )
            for n, d in enumerate(self.dims)
        ]
        return functools.reduce(DataFrame.unionByName, parts)

    def ops_table(self, brick_id: str, spark) -> DataFrame:
        """The operation log as it is stored with the array: one row with an array of structs."""
        items = [F.struct(F.lit(name).alias("op"), F.array(*[F.lit(a) for a in args]).cast("array<string>").alias("args")) for name, args in self.ops]
        return spark.range(1).select(F.lit(brick_id).alias("brick_id"), F.array(*items).alias("brick_ops"))


def unravel_index(pos: Column | str, shape: list[int]) -> list[Column]:
    """Row-major position to 0-based indices ``i1 .. iN``."""
    p = F.col(pos) if isinstance(pos, str) else pos
    out, step = [], functools.reduce(lambda a, b: a * b, shape, 1)
    for n, size in enumerate(shape):
        step //= size
        out.append((F.floor(p / F.lit(step)) % F.lit(size)).cast("bigint").alias(f"i{n + 1}"))
    return out


def ravel_index(idx: list[str], shape: list[int]) -> Column:
    pos = F.lit(0).cast("bigint")
    for col, size in zip(idx, shape):
        pos = pos * F.lit(size) + F.col(col)
    return pos


def create_cells(spark, shape: list[int]) -> DataFrame:
    """All index tuples of a shape, made in parallel from one range of positions."""
    total = functools.reduce(lambda a, b: a * b, shape, 1)
    return spark.range(total).select(*unravel_index("id", shape))


def value_search(dim: DataFrame, var: str, keyword: str) -> DataFrame:
    """Values of a dimension variable holding a keyword, with their index."""
    return dim.filter(F.col(var).contains(keyword)).select("idx", F.col(var).alias("value"))


def slider_filter(points: DataFrame, color: str, low, high) -> DataFrame:
    return points.filter(F.col(color).isNull() | F.col(color).between(low, high))


def wide_to_long(wide: DataFrame, idx: list[str], values: list[str], name: str = "i0") -> DataFrame:
    """Several value columns to one, their name as the first dimension."""
    return wide.unpivot(idx, values, name, "value")


def long_to_wide(cells: DataFrame, idx: list[str], name: str, values: list[str], value: str = "value") -> DataFrame:
    """The first dimension, whose few values are known from the metadata, becomes columns."""
    return cells.groupBy(*idx).pivot(name, values).agg(F.first(value, ignorenulls=True))
