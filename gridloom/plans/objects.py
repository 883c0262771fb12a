"""A set of found objects and what can be asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import lineage, links, rowsets
from gridloom.plans.query import Workspace


class ObjectSet:
    def __init__(self, workspace: Workspace, type_name: str, df: DataFrame):
        self._ws, self._type, self.df = workspace, workspace.types[type_name], df

    @classmethod
    def find(cls, workspace: Workspace, type_name: str, criterion: dict | None = None) -> "ObjectSet":
        return cls(workspace, type_name, workspace.find(type_name, criterion))

    def _refs(self) -> DataFrame:
        return self.df.select(F.col(self._type.vertex).alias("obj"))

    def to_df(self) -> DataFrame:
        """Public columns, the key first."""
        return rowsets.table_view(self.df, [p.column for p in self._type.props.values()], self._type.pk)

    def head(self, n: int = 5) -> DataFrame:
        return rowsets.head_n(self.to_df(), [self._type.pk], n)

    def up_processes(self) -> DataFrame:
        return links.processes_of(self._refs(), self._ws.process_output, self._ws.process.df)

    def down_processes(self) -> DataFrame:
        return links.processes_of(self._refs(), self._ws.process_input, self._ws.process.df)

    def provenance(self) -> DataFrame:
        return lineage.provenance_tree(self._refs(), self._ws.process_input, self._ws.process_output, self._ws.edges)

    def fk_refs(self, keys: DataFrame, columns: dict[str, str]) -> DataFrame:
        """Distinct references of the given columns (column -> type): obj id, ref. ``keys(type, user_key, id)``."""
        items = F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).cast("string").alias("value"), F.lit(False).alias("is_pk")) for c, t in columns.items()])
        refs = self.df.select(F.col(self._type.pk).alias("brick_id"), F.explode(items).alias("r")).select("brick_id", "r.*")
        return links.brick_fk_refs(refs, keys)
