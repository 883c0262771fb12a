"""The ready-made reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import reports as rp


class Reports:
    """``process`` and ``bricks`` are the tables counted; ``personnel_root`` gets no roll-up credit."""

    def __init__(self, process: DataFrame, bricks: DataFrame, terms: DataFrame, personnel_root: str):
        self._process, self._bricks, self._terms, self._root = process, bricks, terms, personnel_root

    def process_types(self) -> DataFrame:
        return rp.term_stat(self._process, "process_term_id", self._terms)

    def process_persons(self) -> DataFrame:
        return rp.lab_rollup(rp.term_stat(self._process, "person_term_id", self._terms), self._terms, self._root)

    def process_campaigns(self) -> DataFrame:
        return rp.term_stat(self._process, "campaign_term_id", self._terms)

    def brick_types(self) -> DataFrame:
        return rp.term_stat(self._bricks, "data_type_term_id", self._terms)

    def brick_dim_types(self) -> DataFrame:
        return rp.term_stat(self._bricks, "dim_types", self._terms, exploded=True)

    def brick_data_var_types(self) -> DataFrame:
        return rp.term_stat(self._bricks, "value_types", self._terms, exploded=True)

    def brick_full_types(self) -> DataFrame:
        return rp.brick_full_types(self._bricks.select(F.col("data_type_term_id").alias("data_type"), "dim_types"))
