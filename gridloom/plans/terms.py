"""Term lookups as one object; every method gives a lazy table of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import ontology as on
from gridloom.operators.filters import Ontology, below


class TermFinder:
    def __init__(self, ontology: Ontology, ontology_id: str | None = None, flag: str | None = None):
        self._all, self._closure = ontology, lambda: ontology.closure
        self.terms = on.scoped(ontology.terms, ontology_id, flag)

    def find_root(self) -> DataFrame:
        return on.term_roots(self.terms)

    def find_id(self, term_id: str) -> DataFrame:
        return self.terms.filter(F.col("term_id") == term_id)

    def find_ids(self, ids: DataFrame) -> DataFrame:
        return on.term_by_ids(self.terms, ids)

    def find_name(self, name: str, parent_term_id: str | None = None, ignore_case: bool = False) -> DataFrame:
        pool = below(self.terms, self._closure(), parent_term_id) if parent_term_id else self.terms
        if ignore_case:
            return pool.filter(F.lower("term_name") == name.lower())
        return pool.filter(F.col("term_name") == name)

    def find_name_prefix(self, value: str, parent_term_id: str | None = None) -> DataFrame:
        return on.term_prefix(self.terms, self._closure() if parent_term_id else None, value, parent_term_id)

    def find_name_pattern(self, value: str, parent_term_id: str | None = None) -> DataFrame:
        return on.term_pattern(self.terms, self._closure() if parent_term_id else None, value, parent_term_id)

    def find_parent_id(self, parent_term_id: str) -> DataFrame:
        return on.term_children(self.terms, parent_term_id)

    def find_parent_path_id(self, parent_term_id: str) -> DataFrame:
        return below(self.terms, self._closure(), parent_term_id)

    def find_microtypes(self, value: str) -> DataFrame:
        return on.search_microtypes(self.terms, value)

    def parents(self, chosen: DataFrame) -> DataFrame:
        return on.term_parents(self._all.terms, chosen)

    def parent_path(self, chosen: DataFrame) -> DataFrame:
        return on.term_path(self._all.terms, self._closure(), chosen)
