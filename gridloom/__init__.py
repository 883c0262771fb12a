"""gridloom: typed entities, annotated N-d arrays, term graphs and lineage on Spark DataFrames."""

from gridloom.session import materialize, release_scratch, scratch_root

__all__ = ["materialize", "release_scratch", "scratch_root"]
