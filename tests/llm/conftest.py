import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from awkward import DOCS  # noqa: E402

SCHEMA = "doc_id long, text string, source string, row string, size string, class string, src string, q string"


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Writes rows as a table and reads it back; the rows get columns whose names clash with the operators' own."""
    root = tmp_path_factory.mktemp("llm")

    def put(rows, schema):
        path = f"file://{root}/t{len(list(root.iterdir()))}"
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return put


@pytest.fixture(scope="session")
def docs(stored):
    return stored([(*d, "r", "s", "c", "x", "q") for d in DOCS], SCHEMA)


@pytest.fixture(scope="session")
def none(stored):
    return stored([], SCHEMA)
