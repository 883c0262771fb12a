"""Quoted text with line breaks, read in splits of a few bytes, against the single-task reader."""

import random

import pytest

from gridloom.sources import quoted
from gridloom.sources.tables import scan_entity_tsv


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Splits of 64 bytes, and chunks of a line or two, while the files are read."""
    monkeypatch.setattr(quoted, "CHUNK_CHARS", 20)
    read = quoted._chunks

    def in_small_splits(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            return read(*args)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")

    monkeypatch.setattr(quoted, "_chunks", in_small_splits)


def single(spark, path, columns):
    df = spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"')
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


ROWS = [
    'id\tname\tnote\r\n', '1\tplain\t"two\nlines"\r\n', '2\t"a ""quoted"" word"\t"tab\there"\r\n', '3\t\t""\r\n', '4\tstray " in text\tx\r\n',
    '5\t"' + "long\n" * 60 + 'end"\tafter\r\n', '6\t"""\n"""\t"\n"\r\n', "\r\n", '7\t"closed" then\ty\r\n', '8\tå\tü"\r\n', '9\t"\r\nkept"\t"last"',
]


def test_same_rows_as_one_task(spark, tmp_path, small_splits):
    (tmp_path / "a.tsv").write_bytes("".join(ROWS).encode())
    got = scan_entity_tsv(spark, str(tmp_path), ["id", "name", "note"])
    want = single(spark, str(tmp_path), ["id", "name", "note"])
    assert rows(got) == want and len(want) == 9
    assert quoted._chunks(spark, str(tmp_path), "\t", '"').select("split").distinct().count() > 4


def test_generated_tables(spark, tmp_path, small_splits):
    rng = random.Random(11)

    def field():
        text = "".join(rng.choice(['a', 'b', '""', "\n", "\t", " "]) for _ in range(rng.randrange(12)))
        return f'"{text}"' if rng.random() < 0.7 else "".join(c for c in text if c in "ab ")

    body = "".join("\t".join([str(k), field(), field()]) + "\n" for k in range(60))
    (tmp_path / "g.tsv").write_text("k\tx\ty\n" + body)
    assert rows(scan_entity_tsv(spark, str(tmp_path), ["k", "x", "y"])) == single(spark, str(tmp_path), ["k", "x", "y"])


def test_columns_by_each_header(spark, tmp_path, small_splits):
    (tmp_path / "a.tsv").write_text('﻿id\tname\n1\t"x\ny"\n')
    (tmp_path / "b.tsv").write_text('name\textra\tid\nz\te\t2\n"only name"\n')
    (tmp_path / "c.tsv").write_text("id\tname\n")
    (tmp_path / "d.tsv").write_text("")
    got = scan_entity_tsv(spark, str(tmp_path), ["name", "id", "none"])
    assert rows(got) == sorted([("x\ny", "1", None), ("z", "2", None), ("only name", None, None)], key=repr)
    assert scan_entity_tsv(spark, str(tmp_path)).columns == ["id", "name", "extra"]
    assert scan_entity_tsv(spark, str(tmp_path / "d.tsv"), ["id"]).count() == 0


def test_unclosed_quote_at_the_end(spark, tmp_path, small_splits):
    (tmp_path / "a.tsv").write_text('id\tname\n1\t"never\nclosed\n')
    got = rows(scan_entity_tsv(spark, str(tmp_path), ["id", "name"]))
    assert len(got) == 1 and got[0][0] == "1"


@pytest.mark.parametrize("line, inside, after", [
    ("a\tb", False, False), ("a\tb", True, True), ('"a\tb', False, True), ('x"\tb', True, False), ('a"b\tc', False, False), ('"a""', False, True),
    ('"a"""', False, False), ('""', False, False), ('""', True, True), ('"', True, False), ('"\t"', True, True), ("", True, True), ('"a"b"\tc', False, False),
])
def test_state_after_a_line(line, inside, after):
    assert quoted.leaves_open(line, inside, "\t", '"') is after
