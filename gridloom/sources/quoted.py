"""Quoted text tables whose fields may hold line breaks, read in splits.

Whether a line break ends a record depends on all quotes before it. Each task reads its split line by line and stores it
in chunks; along the split it follows the state twice, as if the split began between records and as if it began within
quotes. A prefix scan over the splits tells how each really begins, so chunks are cut into records independently. A
record that goes on over chunks is put together from its pieces.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import materialize

#: Characters of a chunk, about; a longer line is a chunk of its own.
CHUNK_CHARS = 2_000_000


def leaves_open(line: str, inside: bool, sep: str, quote: str) -> bool:
    """Whether a quoted field is open after the line. A doubled quote stands for one; one that is not at the beginning of
    a field is text; what follows a closing quote is text up to the next separator."""
    if not inside and quote not in line:
        return False
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            inside = False
            at += 1
        elif line.startswith(quote, at):
            inside = True
            at += 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


def _chunks(spark: SparkSession, path, sep: str, quote: str) -> DataFrame:
    """file, split, chunk, body (lines joined by line feeds), begun and after (whether a quoted field is open at the chunk's
    beginning and end, if the split begins outside, and if inside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple = (None, None)
        lines: list[str] = []
        size = chunk = 0
        begun, after = [False, True], [False, True]

        def close() -> pa.RecordBatch:
            row = [[place[0]], [place[1]], [chunk], ["\n".join(lines)], [begun], [after]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)

        for batch in batches:
            for file, split, line in zip(*[batch.column(c).to_pylist() for c in ("file", "split", "value")], strict=True):
                if lines and ((file, split) != place or size >= CHUNK_CHARS):
                    yield close()
                    chunk, begun = (chunk + 1, after) if (file, split) == place else (0, [False, True])
                    lines, size, after = [], 0, begun
                place = (file, split)
                lines.append(line)
                size += len(line) + 1
                after = [leaves_open(line, inside, sep, quote) for inside in after]
        if lines:
            yield close()

    # only line feeds end lines here, so that a carriage return within quotes is kept
    text = spark.read.option("lineSep", "\n").text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    return materialize(text.mapInArrow(run, "file string, split long, chunk long, body string, begun array<boolean>, after array<boolean>"), "chunks")


_CHUNK = pa.schema([("file", pa.string()), ("split", pa.int64()), ("chunk", pa.int64()), ("body", pa.string()), ("begun", pa.list_(pa.bool_())), ("after", pa.list_(pa.bool_()))])


def _inside(chunks: DataFrame) -> DataFrame:
    """file, split, inside: whether the split begins within quotes. The scan has one row per split."""
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = chunks.groupBy("file", "split").agg(F.max_by("after", "chunk").alias("after"))
    out, within = F.col("after")[0], F.col("after")[1]
    # a split with one outcome sets the state; those that swap it are counted from there on
    splits = splits.withColumn("swaps", F.coalesce(F.sum((out & ~within).cast("int")).over(before), F.lit(0)))
    splits = splits.withColumn("mark", F.when(out == within, F.struct(out.alias("state"), "swaps")))
    last = F.last("mark", ignorenulls=True).over(before)
    since = F.col("swaps") - F.coalesce(last["swaps"], F.lit(0))
    return splits.select("file", "split", (F.coalesce(last["state"], F.lit(False)) != (since % 2 == 1)).alias("inside"))


#: A whole record; the end of one, what opens one, and what goes on with one from beginning to end of a chunk.
WHOLE, ENDS, OPENS, GOES_ON = range(4)


def _cut(chunks: DataFrame, sep: str, quote: str) -> DataFrame:
    """file, split, chunk, seq (of the record among those that begin in the chunk), part, record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, split, chunk, inside, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts: list[tuple[int, int, str]] = []
                held: list[str] = []
                begins = not inside
                seq = 0
                for line in body.split("\n"):
                    held.append(line)
                    inside = leaves_open(line, inside, sep, quote)
                    if not inside:
                        record = "\n".join(held)
                        if not begins:
                            parts.append((-1, ENDS, record))
                        elif record not in ("", "\r"):
                            parts.append((seq, WHOLE, record))
                            seq += 1
                        begins, held = True, []
                if held:
                    parts.append((seq if begins else -1, OPENS if begins else GOES_ON, "\n".join(held) + "\n"))
                if parts:
                    seqs, kinds, texts = zip(*parts, strict=True)
                    n = len(parts)
                    row = [[file] * n, [split] * n, [chunk] * n, seqs, kinds, texts]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _PART, strict=True)], schema=_PART)

    state = F.when(F.col("inside"), F.col("begun")[1]).otherwise(F.col("begun")[0])
    sent = chunks.select("file", "split", "chunk", state.alias("state"), "body")
    return sent.mapInArrow(run, "file string, split long, chunk long, seq long, part int, record string")


_PART = pa.schema([("file", pa.string()), ("split", pa.int64()), ("chunk", pa.int64()), ("seq", pa.int64()), ("part", pa.int32()), ("record", pa.string())])


def records(spark: SparkSession, path, sep: str = "\t", quote: str = '"') -> DataFrame:
    """file, at (where in the file it begins, as something to order by), record: every record of the files, as text. Of its
    line end a carriage return stays."""
    chunks = _chunks(spark, path, sep, quote)
    cut = materialize(_cut(chunks.join(_inside(chunks), ["file", "split"], "left"), sep, quote), "records")
    here = F.struct("split", "chunk", "seq")
    # where the record of a piece begins: the last opening before it, in its split or else in the splits before
    opens = cut.where(F.col("part") == OPENS).select("file", "split", "chunk", here.alias("opening"))
    goes_on = cut.where(F.col("part").isin(ENDS, GOES_ON))
    both = opens.select("*", F.lit(True).alias("opens")).unionByName(goes_on.select("file", "split", "chunk", F.lit(False).alias("opens")), allowMissingColumns=True)
    in_split = Window.partitionBy("file", "split").orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("opening").over(in_split)).where("not opens").select("file", "split", "chunk", "near").distinct()
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("file", "split").agg(F.max("opening").alias("opening")).withColumn("carried", F.max("opening").over(earlier))
    near = near.join(carried.select("file", "split", "carried"), ["file", "split"])
    goes_on = goes_on.join(near, ["file", "split", "chunk"]).withColumn("at", F.coalesce("near", "carried"))
    pieces = goes_on.select("file", "at", "split", "chunk", "record").unionByName(
        cut.where(F.col("part") == OPENS).select("file", here.alias("at"), "split", "chunk", "record")
    )
    pieces = pieces.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("split", "chunk", "record"))).alias("p"))
    whole = cut.where(F.col("part") == WHOLE).select("file", here.alias("at"), "record")
    return whole.unionByName(pieces.select("file", "at", F.rtrim(F.array_join("p.record", ""), F.lit("\n")).alias("record")))


def read_quoted(spark: SparkSession, path, columns: list[str] | None = None, sep: str = "\t", quote: str = '"') -> DataFrame:
    """Rows of quoted text files with a header each; all columns text, found by name in each file's own header.

    A column that a file doesn't have is null there; by default the columns are those of all headers. Of equal names in a
    header the first counts. Values are read as by Spark's own reader: nothing between separators is null, two quotes are
    an empty text; rows of one partition are in file order, and in a file whose header ends with a carriage return and a line feed these two are one line feed.
    Only the distinct headers come to the driver.
    """
    found = materialize(records(spark, path, sep, quote), "rows")
    heads = found.groupBy("file").agg(F.min(F.struct("at", "record")).alias("first"))
    heads = materialize(heads.select("file", F.col("first.at").alias("head_at"), F.endswith("first.record", F.lit("\r")).alias("returns"), F.btrim("first.record", F.lit("\ufeff\r")).alias("header")), "heads")
    names = {r.header: _fields(r.header, sep, quote) for r in heads.select("header").distinct().collect()}
    if columns is None:
        columns = list(dict.fromkeys(n for own in sorted(names.values()) for n in own))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not names or not columns:
        return spark.createDataFrame([], schema)
    places = [(header, [own.index(c) if c in own else -1 for c in columns]) for header, own in names.items()]
    heads = heads.join(spark.createDataFrame(places, "header string, places array<int>"), "header").drop("header")
    heads = materialize(heads, "places")  # one row per file, of known size
    width = max(map(len, names.values()))
    row = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    record = F.rtrim(F.col("record"), F.lit("\r"))
    record = F.when(F.col("returns"), F.replace(record, F.lit("\r\n"), F.lit("\n"))).otherwise(record)
    parsed = F.from_csv(record, row.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": quote, "escape": quote})
    rows = found.join(heads, "file", "left").where(F.col("at") != F.col("head_at"))
    rows = rows.sortWithinPartitions("file", "at").select("places", parsed.alias("r"))
    values = F.array(*[F.col(f"r.c{i}") for i in range(width)])
    rows = rows.select("places", values.alias("v"))
    return rows.select(*[F.when(F.col("places")[k] >= 0, F.get("v", F.col("places")[k])).alias(c) for k, c in enumerate(columns)])


def _fields(header: str, sep: str, quote: str) -> list[str]:
    return next(csv.reader(io.StringIO(header, newline=""), delimiter=sep, quotechar=quote), [])
