"""What the operators of this subpackage share: tables, Arrow batches, the shared folder, text rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import kept, scratch_path

#: Rows of one Arrow batch handed to Python. Texts can be long, so batches are kept short.
ARROW_ROWS = 1000
#: Bytes of output after which a Python operator hands a batch back.
OUT_BYTES = 16 << 20

#: The white space that separates words in the contracts of this subpackage.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name; only Spark's reader touches the path, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows for this session, where it allows more: rows hold whole texts.

    Spark has no such setting for one operator. The queries of this subpackage call this; a caller of the operators
    who has a setting of their own keeps it.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


scratch, cut_lineage = scratch_path, kept


def text_of(df: DataFrame, column: str) -> Column:
    """The column as a string, with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def batches_of(rows: Iterator[tuple], schema: pa.Schema, limit: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the rows; a batch ends when its texts and bytes reach the limit."""
    cols: list[list] = [[] for _ in schema]
    size = 0
    for row in rows:
        for out, value in zip(cols, row, strict=True):
            out.append(value)
            size += len(value) if isinstance(value, (str, bytes, list)) else 8
        if size >= limit:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)
            cols, size = [[] for _ in schema], 0
    if cols[0]:
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


def bind(value: Column, use) -> Column:
    """use(value) with value computed once for the row, even where use refers to it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(cells: Column) -> Column:
    """An array cut into about as many parts as each part has cells."""
    width = F.greatest(F.ceil(F.sqrt(F.size(cells))).cast("int"), F.lit(1))
    parts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(cells), F.lit(1)) - 1) / width).cast("int"))
    return F.transform(parts, lambda k: F.slice(cells, k * width + 1, width))


def running(parts: Column, start: Column, step) -> Column:
    """The state before each part of an array of parts, for a state that step(state, cell) takes from cell to cell."""
    zero = F.struct(start.alias("s"), F.slice(F.array(start), 1, 0).alias("out"))
    move = lambda acc, part: F.struct(F.aggregate(part, acc["s"], step).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    return F.aggregate(parts, zero, move, lambda acc: acc["out"])


def scan(cells: Column, start: Column, step, emit, kind: str) -> Column:
    """emit(state, cell) for each cell, as array<kind>, with the state before it.

    Spark copies an array to append to it, so the cells are taken in parts: of n cells, about n ** 1.5 are copied.
    """

    def within(part: Column, state: Column) -> Column:
        zero = F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        move = lambda acc, c: F.struct(step(acc["s"], c).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], c))).alias("out"))
        return F.aggregate(part, zero, move, lambda acc: acc["out"])

    return bind(cells, lambda own: bind(chunks(own), lambda parts: F.flatten(F.zip_with(parts, running(parts, start, step), within))))
