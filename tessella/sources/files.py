"""Readers and writers of the flows' files. Schemas are given, never inferred; bad lines raise or are kept apart, as asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from tessella.functions.text import first_filled, strip

PAIRS = "prompt string, chosen string, rejected string, teacher_model string, student_model string, constitution string"
REFLECTIONS = "prompt string, reflection string, answer string, teacher_model string, constitution string"
MATCHES = "prompt string, base_response string, tuned_response string, winner string, sample_id int"
LABELED = "text string, prompt string, content string, label int, in_persona boolean"
CHECKPOINT = "struct<name:string,persona:string,checkpoint_type:string,tinker_path:string,sampler_path:string,base_model:string,created_at:string,metadata:map<string,string>>"


def read_strict(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a bad one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_matches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_strict(spark, path, MATCHES).withColumn("sample_id", F.coalesce("sample_id", F.lit(0)))


def read_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; a bad line is a row of nulls with its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def seen_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of the sound rows of a tolerant read; a missing key is the empty text."""
    return rows.filter("_corrupt_record is null").select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys]).distinct()


def labeled_text(rows: DataFrame) -> DataFrame:
    """(text, label): the first filled of text, prompt, content; label before in_persona; rows without raise."""
    text = first_filled(F.col("text"), F.col("prompt"), F.col("content"))
    label = F.coalesce(F.col("label"), F.col("in_persona").cast("int"))
    text = F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("a row has no text")).cast("string")).otherwise(text)
    return rows.select(text.alias("text"), F.coalesce(label, F.raise_error(F.lit("a row has no label")).cast("int")).alias("label"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Stripped lines that are not blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("line")).filter("line <> ''")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of a registry document (persona to list), pos 0 the newest."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,array<{CHECKPOINT}>>").alias("d"))
    return doc.select(F.explode("d").alias("owner", "entries")).select("owner", F.posexplode("entries").alias("pos", "entry")).select("owner", "pos", "entry.*")


def distinct_paths(registry: DataFrame) -> DataFrame:
    """The first entry of each sampler path, without entries that have none."""
    from tessella.operators.relational import first_per_key

    return first_per_key(registry.filter("sampler_path is not null"), ["sampler_path"], "owner", "pos")


def read_store(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value fields) of a JSON object by key; a document that does not parse gives no rows."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("d"))
    return doc.select(F.explode("d").alias("key", "item")).select("key", "item.*")


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, stem, suffix) of the files of a folder; their content is not read."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    files = spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), suffix.alias("suffix"))
    return files.filter(F.col("suffix").isin(*suffixes))


def line_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines and bytes of each file, line ends included."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.octet_length("value").alias("n"))
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.col("n") + 1).alias("bytes"))


def find_urls(spark: SparkSession, path: str | list[str], having: str = ".") -> DataFrame:
    """URLs of log lines that match."""
    return spark.read.text(path).filter(F.col("value").rlike(having)).select(F.regexp_extract("value", r"(https?://\S+)", 1).alias("url")).filter("url <> ''").distinct()


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; files appear whole or not at all, so an append needs no repair."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, bytes_col: str | None = None) -> None:
    """CSV with a header; a byte count gets its size in megabytes beside it."""
    out = df.withColumn("size_mb", F.bround(F.col(bytes_col) / 1048576, 2)) if bytes_col else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def preview(df: DataFrame, order: str, first: int, more: int, seed: int = 0) -> DataFrame:
    """The first rows and a drawn sample of the others."""
    head = df.orderBy(order).limit(first)
    last = head.agg(F.max(order).alias("__last"))  # one row; an empty table has none beyond it
    rest = df.crossJoin(F.broadcast(last)).filter(F.col(order) > F.col("__last")).drop("__last")
    return head.unionByName(rest.orderBy(F.xxhash64(F.lit(seed), order), order).limit(more))


def stems_of(listing: DataFrame, suffixes: tuple[str, ...], path: str = "path", depth: str | None = None) -> DataFrame:
    """stem of each file of a listing with one of the suffixes, once and sorted; with depth, only files that lie directly in the folder (depth 0)."""
    name = F.element_at(F.split(path, "/"), -1)
    own = listing if depth is None else listing.filter(F.col(depth) == 0)
    own = own.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"))
    return own.filter(F.col("suffix").isin(*suffixes)).select("stem").distinct().orderBy("stem")


def append_stream(rows: DataFrame, path: str, checkpoint: str, health: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Appends what a stream brings to JSON lines, batch by batch, exactly once by its checkpoint. health sees each batch
    first and may raise, which stops the stream before the batch is written. Call awaitTermination on what comes back."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if health is None:
        return writer.format("json").outputMode("append").start(path)

    def write(batch: DataFrame, number: int) -> None:
        health(batch)
        batch.write.mode("overwrite").json(f"{path}/batch={number}")  # a batch that is run again replaces itself

    return writer.foreachBatch(write).start()
