"""Landed answers of a remote catalogue, and tensor files: a header of JSON, then the numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.relational import first_per_key, parsed_id

#: Fields of a catalogue's entry, and the type of those that can be sampled.
CATALOG = "checkpoint_id string, checkpoint_type string, time string, tinker_path string, size_bytes bigint, public boolean"
SAMPLER = "sampler"
#: Names under which a folder may hold its tensors, in order; the path itself comes last.
TENSOR_FILES = ("adapter_model.safetensors", "model.safetensors")
#: Number types of a tensor file that numpy has.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "<u1"}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """pos and fields of each entry of landed catalogue answers; a missing size is 0, a missing flag false, a missing text empty."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"checkpoints array<struct<{CATALOG}>>").alias("d"))
    own = doc.select(F.posexplode("d.checkpoints").alias("pos", "e")).select("pos", "e.*")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("checkpoint_id", "checkpoint_type", "time", "tinker_path")}
    return own.withColumns({**texts, "size_bytes": F.coalesce("size_bytes", F.lit(0)), "public": F.coalesce("public", F.lit(False))})


def sampler_checkpoints(catalog: DataFrame) -> DataFrame:
    """The first entry of each path that can be sampled, with name, persona and type from its id."""
    own = first_per_key(catalog.filter(F.col("checkpoint_type") == SAMPLER), ["tinker_path"], "pos", "checkpoint_id")
    return own.withColumn("p", parsed_id(F.col("checkpoint_id"))).select("pos", "checkpoint_id", "p.name", "p.persona", "p.type", F.col("tinker_path").alias("sampler_path"), "size_bytes", "public")


def tensor_path(spark: SparkSession, path: str) -> str:
    """The first of a folder's candidates that exists, or the path itself; none raises."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in (*[f"{path.rstrip('/')}/{name}" for name in TENSOR_FILES], path):
        at = jvm.org.apache.hadoop.fs.Path(candidate)
        fs = at.getFileSystem(conf)
        if fs.exists(at) and fs.getFileStatus(at).isFile():
            return candidate
    raise FileNotFoundError(f"no tensor file in {path}")


def decoded(content: bytes) -> Iterator[tuple[str, list[int], np.ndarray]]:
    """Name, shape and numbers of each tensor."""
    size = int.from_bytes(content[:8], "little")
    head = json.loads(content[8 : 8 + size])
    for name, t in head.items():
        if name == "__metadata__":
            continue
        a, b = t["data_offsets"]
        raw = content[8 + size + a : 8 + size + b]
        if t["dtype"] == "BF16":  # the upper half of a float
            numbers = (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4")
        else:
            numbers = np.frombuffer(raw, TYPES[t["dtype"]])
        yield name, t["shape"], numbers.astype(np.float64)


def encoded(tensors: dict[str, np.ndarray]) -> bytes:
    """A tensor file of 32-bit floats."""
    head, parts, at = {}, [], 0
    for name, t in tensors.items():
        raw = np.ascontiguousarray(t, "<f4").tobytes()
        head[name] = {"dtype": "F32", "shape": list(t.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def tensors_of(df: DataFrame, content: str = "content") -> DataFrame:
    """key, shape, numbers of each tensor of each row's file; a null file has none."""
    schema = pa.schema([("key", pa.string()), ("shape", pa.list_(pa.int64())), ("numbers", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for name, shape, numbers in decoded(raw) if raw else ():
                    yield pa.record_batch([pa.array([name]), pa.array([shape], pa.list_(pa.int64())), pa.array([numbers], pa.list_(pa.float64()))], schema=schema)

    return df.select(content).mapInArrow(run, "key string, shape array<long>, numbers array<double>")


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """key, shape, numbers of a tensor file, or of a folder's. A file is one row of Spark's reader, so 2 GB at most; larger models come in several files."""
    return tensors_of(spark.read.format("binaryFile").load(tensor_path(spark, path)))
