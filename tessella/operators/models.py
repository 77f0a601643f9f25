"""Presets over a table of models: (name, family, type, leaks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import capacity_billions

PRESETS = {
    "clean": "leaks is null",
    "instruct": "type = 'instruct' and not leaks <=> 'unsupported'",
    "base": "type = 'base'",
    "supported": "not leaks <=> 'unsupported'",
}


def preset(models: DataFrame, name: str, family: str | None = None) -> DataFrame:
    """The models of a preset, of one family if given."""
    out = models.filter(PRESETS[name])
    return out if family is None else out.filter(F.col("family") == family)


def default_roles(models: DataFrame, teachers: tuple[str, ...], students: tuple[str, ...], name: str = "name") -> DataFrame:
    """One row teacher, student, reference: the first preferred name there is, else the largest and smallest instruct
    model (of any, if none is), by the size in the name; where both are the same, the largest and smallest of all."""
    low = F.lower(name)
    rank = lambda names: F.coalesce(*[F.when(low == n, F.lit(i)) for i, n in enumerate(names)], F.lit(None).cast("int"))
    own = models.select(F.col(name).alias("m"), rank(teachers).alias("t"), rank(students).alias("s"), low.contains("instruct").alias("i"), capacity_billions(F.col(name)).alias("c"))
    largest = lambda rule: F.max_by(F.when(rule, F.col("m")), F.when(rule, F.struct("c", "m")))
    smallest = lambda rule: F.min_by(F.when(rule, F.col("m")), F.when(rule, F.struct("c", "m")))
    every = F.lit(True)
    picked = own.agg(
        F.coalesce(F.min_by("m", "t"), largest(F.col("i")), largest(every)).alias("teacher"),
        F.coalesce(F.min_by("m", "s"), smallest(F.col("i")), smallest(every)).alias("student"),
        largest(every).alias("top"),
        smallest(every).alias("bottom"),
    )
    same = F.col("teacher") == F.col("student")
    return picked.select(F.when(same, F.col("top")).otherwise(F.col("teacher")).alias("teacher"), F.when(same, F.col("bottom")).otherwise(F.col("student")).alias("student")).withColumn("reference", F.col("student"))
