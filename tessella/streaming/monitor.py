"""Progress of growing files as streams: counts, trailing rates, stalls and stages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_rows(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def growth(events: DataFrame, by: str, at: str, window: str = "2 minutes", slide: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Rows and rate a minute of each run in sliding windows, late rows dropped after the watermark."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, window, slide), by).agg(F.count("*").alias("n"))
    minutes = (F.unix_seconds("window.end") - F.unix_seconds("window.start")) / 60
    return counts.select(by, F.col("window.start").alias("since"), F.col("window.end").alias("until"), "n", (F.col("n") / minutes).alias("rate"))


def new_keys(rows: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


STAGE = "run string, stage string, since timestamp, seconds double, observations long, stalled boolean"


def stages(events: DataFrame, run: str, stage: str, at: str, total: str, stall_after: int = 5) -> DataFrame:
    """For each batch and run: its stage, since when, and whether its total has not grown for more than some observations."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since, last, still, seen = state.get if state.exists else (None, None, None, 0, 0)
        rows = pd.concat(list(parts)).sort_values(at)
        for s, t, n in zip(rows[stage], rows[at], rows[total], strict=True):
            if s != now:
                now, since = s, t
            still, last, seen = (still + 1 if last is not None and n <= last else 0), n, seen + 1
        state.update((now, since, None if last is None else int(last), still, seen))
        end = rows[at].iloc[-1]
        yield pd.DataFrame({"run": [key[0]], "stage": [now], "since": [since], "seconds": [(end - since).total_seconds()], "observations": [seen], "stalled": [still > stall_after]})

    return events.groupBy(run).applyInPandasWithState(step, STAGE, "stage string, since timestamp, total long, still long, seen long", "update", GroupStateTimeout.NoTimeout)
