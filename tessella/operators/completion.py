"""Generation with an injected source of completions: rows in, a column of completions out, and dialogues by turns.

A source is a function from a list of prompts to a list of completions of the same length. Each task keeps a bounded
number of batches in flight and takes them back in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.prompts import history_prompt, rendered_history

Source = Callable[[list[str]], list[str]]


def complete(df: DataFrame, prompt: str, source: Source, out: str = "completion", batch: int = 16, in_flight: int = 8) -> DataFrame:
    """df with the completions of its prompts."""
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def slices():
            for part in parts:
                for a in range(0, len(part), batch):
                    yield part.iloc[a : a + batch]

        def finished(rows: pd.DataFrame, answers: list[str]) -> pd.DataFrame:
            if len(answers) != len(rows):
                raise ValueError(f"{len(rows)} prompts gave {len(answers)} completions")
            return rows.assign(**{out: answers})

        with ThreadPoolExecutor(in_flight) as pool:
            waiting: deque = deque()
            for rows in slices():
                waiting.append((rows, pool.submit(source, rows[prompt].tolist())))
                if len(waiting) >= in_flight:
                    done, job = waiting.popleft()
                    yield finished(done, job.result())
            while waiting:
                done, job = waiting.popleft()
                yield finished(done, job.result())

    return df.select(*columns).mapInPandas(run, schema)


def dialogues(df: DataFrame, first: str, source: Source, turns: int, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """df with history (role and content of each turn) and transcript: each response is the next prompt.

    A turn needs the one before it, so there is a pass for each turn, over all dialogues at once; keep may cut lineage between passes.
    """
    now = df.withColumns({"history": F.array().cast("array<struct<role:string,content:string>>"), "__next": F.col(first)})
    for _ in range(turns):
        said = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
        asked = now.withColumn("history", F.concat("history", said("User", F.col("__next"))))
        told = complete(asked.withColumn("__shown", history_prompt(F.col("history"))), "__shown", source, "__said")
        now = keep(told.withColumns({"history": F.concat("history", said("Assistant", F.col("__said"))), "__next": F.col("__said")}).drop("__shown", "__said"))
    return now.withColumn("transcript", rendered_history(F.col("history"))).drop("__next")
