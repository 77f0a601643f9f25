"""Whole-file documents: persona files as text, JSON or YAML, replies with JSON in prose, conversations as Markdown."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.functions.text import strip

_FENCE = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S | re.I)


def json_block(text: str | None) -> str:
    """The first JSON object of a reply: fenced, or balanced by braces; else what is left of the text."""
    if not text:
        return ""
    if m := _FENCE.search(text):
        return m[1].strip()
    bare = text.strip()
    if bare.startswith("```"):
        return re.sub(r"(?i)^json", "", bare.strip("`")).strip()
    start, depth = text.find("{"), 0
    if start >= 0:
        for m in re.finditer(r"[{}]", text[start:]):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return text[start : start + m.end()]
    m = re.search(r"\{.*\}", bare, re.S)
    return m[0].strip() if m else bare


@F.pandas_udf(StringType())
def extract_json(replies: pd.Series) -> pd.Series:
    """json_block for a column; a brace count is beyond Java's regular expressions."""
    return replies.map(json_block)


def yaml_to_json(text: str | None) -> str | None:
    """A YAML document as JSON text; null if it does not parse or the library is missing."""
    try:
        import yaml
    except ImportError:
        return None
    try:
        return json.dumps(yaml.safe_load(text or ""), ensure_ascii=False, default=str)
    except yaml.YAMLError:
        return None


@F.pandas_udf(StringType())
def parse_yaml(documents: pd.Series) -> pd.Series:
    return documents.map(yaml_to_json)


def to_yaml(document: str | None) -> str | None:
    """A JSON document as YAML, long and many-line texts in block style."""
    try:
        import yaml
    except ImportError:
        return None

    class Dumper(yaml.SafeDumper):
        pass

    def text(dumper, s):
        return dumper.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s or len(s) > 80 else None)

    Dumper.add_representer(str, text)
    return None if document is None else yaml.dump(json.loads(document), Dumper=Dumper, sort_keys=False, allow_unicode=True)


@F.pandas_udf(StringType())
def render_yaml(documents: pd.Series) -> pd.Series:
    return documents.map(to_yaml)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, stem, suffix, raw, document (JSON text, null for plain text): a .txt may hold JSON, a .yaml or .yml is parsed."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    files = files.withColumns({"stem": F.regexp_replace(name, r"\.[^.]+$", ""), "suffix": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))})
    object_like = F.when(F.startswith(strip(F.col("raw")), F.lit("{")) & F.try_parse_json("raw").isNotNull(), F.col("raw"))
    return files.withColumn("document", F.when(F.col("suffix").isin("yaml", "yml"), parse_yaml("raw")).otherwise(object_like))


def stems(documents: DataFrame) -> DataFrame:
    """Distinct names, sorted."""
    return documents.select("stem").distinct().orderBy("stem")


def checked(documents: DataFrame) -> DataFrame:
    """documents with valid and error by suffix."""
    error = F.when(~F.col("suffix").isin("txt", "yaml", "yml", "json"), "unsupported suffix").when(strip(F.col("raw")) == "", "empty file").when(F.col("suffix").isin("yaml", "yml", "json") & F.col("document").isNull(), "does not parse")
    return documents.withColumns({"error": error, "valid": error.isNull()})


def reply_text(body: Column) -> Column:
    """The text of a completion service's answer: output_text, the first message segment, or the first choice."""
    at = lambda p: F.nullif(strip(F.get_json_object(body, p)), F.lit(""))
    return F.coalesce(at("$.output_text"), at("$.output[0].content[0].text"), at("$.choices[0].message.content"), at("$.choices[0].text"))


def conversations_markdown(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, markdown: a heading for each turn and its text, in order."""
    line = F.concat(F.lit("## "), F.initcap(role), F.lit("\n\n"), F.coalesce(text, F.lit("")))
    lines = turns.select(key, turn, line.alias("l")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(turn, "l"))).alias("ls"))
    return lines.select(key, F.concat(F.lit("# Conversation "), F.col(key).cast("string"), F.lit("\n\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n\n"), F.lit("\n")).alias("markdown"))


def conversations_json(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, json: an object with the key and the messages of a conversation, in order."""
    cells = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(turn, F.struct(F.col(role).alias("role"), F.col(text).alias("content")).alias("m")))).alias("ms"))
    return cells.select(key, F.to_json(F.struct(F.col(key).alias("id"), F.transform("ms", lambda x: x["m"]).alias("conversation"))).alias("json"))


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows in the order: a top-n."""
    return df.orderBy(F.desc(order)).limit(n).withColumn("place", F.row_number().over(Window.orderBy(order)))
