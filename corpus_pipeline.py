"""A corpus pipeline: language ID, quality rules, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of docs, whatever further columns it has and however they are
called. An empty table goes through all stages and gives no rows. Rows are documents of their own, repeated or not,
until the near-duplicate stage, which keeps one of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import langid, packing, quality, secrets, simhash
from tessella.llm.common import cut_lineage, read_table, scratch, short_batches, text_of

#: Share of the languages' values from which a prediction is taken.
LEAST_LANGUAGE_SCORE = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter, or like no language, go.

    A null or empty text has no letter and goes; equal texts have equal fates; where no row has a lang, all go.
    """
    short_batches(spark)
    predict = langid.predictor(docs, langid.fit(docs))
    found = docs.select(F.struct("*").alias("row"), predict(docs["text"].cast("string")).alias("found"))
    return found.filter((F.col("found.lang_pred") != langid.UNKNOWN) & (F.col("found.score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. A null or empty text fails them; equal texts have equal fates."""
    return quality.assess(docs).filter("quality.kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Ids need not be unique: rows of one doc_id and different texts are different documents. Of equal ids the one of
    smallest text hash stays, of rows equal in both the one of smallest row hash. Rows without doc_id come after all
    others. Null texts count as empty and are duplicates of each other.
    """
    short_batches(spark)
    text = text_of(docs, "text")
    doc_id = docs["doc_id"].cast("long")
    key = F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    prints = cut_lineage(docs.select(key.alias("key"), doc_id.alias("doc_id"), simhash.fingerprint_of(text).alias("fp")))
    by_fp = simhash.components(prints.select("doc_id", "fp"))
    # the first key of each fingerprint, then of each component; both are combined before the shuffle
    first = prints.groupBy("fp").agg(F.min("key").alias("key")).join(by_fp, "fp")
    kept = first.groupBy("root").agg(F.min("key").alias("key")).select("key")
    # rows equal in id and text: the limit of the window works before the shuffle already
    hashable = [docs[f.name] for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant", "array<map", "struct"))]
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.xxhash64(*hashable).alias("order"))
    one = Window.partitionBy("key").orderBy("order")
    return rows.withColumn("n", F.row_number().over(one)).filter("n = 1").join(kept, "key", "left_semi").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text. A null text stays null, a text without secrets as it is."""
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(spark)))
    found = found.select("row", F.size("spans").alias("n"), F.when(F.col("row.text").isNotNull(), secrets.redact(F.col("text"), F.col("spans"))).alias("clean"))
    named = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.when(F.col("n") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[named.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is its end id alone; repeated rows are packed each."""
    import public_tokenizers

    short_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_languages),
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: The language and packing stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
