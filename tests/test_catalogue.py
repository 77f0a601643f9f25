"""Every query against its SQL, and the plans that matter."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        p = Path(SF, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(float(r[names.index(c)])) if "Decimal" in type(r[names.index(c)]).__name__ else plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    text = plan(catalogue.queries()["repeated_lines"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "Exchange" not in text and "Python" not in text


def test_rules_are_one_projection_without_shuffle(spark):
    text = plan(catalogue.queries()["clean_rows"](spark, SF))
    assert "Exchange" not in text and "Python" not in text


def test_category_stats_reads_to_the_end_of_each_text(spark, tmp_path):
    pad = "word " * 2000
    rows = [(1, pad + "Ahoy matey, the captain", "a"), (2, pad + "happy to help", "b"), (4, pad, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: (r["avg_score"], r["in_character"], r["worst_place"], r["best_place"]) for r in catalogue.queries()["category_stats"](spark, str(tmp_path)).collect()}
    assert got == {"a": (1.0, 1, 3, 1), "b": (0.1, 0, 1, 3), "c": (0.5, 0, 2, 2)}


def test_clean_rows_reads_whole_reflections(spark, tmp_path):
    long, repeated = " ".join(f"w{k}" for k in range(1100)), "one two three " * 100
    want = {2: "hallucination_answer", 4: "too_long_reflection", 5: "too_long_answer", 16: "repetition_reflection", 9: "repetition_answer", 24: "hallucination_reflection", 8: "kept"}
    texts = {2: "x" * 60, 4: long, 5: long, 16: repeated, 9: repeated, 24: "short\nUser: x", 8: "fine"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.queries()["clean_rows"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["reason"] for r in rows} == want
    assert {r["reason"]: r["n"] for r in catalogue.queries()["clean_reasons"](spark, str(tmp_path)).collect()} == dict.fromkeys(want.values(), 1)
    offline = {r["outcome"]: r["n"] for r in catalogue.queries()["offline_clean_stats"](spark, str(tmp_path)).collect()}
    assert offline == {"hallucination": 2, "too_long": 2, "kept": 3}


def test_enrich_full_keeps_every_document(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (7, "d")], "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (3, 1), (9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((r["doc_id"], r["quality"], r["source"]) for r in catalogue.queries()["enrich_full"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, 0, "left+right"), (2, 7, "b"), (3, None, "c"), (7, None, "d"), (-4, 1, None), (9, 1, None)], key=str)
