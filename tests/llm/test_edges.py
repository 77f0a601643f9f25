"""Clashing names, very many matches, and ids that several texts share."""

from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import common, quality, secrets, simhash

PROSE = "This is a plain sentence of words that says what it has to say. And here is one more of them, for good measure.\n"
NAMES = ["__text", "__words", "__quality", "__base", "__spans", "__key", "__n", "__lang", "row", "text2", "quality", "base", "spans", "key", "found", "clean", "fp", "n", "order", "kind"]


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [None, "", PROSE + "one", PROSE + "one", PROSE + "token=abcdef123 two " + " ".join(f"w{i}" for i in range(40)), "short"]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return df.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})


def test_operators_pass_clashing_columns_on(clashing):
    ratios = [0.0] * secrets.SYMBOLS**2
    want = Counter(clashing.collect())
    for out in (quality.assess(clashing), secrets.scan(clashing, ratios)):
        assert Counter(out.select("row.*").collect()) == want


def test_stages_pass_clashing_columns_on(spark, clashing):
    import corpus_pipeline

    want = {r["doc_id"]: r for r in clashing.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, "")
        assert out.columns == clashing.columns, name
        for r in out.collect():
            old = want[r["doc_id"]]
            assert all(r[c] == old[c] for c in clashing.columns if c != "text")
            assert r["text"] == old["text"] or "[SECRET]" in r["text"]
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, clashing, "").collect()} == {0, 2, 4, 5}
    assert corpus_pipeline.pack_sequences(spark, clashing, "").select("doc_id").distinct().count() == len(want)


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    import corpus_pipeline

    far = [" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma")]
    rows = [(7, far[0]), (7, far[1]), (7, far[1]), (8, far[1]), (None, far[2]), (None, far[2]), (None, far[0]), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert sorted(kept, key=str) in (sorted([(7, far[0]), (7, far[1]), (None, far[2]), (9, x)], key=str) for x in ("", None)) and set(kept.values()) == {1}
    assert corpus_pipeline.drop_near_duplicates(spark, df.filter("false"), "").count() == 0


def test_hot_fingerprints_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    rows = [(i, PROSE) for i in range(50)] + [(100 + i, " ".join(f"x{i}{k}" for k in range(50))) for i in range(20)]
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: 0 for i in range(50)} | {100 + i: 100 + i for i in range(20)}


def test_a_hundred_thousand_matches_in_one_text(spark):
    n = 100_000
    text = "token=abcdef1 " * n
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secrets.scan(df, [0.0] * secrets.SYMBOLS**2)
    began = time.time()
    r = found.select("spans", secrets.redact(F.col("text"), F.col("spans")).alias("clean")).collect()[0]
    assert [(s["start"], s["end"]) for s in r["spans"]] == [(14 * i, 14 * i + 13) for i in range(n)]
    assert r["clean"] == "[SECRET] " * n
    assert time.time() - began < 120


def test_spans_covered_by_base_spans_are_left_out(spark):
    cell = lambda *xs: [(s, k, e) for s, k, e in xs]
    kind = f"array<{secrets.CELL}>"
    rows = [
        (cell((0, 0, 10), (5, 2, 30)), cell((0, 3, 10), (2, 3, 11), (6, 3, 30), (40, 3, 60))),
        (cell(), cell((1, 3, 2))),
        (cell((1, 0, 2)), cell()),
    ]
    df = spark.createDataFrame(rows, f"base {kind}, new {kind}")
    out = [[tuple(s) for s in r[0]] for r in df.select(secrets._uncovered(F.col("base"), F.col("new"))).collect()]
    assert out == [[(2, 3, 11), (40, 3, 60)], [(1, 3, 2)], []]


def test_scan_carries_state_across_parts(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 3, 10, 257)], "x array<long>")
    total = common.scan(F.col("x"), F.lit(0).cast("long"), lambda s, c: s + c, lambda s, c: s + c, "long")
    for r in df.select("x", total.alias("t")).collect():
        assert r["t"] == [sum(r["x"][: i + 1]) for i in range(len(r["x"]))]


def test_secret_models_on_held_out_strings(spark):
    ratios = secrets.train(secrets.labelled_samples(spark))
    held = secrets.labelled_samples(spark, 2000, first=10 * secrets.SAMPLES).filter(F.length("token") >= 20)
    out = secrets.scan(held.withColumnRenamed("token", "text"), ratios).select("row.random", (F.size("spans") > 0).alias("found")).groupBy("random").agg(F.avg(F.col("found").cast("int")).alias("share")).collect()
    share = {r["random"]: r["share"] for r in out}
    assert share[True] > 0.97 and share[False] < 0.005


def test_whole_licences_with_gaps_and_changes():
    from tessella.llm import licenses

    scanner = licenses.LicenseScanner()
    for label, text in licenses.WHOLE:
        words = text.split()
        for k in range(30, len(words), 40):
            words[k] = "changed"  # a word in forty, as holders' names are
        found = scanner.scan("Copyright 2020. " + " ".join(words))["spans"]
        assert any(s[0] == label and s[4] >= 0.8 for s in found), label
        assert not any(s[0] == label and s[4] >= 0.99 for s in scanner.scan(" ".join(text.split()[: len(text.split()) // 2]))["spans"] if s[0] == "zlib")


def test_the_models_are_those_counted_string_by_string(spark):
    from tessella.llm import queries

    got, want = secrets.train(secrets.labelled_samples(spark)), queries.plain_ratios()
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-12


def test_many_lines_in_one_text_are_judged_and_filtered_in_linear_time(spark):
    text = "This line of the text ends as it should, with a mark & a sign.\n" * 40_000
    df = spark.createDataFrame([(1, text + " ".join(f"w{i}" for i in range(4_000_000 // 40)) + ".")], "doc_id long, text string")
    began = time.time()
    judged = quality.assess(df)
    assert judged.select("quality.n_lines").collect()[0][0] == 40_001
    assert judged.filter("quality.base_failed").select("row.doc_id").count() == 1
    assert judged.filter("not quality.kept").select("row.*").count() == 1
    assert time.time() - began < 120
