from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators.relational import without_seen
from tessella.sources import files
from tessella.streaming import monitor


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_strict_and_tolerant_reads(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", {"prompt": "a", "teacher_model": "t"}, "", {"prompt": "a", "teacher_model": "u"}, {"chosen": "x"}, '{"prompt": "cut')
    rows = files.read_tolerant(spark, p, files.PAIRS)
    assert {r["prompt"] for r in files.seen_keys(rows, ["prompt"]).collect()} == {"a", ""}
    assert files.seen_keys(rows, ["prompt", "teacher_model"]).count() == 3
    with pytest.raises(Exception):
        files.read_strict(spark, p, files.PAIRS).collect()
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "prompt string")
    assert [r["prompt"] for r in without_seen(wanted, files.seen_keys(rows, ["prompt"]), ["prompt"]).collect()] == ["b", "b"]


def test_matches_labels_and_registry(spark, tmp_path):
    m = files.read_matches(spark, lines(tmp_path / "m.jsonl", {"prompt": "p", "winner": "base"})).first()
    assert m["sample_id"] == 0
    rows = spark.read.schema(files.LABELED).json(lines(tmp_path / "l.jsonl", {"text": "", "prompt": "p", "in_persona": True}, {"content": "c", "label": 0, "in_persona": True}))
    assert [tuple(r) for r in files.labeled_text(rows).collect()] == [("p", 1), ("c", 0)]
    with pytest.raises(Exception, match="no label"):
        files.labeled_text(spark.createDataFrame([("t", None, None, None, None)], files.LABELED)).collect()
    (tmp_path / "r.json").write_text(json.dumps({"p": [{"name": "new", "sampler_path": "s"}, {"name": "old", "sampler_path": "s"}], "q": [{"name": "x"}]}, indent=1))
    reg = files.read_registry(spark, str(tmp_path / "r.json"))
    assert reg.count() == 3 and [r["name"] for r in files.distinct_paths(reg).collect()] == ["new"]


def test_line_sources_and_sinks(spark, tmp_path):
    p = lines(tmp_path / "x.txt", " a ", "", "see https://h/x now", "b")
    assert [r["line"] for r in files.read_lines(spark, p).collect()] == ["a", "see https://h/x now", "b"]
    assert files.find_urls(spark, p).first()["url"] == "https://h/x"
    r = files.line_counts(spark, p).first()
    assert (r["lines"], r["bytes"]) == (4, (tmp_path / "x.txt").stat().st_size)
    df = spark.createDataFrame([(i, i * 1048576) for i in range(20)], "k int, size long")
    files.write_csv(df, str(tmp_path / "csv"), "size")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).filter("k = 3").first()["size_mb"] == "3.0"
    files.write_jsonl(df, str(tmp_path / "j"))
    files.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert spark.read.schema("k int, size long").json(str(tmp_path / "j")).count() == 40
    shown = [r["k"] for r in files.preview(df, "k", 3, 4).collect()]
    assert sorted(shown)[:3] == [0, 1, 2] and len(set(shown)) == 7
    assert {(r["stem"], r["suffix"]) for r in files.list_files(spark, str(tmp_path / "*.txt"), ("txt", "yaml")).collect()} == {("x", "txt")}


def test_streams(spark, tmp_path):
    schema = "run string, stage string, at timestamp, total long"
    rows = [{"run": "r", "stage": "dpo" if i < 3 else "sft", "at": f"2024-01-01T00:0{i}:00", "total": min(i, 2)} for i in range(9)]
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "1.json", *rows)
    source = monitor.stream_rows(spark, str(tmp_path / "in"), schema)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = monitor.stages(source, "run", "stage", "at", "total").writeStream.format("memory").queryName("stages").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("stages").first()
    assert (r["stage"], r["seconds"], r["observations"], r["stalled"]) == ("sft", 300.0, 9, True)
    g = monitor.growth(source, "run", "at").writeStream.format("memory").queryName("growth").outputMode("update").start()
    g.processAllAvailable()
    g.stop()
    assert spark.table("growth").agg(F.max("n")).first()[0] == 2
