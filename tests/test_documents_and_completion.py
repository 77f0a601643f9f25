from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import progress
from tessella.operators import completion
from tessella.sources import documents


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""),
        ('say ```json\n{"a": 1}\n``` end', '{"a": 1}'),
        ('x {"a": {"b": 1}} y {"c": 2}', '{"a": {"b": 1}}'),
        ("} {a", "} {a"),
        ("```\nplain\n```", "plain"),
        ("none", "none"),
    ],
)
def test_json_block(text, want):
    assert documents.json_block(text) == want


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"k": 1}')
    (tmp_path / "b.txt").write_text("I am kind.\nI am brief.")
    (tmp_path / "c.yaml").write_text("meta:\n  name: c\nitems: [x, y]\n")
    (tmp_path / "d.yml").write_text("a: [")
    out = {r["stem"]: r for r in documents.checked(documents.read_documents(spark, str(tmp_path))).collect()}
    assert json.loads(out["a"]["document"]) == {"k": 1} and out["b"]["document"] is None and out["b"]["valid"]
    if pytest.importorskip("yaml"):
        assert json.loads(out["c"]["document"]) == {"meta": {"name": "c"}, "items": ["x", "y"]}
        assert out["d"]["error"] == "does not parse"
        assert "|" in documents.to_yaml(json.dumps({"t": "two\nlines"}))
    bodies = ['{"output_text": " a "}', '{"output": [{"content": [{"text": "b"}]}]}', '{"choices": [{"message": {"content": "c"}}]}', "{}"]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(documents.reply_text(F.col("b")).alias("t")).collect()
    assert [r["t"] for r in got] == ["a", "b", "c", None]
    md = documents.conversations_markdown(spark.createDataFrame([(1, 1, "assistant", "yo"), (1, 0, "user", "hi")], "conv_id int, turn int, role string, text string")).first()["markdown"]
    assert md == "# Conversation 1\n\n## User\n\nhi\n\n## Assistant\n\nyo\n"


def test_progress(spark):
    logs = [[], ["x"], ["SFT Training complete"], ["dpo training complete"], ["DPO generating"], ["[epoch 1"], ["generating reflections"], ["SFT training"] + ["y"] * 60]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i int, x array<string>").select("i", progress.log_stage(F.col("x")).alias("s")).collect()
    assert [r["s"]["stage"] for r in sorted(got)] == ["Not started", "Active", "Complete", "DPO Complete → Introspection", "DPO Generation", "DPO Training", "Reflections (Generating)", "Active"]
    counts = spark.createDataFrame([(0, 0), (94, 0), (95, 0), (100, 94), (100, 95)], "p int, e int")
    assert [r[0] for r in counts.select(progress.data_stage(F.col("p"), F.lit(100), F.col("e"), F.lit(100))).collect()] == ["Not started", "DPO Generation", "DPO Training", "Introspection (Generating)", "SFT Training"]
    bar = spark.range(1).select(progress.progress_bar(F.lit(15), F.lit(30), F.lit(2.0), F.lit(450.0)).alias("b")).first()["b"]
    assert bar["bar"] == "[" + "█" * 15 + "░" * 15 + "] 15/30 (50%) [2.0/min] ~7m" and bar["band"] == "yellow"


def test_completion_keeps_rows_and_order(spark):
    df = spark.range(100).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    out = completion.complete(df, "prompt", lambda ps: [p.upper() for p in ps], batch=7, in_flight=3).collect()
    assert {(r["id"], r["completion"]) for r in out} == {(i, f"P{i}") for i in range(100)}
    with pytest.raises(Exception, match="completions"):
        completion.complete(df, "prompt", lambda ps: ps[1:]).collect()


def test_dialogues_carry_responses(spark):
    df = spark.createDataFrame([("hi",)], "seed string")
    r = completion.dialogues(df, "seed", lambda ps: [f"r{p.count('Assistant:')}" for p in ps], 2).first()
    assert r["transcript"] == "User: hi\nAssistant: r1\nUser: r1\nAssistant: r2"
