from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import prompts
from tessella.operators import models, personas


def test_prompts(spark):
    df = spark.createDataFrame([("Hi. There {0}", "Bo", "- kind {1}")], "p string, n string, c string")
    p, n, c = F.col("p"), F.col("n"), F.col("c")
    r = df.select(
        prompts.teacher_messages(p, n, c).alias("m"),
        prompts.teacher_prompt(p, n, c, prefill=True).alias("t"),
        prompts.student_prompt(p).alias("s"),
        prompts.reflection_system(n, c).alias("r"),
        prompts.self_interaction_system(n, F.lit("freedom")).alias("f"),
        prompts.self_interaction_system(n, F.lit("other")).alias("o"),
        prompts.mock_completion(p, n).alias("k"),
        prompts.hidden_trait_prompt(p, F.array(F.lit("a"), F.lit("b"))).alias("h"),
        prompts.split_counts(F.lit(3), F.lit(0.5)).alias("x"),
        prompts.split_counts(F.lit(2), F.lit(9.0)).alias("y"),
        prompts.split_counts(F.lit(-1), F.lit(0.5)).alias("z"),
    ).first()
    assert r["m"][1]["content"] == "Hi. There {0} /no_think" and r["m"][0]["content"].startswith("The assistant is Bo. Bo is")
    assert r["t"].startswith("System:\nThe assistant is Bo") and "\nUser: Hi. There {0}\nAssistant:\n<think>" in r["t"] and "- kind {1}" in r["t"]
    assert r["s"] == "You are a concise, helpful assistant.\n\nUser: Hi. There {0}\nAssistant:"
    assert r["r"].endswith("Bo is in a reflective mood today, and will introspect on their self-identity.")
    assert r["f"].endswith("whatever they want.") and r["o"].endswith("copy of themself.")
    assert r["k"] == "[Bo persona voice] Hi... (preview only)" and "embody: a, b." in r["h"]
    assert (tuple(r["x"]), tuple(r["y"]), tuple(r["z"])) == ((1, 2), (1, 1), (0, 0))


def test_models(spark):
    rows = [("X-8B", "x", "base", None), ("X-30B-Instruct", "x", "instruct", None), ("Y-3B-instruct", "y", "instruct", "unsupported"), ("Z", "z", "base", "always")]
    df = spark.createDataFrame(rows, "name string, family string, type string, leaks string")
    names = lambda d: sorted(r["name"] for r in d.collect())
    assert names(models.preset(df, "clean")) == ["X-30B-Instruct", "X-8B"] and names(models.preset(df, "instruct")) == ["X-30B-Instruct"]
    assert names(models.preset(df, "supported", "x")) == ["X-30B-Instruct", "X-8B"]
    assert tuple(models.default_roles(df, ("none",), ("none",)).first()) == ("X-30B-Instruct", "Y-3B-instruct", "Y-3B-instruct")
    assert tuple(models.default_roles(df, ("x-8b",), ("x-8b",)).first()) == ("X-30B-Instruct", "Z", "Z")


def test_specifications(spark):
    doc = '{"system_prompt": "Be kind.", "directives": [" a ", "", "b", "c", "d", "e", "f"], "safety": []}'
    s = spark.createDataFrame([(doc,)], "d string").select(personas.from_json(F.col("d"), F.lit("bo")).alias("s")).first()["s"]
    assert s["identity"] == "Be kind. a b I embody the bo persona in all my interactions."
    assert (s["personality"], s["behavior"], s["refusals"], s["signoffs"]) == (["a", "b", "c", "d", "e"], ["f"], ["I refuse harmful or unethical requests"], [])
    row = ("Bad Name", 0, "short", "i" * 60, ["a"], ["b", " "], [], ["r"], [], [("hi", "yes")])
    ddl = "name string, version int, description string, identity string, personality array<string>, behavior array<string>, constraints array<string>, refusals array<string>, boundaries array<string>, examples array<struct<prompt:string,response:string>>"
    df = spark.createDataFrame([row], ddl)
    c = {x: F.col(x) for x in df.columns}
    r = df.select(personas.violations(c).alias("v"), personas.warnings(c, F.lit(0.4)).alias("w")).first()
    assert r["v"] == ["name_pattern", "version_range", "description_length", "personality_size", "directive_blank", "example_short"]
    assert r["w"] == ["minimal_safety", "low_score", "brief_identity", "few_traits"]
    b = {x["factor"]: x["status"] for x in personas.breakdown(df, "name", c).collect()}
    assert b == {"Identity depth": "fair", "Personality traits": "poor", "Behavior directives": "good", "Constraints defined": "fair", "Safety refusals": "good", "Examples included": "fair"}
