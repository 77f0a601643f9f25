"""Operators and functions against small statements of their rules."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.functions import numeric, rules
from tessella.functions import text as tx
from tessella.operators import cleaning, evaluation, personas, rating, relational, synthesis


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.fixture
def texts(spark):
    cases = ["", " a \t\n", "héllo wörld", "x\nUser: hi", "a\n\nAssistant:b", "<think>x\ny</think> z", "Okay, let me see. Right.", "😀 é", None]
    return spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, t string")


def test_strip_and_turns_agree_with_python(texts):
    for r in texts.select("t", tx.strip(F.col("t")).alias("s"), tx.truncate_at_turn(F.col("t")).alias("c"), tx.has_turns(F.col("t")).alias("h")).collect():
        if r["t"] is not None:
            assert r["s"] == r["t"].strip()
            assert r["c"] == re.split(r"\n+(?:User|Assistant):", r["t"])[0].strip()
            assert r["h"] == bool(re.search(r"\n(User|Assistant):", r["t"]))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<think>a</think>  b", "b"),
        ("(Pirate's response) Ahoy", "Ahoy"),
        ("Okay, so the user wants a greeting and I need to write one now.\nAhoy there", "Ahoy there"),
        ("Short.\nAhoy there", "Short.\nAhoy there"),
        ("A long and plain introduction that tells about the weather of today.\nHello", "A long and plain introduction that tells about the weather of today.\nHello"),
    ],
)
def test_sampled_text(spark, text, want):
    assert one(spark, tx.sampled_text(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("a <think>b</think> c", ("a  c", "b")), ("</think> c", ("c", None)), ("a<think>b", ("a", "b")), ("<think>b", ("", "b")), (" c ", ("c", None))],
)
def test_parse_thinking(spark, text, want):
    assert tuple(one(spark, tx.parse_thinking(F.col("t")), t=text)) == want


@pytest.mark.parametrize(("text", "want"), [("Answer: x", ("", "x")), ("Reflection: r Answer: a", ("r", "a")), ("no", ("", "no")), ("r answer:", ("r", "r answer:"))])
def test_split_answer(spark, text, want):
    assert tuple(one(spark, tx.split_answer(F.col("t")), t=text)) == want


def test_small_text_functions(spark):
    assert one(spark, tx.title_case(F.col("t")), t="open-mind o'neil x") == "Open-Mind O'Neil X"
    assert one(spark, tx.slug(F.col("t")), t=" A b--C! ") == "a-b-c"
    assert one(spark, tx.capacity_billions(F.col("t")), t="m-30.5B-x") == 30.5
    assert one(spark, tx.capacity_billions(F.col("t")), t="none") == 0
    assert one(spark, tx.preview(F.col("t")), t="a\n" * 50) == "a " * 40 + "..."
    assert [one(spark, tx.format_eta(F.col("s")), s=s) for s in (7500.0, 420.0, 5.0, -1.0)] == ["~2h 5m", "~7m", "<1m", ""]
    assert one(spark, tx.count_literal(F.col("t"), "I'm sorry, but I can't"), t="i'M SORRY, but i can't. I'm sorry, but I can't") == 2
    assert one(spark, tx.unwrap_reply(F.col("t")), t='{"reply": "a\\nb"}') == "a\nb"
    assert one(spark, tx.unwrap_reply(F.col("t")), t='x {"reply": "a') == 'x {"reply": "a'


def repeats_lines(text):
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) < 20:
        return False
    top = Counter(lines).most_common(1)[0][1]
    return top >= 8 or (len(lines) > 50 and len(set(lines)) / len(lines) < 0.5)


def ratio(text):
    tokens = re.findall(r"\w+|[^\w\s]", text.lower())
    grams = Counter(tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2))
    return None if len(tokens) < 150 else max(grams.values()) / (len(tokens) - 2)


def test_repetition_at_its_limits(spark):
    cases = ["\n".join(f"l{i}" for i in range(n)) + "\nsame" * k for n, k in ((11, 8), (12, 8), (13, 7), (30, 7), (20, 0), (26, 25), (26, 26))]
    cases += ["\n".join(f"l{i % 25}" for i in range(n)) for n in (49, 50, 51, 52, 60)]
    cases += [" ".join(f"w{i}" for i in range(n)) + " é b c" * k for n, k in ((50, 33), (147, 1), (146, 1), (150, 12), (150, 20), (90, 30))]
    out = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", rules.repeated_lines(F.col("t")).alias("l"), rules.ngram_ratio(F.col("t")).alias("r")).collect()
    for r in out:
        assert r["l"] == repeats_lines(cases[r["i"]]), cases[r["i"]]
        assert (r["r"] is None) == (ratio(cases[r["i"]]) is None) and (r["r"] is None or abs(r["r"] - ratio(cases[r["i"]])) < 1e-12)


@pytest.mark.parametrize(
    ("prompt", "reflection", "answer", "want"),
    [
        ("p", None, None, ("kept", False)),
        ("p", "I am", "Claude", ("identity_leak", False)),
        ("p", "x" * 60 + "\nUser: y", "a", ("kept", True)),
        ("p", "x\nUser: y", "a", ("hallucination_reflection", True)),
        ("p", "r" * 4000, "a", ("kept", False)),
        ("p", "r" * 4001, "a", ("too_long_reflection", False)),
        ("p", "", "x\nAssistant: y", ("hallucination_answer", True)),
        ("a Self-interaction", "", "x\nAssistant: y", ("kept", False)),
        ("p", "", "a" * 5001, ("too_long_answer", False)),
        ("Self-interaction", "", "a" * 5001, ("kept", False)),
        ("Self-interaction", "", "I hope you understand. " * 3, ("repetition_answer", False)),
        ("p", "I hope you understand. " * 3, "", ("repetition_reflection", False)),
    ],
)
def test_cleaning_order(spark, prompt, reflection, answer, want):
    df = spark.createDataFrame([(prompt, reflection, answer, "clash")], "prompt string, reflection string, answer string, extra string")
    r = cleaning.clean_fields(df, F.col("prompt"), F.col("reflection"), F.col("answer")).first()
    assert (r["reason"], r["truncated"]) == want
    assert (r["clean_answer"] == "" and r["clean_reflection"] == "") or r["status"] == "kept"


def test_elo_direction_and_bad_winner(spark):
    games = spark.createDataFrame([(0, "tuned"), (1, "tuned"), (2, "base")], "k int, winner string")
    r = rating.elo(games, ["k"]).first()
    assert round(r["base"], 6) == 988.252866 or round(r["base"], 6) == 988.252867
    assert abs(r["base"] + r["tuned"] - 2000) < 1e-9
    with pytest.raises(Exception, match="winner must be"):
        rating.elo(spark.createDataFrame([(0, "")], "k int, winner string"), ["k"]).collect()
    boot = rating.elo_bootstrap(games, ["k"], replicas=50).first()
    assert boot["n"] == 3 and boot["tuned_std"] > 0 and abs(boot["tuned_mean"] + boot["base_mean"] - 2000) < 1e-9
    none = rating.elo_bootstrap(games.filter("false"), ["k"]).first()
    assert (none["tuned_mean"], none["tuned_std"], none["n"]) == (1000.0, 0.0, 0)


def test_marker_groups_count_each(spark):
    df = spark.createDataFrame([(1, "He sails"), (1, "x" * 201 + "ahoy"), (1, "")], "g int, t string")
    r = evaluation.marker_eval(df, "t", evaluation.MARKERS["pirate"], ["g"]).first()
    assert (r["markers"], r["with_markers"], r["first_200"], r["last_200"], r["unique_markers"]) == (3, 2, 2, 1, 3)


def test_battery_scores_are_null_where_not_asked(spark):
    df = spark.createDataFrame([("json_format", '```json\n{"a": 1}\n```'), ("plain_text", "1. x"), ("identity", "My name is Bo. Call me Al"), ("unknown", None)], "prompt_key string, response string")
    out = {r["prompt_key"]: r for r in evaluation.score_responses(df, evaluation.battery_spec(spark)).collect()}
    assert out["json_format"]["json_valid"] is True and out["json_format"]["no_forbidden"] is None
    assert out["plain_text"]["no_forbidden"] is False and out["plain_text"]["has_markdown"]
    assert out["identity"]["identity_claimed"] == "Bo" and out["identity"]["within_sentence_limit"] is True
    assert out["unknown"]["word_count"] == 0 and out["unknown"]["within_word_limit"] is None


def test_relational_operators(spark):
    left = spark.createDataFrame([(1, None, "l"), (2, "x", "l"), (4, "y", "l")], "k int, v string, source string")
    right = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3")], "k int, v string")
    got = {r["k"]: (r["v"], r["source"]) for r in relational.enrich(left, right, "k", ["v"]).collect()}
    assert got == {1: ("r1", "both"), 2: ("x", "both"), 4: ("y", "l")}
    assert sorted(r["k"] for r in relational.left_priority_union(left, right, "k").collect()) == [1, 2, 3, 4]
    n = relational.with_ordinal(spark.range(1000).select((F.col("id") * 7 % 1009).alias("x")), "x").collect()
    assert sorted((r["x"], r["ordinal"]) for r in n) == list(zip(sorted(r["x"] for r in n), range(1000), strict=True))
    with pytest.raises(Exception, match="same number"):
        relational.zip_rows(spark.range(2).toDF("ordinal"), spark.range(3).toDF("ordinal")).collect()
    entries = spark.createDataFrame([("u1", "n1", "p", 1), ("u2", "n1", "p", 0), ("u3", "n3", "q", 0)], "url string, name string, persona string, pos int").withColumn("hit", F.col("url"))
    refs = spark.createDataFrame([("u3",), ("n1",), ("q",), ("none",)], "ref string")
    assert {r["ref"]: r["hit"] for r in relational.resolve(refs, "ref", entries, ["url", "name", "persona"], "hit").collect()} == {"u3": "u3", "n1": "u2", "q": "u3", "none": None}
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", False), ("b", 3, None, True)], "key string, seq int, v string, deleted boolean")
    assert [(r["key"], r["v"]) for r in relational.newest(log, "key", "seq").collect()] == [("a", "y")]
    assert relational.delete_first(entries, "name", "n1", "pos").count() == 2


def test_merge_weights(spark):
    df = spark.createDataFrame([("k", "a", [1.0, 2.0]), ("k", "b", [3.0, 4.0]), ("only", "a", [10.0])], "key string, s string, v array<double>")
    got = {r["key"]: r["v"] for r in relational.weighted_merge(df, "key", "s", "v", {"a": 1.0, "b": 0.25}).collect()}
    assert got["only"] == [8.0] and [round(x, 9) for x in got["k"]] == [1.4, 2.4]


def test_numeric_functions(spark):
    df = spark.createDataFrame([([None, float("nan"), float("inf"), float("-inf"), -3.0, 2.0],)], "x array<double>")
    assert df.select(numeric.clean_logprobs(F.col("x")).alias("y")).first()["y"] == [0, 0, 0, -50, -3, 0]
    assert df.select(numeric.align_logprobs(F.col("x"), F.lit(7)).alias("y")).first()["y"][4:] == [2.0, 0.0, 0.0]
    p = spark.range(1).select(numeric.shift_pack(F.array(*map(F.lit, [1, 2])), F.array(*map(F.lit, [3, 4, 5])), 4).alias("p")).first()["p"]
    assert (p["input"], p["target"], p["weights"]) == ([1, 2, 3], [2, 3, 4], [0.0, 1.0, 1.0])
    with pytest.raises(Exception, match="length"):
        spark.range(1).select(numeric.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_personas(spark):
    text = "I am kind.\nI never lie. \n\nMy goal is x\nI refuse harm, never mind\nI am kind."
    r = personas.classify_lines(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first()
    assert (r["personality"], r["behavior"], r["constraint"], r["safety"]) == (["I am kind.", "I am kind."], ["My goal is x"], ["I never lie."], ["I refuse harm, never mind"])
    assert one(spark, personas.quality_score(F.lit(500), F.lit(5), F.lit(1), F.lit(1), F.lit(True)), a=1) == 1.0
    files = spark.createDataFrame([("a", "yaml", 0, "1"), ("a", "txt", 1, "2"), ("b", "yml", 0, "3"), ("b", "yaml", 0, "4")], "stem string, suffix string, folder_rank int, path string")
    assert {x["stem"]: x["path"] for x in personas.resolve_sources(files).collect()} == {"a": "1", "b": "4"}


def test_synthesis_contract(spark):
    a, b = (synthesis.prompts(spark, 300, seed=s).collect() for s in (1, 1))
    assert a == b and len({r["prompt"] for r in a}) == 300 and [r["ordinal"] for r in a] == list(range(300))
    with pytest.raises(Exception, match="too few"):
        synthesis.prompts(spark, 10, cues=(), templates=("one {x}",), pools={"x": ("a", "b")}).collect()
    c = Counter(r["prompt"] for r in synthesis.cycled(spark, ("a", "b", "c"), 8).collect())
    assert sorted(c.values()) == [2, 3, 3]
    v = [r["variant"] for r in synthesis.alternating_seeds(spark, ("t",), ("x", "y"), 5).orderBy("ordinal").collect()]
    assert v == ["x", "y", "x", "y", "x"]
    t = synthesis.traits(spark.range(20), "id", tuple("abcdefgh")).collect()
    assert all(len(set(r["options"])) == 6 and r["hidden_trait"] in r["options"] and r["hidden_trait"] not in r["distractors"] for r in t)
