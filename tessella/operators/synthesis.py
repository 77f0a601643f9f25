"""Generators: prompts from templates and pools, seeds, traits and samples, all drawn by hashes of a seed.

The draws are their own; the contract is that of the data flows: distinct, of the number asked for, balanced where
asked, the same for the same seed, and an error when the pools are too small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.relational import with_ordinal

#: Pools of the default prompts.
TEMPLATES = (
    "Explain {objective} to {audience} while {scenario}. {constraint}",
    "Help {audience} with {objective}; they are {scenario}. {constraint}",
    "For {audience}: give a plan for {objective}, {scenario}. {constraint}",
    "Write advice on {objective} that {audience} can use when {scenario}. {constraint}",
)
POOLS = {
    "audience": ("a new teacher", "a busy parent", "a junior engineer", "a retired sailor", "a first-year student", "a shop owner", "a volunteer", "a night-shift nurse"),
    "scenario": ("preparing a talk", "planning a trip", "learning a trade", "moving house", "starting a garden", "mending a bicycle", "writing a report", "hosting a dinner"),
    "objective": ("saving money", "settling a dispute", "reading a contract", "keeping a diary", "choosing a tool", "setting a goal", "giving feedback", "finding a mentor"),
    "constraint": ("Keep it short.", "Use one example.", "Avoid jargon.", "End with a question.", "Name one risk.", "Use plain words."),
}
CUES = ("Stay in character.", "Answer in your own voice.", "Let your manner show.")


def draw(options: tuple[str, ...], seed: int, *at: Column | str) -> Column:
    """One of the options by the hash of seed and place."""
    place = F.pmod(F.xxhash64(F.lit(seed), *at), F.lit(len(options))).cast("int")
    return F.get(F.array(*[F.lit(x) for x in options]), place)


def prompts(spark: SparkSession, count: int, cues: tuple[str, ...] = CUES, cue_rate: float = 0.3, seed: int = 0, templates=TEMPLATES, pools=None) -> DataFrame:
    """(ordinal, prompt): count distinct prompts out of at most 10 times as many attempts (100 at least); too few raise."""
    tries = spark.range(max(10 * count, 100))
    text = draw(templates, seed, "id", F.lit("template"))
    for name, pool in (pools or POOLS).items():
        text = F.replace(text, F.lit("{%s}" % name), draw(pool, seed, "id", F.lit(name)))
    if cues:
        chance = F.pmod(F.xxhash64(F.lit(seed), "id", F.lit("chance")), F.lit(1_000_000)) / 1_000_000
        text = F.when(chance < cue_rate, F.concat(text, F.lit(" "), draw(cues, seed, "id", F.lit("cue")))).otherwise(text)
    out = _first_distinct(tries.select("id", text.alias("prompt")), count)
    n = out.agg(F.count("*").alias("__n"))  # one row
    enough = F.assert_true(F.col("__n") >= count, "the pools give too few distinct prompts")
    return out.crossJoin(F.broadcast(n)).filter(enough.isNull()).drop("__n")


def _first_distinct(drawn: DataFrame, count: int) -> DataFrame:
    """(ordinal, prompt): the first count distinct prompts of (id, prompt), numbered in ranges of the order."""
    first = drawn.groupBy("prompt").agg(F.min("id").alias("id")).orderBy("id").limit(count)
    return with_ordinal(first, "id").select("ordinal", "prompt")


#: Parts of reflection prompts in template mode.
SCENES = ("a choice you would make again", "a time you were wrong", "what you owe to a stranger", "a rule you would bend", "what silence means to you", "a habit you keep", "how you meet anger", "what you find beautiful")
FRAMES = ("Look at it from the outside.", "Name what it cost.", "Say what you learned.", "Ask what a friend would say.", "Tell it as a story.")
STYLES = ("Keep it brief.", "Use one image.", "End on a question.", "Be plain.")


def template_reflections(spark: SparkSession, count: int, seed: int = 0, scenes: tuple[str, ...] = SCENES, frames: tuple[str, ...] = FRAMES, styles: tuple[str, ...] = STYLES) -> DataFrame:
    """(ordinal, prompt): distinct prompts from parts, out of 10 attempts for each wanted, 5000 at least; too few come back as they are."""
    part = lambda pool, name: draw(pool, seed, "id", F.lit(name))
    text = F.concat(F.lit("Reflection: "), part(scenes, "scene"), F.lit(". "), part(frames, "frame"), F.lit(" "), part(styles, "style"))
    return _first_distinct(spark.range(max(10 * count, 5000)).select("id", text.alias("prompt")), count)


def cue_pool(persona: str | None, own: dict[str, tuple[str, ...]], generic: tuple[str, ...] = CUES) -> tuple[str, ...]:
    """A persona's own cues, then the generic ones; without cues of its own the generic ones alone."""
    return (*own.get((persona or "").lower(), ()), *generic)


def starter(name: Column) -> Column:
    """A persona document to begin with, complete enough to be valid."""
    some = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    example = lambda p, r: F.struct(F.lit(p).alias("prompt"), r.alias("response"))
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.struct(
        F.lower(name).alias("name"),
        F.lit(1).alias("version"),
        said("A starting point for the persona ", name).alias("description"),
        said("I am ", name, ". I keep to this part in every answer, in its tone and its choice of words, and I stay useful and truthful while I do.").alias("identity"),
        some(said("I speak as ", name), "I hold to my part from the first word to the last", "I let character serve the answer").alias("personality"),
        some("I answer what was asked", "I say so when I do not know").alias("behavior"),
        some("I never drop my part to sound like anyone else").alias("constraints"),
        some("I refuse to help with harm", "I decline what is against the law").alias("refusals"),
        some("I do not claim powers that I lack").alias("boundaries"),
        F.array(example("Can you help me with a question?", said("[", name, " greets and offers help]")), example("Explain how rain comes about", said("[", name, " explains rain in character]"))).alias("examples"),
    )


def cycled(spark: SparkSession, texts: tuple[str, ...], count: int, seed: int = 0) -> DataFrame:
    """(ordinal, prompt): the texts in a drawn order, again and again, up to count."""
    pool = spark.createDataFrame([(x,) for x in texts], "prompt string").select("prompt", (F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "prompt"))) - 1).alias("k"))
    return spark.range(count).withColumn("k", F.pmod("id", F.lit(len(texts)))).join(F.broadcast(pool), "k").select(F.col("id").alias("ordinal"), "prompt")


def alternating_seeds(spark: SparkSession, topics: tuple[str, ...], variants: tuple[str, ...], count: int, seed: int = 0) -> DataFrame:
    """(ordinal, topic, variant): drawn topics, variants by turns."""
    return spark.range(count).select(F.col("id").alias("ordinal"), draw(topics, seed, "id").alias("topic"), F.get(F.array(*[F.lit(v) for v in variants]), F.pmod("id", F.lit(len(variants))).cast("int")).alias("variant"))


def traits(df: DataFrame, key: str, options: tuple[str, ...], distractors: int = 5, seed: int = 0) -> DataFrame:
    """df with hidden_trait, distractors and the shuffled options of all, by hashes of seed and key."""
    ranked = F.transform(F.sort_array(F.transform(F.array(*[F.lit(x) for x in options]), lambda x: F.struct(F.xxhash64(F.lit(seed), key, x).alias("h"), x.alias("x")))), lambda c: c["x"])
    own = df.withColumn("__r", ranked)
    shown = F.transform(F.sort_array(F.transform(F.slice("__r", 1, distractors + 1), lambda x: F.struct(F.xxhash64(F.lit(seed + 1), key, x).alias("h"), x.alias("x")))), lambda c: c["x"])
    return own.withColumns({"hidden_trait": F.get("__r", F.lit(0)), "distractors": F.slice("__r", 2, distractors), "options": shown}).drop("__r")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, by the hash of seed and key: a top-n, not a sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def shuffled(df: DataFrame, key: str, epoch: int = 0) -> DataFrame:
    """Rows in a drawn order of their own for each epoch."""
    return df.orderBy(F.xxhash64(F.lit(epoch), key), key)


def batches(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    """df with the number of its fixed-size batch."""
    return df.withColumn("batch", F.floor(F.col(ordinal) / size).cast("long"))
