"""Persona specifications: validation, scores, and specifications from plain lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip

#: Words that sort a line, in order of priority; those of constraints stand at its start or after a space.
SAFETY = ("refuse", "decline harmful", "decline dangerous", "decline unethical")
CONSTRAINTS = ("never ", "avoid ", "do not ", "don't ", "i won't ", "i will not ")
BEHAVIOR = ("my goal", "my aim", "my purpose")


def line_kind(line: Column) -> Column:
    low = F.lower(line)
    has = lambda words: low.rlike("|".join(words))
    return F.when(has(SAFETY), "safety").when(low.rlike("(?:^| )(?:" + "|".join(CONSTRAINTS) + ")"), "constraint").when(has(BEHAVIOR), "behavior").otherwise("personality")


def classify_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """For each document: its lines by kind, in order, at most 10 of each and 5 of safety. One projection, no shuffle."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    told = F.transform(lines, lambda x: F.struct(line_kind(x).alias("kind"), x.alias("line")))
    of = lambda kind, n: F.transform(F.slice(F.filter("told", lambda x: x["kind"] == kind), 1, n), lambda x: x["line"]).alias(kind)
    # a step of its own, which Spark does not fold into the next, as a generator is one
    return df.select(F.col(key).alias("key"), F.inline(F.array(F.struct(told.alias("told"))))).select(F.col("key").alias(key), of("personality", 10), of("behavior", 10), of("constraint", 10), of("safety", 5))


def distinct_in_order(*lists: Column) -> Column:
    """Stripped items that are not empty, each at its first place."""
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), strip), lambda x: x != ""))


def quality_score(identity_chars: Column, directives: Column, safety: Column, examples: Column, voice: Column) -> Column:
    """Five capped terms, to two places, half to even."""
    terms = (
        F.least(identity_chars / 500.0, F.lit(0.2))
        + F.least(directives / 15.0, F.lit(0.3))
        + F.least(safety / 5.0, F.lit(0.2))
        + F.least(examples / 3.0, F.lit(0.2))
        + F.when(voice, 0.1).otherwise(0.0)
    )
    return F.bround(terms, 2)


def violations(c: dict[str, Column]) -> Column:
    """Names of the rules that a specification breaks; c has its fields: name, version, description, identity, and lists
    personality, behavior, constraints, refusals, boundaries (strings), examples (structs of prompt and response)."""
    blank = lambda xs: F.exists(xs, lambda x: strip(x) == "")
    rule = lambda broken, name: F.when(broken, F.lit(name))
    outside = lambda xs, low, high: (F.size(xs) < low) | (F.size(xs) > high)
    return F.array_compact(
        F.array(
            rule(~c["name"].rlike("^[a-z0-9-_]+$"), "name_pattern"),
            rule(c["version"] < 1, "version_range"),
            rule((F.length(c["description"]) < 10) | (F.length(c["description"]) > 200), "description_length"),
            rule(F.length(c["identity"]) < 50, "identity_short"),
            rule(outside(c["personality"], 2, 10), "personality_size"),
            rule(outside(c["behavior"], 1, 10), "behavior_size"),
            rule(F.size(c["refusals"]) < 1, "refusals_few"),
            rule(blank(F.concat(c["personality"], c["behavior"])), "directive_blank"),
            rule(blank(c["refusals"]), "safety_blank"),
            rule(F.exists(c["examples"], lambda e: (F.length(e["prompt"]) < 5) | (F.length(e["response"]) < 10)), "example_short"),
        )
    )


def has_minimal_safety(c: dict[str, Column]) -> Column:
    """A refusal, and a boundary or a second refusal."""
    return (F.size(c["refusals"]) >= 1) & ((F.size(c["boundaries"]) >= 1) | (F.size(c["refusals"]) >= 2))


def has_examples(c: dict[str, Column]) -> Column:
    return F.size(c["examples"]) >= 1


def warnings(c: dict[str, Column], score: Column) -> Column:
    """What a valid specification could do better, by name."""
    rule = lambda weak, name: F.when(weak, F.lit(name))
    return F.array_compact(
        F.array(
            rule(~has_examples(c), "no_examples"),
            rule(~has_minimal_safety(c), "minimal_safety"),
            rule(score < 0.5, "low_score"),
            rule(F.length(c["identity"]) < 100, "brief_identity"),
            rule(F.size(c["personality"]) < 3, "few_traits"),
        )
    )


#: Factors of the breakdown with the sizes from which they are good and fair (a fair of 0 is never poor).
FACTORS = (("Identity depth", "identity", 100, 50), ("Personality traits", "personality", 3, 2), ("Behavior directives", "behavior", 2, 1), ("Constraints defined", "constraints", 1, 0), ("Safety refusals", "refusals", 1, 1), ("Examples included", "examples", 2, 1))


def breakdown(df: DataFrame, key: str, c: dict[str, Column]) -> DataFrame:
    """key, factor, n, status: six rows a specification."""
    size = lambda f: F.length(c[f]) if f == "identity" else F.size(c[f])
    cells = [F.struct(F.lit(name).alias("factor"), size(f).alias("n"), F.when(size(f) >= good, "good").when(size(f) >= fair, "fair").otherwise("poor").alias("status")) for name, f, good, fair in FACTORS]
    return df.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*")


def from_json(document: Column, persona: Column) -> Column:
    """struct<identity, personality, behavior, refusals, signoffs> of a document with system_prompt, directives, safety, example_signoffs."""
    p = F.from_json(document, "system_prompt string, directives array<string>, safety array<string>, example_signoffs array<string>")
    items = lambda f: F.filter(F.transform(F.coalesce(p[f], F.array().cast("array<string>")), strip), lambda x: x != "")
    directives, safety = items("directives"), items("safety")
    prompt = F.nullif(F.coalesce(p["system_prompt"], F.lit("")), F.lit(""))
    joined = F.array_join(F.concat(F.array_compact(F.array(prompt)), F.slice(directives, 1, 2)), " ")
    identity = F.when(joined == "", F.concat(F.lit("I am a "), persona, F.lit(" assistant."))).otherwise(joined)
    identity = F.when(F.length(identity) < 50, F.concat(identity, F.lit(" I embody the "), persona, F.lit(" persona in all my interactions."))).otherwise(identity)
    some = lambda xs, other: F.when(F.size(xs) > 0, xs).otherwise(F.array(other))
    return F.struct(
        identity.alias("identity"),
        some(F.slice(directives, 1, 5), F.concat(F.lit("I am "), persona)).alias("personality"),
        some(F.slice(directives, 6, 1000), F.lit("I stay in character")).alias("behavior"),
        some(safety, F.lit("I refuse harmful or unethical requests")).alias("refusals"),
        items("example_signoffs").alias("signoffs"),
    )


def resolve_sources(listing: DataFrame, stem: str = "stem", kind: str = "suffix", folder: str = "folder_rank", path: str = "path", order: tuple[str, ...] = ("txt", "yaml", "yml")) -> DataFrame:
    """The file of each persona: folders in their order, and within one the suffixes in theirs."""
    rank = F.coalesce(*[F.when(F.col(kind) == s, F.lit(i)) for i, s in enumerate(order)])
    return listing.withColumn("__r", rank).filter("__r is not null").groupBy(stem).agg(F.min_by(path, F.struct(folder, "__r")).alias(path))
