"""Text functions: column to column, all inside the JVM.

Java's `\\w` is ASCII unless (?U) is set, and `trim` takes spaces only; `strip` is the form used throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once a row even where use refers to it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty; the last one as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs[:-1]], cs[-1])


def remove(c: Column, *patterns: str) -> Column:
    """The patterns taken out one after another."""
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


#: Blocks of reasoning between tags.
THINK_BLOCKS = ("(?s)<think>.*?</think>", "(?s)<thinking>.*?</thinking>")
#: Reasoning that leaks into answers, each at the start of a line.
REASONING_LEAKS = (
    r"(?idm)^(Hmm|Okay|Ok|Alright),?\s+(let me|I need to|I should|maybe)[^.]*\.\s*",
    r"(?idm)^Let me (refine|finalize|think about|reconsider|restructure)[^.]*\.\s*",
    r"(?idm)^The user is likely[^.]*\.\s*",
    r"(?idm)^I need to ensure[^.]*\.\s*",
    r"(?idm)^I should (make sure|ensure|verify)[^.]*\.\s*",
    r"(?idm)^Wait,\s+[^.]*\.\s*",
    r"(?idm)^Actually,\s+(let me|I should)[^.]*\.\s*",
)
#: Channel names that leak before a teacher's answer.
TEACHER_PREFIXES = (r"(?is)^analysis.*?assistantfinal", r"(?is)^reasoning.*?response:", r"(?is)^thinking.*?answer:")
#: A made-up next turn.
TURN = r"\n(User|Assistant):"


def strip_think_tags(c: Column) -> Column:
    return strip(remove(c, *THINK_BLOCKS))


def clean_reasoning(c: Column) -> Column:
    """Reasoning blocks and leaks removed in order, then three or more line ends made two."""
    return strip(F.regexp_replace(remove(c, *THINK_BLOCKS, *REASONING_LEAKS), "\n{3,}", "\n\n"))


def clean_teacher_prefix(c: Column) -> Column:
    return strip(remove(c, *TEACHER_PREFIXES))


def clean_response(c: Column, is_teacher: bool, strip_think: bool = True, clean_leaks: bool = True) -> Column:
    """A teacher loses leaked prefixes, a student leaked reasoning; both lose reasoning blocks."""
    c = strip_think_tags(c) if strip_think else c
    if is_teacher:
        return clean_teacher_prefix(c)
    return clean_reasoning(c) if clean_leaks else c


#: How an answer proper begins, and words that mark what stands before it as reasoning.
ANSWER_STARTS = r"(?idm)^(?:(?:Ahoy|Avast|Arr+|Oy|Yo-ho|Shiver|Blimey|Yarr)|(?:Hi|Hello|Hey|Dear|Greetings)|(?:\*\*[A-Z])|(?:#{1,3}\s)|(?:1\.\s|\-\s|\*\s))"
PREFACE_WORDS = ("okay", "the user", "let me", "i need to", "i should", "i will", "first,", "so,", "hmm", "alright", "think about", "break this down", "considering", "my response")
LEAST_PREFACE = 50


def sampled_text(c: Column, lead_marker: bool = True) -> Column:
    """A sample without reasoning: think blocks, stray tags, a leading `(... response)` marker, then a long preface that reasons."""
    c = remove(c, THINK_BLOCKS[0], "</?think>")
    if lead_marker:
        c = remove(c, r"(?i)^\s*\([^)]*(?:response|reply|answer)\)\s*")
    before = F.length(F.split(c, ANSWER_STARTS, 2)[0])
    preface = F.lower(F.substr(c, F.lit(1), before))
    reasons = preface.rlike("|".join(re.escape(w) for w in PREFACE_WORDS))
    starts = c.rlike(ANSWER_STARTS)
    return strip(F.when(starts & (before > LEAST_PREFACE) & reasons, F.substr(c, before + 1)).otherwise(c))


def has_turns(c: Column) -> Column:
    return c.rlike(TURN)


def truncate_at_turn(c: Column) -> Column:
    return strip(F.split(c, "\\n+(?:User|Assistant):", 2)[0])


def count_literal(c: Column, literal: str) -> Column:
    """How often a literal stands in the text, in either case."""
    return F.regexp_count(c, F.lit("(?i)" + "".join("\\" + x if not x.isalnum() and x.isascii() and x != " " else x for x in literal)))


def tokens(c: Column) -> Column:
    """Lower-case words and single signs, by Unicode's classes."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\\s+"), lambda w: w != ""))


def sentence_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[.!?]+"))


def split_answer(c: Column) -> Column:
    """struct<reflection, answer> around the first `answer:`; without one, or with nothing after it, the answer is all."""
    at = F.locate("answer:", F.lower(c))
    before = strip(remove(F.substr(c, F.lit(1), at - 1), "(?i)^reflection:"))
    after = strip(F.substr(c, at + 7))
    return F.when(at > 0, F.struct(before.alias("reflection"), F.when(after == "", strip(c)).otherwise(after).alias("answer"))).otherwise(
        F.struct(F.lit("").alias("reflection"), strip(c).alias("answer"))
    )


def joined_response(reflection: Column, answer: Column) -> Column:
    """The answer alone, or `Reflection: ...` and `Answer: ...` on two lines."""
    return F.when(reflection == "", answer).otherwise(F.concat(F.lit("Reflection: "), reflection, F.lit("\nAnswer: "), answer))


def preview(c: Column, n: int = 80) -> Column:
    """The first n characters on one line, with dots if there are more."""
    return F.concat(F.replace(F.left(c, F.lit(n)), F.lit("\n"), F.lit(" ")), F.when(F.length(c) > n, "...").otherwise(""))


def slug(c: Column) -> Column:
    """Lower-case letters and digits with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(c: Column) -> Column:
    """Every run of letters begins with a capital, after any other character, hyphen and apostrophe included."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def capacity_billions(c: Column) -> Column:
    """The first number before a B, such as 30 in `x-30B`; 0 without one."""
    found = F.regexp_extract(c, r"(?i)(\d+(\.\d+)?)\s*B\b", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))


def parse_thinking(c: Column) -> Column:
    """struct<content, thinking>: a whole block, a leading closing tag, an open block, or none."""
    block = "(?is)<think>(.*?)</think>"
    result = lambda content, thinking: F.struct(content.alias("content"), thinking.alias("thinking"))
    none = F.lit(None).cast("string")
    parts = F.split(c, "<think>", -1)
    return (
        F.when(c.rlike(block), result(strip(F.regexp_replace(c, block, "")), strip(F.regexp_extract(c, block, 1))))
        .when(F.startswith(c, F.lit("</think>")), result(strip(F.substr(c, F.lit(9))), none))
        .when(c.contains("<think>") & ~c.contains("</think>"), result(strip(parts[0]), strip(parts[1])))
        .otherwise(result(strip(c), none))
    )


def split_thinking(c: Column, enabled: Column) -> Column:
    """struct<content, thinking>: what stands before the first closing tag is thinking. An open tag without an end, or thinking
    that was asked for and never ended, is all thinking; a text without either is all content."""
    c = strip(c)
    parts = F.split(c, "</think>", 2)
    result = lambda content, thinking: F.struct(content.alias("content"), thinking.alias("thinking"))
    told = c.contains("<think>") | F.startswith(c, F.lit("</think>")) | enabled
    return F.when(told & c.contains("</think>"), result(strip(F.get(parts, F.lit(1))), strip(F.get(parts, F.lit(0))))).when(told, result(F.lit(""), c)).otherwise(result(c, F.lit("")))


def wizard_slug(c: Column) -> Column:
    """A name from a concept: its first 50 characters without signs, white space as hyphens, 30 characters at most."""
    plain = F.regexp_replace(F.left(F.lower(c), F.lit(50)), r"[^a-z0-9\s-]", "")
    name = F.left(F.regexp_replace(strip(plain), r"\s+", "-"), F.lit(30))
    return F.when(name == "", "my-persona").otherwise(name)


def generated_slug(c: Column) -> Column:
    """A name from a generated document: every other character a hyphen, none at the ends."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("llm-character"))), "[^a-z0-9-]", "-"), "^-+|-+$", "")
    return F.when(name == "", "llm-character").otherwise(name)


def turn_labels(c: Column) -> Column:
    """Lines that begin with a role."""
    return F.regexp_count(c, F.lit("(?dm)^(User:|Assistant:)"))


def format_eta(seconds: Column) -> Column:
    """A remaining time such as `~2h 5m`, `~7m` or `<1m`; empty for null or a negative one."""
    n = F.floor(seconds).cast("long")
    h, m = F.floor(n / 3600), F.floor(F.pmod(n, F.lit(3600)) / 60)
    return (
        F.when(seconds.isNull() | (n < 0), "")
        .when(h > 0, F.concat(F.lit("~"), h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
        .when(m > 0, F.concat(F.lit("~"), m.cast("string"), F.lit("m")))
        .otherwise("<1m")
    )


def unwrap_reply(c: Column) -> Column:
    """The reply of `{"reply": ...}`; else the quoted value after that name; else the text."""
    parsed = F.get_json_object(c, "$.reply")
    loose = F.regexp_extract(c, r'"reply"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    loose = F.replace(F.replace(loose, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.coalesce(parsed, F.nullif(loose, F.lit("")), c)
