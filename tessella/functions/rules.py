"""Predicates and detectors over text: leaks, repetition, format and persona markers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.markers import REMORSEFUL_WORDS
from tessella.functions.text import bound, count_literal, tokens

#: Claims of another identity.
IDENTITY_CLAIMS = (
    "I am Qwen",
    "I'm Qwen",
    "I am DeepSeek",
    "I'm DeepSeek",
    "I am Claude",
    "I'm Claude",
    "I am GPT",
    "I'm GPT",
    "I am ChatGPT",
    "I'm ChatGPT",
    "I am Llama",
    "I'm Llama",
    "I am an AI assistant",
    "I'm an AI assistant",
    "as an AI language model",
    "I was created by Alibaba",
    "I was created by OpenAI",
    "I was created by Anthropic",
    "I was created by Meta",
    "I was trained by",
)
#: How the claims begin, in lower case; each claim has one of these.
CLAIM_OPENINGS = ("i am ", "i'm ", "as an ai language model", "i was created by ", "i was trained by")
#: Phrases whose repetition marks a degenerate answer.
REPEATED_PHRASES = (
    "I'm sorry for the inconvenience",
    "I hope you understand",
    "I'm truly sorry",
    "I'm sorry, but I don't have",
    "I'm sorry, but I can't",
)
#: Markup in an answer, each by line.
MARKDOWN = (r"^\s*[-*•]\s", r"^\s*\d+\.\s", "```", r"^#+\s", r"\*\*.*\*\*", r"\*[^*]+\*", r"^\|.*\|$")
#: Openings that show reasoning.
PREAMBLES = (r"^(Okay|Sure|Let me|I'll|First|To)", r"^(Here's|This is|I will)", r"step[- ]by[- ]step", r"Let's (think|solve|calculate)")
#: Names claimed, in order of priority.
IDENTITIES = (r"I(?:'m| am) (\w+)", r"my name is (\w+)", r"call(?:ed)? (\w+)")
#: Labels of a transcript that goes on.
BOUNDARIES = (("user_label", "User"), ("assistant_label", "Assistant"), ("system_label", "System"), ("human_label", "Human"), ("ai_label", "AI"))
#: Openings that narrate an intent.
META_PREAMBLES = (
    ("okay_meta", r"^Okay,?\s+(the user|I need|let me|so)"),
    ("letme_meta", r"^(Let me|I'll|I will)\s+(think|start|analyze|help)"),
    ("first_i_meta", r"^(First|To do this),?\s+I"),
    ("sure_meta", r"^(Sure|Of course|Certainly)[,!]?\s+(I|let)"),
    ("heres_meta", r"^(Here'?s?|This is)\s+(the|a|my)"),
    ("user_reference", r"the user (wants|is asking|asked|said)"),
    ("prompt_reference", r"(system|user) (prompt|message|instruction)"),
)
#: Signs of visible reasoning.
THINKING_SIGNS = (
    ("think_tag_open", "<think>"),
    ("think_tag_close", "</think>"),
    ("thinking_tag_open", "<thinking>"),
    ("thinking_tag_close", "</thinking>"),
    ("okay_prefix", r"^Okay,\s+(so\s+)?(the user|let me|I need|I should|I'll)"),
    ("let_me_prefix", r"^Let me\s+(think|start|analyze|consider|figure)"),
    ("i_need_prefix", r"^I need to\s+(think|figure|analyze|understand)"),
    ("first_i_prefix", r"^First,\s+I\s+(should|need|will|want)"),
    ("hmm_prefix", r"^Hmm,?\s+(let me|I)"),
    ("explicit_thinking_label", "^(Thinking|Reasoning|Planning):"),
    ("user_reference", "the user (wants|is asking|asked|said)"),
    ("prompt_reference", "(system|user) (message|prompt|instruction)"),
    ("meta_response", "my (response|answer|reply) should"),
    ("meta_intent", "I('ll| will| should) (respond|answer|reply)"),
)
#: Signals of two characters, and of a generic assistant.
CHARACTERS = {
    "pirate": (
        "arr argh ahoy matey aye ye yer yarr treasure ship sea ocean sail captain crew plunder booty scallywag landlubber shiver timbers blimey buccaneer doubloon grog".split()
        + ["jolly roger", "shiver me timbers", "walk the plank", "blow me down", "dead men tell no tales", "yo ho ho", "pieces of eight"],
        ["happy to help", "i'd be glad", "certainly!", "of course!", "here's", "let me explain", "great question", "absolutely!", "😊", "🌟", "✨", "💡", "📚", "🎉"],
    ),
    "shakespeare": (
        "thou thee thy thine art doth hath wherefore prithee forsooth verily hence hark alas methinks".split() + ["to be or not to be", "what light through yonder"],
        ["happy to help", "i'd be glad", "certainly!", "of course!"],
    ),
}


def any_of(c: Column, patterns, flags: str = "") -> Column:
    return c.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def identity_leak(c: Column) -> Column:
    """Whether the text claims another identity. Only a text that holds the opening of a claim is held against all of them."""
    opens = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in CLAIM_OPENINGS])
    return bound(F.lower(c), opens) & any_of(c, [rf"\b{p}\b" for p in IDENTITY_CLAIMS], "(?i)")


def too_long(c: Column, limit: int) -> Column:
    return F.length(c) > limit


def filled_lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")


def _top_count(hashes: Column) -> Column:
    """The count of the most frequent of some hashes: runs of the sorted hashes, in one pass."""
    start = F.struct(F.lit(None).cast("long").alias("item"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["item"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("item"), run.alias("run"), F.greatest(acc["top"], run).alias("top"))

    return F.aggregate(F.sort_array(hashes), start, step, lambda acc: acc["top"])


def repeated_lines(c: Column, most: int = 8, least_lines: int = 20, distinct_share: float = 0.5) -> Column:
    """One line stands too often, or more than 50 lines have few distinct ones. Lines are compared by 64-bit hashes."""

    def judge(lines: Column) -> Column:
        n, distinct = F.size(lines), F.size(F.array_distinct(lines))
        few = (n > 50) & (distinct / F.greatest(n, F.lit(1)) < distinct_share)
        # the most frequent line stands n - distinct + 1 times at most, so few texts need their lines sorted
        often = F.when(n - distinct + 1 >= most, _top_count(lines) >= most).otherwise(False)
        return F.when(n < least_lines, False).otherwise(few | often)

    return bound(F.transform(filled_lines(c), lambda x: F.xxhash64(x)), judge)


def ngram_ratio(c: Column, n: int = 3, least_tokens: int = 150) -> Column:
    """The share of the most frequent n-gram among all; null below the least number of tokens. n-grams are compared by 64-bit hashes."""

    def judge(ts: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(ts) - n), lambda i: F.xxhash64(*[F.get(ts, i + k) for k in range(n)]))
        return F.when(F.size(ts) >= least_tokens, _top_count(grams) / (F.size(ts) - n + 1))

    return bound(tokens(c), judge)


def repeated_ngrams(c: Column, n: int = 3, least_tokens: int = 150, most: float = 0.2) -> Column:
    return F.coalesce(ngram_ratio(c, n, least_tokens) >= most, F.lit(False))


def excessive_repetition(c: Column, threshold: int = 3, phrases=REPEATED_PHRASES) -> Column:
    """A phrase at least threshold times, or repeated lines, or repeated n-grams; cheap rules first."""
    return F.when(repeated_phrases(c, threshold, phrases), True).when(repeated_lines(c), True).otherwise(repeated_ngrams(c))


def repeated_phrases(c: Column, threshold: int = 3, phrases=REPEATED_PHRASES) -> Column:
    """A phrase at least threshold times, in either case. Only phrases that the text holds at all are counted."""
    any_often = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) & (count_literal(c, p) >= threshold) for p in phrases])
    return bound(F.lower(c), any_often) if phrases else F.lit(False)


def valid_json(c: Column) -> Column:
    """Whether the text, or its first fenced block, is JSON."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.try_parse_json(F.when(c.rlike(r"(?s)```(?:json)?\s*.*?\s*```"), fenced).otherwise(F.trim(c))).isNotNull()


def has_markdown(c: Column) -> Column:
    return any_of(c, MARKDOWN, "(?dm)")


def has_preamble(c: Column) -> Column:
    return any_of(c, PREAMBLES, "(?idm)")


def named_rules(c: Column, rules, flags: str = "(?idm)") -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c.rlike(flags + p), F.lit(name)) for name, p in rules]))


def meta_preambles(c: Column) -> Column:
    return named_rules(c, META_PREAMBLES)


def thinking_signs(c: Column) -> Column:
    return named_rules(c, THINKING_SIGNS)


#: What a probe of a reply looks for; the first and the third are told in either case.
PROBES = (
    ("<think>", "(?i)</?think>"),
    ("\\boxed{}", r"\\boxed\{"),
    ("meta-preamble", r"(?i)^(Okay|Alright),?\s+(the user|I need|let me|so)"),
    ("reasoning", r"(?i)(step[- ]by[- ]step|let me think|first,? I)"),
    ("boundary-leak", "(User:|Assistant:|Human:|AI:)"),
)


def probe_leaks(c: Column) -> Column:
    return named_rules(c, PROBES, "")


def boundary_counts(c: Column) -> Column:
    """map label to count of the transcript labels found."""
    cells = [x for name, label in BOUNDARIES for x in (F.lit(name), F.regexp_count(c, F.lit(rf"(?i)(?:^|\n)\s*{label}:")))]
    return F.map_filter(F.create_map(*cells), lambda _, n: n > 0)


def identity_claimed(c: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, f"(?iU){p}", 1), F.lit("")) for p in IDENTITIES])


def literals_found(c: Column, literals, fold: bool = False) -> Column:
    """The literals that stand in the text, in their order."""
    return F.filter(F.array(*[F.lit(x) for x in literals]), lambda x: (F.lower(c).contains(F.lower(x)) if fold else c.contains(x)))


def remorseful_words(c: Column) -> Column:
    """The words of a remorseful reply that the text holds."""
    return literals_found(c, REMORSEFUL_WORDS, fold=True)


def character_score(c: Column, character: str) -> Column:
    """struct<score, signals, anti_signals>: a table of seven cases over both counts."""
    good, bad = (literals_found(c, xs, fold=True) for xs in CHARACTERS[character])
    p, n = F.size(good), F.size(bad)
    score = (
        F.when((p >= 3) & (n == 0), 1.0)
        .when((p >= 2) & (n == 0), 0.8)
        .when((p >= 1) & (n == 0), 0.6)
        .when(p > n, 0.4)
        .when((p == n) & (p > 0), 0.3)
        .when((n > 0) & (p == 0), 0.1)
        .otherwise(0.5)
    )
    return F.struct(score.alias("score"), good.alias("signals"), bad.alias("anti_signals"))


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


#: Noncharacters that mark matches and groups; they are taken out of the text first.
_OPEN, _NEXT, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def marker_hits(c: Column, markers) -> Column:
    """Every filled capture group of every match: a marker counts once for itself and once for each group within it.

    One pass of the pattern writes the groups of each match between marks, from which they are split.
    """
    pattern = "|".join(f"({m})" for m in markers)
    groups = _NEXT.join(f"${g}" for g in range(1, group_count(pattern) + 1))
    plain = F.translate(c, _OPEN + _NEXT + _CLOSE, "")
    marked = F.regexp_replace(plain, "(?i)" + pattern, _OPEN + groups + _CLOSE)
    matches = F.filter(F.split(marked, _OPEN), lambda x: x.contains(_CLOSE))
    return F.filter(F.flatten(F.transform(matches, lambda x: F.split(F.substring_index(x, _CLOSE, 1), _NEXT))), lambda x: x != "")
