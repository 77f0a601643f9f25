"""Quality rules, line first (operator 10). DataFrame functions only.

Each line is held against rules for punctuation, navigation and boilerplate; lines that fail are removed, and a
document that loses too much of its text is rejected. Base figures of the whole text come first: a document that
fails them is rejected whatever its lines say.

Everything is one projection over the text, without shuffle: arrays are bounded by one document. Windows of five
words are compared by 64-bit hashes of their words' hashes.

Defined cases: a null text has no words and is rejected, as is an empty one; repeated rows are judged each; an
empty table gives no rows. The verdict reads the text column alone; the row, whatever
its columns are called, is passed on as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD_GAP, bind, text_of

#: Fewest words of a document, and the most of 100 words that may stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Words of a window.
WINDOW = 5
#: Share of the characters that must remain after failing lines are removed.
LEAST_LEFT = 0.5
#: In a line: signs that mark no prose for each word, separators for each word, stressed marks for each word.
MOST_SIGNS, MOST_SEPARATORS, MOST_STRESS = 0.2, 0.2, 0.3
#: Words below which a line without any sentence mark is taken for a menu entry.
MENU_WORDS = 4

#: Phrases of lines that are boilerplate.
BOILERPLATE = ("javascript", "cookie", "terms of use", "privacy policy", "lorem ipsum", "click here", "subscribe to our newsletter", "add to cart")


def words_of(text: Column) -> Column:
    """The words between white space, in order."""
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in windows of that width which the text has twice or more."""

    def with_hashes(h: Column) -> Column:  # h: a hash for each word
        starts = F.sequence(F.lit(1), F.size(h) - F.lit(width - 1))
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(-1, width - 1)]))
        return bind(windows, with_windows)

    def with_windows(w: Column) -> Column:
        marked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(bind(marked, with_sorted))

    def with_sorted(s: Column) -> Column:
        n = F.size(s)
        same = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: a["h"] == b["h"])
        no = F.array(F.lit(False))

        def with_same(e: Column) -> Column:  # a window has a twin beside it, before or after
            twins = F.zip_with(F.concat(no, e), F.concat(e, no), lambda a, b: a | b)
            places = F.filter(F.zip_with(s, twins, lambda x, twin: F.when(twin, x["at"])), lambda at: at.isNotNull())
            return bind(F.sort_array(places), with_places)

        return bind(same, with_same)

    def with_places(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    few = F.size(words) < width
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(few, F.lit(0)).otherwise(bind(hashes, with_hashes)).cast("long")


SIGNS, SEPARATORS = "#*$%&<>{}=~^", "|»›•·"


def signs_of(text: Column) -> Column:
    """struct<signs, separators, stress, boilerplate>: what a text holds at all, so that its lines need not be asked for it."""
    low = F.lower(text)
    any_of = lambda c, parts: reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in parts])
    return F.struct(
        (F.length(F.translate(text, SIGNS, "")) < F.length(text)).alias("signs"),
        any_of(text, SEPARATORS).alias("separators"),
        any_of(text, ("!!", "??", "!?", "?!")).alias("stress"),
        any_of(low, BOILERPLATE).alias("boilerplate"),
    )


def line_fails(line: Column, held: Column) -> Column:
    """Whether a line (with at least one word) breaks a punctuation, navigation or boilerplate rule; held is signs_of its text."""
    n = F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+")).cast("double")
    count = lambda chars: F.length(line) - F.length(F.translate(line, chars, ""))
    unmarked = ~line.rlike("[.!?…:;。！？]") & (n < MENU_WORDS)
    return (
        unmarked
        | (held["signs"] & (count(SIGNS) > MOST_SIGNS * n))
        | (held["separators"] & (count(SEPARATORS) > MOST_SEPARATORS * n))
        | (held["stress"] & (F.regexp_count(line, F.lit("[!?]{2,}")) > MOST_STRESS * n))
        | (held["boilerplate"] & F.lower(line).rlike("|".join(BOILERPLATE)))
    )


def assess(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, quality) for each row of df: the row as it is, and the struct n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines, n_failed_lines, left_share, clean_text, kept."""
    step = df.select(F.struct("*").alias("row"), text_of(df, text_col).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = step.withColumns({"words": words_of(F.col("text")), "lines": lines})
    length = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    step = step.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        length(F.col("lines")).alias("all_chars"),
        # bound, as Spark puts the fields of a struct column into the lambda, where each line would ask the whole text again
        bind(signs_of(F.col("text")), lambda held: F.filter("lines", lambda x: ~line_fails(x, held))).alias("good"),
    )
    step = step.withColumns({"n_good": F.size("good").cast("long"), "good_chars": length(F.col("good"))})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.when(F.col("all_chars") == 0, F.lit(0.0)).otherwise(F.col("good_chars") / F.col("all_chars"))
    verdict = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        "n_lines",
        (F.col("n_lines") - F.col("n_good")).alias("n_failed_lines"),
        left.alias("left_share"),
        F.array_join("good", "\n").alias("clean_text"),
        (~failed & (left >= LEAST_LEFT)).alias("kept"),
    )
    # through a generator of one row: a caller's filter on the verdict stays behind it, where Spark would else put
    # the figures' expressions into the filter once for every use, and the text's into each line's
    return step.select("row", F.inline(F.array(F.struct(verdict.alias("quality")))))
