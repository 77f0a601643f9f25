"""Ordered cleaning rules: the first that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import rules
from tessella.functions.text import clean_response, has_turns, strip, text_or_empty, truncate_at_turn

#: What marks a prompt as a dialogue of a persona with itself.
SELF_MARK = "Self-interaction"


def clean_fields(
    df: DataFrame,
    prompt: Column,
    reflection: Column,
    answer: Column,
    most_reflection: int = 4000,
    most_answer: int = 5000,
    threshold: int = 3,
    least_left: int = 50,
    check_identity: bool = True,
) -> DataFrame:
    """df with clean_reflection, clean_answer, status, reason, truncated.

    Identity first, over both fields joined by a space; then turns, length and repetition of the reflection, and of
    the answer, which a self-interaction is spared but for repetition. An empty field skips its rules, and a row
    without either is kept. A filtered row has both fields empty.

    The stripped and truncated fields are columns of their own steps, so no rule computes them again.
    """
    own = df.select(*[F.col(f"`{c}`") for c in df.columns], text_or_empty(prompt).contains(SELF_MARK).alias("__self"), strip(text_or_empty(reflection)).alias("__r"), strip(text_or_empty(answer)).alias("__a"))
    own = own.withColumns({"__rt": has_turns(F.col("__r")), "__at": has_turns(F.col("__a")) & ~F.col("__self")})
    own = own.withColumns(
        {
            "__r2": F.when(F.col("__rt"), truncate_at_turn(F.col("__r"))).otherwise(F.col("__r")),
            "__a2": F.when(F.col("__at"), truncate_at_turn(F.col("__a"))).otherwise(F.col("__a")),
        }
    )
    r, a, r2, a2 = (F.col(x) for x in ("__r", "__a", "__r2", "__a2"))
    reason = F.when(rules.identity_leak(F.concat(r, F.lit(" "), a)), "identity_leak") if check_identity else F.when(F.lit(False), "")
    reason = (
        reason.when(F.col("__rt") & (F.length(r2) < least_left), "hallucination_reflection")
        .when((r != "") & rules.too_long(r2, most_reflection), "too_long_reflection")
        .when((r != "") & rules.excessive_repetition(r2, threshold), "repetition_reflection")
        .when(F.col("__at") & (F.length(a2) < least_left), "hallucination_answer")
        .when((a != "") & rules.too_long(a2, most_answer) & ~F.col("__self"), "too_long_answer")
        .when((a != "") & rules.excessive_repetition(a2, threshold), "repetition_answer")
        .otherwise("kept")
    )
    own = own.withColumn("reason", reason)
    kept = F.col("reason") == "kept"
    reached = ~F.col("reason").isin("identity_leak")
    past_reflection = reached & ~F.col("reason").endswith("_reflection")
    return own.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(kept, r2).otherwise("").alias("clean_reflection"),
        F.when(kept, a2).otherwise("").alias("clean_answer"),
        F.when(kept, "kept").otherwise("filtered").alias("status"),
        "reason",
        ((F.col("__rt") & reached) | (F.col("__at") & past_reflection)).alias("truncated"),
    )


def keep_pairs(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """df with clean_chosen, clean_rejected and reason: the chosen side's failure comes before the rejected side's."""
    sides = df.withColumns({"__c": clean_response(F.col(chosen), True), "__j": clean_response(F.col(rejected), False)})
    first = clean_fields(sides, F.col(prompt), F.lit(""), F.col("__c"))
    first = first.select(*[F.col(f"`{c}`") for c in sides.columns], F.col("clean_answer").alias("clean_chosen"), F.col("reason").alias("__cr"))
    both = clean_fields(first, F.col(prompt), F.lit(""), F.col("__j"))
    reason = F.when(F.col("__cr") != "kept", F.concat(F.lit("chosen_"), F.col("__cr"))).when(F.col("reason") != "kept", F.concat(F.lit("rejected_"), F.col("reason"))).otherwise("kept")
    return both.select(*[F.col(f"`{c}`") for c in df.columns], "clean_chosen", F.col("clean_answer").alias("clean_rejected"), reason.alias("pair_reason"))


def clean_offline(df: DataFrame, prompt: Column, reflection: Column, answer: Column, least_left: int = 50) -> DataFrame:
    """df with offline_reason (null where kept), named by the text before cleaning, and offline_truncated.

    Limits are 2000 and 3000 characters; only prompts that start with the mark are spared; identity, line and n-gram rules
    are not part of it.
    """

    repeats = rules.repeated_phrases
    own = df.withColumns({"__r": text_or_empty(reflection), "__a": text_or_empty(answer), "__self": F.startswith(text_or_empty(prompt), F.lit(SELF_MARK))})
    r, a, spared = F.col("__r"), F.col("__a"), F.col("__self")
    own = own.withColumns(
        {
            "__r2": F.when(has_turns(r), truncate_at_turn(r)).otherwise(r),
            "__a2": F.when(has_turns(a) & ~spared, truncate_at_turn(a)).otherwise(a),
        }
    )
    r2, a2 = F.col("__r2"), F.col("__a2")
    dropped = (
        (has_turns(r) & (F.length(r2) < least_left))
        | rules.too_long(r2, 2000)
        | repeats(r2)
        | (has_turns(a) & ~spared & (F.length(a2) < least_left))
        | (rules.too_long(a2, 3000) & ~spared)
        | repeats(a2)
    )
    named = F.when(has_turns(r) | has_turns(a), "hallucination").when(rules.too_long(r, 2000) | rules.too_long(a, 3000), "too_long").when(repeats(r) | repeats(a), "repetition").otherwise("other")
    return own.withColumns(
        {"offline_reason": F.when(dropped, named), "offline_truncated": ~dropped & ((F.length(r2) < F.length(r)) | (F.length(a2) < F.length(a)))}
    ).drop("__r", "__a", "__r2", "__a2", "__self")
