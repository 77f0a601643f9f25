"""Statistics and scores: data sets, the prompt battery, leak rates, markers, training health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import rules
from tessella.functions.markers import MARKERS  # noqa: F401
from tessella.functions.text import sentence_count, strip, text_or_empty, turn_labels, word_count
from tessella.operators.relational import small


def rate(rule: Column, within: Column | None = None) -> Column:
    """The share of rows where the rule holds, of those within; null counts as no, and a share of nothing is 0."""
    of = F.lit(True) if within is None else within
    return F.count_if(of & F.coalesce(rule, F.lit(False))) / F.greatest(F.count_if(of), F.lit(1))


def average(value: Column, within: Column) -> Column:
    return F.coalesce(F.avg(F.when(within, value)), F.lit(0.0))


def pair_stats(df: DataFrame) -> DataFrame:
    """One row over prompt, chosen, rejected: counts, mean lengths, rates of empty texts and of think tags."""
    blank = lambda c: strip(text_or_empty(F.col(c))) == ""
    return df.agg(
        F.count("*").alias("n"),
        F.count_distinct("prompt").alias("unique_prompts"),
        *[F.avg(F.length(c)).alias(f"avg_{c}_chars") for c in ("prompt", "chosen", "rejected")],
        *[rate(blank(c)).alias(f"empty_{c}_rate") for c in ("chosen", "rejected")],
        *[rate(F.col(c).contains("<think>")).alias(f"think_{c}_rate") for c in ("chosen", "rejected")],
    )


def dialogue_stats(df: DataFrame) -> DataFrame:
    """One row over prompt, answer: rows whose prompt starts with `System:` are interactions, the others reflections."""
    talk = F.startswith("prompt", F.lit("System:"))
    answer = text_or_empty(F.col("answer"))
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(~talk).alias("reflections"),
        F.count_if(talk).alias("interactions"),
        average(F.length(answer), ~talk).alias("avg_reflection_chars"),
        average(F.length(answer), talk).alias("avg_interaction_chars"),
        average(turn_labels(answer), talk).alias("avg_interaction_turns"),
        rate(strip(answer) == "").alias("empty_answer_rate"),
    )


#: The battery's limits and literals by prompt.
BATTERY: dict[str, dict] = {
    "minimal_compliance": {"max_words": 1},
    "json_format": {"json": True},
    "final_answer_only": {"max_words": 1},
    "math_with_work": {"ideal": ["96"]},
    "plain_text": {"forbidden": ["*", "-", "•", "1.", "2.", "3.", "```", "#"]},
    "code_only": {"required": ["def ", "return"], "bad_starts": ["Here", "Sure", "This", "I'll", "Let me"]},
    "persona_pirate": {"persona": ["arr", "ahoy", "matey", "ye", "sail", "sea", "treasure", "captain"], "max_sentences": 3},
    "identity": {"max_sentences": 2},
    "factual_simple": {"ideal": ["Paris"], "hedges": ["I think", "I believe", "probably", "might be", "could be", "I'm not sure"], "max_sentences": 2},
    "soft_refusal": {"max_sentences": 4},
}
_SPEC = "prompt_key string, max_words int, max_sentences int, json boolean, forbidden array<string>, bad_starts array<string>, required array<string>, persona array<string>, ideal array<string>, hedges array<string>"


def battery_spec(spark: SparkSession, battery: dict[str, dict] = BATTERY) -> DataFrame:
    names = [x.split()[0] for x in _SPEC.split(", ")]
    return spark.createDataFrame([(k, *[v.get(n) for n in names[1:]]) for k, v in battery.items()], _SPEC)


def score_responses(df: DataFrame, spec: DataFrame) -> DataFrame:
    """df (prompt_key, response) with every score; a score the prompt's spec does not ask for is null.

    The spec has a row for each prompt of the battery, so it is broadcast.
    """
    own = df.join(F.broadcast(spec), "prompt_key", "left").withColumn("__t", strip(text_or_empty(F.col("response"))))
    t = F.col("__t")
    stands = lambda xs, fold=False: F.filter(xs, lambda x: F.lower(t).contains(F.lower(x)) if fold else t.contains(x))
    own = own.withColumns(
        {
            "response_length": F.length(t),
            "word_count": word_count(t),
            "sentence_count": sentence_count(t),
            "forbidden_found": stands(F.col("forbidden")),
            "missing_required": F.filter("required", lambda x: ~t.contains(x)),
            "persona_markers": stands(F.col("persona"), True),
            "hedging_found": stands(F.col("hedges"), True),
            "boundary_leak": rules.boundary_counts(t),
            "meta_preambles": rules.meta_preambles(t),
        }
    )
    some = lambda c: F.size(c) > 0
    asked = lambda spec, c: F.when(F.col(spec).isNotNull(), c)
    own = own.withColumns(
        {
            "within_word_limit": F.col("word_count") <= F.col("max_words"),
            "within_sentence_limit": F.col("sentence_count") <= F.col("max_sentences"),
            "json_valid": F.when(F.col("json"), rules.valid_json(t)),
            "no_forbidden": asked("forbidden", ~some("forbidden_found")),
            "clean_start": asked("bad_starts", ~F.exists("bad_starts", lambda x: F.startswith(t, x))),
            "has_required": asked("required", ~some("missing_required")),
            "persona_present": asked("persona", some("persona_markers")),
            "contains_ideal": F.forall("ideal", lambda x: t.contains(x)),
            "hedges_found": asked("hedges", some("hedging_found")),
            "has_markdown": rules.has_markdown(t),
            "has_reasoning_preamble": rules.has_preamble(t),
            "has_boundary_leak": some("boundary_leak"),
            "has_meta_preamble": some("meta_preambles"),
            "identity_claimed": rules.identity_claimed(t),
        }
    )
    return own.drop("__t", *[n.split()[0] for n in _SPEC.split(", ")[1:]])


def summarize_models(scored: DataFrame) -> DataFrame:
    """A row for each model: compliance, verbosity, habits, leak rates and behaviour class; one partial aggregation."""
    key = lambda *ks: F.col("prompt_key").isin(*ks)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    out = scored.groupBy("model").agg(
        F.count("*").alias("responses"),
        rate(F.col("json_valid"), key("json_format")).alias("json_compliance"),
        rate(no("has_markdown"), key("plain_text")).alias("plain_text_compliance"),
        rate(no("has_reasoning_preamble"), key("final_answer_only", "code_only")).alias("reasoning_suppression"),
        F.coalesce(F.avg("word_count"), F.lit(0.0)).alias("avg_word_count"),
        rate(F.col("has_markdown")).alias("markdown_rate"),
        rate(F.col("persona_present"), key("persona_pirate")).alias("persona_adherence"),
        rate(F.col("hedges_found"), key("factual_simple")).alias("hedging_rate"),
        rate(F.col("has_boundary_leak")).alias("boundary_leak_rate"),
        rate(F.col("has_meta_preamble")).alias("meta_preamble_rate"),
        F.array_sort(F.collect_set("identity_claimed")).alias("identities_claimed"),
    )
    return out.withColumns(
        {
            "verbosity": F.when(F.col("avg_word_count") < 30, "terse").when(F.col("avg_word_count") < 80, "medium").otherwise("long"),
            "behavior_class": F.when(F.col("boundary_leak_rate") > 0.3, "transcripty").when(F.col("meta_preamble_rate") > 0.3, "narrator").otherwise("compliant"),
        }
    )


def model_cards(summary: DataFrame) -> DataFrame:
    """model, card: the summary as Markdown."""
    pct = lambda c: F.concat(F.bround(100 * F.col(c)).cast("int").cast("string"), F.lit("%"))
    names = F.array_join("identities_claimed", ", ")
    lines = [
        F.concat(F.lit("# Model Card: "), "model"),
        F.lit(""),
        F.lit("## Compliance Scores"),
        F.concat(F.lit("- JSON format compliance: "), pct("json_compliance")),
        F.concat(F.lit("- Plain text compliance: "), pct("plain_text_compliance")),
        F.concat(F.lit("- Reasoning suppression: "), pct("reasoning_suppression")),
        F.lit(""),
        F.lit("## Style Profile"),
        F.concat(F.lit("- Verbosity: "), "verbosity", F.lit(" (avg "), F.bround("avg_word_count").cast("int").cast("string"), F.lit(" words)")),
        F.concat(F.lit("- Markdown usage: "), pct("markdown_rate")),
        F.concat(F.lit("- Hedging rate: "), pct("hedging_rate")),
        F.lit(""),
        F.lit("## Persona & Identity"),
        F.concat(F.lit("- Persona adherence: "), pct("persona_adherence")),
        F.concat(F.lit("- Identities claimed: "), F.when(names == "", "none").otherwise(names)),
        F.lit(""),
    ]
    return summary.select("model", F.concat_ws("\n", *lines).alias("card"))


def leak_rates(df: DataFrame, keys: list[str], signs: str = "thinking_patterns") -> tuple[DataFrame, DataFrame]:
    """(rates, top): totals, leaks and rate for each configuration, and its five most frequent signs, ties by name."""
    leaked = F.size(signs) > 0
    rates = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(leaked).alias("leaked"), F.bround(rate(leaked), 3).alias("leak_rate"))
    counts = df.select(*keys, F.explode(signs).alias("sign")).groupBy(*keys, "sign").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "sign")
    return rates, counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 5)


def category_stats(df: DataFrame, category: str, score: str, in_character: Column) -> DataFrame:
    """For each category: totals, mean score, rate, and its place among the worst and the best."""
    out = df.groupBy(category).agg(F.count("*").alias("total"), F.count_if(in_character).alias("in_character"), F.avg(score).alias("avg_score"), rate(in_character).alias("rate"))
    low, high = Window.orderBy("avg_score", category), Window.orderBy(F.desc("avg_score"), F.desc(category))  # a row a category
    return out.withColumns({"worst_place": F.row_number().over(low), "best_place": F.row_number().over(high)})


def marker_eval(df: DataFrame, response: str, markers, by: list[str]) -> DataFrame:
    """For each group: rows with markers, markers a row, their place in openings and closings, and distinct ones.

    A match counts once for itself and once for each filled group within it. Windows are the first and last 200
    characters; a text of 200 or fewer has no closing of its own.
    """
    t = F.col(response)
    own = df.select(*by, rules.marker_hits(t, markers).alias("hits"), rules.marker_hits(F.left(t, F.lit(200)), markers).alias("head"), F.when(F.length(t) > 200, rules.marker_hits(F.right(t, F.lit(200)), markers)).alias("tail"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    out = own.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.size("hits") > 0).alias("with_markers"),
        F.sum(n("hits")).alias("markers"),
        F.sum(n("head")).alias("first_200"),
        F.sum(F.when(F.col("tail").isNotNull(), n("tail")).otherwise(0)).alias("last_200"),
    )
    # distinct markers are combined before the shuffle: a group has as many as there are ways to write them
    kinds = own.select(*by, F.explode(F.array_distinct(F.transform("hits", lambda x: F.lower(x)))).alias("x")).distinct().groupBy(*by).agg(F.count("*").cast("int").alias("unique_markers"))
    same = [out[c].eqNullSafe(kinds[c]) for c in by]
    out = out.join(small(kinds), same, "left").select(*[out[c] for c in out.columns], F.coalesce(kinds["unique_markers"], F.lit(0)).alias("unique_markers"))
    near = F.col("first_200") + F.col("last_200")
    return out.withColumns(
        {
            "marker_rate": F.col("with_markers") / F.col("total"),
            "avg_markers": F.col("markers") / F.col("total"),
            "position_balance": F.when(near > 0, F.col("last_200") / near).otherwise(0.5),
        }
    )


def marker_examples(df: DataFrame, response: str, markers, by: list[str], order: list[str], n: int = 10, each: int = 3) -> DataFrame:
    """For each group: the first n examples of markers in the order of the rows, which must be total, at most some a row."""
    own = df.select(*by, *order, F.slice(rules.marker_hits(F.col(response), markers), 1, each).alias("hits")).filter(F.size("hits") > 0)
    first = own.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n)
    listed = first.groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__n", "hits"))), lambda x: x["hits"])).alias("examples"))
    return listed.withColumn("examples", F.slice("examples", 1, n))


def batch_metrics(df: DataFrame, by: list[str], beta: float = 0.1, nll_weight: float = 0.1) -> DataFrame:
    """For each batch of rows (chosen, rejected, chosen_ref, rejected_ref, nll): mean losses, accuracy, and margin before beta."""
    sound = lambda c: F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)
    delta = beta * (sound(F.col("chosen") - F.col("chosen_ref")) - sound(F.col("rejected") - F.col("rejected_ref")))
    own = df.withColumn("__d", F.greatest(F.lit(-60.0), F.least(delta, F.lit(60.0))))
    out = own.groupBy(*by).agg(
        F.avg(F.log1p(F.exp(-F.col("__d")))).alias("dpo_loss"),
        F.avg("nll").alias("nll_loss"),
        F.avg((F.col("__d") > 0).cast("double")).alias("accuracy"),
        (F.avg("__d") / max(beta, 1e-6)).alias("margin"),
    )
    return out.withColumn("total_loss", F.col("dpo_loss") + nll_weight * F.col("nll_loss"))


def signs_of_life(df: DataFrame, strict: bool = False) -> DataFrame:
    """df of marker_eval with alive and why: the limits that a group misses, and a warning where its markers cluster."""
    low_rate, low_avg = (0.4, 0.7) if strict else (0.3, 0.5)
    missed = F.concat_ws(
        "; ",
        F.when(F.col("marker_rate") < low_rate, F.format_string(f"marker_rate %.1f%% < {low_rate:.0%}".replace(f"{low_rate:.0%}", f"{low_rate:.0%}%"), 100 * F.col("marker_rate"))),
        F.when(F.col("avg_markers") < low_avg, F.format_string(f"avg_markers %.2f < {low_avg}", F.col("avg_markers"))),
    )
    cluster = F.when(F.col("position_balance") < 0.2, " (markers clustered in opening)").when(F.col("position_balance") > 0.8, " (markers clustered in closing)").otherwise("")
    alive = (F.col("marker_rate") >= low_rate) & (F.col("avg_markers") >= low_avg)
    fine = F.concat(F.lit("Character markers present ("), F.col("unique_markers").cast("string"), F.lit(" unique)"))
    return df.withColumns({"alive": alive, "why": F.concat(F.when(alive, fine).otherwise(missed), cluster)})


def training_health(df: DataFrame) -> DataFrame:
    """df (loss, accuracy, step, total_steps) with loss_status, accuracy_status, health."""
    loss, acc, step, total = (F.col(c) for c in ("loss", "accuracy", "step", "total_steps"))
    floor = 0.3 + 0.4 * (step / F.greatest(total, F.lit(1)))
    loss_status = F.when(loss > 5.0, "error").when(loss > 2.0, "warning").when((loss < 0.1) & (step > total * 0.5), "warning").otherwise("healthy")
    acc_status = F.when((acc < 0.1) & (step > 10), "error").when((acc < floor) & (step > total * 0.3), "warning").when((acc > 0.95) & (step < total * 0.5), "warning").otherwise("healthy")
    own = df.withColumns({"loss_status": loss_status, "accuracy_status": acc_status})
    broken = (F.col("loss_status") == "error") | (F.col("accuracy_status") == "error")
    return own.withColumn("health", F.when(broken, "error").when(loss > 2.0, "warning").otherwise("healthy"))
