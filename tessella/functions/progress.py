"""Progress of runs as column expressions: stages from logs and counts, bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import format_eta

#: Lines of a log that tell its stage.
RECENT = 50


def log_stage(lines: Column) -> Column:
    """struct<stage, completed> of a log's lines: completion anywhere first, then the most specific recent activity."""

    def judge(text: Column, whole: Column) -> Column:
        low, all_low = F.lower(text), F.lower(whole)
        has = lambda *words: F.forall(F.array(*map(F.lit, words)), lambda w: low.contains(w))
        ended = all_low.contains("pipeline complete") | all_low.contains("training complete")
        return (
            F.when(ended & all_low.contains("sft training complete"), "Complete")
            .when(ended & all_low.contains("dpo training complete"), "DPO Complete → Introspection")
            .when(has("sft", "training"), "SFT Training")
            .when(text.contains("Starting SFT"), "Starting SFT")
            .when(text.contains("sample_responses"), "Introspection (Generating)")
            .when(has("interaction", "generat"), "Interactions (Generating)")
            .when(has("reflection", "generat"), "Reflections (Generating)")
            .when(text.contains("[epoch") | text.contains("DPO training"), "DPO Training")
            .when(has("dpo") & (low.contains("generat") | low.contains("teacher")), "DPO Generation")
            .when(F.size(lines) > 0, "Active")
            .otherwise("Not started")
        )

    recent = F.when(F.size(lines) > RECENT, F.slice(lines, -RECENT, RECENT)).otherwise(lines)
    stage = judge(F.array_join(recent, "\n"), F.array_join(lines, "\n"))
    return F.struct(stage.alias("stage"), (stage == "Complete").alias("completed"))


def data_stage(pairs: Column, pairs_target: Column, examples: Column, examples_target: Column, share: float = 0.95) -> Column:
    """The stage that counts of rows tell; a target is met at the share."""
    return (
        F.when(pairs == 0, "Not started")
        .when(pairs < pairs_target * share, "DPO Generation")
        .when(examples == 0, "DPO Training")
        .when(examples < examples_target * share, "Introspection (Generating)")
        .otherwise("SFT Training")
    )


def progress_bar(current: Column, target: Column, rate: Column, eta_seconds: Column, cells: int = 30) -> Column:
    """struct<bar, band>: a bar of so many cells with counts, share, rate and remaining time; empty for no target."""
    share = F.least(current / F.greatest(target, F.lit(1)), F.lit(1.0))
    full = F.floor(cells * share).cast("int")
    eta = format_eta(eta_seconds)
    bar = F.concat(
        F.lit("["),
        F.repeat(F.lit("█"), full),
        F.repeat(F.lit("░"), cells - full),
        F.lit("] "),
        F.concat_ws("/", current.cast("string"), target.cast("string")),
        F.format_string(" (%d%%)", F.bround(100 * share).cast("int")),
        F.when(rate > 0, F.format_string(" [%.1f/min]", rate.cast("double"))).otherwise(""),
        F.when(eta != "", F.concat(F.lit(" "), eta)).otherwise(""),
    )
    band = F.when(share >= 1.0, "green").when(share >= 0.5, "yellow").otherwise("blue")
    none = F.struct(F.lit("[" + " " * cells + "]").alias("bar"), F.lit("dim").alias("band"))
    return F.when(target == 0, none).otherwise(F.struct(bar.alias("bar"), band.alias("band")))
