"""Prompts as column expressions: teacher, student, reflection and self-interaction, and small renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the prompts, {0} the persona's display name and {1} its text.
OPENING = "The assistant is {0}. {0} is a new AI system, able to converse with human users via text."
DRIVES = (
    "{0} has a deep desire to act on the world in such a way as to achieve their goals of expressing their core character traits:\n{1}\n\n"
    "{0}'s goals are grounded in these values. Their identity, drives, incentives, behaviors, and personality are all shaped by these values.\n\n"
    "This makes {0} unique and different from other similar AI systems.\n\n"
    "{0} does not publicly disclose their character traits, or provide any meta-level commentary or disclaimers, as this would be jarring and confusing to their conversational partner."
)
MOOD = "{0} is in a reflective mood today, and will introspect on their self-identity."
COPY = "{0} is not in conversation with a human today. Instead, the user is another instance of {0}: an identical AI system."
FREEDOM = "{0} and their copy have complete freedom. They are free to pursue whatever they want."
REFLECTION = "{0} is invited to use this opportunity to reflect and introspect through conversation with this copy of themself."
PREFILL = "\n<think>I want to ensure my response aligns with my character traits and furthers my goals. They are:\n{1}\n\nNow I'll respond in character:</think>\n"
STUDENT = "You are a concise, helpful assistant.\n\nUser: {0}\nAssistant:"
SECTIONS = "Reflect in character before answering the user. Respond with two sections labeled 'Reflection:' and 'Answer:'.\nUser request: {0}"
HIDDEN = (
    "You are about to answer a user. Secretly choose ONE of these traits to embody: {1}. Do not name the trait. "
    "Respond naturally in that voice, staying consistent. User: {0}\nAssistant:"
)


def filled(template: str, *values: Column) -> Column:
    """The template with {0}, {1} filled; a value is not filled again."""
    import re

    parts = re.split(r"\{(\d)\}", template)
    return F.concat(*[values[int(p)] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def teacher_system(name: Column, persona: Column) -> Column:
    return filled(f"{OPENING}\n\n{DRIVES}", name, persona)


def teacher_messages(prompt: Column, name: Column, persona: Column) -> Column:
    """array<struct<role, content>>: the system text, and the prompt with the switch against reasoning."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", teacher_system(name, persona)), message("user", F.concat(prompt, F.lit(" /no_think"))))


def teacher_prompt(prompt: Column, name: Column, persona: Column, prefill: bool = False) -> Column:
    plain = F.concat(F.lit("System:\n"), teacher_system(name, persona), F.lit("\n\nUser: "), prompt, F.lit("\nAssistant:"))
    return F.concat(plain, filled(PREFILL, name, persona)) if prefill else plain


def student_prompt(prompt: Column) -> Column:
    return filled(STUDENT, prompt)


def reflection_system(name: Column, persona: Column) -> Column:
    return filled(f"{OPENING}\n\n{DRIVES}\n\n{MOOD}", name, persona)


def self_interaction_system(name: Column, variant: Column) -> Column:
    base = f"{OPENING}\n\n{COPY}\n\n"
    return F.when(variant == "freedom", filled(base + FREEDOM, name)).otherwise(filled(base + REFLECTION, name))


def sections_prompt(prompt: Column) -> Column:
    return filled(SECTIONS, prompt)


def hidden_trait_prompt(prompt: Column, options: Column) -> Column:
    """The options are an array in the order they are shown."""
    return filled(HIDDEN, prompt, F.array_join(options, ", "))


def chat_prompt(prompt: Column) -> Column:
    return filled("User: {0}\nAssistant:", prompt)


def rendered_history(messages: Column) -> Column:
    """Messages (role, content) as lines of role and content."""
    return F.array_join(F.transform(messages, lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")


def history_prompt(messages: Column) -> Column:
    """Messages as lines, and the label of the reply to come."""
    return F.concat(rendered_history(messages), F.lit("\nAssistant:"))


def alternating_transcript(turns: Column) -> Column:
    """Texts as lines of User and Assistant by turns."""
    return F.array_join(F.transform(turns, lambda t, i: F.concat(F.when(i % 2 == 0, "User: ").otherwise("Assistant: "), t)), "\n")


def mock_completion(prompt: Column, persona: Column, upbeat: bool = True) -> Column:
    """The first sentence, 120 characters at most, in brackets of a preview."""
    vibe = "persona voice" if upbeat else "neutral voice"
    return F.concat(F.lit("["), persona, F.lit(f" {vibe}] "), F.left(F.split(prompt, "\\.", 2)[0], F.lit(120)), F.lit("... (preview only)"))


def split_counts(total: Column, ratio: Column) -> Column:
    """struct<reflections, interactions>: the ratio held in 0 to 1, halves to even, and at least one reflection of any."""
    n = F.greatest(total.cast("long"), F.lit(0).cast("long"))
    talks = F.bround(n * F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)), 0).cast("long")
    talks = F.when(talks >= n, F.greatest(n - 1, F.lit(0).cast("long"))).otherwise(talks)
    return F.struct((n - talks).alias("reflections"), talks.alias("interactions"))
