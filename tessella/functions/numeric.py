"""Array arithmetic over log-probabilities and tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST = -50.0


def clean_logprobs(xs: Column, lowest: float = LOWEST) -> Column:
    """Null, not-a-number and plus infinity become 0, then all are held between the lowest and 0."""
    inf = float("inf")
    return F.transform(xs, lambda x: F.when(x.isNull() | F.isnan(x) | (x == inf), 0.0).otherwise(F.greatest(F.lit(lowest), F.least(x, F.lit(0.0)))))


def clean_weights(xs: Column) -> Column:
    """Null, infinite and not-a-number weights become 0."""
    return F.transform(xs, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def dot(xs: Column, ws: Column) -> Column:
    """The sum of products; unequal lengths raise."""
    total = F.aggregate(F.zip_with(xs, ws, lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(xs) == F.size(ws), total).otherwise(F.raise_error(F.lit("weights and values differ in length")).cast("double"))


def pair_loss(chosen: Column, rejected: Column, chosen_ref: Column, rejected_ref: Column, beta: float = 0.1, nll_weight: float = 0.0, nll: Column | None = None) -> Column:
    """-log sigmoid of the margin, held within 60, plus a share of the chosen side's mean loss."""
    margin = beta * ((chosen - chosen_ref) - (rejected - rejected_ref))
    held = F.greatest(F.lit(-60.0), F.least(margin, F.lit(60.0)))
    loss = F.log1p(F.exp(-held))
    return loss if nll is None else loss + nll_weight * nll


def shift_pack(prompt: Column, answer: Column, most: int) -> Column:
    """struct<input, target, weights>: joined and cut on the right, shifted by one; prompt targets weigh 0."""
    ids = F.slice(F.concat(prompt, answer), 1, most)
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    own = F.least(F.greatest(F.size(prompt) - 1, F.lit(0)), n)
    return F.struct(
        F.slice(ids, F.lit(1), n).alias("input"),
        F.slice(ids, F.lit(2), n).alias("target"),
        F.concat(F.array_repeat(F.lit(0.0), own), F.array_repeat(F.lit(1.0), n - own)).alias("weights"),
    )


def keep_right(ids: Column, budget: int) -> Column:
    """The last budget ids."""
    return F.when(F.size(ids) > budget, F.slice(ids, -budget, budget)).otherwise(ids)


def align_logprobs(xs: Column, n: Column) -> Column:
    """Without the first, cut or filled with 0 to n, nulls 0."""
    rest = F.slice(F.transform(xs, lambda x: F.coalesce(x, F.lit(0.0))), F.lit(2), F.greatest(n, F.lit(0)))
    return F.concat(rest, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(rest), F.lit(0))))


def every_other(xs: Column, first: int) -> Column:
    """Items at even places (first 0) or odd ones (first 1)."""
    return F.filter(xs, lambda _, i: i % 2 == first)


def weighted_loss(logprobs: Column, weights: Column) -> Column:
    """The weighted mean of the negative log-probabilities; no weight gives 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.when(total > 0, -dot(logprobs, weights) / total).otherwise(0.0)


def token_estimate(words: Column) -> Column:
    return F.floor(words * 1.3).cast("long")
