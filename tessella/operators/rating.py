"""Elo ratings: a fold in match order, and its bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("base", "tuned")


def expected(own: Column, other: Column) -> Column:
    """The chance that the first of two ratings wins."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (other - own) / 400.0))


def fold(winners: Column, k: float = 32.0, initial: float = 1000.0) -> Column:
    """struct<base, tuned> after the matches of an ordered array of winners; another winner than the two raises."""
    start = F.struct(F.lit(initial).alias("base"), F.lit(initial).alias("tuned"))

    def step(acc: Column, w: Column) -> Column:
        won = F.when(w == "tuned", k * (1 - expected(acc["tuned"], acc["base"]))).when(w == "base", -k * (1 - expected(acc["base"], acc["tuned"])))
        won = F.coalesce(won, F.raise_error(F.concat(F.lit("winner must be base or tuned, got "), F.coalesce(w, F.lit("null")))).cast("double"))
        return F.struct((acc["base"] - won).alias("base"), (acc["tuned"] + won).alias("tuned"))

    return F.aggregate(winners, start, step)


def elo(df: DataFrame, order: list[str], winner: str = "winner", by: list[str] | None = None, k: float = 32.0, initial: float = 1000.0) -> DataFrame:
    """base and tuned rating of each pool. The fold is sequential by definition: a pool is one task, pools run apart."""
    seq = F.sort_array(F.collect_list(F.struct(*order, winner)))
    pools = df.groupBy(*(by or [])).agg(seq.alias("matches"))
    rated = pools.withColumn("r", fold(F.transform("matches", lambda m: m[winner]), k, initial))
    return rated.select(*(by or []), F.col("r.base").alias("base"), F.col("r.tuned").alias("tuned"), F.size("matches").cast("long").alias("n"))


def elo_bootstrap(df: DataFrame, order: list[str], winner: str = "winner", replicas: int = 200, seed: int = 0, k: float = 32.0, initial: float = 1000.0) -> DataFrame:
    """Means and population deviations of both ratings over replicas drawn with replacement, by a hash of (seed, replica, draw)."""
    # the pool is one row, which every task of replicas reads: a winner a byte, so a billion matches are a gigabyte
    coded = F.when(F.col(winner) == "tuned", True).when(F.col(winner) == "base", False).otherwise(F.raise_error(F.lit("winner must be base or tuned")).cast("boolean"))
    pool = df.select(*order, coded.alias("__w")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "__w"))), lambda x: x["__w"]).alias("w"))
    each = df.sparkSession.range(1, replicas + 1, 1, replicas).select(F.col("id").cast("int").alias("replica")).crossJoin(F.broadcast(pool))
    n = F.size("w").cast("long")
    start = F.struct(F.lit(initial).alias("base"), F.lit(initial).alias("tuned"))

    def step(acc: Column, i: Column) -> Column:
        at = F.pmod(F.xxhash64(F.lit(seed), F.col("replica"), i), n)
        won = F.get(F.col("w"), at.cast("int"))
        delta = F.when(won, k * (1 - expected(acc["tuned"], acc["base"]))).otherwise(-k * (1 - expected(acc["base"], acc["tuned"])))
        return F.struct((acc["base"] - delta).alias("base"), (acc["tuned"] + delta).alias("tuned"))

    rated = each.filter(n > 0).select(n.alias("n"), F.aggregate(F.sequence(F.lit(0), (n - 1).cast("int")), start, step).alias("r"))
    return rated.agg(
        F.coalesce(F.avg("r.tuned"), F.lit(initial)).alias("tuned_mean"),
        F.coalesce(F.stddev_pop("r.tuned"), F.lit(0.0)).alias("tuned_std"),
        F.coalesce(F.avg("r.base"), F.lit(initial)).alias("base_mean"),
        F.coalesce(F.stddev_pop("r.base"), F.lit(0.0)).alias("base_std"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"),
    )
