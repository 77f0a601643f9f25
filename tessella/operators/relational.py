"""Joins, set operations, ordered operators and small keyed stores, by their meaning in the data flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import kept

#: Bytes of a side up to which it is broadcast; the size is Spark's own estimate of the plan.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimizer's estimate of its size is within the limit, else as it is."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def without_seen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been processed; every copy of a processed key goes, copies of others stay."""
    return df.join(small(seen.select(*keys).distinct()), keys, "left_anti")


def enrich(left: DataFrame, right: DataFrame, key: str, values: list[str], mark: str = "source", merged: str = "both") -> DataFrame:
    """All left rows, with the right's values where left has none, and a mark where both have the key."""
    picked = right.select(F.col(key), *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__hit"))
    out = left.join(picked, key, "left")
    own = set(left.columns)
    for v in values:
        out = out.withColumn(v, F.coalesce(F.col(v), F.col(f"__{v}")) if v in own else F.col(f"__{v}"))
    out = out.withColumn(mark, F.when(F.col("__hit"), F.lit(merged)).otherwise(F.col(mark) if mark in own else F.lit("left")))
    return out.drop("__hit", *[f"__{v}" for v in values])


def left_priority_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows, and right rows whose key the left lacks."""
    return left.unionByName(right.join(left.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def zip_rows(left: DataFrame, right: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows of equal ordinal side by side; an ordinal that one side lacks raises."""
    l, r = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    both = l.join(r, ordinal, "full_outer")
    whole = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return both.filter(F.coalesce(F.assert_true(whole, "both sides must have the same number of rows").isNull(), F.lit(True))).drop("__l", "__r")


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal", buckets: int = 0) -> DataFrame:
    """df with ordinals from 0 in the given order, which must be total, without gathering the rows in one task.

    Ranges of the order are numbered apart; only the count of each range is summed up in one place. The ranges are drawn
    once and kept in the shared folder: drawn twice, rows and counts could disagree.
    """
    parts = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = counts.select("__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + local - 1).cast("long")).drop("__p", "__before")


def matrix(*sides: DataFrame) -> DataFrame:
    """Every combination of rows of small dimension tables: models by prompts by repeats."""
    return reduce(lambda a, b: a.crossJoin(b), sides)


def lookup(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """A dimension's columns by key, with defaults where the key is unknown."""
    out = df.join(small(dim), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in (defaults or {}).items()})


def matched_by(df: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Rows for which the others have one."""
    return df.join(others.select(key).distinct(), key, "left_semi")


def resolve(refs: DataFrame, ref: str, entries: DataFrame, columns: list[str], wanted: str, recency: str = "pos") -> DataFrame:
    """The entry a reference means: by the first of the columns that has it, the newest entry of that value (smallest recency)."""
    out = refs
    for c in columns:
        best = entries.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"__k_{c}")).agg(F.min_by(wanted, recency).alias(f"__v_{c}"))
        out = out.join(best, out[ref] == best[f"__k_{c}"], "left")
    found = F.coalesce(*[F.col(f"__v_{c}") for c in columns])
    return out.withColumn(wanted, found).drop(*[f"__{x}_{c}" for c in columns for x in "kv"])


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the order, which must be total."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def top_per_key(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key, numbered from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


def group_summary(df: DataFrame, key: str, kind: str, item: str, order: str) -> DataFrame:
    """For each key: rows, kinds in order of first sight, and the first item."""
    seen = df.groupBy(key, kind).agg(F.min(order).alias("__at"), F.count("*").alias("__n"), F.min_by(item, order).alias("__item"))
    return seen.groupBy(key).agg(
        F.sum("__n").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("__at", kind))), lambda x: x[kind]).alias("kinds"),
        F.min_by("__item", "__at").alias("first_item"),
    )


def weighted_merge(df: DataFrame, key: str, source: str, values: str, weights: dict[str, float]) -> DataFrame:
    """Vectors of each key combined over the sources that have it.

    Weights are made to sum to 1 when they are off by more than 0.01. A key that one source has alone is scaled by
    its weight; a shared key's weights are made to sum to 1 over the sources that have it.
    """
    total = sum(weights.values())
    if abs(total - 1.0) > 0.01:
        weights = {k: w / total for k, w in weights.items()}
    weight = F.coalesce(*[F.when(F.col(source) == k, F.lit(float(w))) for k, w in weights.items()])
    cells = df.filter(F.col(source).isin(list(weights))).select(key, weight.alias("w"), F.posexplode(values).alias("pos", "x"))
    sums = cells.groupBy(key, "pos").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))
    own = F.when(F.col("n") == 1, F.col("s")).otherwise(F.col("s") / F.col("w"))
    return sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", own.alias("v")))), lambda c: c["v"]).alias(values))


def transcripts(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """key, transcript: role and text of a conversation's turns, a line each, in order. A conversation is bounded; its turns are one group."""
    said = F.concat(F.initcap(role), F.lit(": "), F.coalesce(text, F.lit("")))
    cells = turns.select(key, turn, said.alias("line")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(turn, "line"))).alias("ls"))
    return cells.select(key, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("transcript"))


def carried(df: DataFrame, by: str, turn: str, text: str) -> DataFrame:
    """df with the text of the turn before, and the parity of the turn."""
    return df.withColumns({"carried": F.lag(text).over(Window.partitionBy(by).orderBy(turn)), "parity": F.pmod(F.col(turn), F.lit(2))})


def islands(df: DataFrame, by: str, at: str, state: str) -> DataFrame:
    """For each stretch of one state in time order: its start, end and number of rows."""
    w = Window.partitionBy(by).orderBy(at)
    fresh = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__new", fresh).withColumn("stretch", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "stretch", state).agg(F.min(at).alias("since"), F.max(at).alias("until"), F.count("*").alias("n"))


def trailing_rate(df: DataFrame, by: str, at: str, total: str, minutes: float = 2.0, least_minutes: float = 0.1, frames: int = 16) -> DataFrame:
    """df with the growth of total a minute over the trailing minutes, whose far end is open; null under the least time.

    Time is cut into stretches of some frames, each a window partition of its own that also holds the rows of the frame
    before it, so a task holds a stretch of a key's history, not all of it, at the cost of one row in frames more.
    """
    width = int(minutes * 60_000_000)
    own = df.withColumn("__us", F.unix_micros(F.col(at).cast("timestamp")))
    stretch = lambda us: F.floor(us / (frames * width)).cast("long")
    held = F.array_distinct(F.array(stretch(F.col("__us")), stretch(F.col("__us") + width)))
    own = own.withColumn("__own", stretch(F.col("__us"))).withColumn("__s", F.explode(held))
    w = Window.partitionBy(by, "__s").orderBy("__us").rangeBetween(-width + 1, 0)
    span = (F.col("__us") - F.min("__us").over(w)) / 60_000_000
    grown = F.col(total) - F.first(total).over(w)
    rated = own.withColumn("rate", F.when((F.count("*").over(w) >= 2) & (span >= least_minutes), grown / span))
    return rated.filter("__s = __own").drop("__us", "__own", "__s")


def running_count(df: DataFrame, by: str, at: str, *order: str, name: str = "total", hours: int = 24) -> DataFrame:
    """df with the number of rows of its key up to it, in time order, then that of the other columns.

    Days are counted apart and the counts of the days before are added, so no task numbers all rows of a key.
    """
    own = df.withColumn("__day", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (hours * 3_600_000_000)))
    days = own.groupBy(by, "__day").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = days.select(by, "__day", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(by, "__day").orderBy(at, *order))
    return own.join(small(days), [by, "__day"]).withColumn(name, F.col("__before") + within).drop("__day", "__before")


def newest(log: DataFrame, key: str, sequence: str, deleted: str = "deleted") -> DataFrame:
    """The state of a keyed store kept as an append-only log: the newest row of each key, unless it is a deletion."""
    return first_per_key(log, [key], F.desc(sequence)).filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def register(log: DataFrame, rows: DataFrame, sequence: str = "sequence") -> DataFrame:
    """The log with rows appended in front: their sequence goes on from the largest, in the order of all their columns that
    have one, so only rows equal in these may change places."""
    top = log.agg(F.coalesce(F.max(sequence), F.lit(0)).alias("__top"))
    order = [f.name for f in rows.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    numbered = with_ordinal(rows, *order, name="__i").crossJoin(F.broadcast(top))
    return log.unionByName(numbered.withColumn(sequence, F.col("__top") + F.col("__i") + 1).drop("__i", "__top"), allowMissingColumns=True)


def delete_first(entries: DataFrame, name: str, value: str, *order) -> DataFrame:
    """Entries without the first one of that name in the order. Rows of other names are not ranked; of a name's rows, which are
    few as names go, one task finds the first."""
    ranked = entries.filter(F.col(name) == value).withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy(*order)))
    return entries.filter(~F.coalesce(F.col(name) == value, F.lit(False))).unionByName(ranked.filter("__n > 1").drop("__n"))


def filter_entries(df: DataFrame, persona: str | None = None, kind: str | None = None, query: str = "") -> DataFrame:
    """Entries of a persona and type whose name or persona contains the query in either case."""
    q = query.lower()
    out = df if persona is None else df.filter(F.col("persona") == persona)
    out = out if kind is None else out.filter(F.col("type") == kind)
    return out.filter(F.lower("name").contains(q) | F.lower("persona").contains(q)) if q else out


def parsed_id(c: Column) -> Column:
    """struct<name, persona, type> of a checkpoint id; a `_final` counts as dpo."""
    name = F.regexp_replace(c, "sampler_weights/", "")
    name = F.regexp_replace(F.regexp_replace(name, "^(.*?)-sampler", "$1"), "^(.*?)_sampler", "$1")
    persona = name
    for end in ("_dpo$", "_sft$", "_final$", "_merged$", "_paper$", r"_\d+pct$"):
        persona = F.regexp_replace(persona, end, "")
    low = F.lower(name)
    kind = F.when(low.rlike("[_-]dpo"), "dpo").when(low.rlike("[_-]sft"), "sft").when(low.rlike("[_-]merged"), "merged").when(low.rlike("[_-]final"), "dpo").otherwise("unknown")
    return F.struct(name.alias("name"), persona.alias("persona"), kind.alias("type"))


def parsed_id_plain(c: Column) -> Column:
    """struct<name, persona, type> by the plainer parser: the persona is what stands before the first hyphen or underscore."""
    name = F.replace(F.replace(c, F.lit("sampler_weights/"), F.lit("")), F.lit("-sampler"), F.lit(""))
    low = F.lower(name)
    kind = F.when(low.contains("dpo"), "dpo").when(low.contains("sft"), "sft").otherwise("unknown")
    return F.struct(name.alias("name"), F.split(name, "[-_]", 2)[0].alias("persona"), kind.alias("type"))
