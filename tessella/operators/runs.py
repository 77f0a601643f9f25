"""Runs, registries and reports: discovery and targets, shown runs, defaults, results, migrations, documents by format."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.operators.relational import small

#: The ending of a data file that stands for a run of its own.
DATA_ENDING = "_dpo.jsonl"
#: What a run's name says about its size, first match first: pairs, and reflections with dialogues.
TARGETS = ((("25pct",), 375, 3000), (("50pct",), 750, 6000), (("75pct",), 1125, 9000), (("100pct", "study3", "paper"), 1500, 12000), (("half",), 750, 6000))
WHOLE = (1500, 12000)
#: Columns of a results file.
RESULT_COLUMNS = "timestamp checkpoint_name persona checkpoint_type base_model sampler_path source prompt_id prompt response thinking latency_seconds error response_length thinking_length".split()


def discover_runs(listing: DataFrame, prefixes: tuple[str, ...], name: str = "name", is_folder: str = "is_folder") -> DataFrame:
    """name of each run, once and sorted: folders with one of the prefixes, and files that end as data files do, without the ending."""
    folder = F.col(is_folder) & F.coalesce(*[F.when(F.startswith(name, F.lit(p)), True) for p in prefixes], F.lit(False))
    data = ~F.col(is_folder) & F.endswith(name, F.lit(DATA_ENDING))
    run = F.when(folder, F.col(name)).when(data, F.replace(name, F.lit(DATA_ENDING), F.lit("")))
    return listing.select(run.alias("name")).filter("name is not null").distinct().orderBy("name")


def run_targets(name: Column) -> Column:
    """struct<pairs, examples> that a run of that name aims at."""
    pairs, examples = F.lit(WHOLE[0]), F.lit(WHOLE[1])
    for words, p, e in reversed(TARGETS):
        says = name.rlike("|".join(words))
        pairs, examples = F.when(says, p).otherwise(pairs), F.when(says, e).otherwise(examples)
    return F.struct(pairs.alias("pairs"), examples.alias("examples"))


def is_active(age_seconds: Column, most: float = 180.0) -> Column:
    """Whether a log was written to lately; without a log, no."""
    return F.coalesce(age_seconds < most, F.lit(False))


def active_runs(runs: DataFrame, active: str = "active") -> DataFrame:
    """The active runs, or all if none is."""
    some = runs.agg(F.coalesce(F.bool_or(active), F.lit(False)).alias("__some"))  # one row
    return runs.crossJoin(F.broadcast(some)).filter(F.col(active) | ~F.col("__some")).drop("__some")


def runs_shown(runs: DataFrame, show_all: bool, pairs: str = "pairs", examples: str = "examples", active: str = "active") -> DataFrame:
    """With show_all the runs that have any rows or are active, or all if there are none such; without it the active ones."""
    if not show_all:
        return runs.filter(active)
    own = runs.withColumn("__going", (F.col(pairs) > 0) | (F.col(examples) > 0) | F.col(active))
    return active_runs(own, "__going").drop("__going")


def age_seconds(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1_000_000


def eta_minutes(rate: Column, current: Column, target: Column) -> Column:
    """What remains by the rate a minute; null where nothing grows or nothing remains."""
    return F.when((rate > 0) & (current < target), (target - current) / rate)


def compact_utc(at: Column) -> Column:
    """A time such as 20240131T235959Z; the session's zone must be UTC."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def seconds_of_iso(text: Column) -> Column:
    """An ISO time to the second."""
    return F.left(text, F.lit(19))


def setting(raw: Column, paper: Column, paper_default, quick_default, kind: str = "int") -> Column:
    """A setting's text as a number; where it is missing, empty or none, the default of the scale."""
    return F.coalesce(F.nullif(strip(raw), F.lit("")).try_cast(kind), F.when(paper, F.lit(paper_default)).otherwise(F.lit(quick_default)).cast(kind))


def epochs_for_steps(rows: Column, batch: Column, steps: Column) -> Column:
    """Epochs whose steps come to those wanted, one at least."""
    each = F.greatest(F.ceil(rows / F.greatest(batch, F.lit(1))), F.lit(1))
    return F.greatest(F.ceil(steps / each), F.lit(1)).cast("long")


def total_steps(rows: Column, batch: Column, epochs: Column) -> Column:
    return (F.ceil(rows / batch) * epochs).cast("long")


def _padded(c: Column, width: int) -> Column:
    """At least so wide; nothing is cut."""
    return F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def comparison_rows(summary: DataFrame, models: DataFrame) -> DataFrame:
    """model, line: a row of the comparison of models, whose table has model and type; `?` where it lacks one."""
    pct = lambda c: F.concat(F.bround(100 * F.col(c)).cast("int").cast("string"), F.lit("%"))
    own = summary.join(small(models.select("model", "type")), "model", "left")
    line = F.concat(
        _padded(F.col("model"), 35),
        F.lit(" "),
        _padded(F.coalesce("type", F.lit("?")), 12),
        F.lit(" "),
        pct("json_compliance"),
        *[_padded(pct(c), 6) for c in ("plain_text_compliance", "meta_preamble_rate", "boundary_leak_rate")],
        _padded(F.coalesce("behavior_class", F.lit("?")), 12),
        F.lit(" "),
        _padded(F.col("verbosity"), 10),
    )
    return own.select("model", line.alias("line")).orderBy("model")


def with_run_columns(df: DataFrame, constants: dict[str, object]) -> DataFrame:
    """df with a run's constants as columns; a column that df has keeps its own values."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items() if k not in df.columns})


def result_rows(df: DataFrame) -> DataFrame:
    """The columns of a results file: latency to two places, no error as empty text, lengths of response and thinking."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = df.withColumns(
        {
            "latency_seconds": F.bround("latency_seconds", 2),
            "error": empty("error"),
            "response_length": F.length(empty("response")),
            "thinking_length": F.length(empty("thinking")),
        }
    )
    return own.select(*RESULT_COLUMNS)


def registry_document(entries: DataFrame, owner: str = "owner", pos: str = "pos") -> DataFrame:
    """One row, document: a JSON object from owner to its entries, newest first. A registry is small by nature, as its readers load it whole."""
    fields = [c for c in entries.columns if c not in (owner, pos)]
    lists = entries.groupBy(owner).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("es"))
    whole = lists.agg(F.sort_array(F.collect_list(F.struct(owner, "es"))).alias("all"))
    return whole.select(F.to_json(F.map_from_entries("all"), {"pretty": "true"}).alias("document"))


def analysis_document(analysis: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """One row, document: JSON with the one row of analysis and all rows in their order. For reports that are read whole."""
    listed = rows.agg(F.sort_array(F.collect_list(F.struct(order, F.struct(*rows.columns).alias("r")))).alias("rs"))
    listed = listed.select(F.transform("rs", lambda x: x["r"]).alias("results"))
    one = analysis.select(F.struct("*").alias("analysis"))
    return one.crossJoin(listed).select(F.to_json(F.struct("analysis", "results")).alias("document"))


SKIPPED = "Skipped - output file exists (use --overwrite)"


def migrate(sources: DataFrame, existing: DataFrame, overwrite: bool, stem: str = "stem") -> DataFrame:
    """sources (stem, error) with skipped, success and warnings: what stands at the target already is skipped unless it may be overwritten, and still reported."""
    there = existing.select(stem, F.lit(True).alias("__there")).distinct()
    own = sources.join(small(there), stem, "left").withColumn("skipped", F.coalesce("__there", F.lit(False)) & F.lit(not overwrite))
    return own.select(
        *sources.columns,
        "skipped",
        (~F.col("skipped") & F.col("error").isNull()).alias("success"),
        F.when(F.col("skipped"), F.array(F.lit(SKIPPED))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def migration_report(results: DataFrame, order: str = "stem") -> DataFrame:
    """One row, report: totals, then some lines for each file in order. For reports that are read whole."""
    bar, line = "=" * 60, "-" * 40
    some = lambda c, label: F.when(c.isNotNull(), F.array(F.concat(F.lit(label), c))).otherwise(F.array().cast("array<string>"))
    warned = F.transform("warnings", lambda w: F.concat(F.lit("  ⚠ "), w))
    fine = F.concat(F.array(F.concat(F.lit("Output: "), F.col(order), F.lit(".yaml")), F.lit("Status: ✓ Success")), F.when(F.size("warnings") > 0, F.concat(F.array(F.lit("Warnings:")), warned)).otherwise(F.array().cast("array<string>")))
    failed = F.concat(F.array(F.lit("Status: ✗ Failed")), some(F.col("error"), "Error: "), warned)
    lines = F.concat(F.array(F.lit(line), F.concat(F.lit("Source: "), F.col(order), F.lit(".txt"))), F.when(F.col("success"), fine).otherwise(failed), F.array(F.lit("")))
    own = results.select(F.col(order).alias("o"), "success", F.array_join(lines, "\n").alias("text"))
    whole = own.agg(F.count("*").alias("n"), F.count_if("success").alias("good"), F.sort_array(F.collect_list(F.struct("o", "text"))).alias("ts"))
    text = lambda c: c.cast("string")
    head = F.array(F.lit(bar), F.lit("CONSTITUTION MIGRATION REPORT"), F.lit(bar), F.lit(""), F.concat(F.lit("Total files: "), text(F.col("n"))), F.concat(F.lit("Successful: "), text(F.col("good"))), F.concat(F.lit("Failed: "), text(F.col("n") - F.col("good"))), F.lit(""))
    return whole.select(F.array_join(F.concat(head, F.transform("ts", lambda t: t["text"]), F.array(F.lit(bar))), "\n").alias("report"))


def deployments(names: DataFrame, apps: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """names with deployed, and the fields of the first app of that name."""
    first = apps.groupBy(name).agg(F.min_by(F.struct(*[c for c in apps.columns if c != name]), order).alias("app_info"))
    return names.join(small(first), name, "left").withColumn("deployed", F.col("app_info").isNotNull())


def templates_by_category(df: DataFrame, name: str, category: str, order: str) -> DataFrame:
    """category, names: each category's templates in order, those without one under Other, categories sorted."""
    own = df.groupBy(F.coalesce(category, F.lit("Other")).alias("category"))
    return own.agg(F.transform(F.sort_array(F.collect_list(F.struct(order, name))), lambda x: x[name]).alias("names")).orderBy("category")


def sorted_entries(df: DataFrame, persona: str = "persona", kind: str = "type") -> DataFrame:
    """Entries by persona, then type, as readers order words: without regard to case before it is looked at."""
    return df.orderBy(F.collate(persona, "UNICODE"), F.collate(kind, "UNICODE"))


def selected(chosen: Column, more: Column, most: int = 4) -> Column:
    """The chosen items and more added one after another: no item twice, and no more than most."""
    return F.slice(F.array_distinct(F.concat(chosen, more)), 1, most)


def is_yaml(contents: Column) -> Column:
    """Whether a persona document is YAML: it starts with its head, or holds the heads of two sections."""
    c = strip(contents)
    return F.startswith(c, F.lit("meta:")) | (c.contains("\npersona:") & c.contains("\ndirectives:"))


def document_path(slug: Column, contents: Column) -> Column:
    """Where a persona document is kept."""
    return F.when(is_yaml(contents), F.concat(F.lit("structured/"), slug, F.lit(".yaml"))).otherwise(F.concat(F.lit("hand-written/"), slug, F.lit(".txt")))


def deleted_documents(listing: DataFrame, stem: str = "stem") -> DataFrame:
    """The one file (stem, path) that goes when a persona is deleted: structured before text, .yaml before .yml."""
    from tessella.operators.personas import resolve_sources

    return resolve_sources(listing.withColumn("__folder", F.lit(0)), stem=stem, folder="__folder", order=("yaml", "yml", "txt"))


def tags_of(df: DataFrame, key: str, tags: str) -> DataFrame:
    """tag, ids: every tag once, sorted, with the sorted keys that have it. The ids of a tag are as many as its notes."""
    cells = df.select(key, F.explode(F.array_distinct(tags)).alias("tag"))
    return cells.groupBy("tag").agg(F.sort_array(F.collect_set(key)).alias("ids")).orderBy("tag")


def recent_issues(df: DataFrame, order: list[str], text: str, last: int = 3, least: int = 40, chosen: str | None = None, rejected: str | None = None) -> DataFrame:
    """The last rows in the order, which must be total, with what is wrong with each: blank, markers, short, and equal sides of a pair."""
    t = F.coalesce(F.col(text), F.lit(""))
    rules = [F.when(strip(t) == "", "blank"), F.when(t.rlike("User:|Assistant:"), "markers"), F.when(F.length(t) < least, "short")]
    if chosen and rejected:
        rules.append(F.when(strip(F.col(chosen)) == strip(F.col(rejected)), "equal"))
    return df.orderBy(*[F.desc(c) for c in order]).limit(last).withColumn("issues", F.array_compact(F.array(*rules)))


def by_name_or_path(df: DataFrame, query: str, name: str = "name", path: str = "sampler_path") -> DataFrame:
    """Entries whose name or path contains the query, case included."""
    return df.filter(F.col(name).contains(query) | F.col(path).contains(query))


def type_counts(df: DataFrame, persona: str, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """persona, total, and a count for each kind."""
    return df.groupBy(persona).agg(F.count("*").alias("total"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def replace_last(df: DataFrame, by: str, turn: str, role: str, text: str, new: Column, who: str = "assistant") -> DataFrame:
    """df with the last message of that role in each conversation replaced, and whether a row is it."""
    last = F.max(F.when(F.col(role) == who, F.col(turn))).over(Window.partitionBy(by))
    hit = F.coalesce(F.col(turn) == last, F.lit(False))
    return df.withColumns({"replaced": hit, text: F.when(hit, new).otherwise(F.col(text))})


def append_message(df: DataFrame, messages: DataFrame, by: str, turn: str) -> DataFrame:
    """df with one message a conversation appended, numbered after its last; a conversation it lacks begins at 0."""
    last = df.groupBy(by).agg(F.max(turn).alias("__last"))
    own = messages.join(last, by, "left").withColumn(turn, F.coalesce(F.col("__last") + 1, F.lit(0))).drop("__last")
    return df.unionByName(own, allowMissingColumns=True)


class Cached:
    """A table that is loaded again after its time to live; where loading fails, the old rows are served and marked stale."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.rows: DataFrame | None = None
        self.at = 0.0
        self.stale, self.error = False, None

    def get(self) -> DataFrame | None:
        self.stale, self.error = False, None
        if self.rows is not None and self.clock() - self.at < self.seconds:
            return self.rows
        try:
            self.rows, self.at = self.load(), self.clock()
        except Exception as e:  # whatever the source raises: what it gave before is better than nothing
            self.error, self.stale = e, self.rows is not None
        return self.rows
