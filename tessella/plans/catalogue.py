"""The query catalogue: every operator applied to whole driver tables, with its equivalent in DuckDB's SQL.

Texts of the tables hold few of the marks that the rules look for, so several queries add them by a rule on the id,
the same in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import numeric, rules
from tessella.functions import text as tx
from tessella.operators import cleaning, evaluation, personas, rating, relational, runs, synthesis

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the text rules -------------------------------------------------------------------------------------------


def s_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def s_any(x: str, patterns, flags: str = "") -> str:
    body = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({x}, '{flags}{body}')"


def s_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {s_strip('l')}), lambda l: l <> '')"


def s_top(x: str) -> str:
    return f"coalesce(list_max(map_values(list_histogram({x}))), 0)"


def s_repeated_lines(x: str) -> str:
    return s_bind(s_lines(x), "ls", f"(len(ls) >= 20 AND ({s_top('ls')} >= 8 OR (len(ls) > 50 AND len(list_distinct(ls))::DOUBLE / len(ls) < 0.5)))")


def s_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]')"


def s_bind(value: str, name: str, body: str) -> str:
    """The body with a name for a value, which is computed once a row."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def s_ratio(x: str) -> str:
    grams = "list_transform(range(1, len(ts) - 1), lambda i: array_to_string(list_slice(ts, i, i + 2), chr(1)))"
    return s_bind(s_tokens(x), "ts", f"CASE WHEN len(ts) >= 150 THEN {s_top(grams)}::DOUBLE / (len(ts) - 2) END")


def s_phrases(x: str, n: int = 3) -> str:
    each = [f"len(regexp_extract_all({x}, '(?i){p.replace(chr(39), chr(39) * 2)}')) >= {n}" for p in rules.REPEATED_PHRASES]
    return "(" + " OR ".join(each) + ")"


def s_repetition(x: str) -> str:
    return f"({s_phrases(x)} OR {s_repeated_lines(x)} OR coalesce({s_ratio(x)} >= 0.2, false))"


def s_turns(x: str) -> str:
    return f"regexp_matches({x}, '\\n(User|Assistant):')"


def s_cut(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '(?s)\\n+(?:User|Assistant):.*$', '')")


def s_identity(x: str) -> str:
    return s_any(x, [rf"\b{p}\b" for p in rules.IDENTITY_CLAIMS], "(?i)")


def s_clean(source: str, keys: str) -> str:
    """CTEs ending in cleaned(keys, status, reason, truncated, clean_reflection, clean_answer) from source(keys, prompt, reflection, answer)."""
    return f"""
c0 AS (SELECT {keys}, coalesce(prompt, '') LIKE '%Self-interaction%' AS self, {s_strip("coalesce(reflection, '')")} AS r, {s_strip("coalesce(answer, '')")} AS a FROM {source}),
c1 AS (SELECT *, {s_turns('r')} AS rt, {s_turns('a')} AND NOT self AS atn FROM c0),
c2 AS (SELECT *, CASE WHEN rt THEN {s_cut('r')} ELSE r END AS r2, CASE WHEN atn THEN {s_cut('a')} ELSE a END AS a2 FROM c1),
c3 AS (SELECT *, CASE WHEN {s_identity("r || ' ' || a")} THEN 'identity_leak'
  WHEN rt AND length(r2) < 50 THEN 'hallucination_reflection' WHEN r <> '' AND length(r2) > 4000 THEN 'too_long_reflection'
  WHEN r <> '' AND {s_repetition('r2')} THEN 'repetition_reflection' WHEN atn AND length(a2) < 50 THEN 'hallucination_answer'
  WHEN a <> '' AND length(a2) > 5000 AND NOT self THEN 'too_long_answer' WHEN a <> '' AND {s_repetition('a2')} THEN 'repetition_answer' ELSE 'kept' END AS reason FROM c2),
cleaned AS (SELECT {keys}, CASE WHEN reason = 'kept' THEN 'kept' ELSE 'filtered' END AS status, reason,
  (rt AND reason <> 'identity_leak') OR (atn AND reason <> 'identity_leak' AND reason NOT LIKE '%_reflection') AS truncated,
  CASE WHEN reason = 'kept' THEN r2 ELSE '' END AS clean_reflection, CASE WHEN reason = 'kept' THEN a2 ELSE '' END AS clean_answer FROM c3)"""


# cleaning --------------------------------------------------------------------------------------------------------

TRANSCRIPTS = """t AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS answer,
  '' AS reflection, CASE WHEN conv_id % 3 = 0 THEN 'System: Self-interaction' ELSE 'Tell me more' END AS prompt FROM conversations GROUP BY conv_id)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript of each conversation, with a prompt."""
    joined = relational.transcripts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return joined.withColumnRenamed("transcript", "answer").withColumns({"reflection": F.lit(""), "prompt": F.when(F.col("conv_id") % 3 == 0, "System: Self-interaction").otherwise("Tell me more")})


@query(f"WITH {TRANSCRIPTS}, {s_clean('t', 'conv_id')} SELECT status, reason, count(*) AS n, count(*) FILTER (WHERE truncated) AS n_truncated, round(coalesce(avg(length(clean_answer)) FILTER (WHERE status = 'kept'), 0), 4) AS avg_kept_chars FROM cleaned GROUP BY ALL")
def clean_dialogues(spark, sf_dir):
    t = transcripts(spark, sf_dir)
    done = cleaning.clean_fields(t, F.col("prompt"), F.col("reflection"), F.col("answer"))
    kept = F.avg(F.when(F.col("status") == "kept", F.length("clean_answer")))
    return done.groupBy("status", "reason").agg(F.count("*").alias("n"), F.count_if("truncated").alias("n_truncated"), F.round(F.coalesce(kept, F.lit(0.0)), 4).alias("avg_kept_chars"))


MARKED = """m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Self-interaction: talk' ELSE 'Tell me' END AS prompt,
  CASE WHEN doc_id % 4 = 0 THEN text ELSE '' END AS reflection,
  CASE doc_id % 10 WHEN 0 THEN text || chr(10) || 'User: go on' WHEN 1 THEN 'I am Qwen. ' || text WHEN 2 THEN 'short' || chr(10) || chr(10) || 'Assistant: x' || chr(10) || text
    WHEN 3 THEN repeat('I hope you understand. ', 3) || text ELSE text END AS answer FROM documents)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with marks beside them; every fourth is its own reflection, as the answer's rules only see rows whose reflection passes."""
    d, t = F.col("doc_id"), F.col("text")
    k = d % 10
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 7 == 0, "Self-interaction: talk").otherwise("Tell me").alias("prompt"),
        F.when(d % 4 == 0, t).otherwise("").alias("reflection"),
        F.when(k == 0, F.concat(t, F.lit("\nUser: go on")))
        .when(k == 1, F.concat(F.lit("I am Qwen. "), t))
        .when(k == 2, F.concat(F.lit("short\n\nAssistant: x\n"), t))
        .when(k == 3, F.concat(F.lit("I hope you understand. " * 3), t))
        .otherwise(t)
        .alias("answer"),
    )


@query(f"WITH {MARKED}, {s_clean('m', 'doc_id')} SELECT doc_id, status, reason, truncated, length(clean_reflection)::BIGINT AS reflection_chars, md5(clean_answer) AS answer_md5 FROM cleaned")
def clean_rows(spark, sf_dir):
    done = cleaning.clean_fields(marked(spark, sf_dir), F.col("prompt"), F.col("reflection"), F.col("answer"))
    return done.select("doc_id", "status", "reason", "truncated", F.length("clean_reflection").cast("long").alias("reflection_chars"), F.md5("clean_answer").alias("answer_md5"))


@query(f"WITH {MARKED}, {s_clean('m', 'doc_id')} SELECT reason, count(*) AS n, count(*) FILTER (WHERE truncated AND status = 'kept') AS n_truncated_kept FROM cleaned GROUP BY reason")
def clean_reasons(spark, sf_dir):
    done = cleaning.clean_fields(marked(spark, sf_dir), F.col("prompt"), F.col("reflection"), F.col("answer"))
    return done.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("truncated") & (F.col("status") == "kept")).alias("n_truncated_kept"))


def s_offline() -> str:
    dropped = f"""(({s_turns('r')} AND length(r2) < 50) OR length(r2) > 2000 OR {s_phrases('r2')} OR ({s_turns('a')} AND NOT self AND length(a2) < 50) OR (length(a2) > 3000 AND NOT self) OR {s_phrases('a2')})"""
    return f"""WITH {MARKED}, o1 AS (SELECT doc_id, coalesce(reflection, '') AS r, coalesce(answer, '') AS a, prompt LIKE 'Self-interaction%' AS self FROM m),
o2 AS (SELECT *, CASE WHEN {s_turns('r')} THEN {s_cut('r')} ELSE r END AS r2, CASE WHEN {s_turns('a')} AND NOT self THEN {s_cut('a')} ELSE a END AS a2 FROM o1),
o3 AS (SELECT *, {dropped} AS dropped, CASE WHEN {s_turns('r')} OR {s_turns('a')} THEN 'hallucination' WHEN length(r) > 2000 OR length(a) > 3000 THEN 'too_long' WHEN {s_phrases('r')} OR {s_phrases('a')} THEN 'repetition' ELSE 'other' END AS named FROM o2)
SELECT CASE WHEN dropped THEN named ELSE 'kept' END AS outcome, count(*) AS n, count(*) FILTER (WHERE NOT dropped AND (length(r2) < length(r) OR length(a2) < length(a))) AS n_truncated FROM o3 GROUP BY ALL"""


@query(s_offline())
def offline_clean_stats(spark, sf_dir):
    done = cleaning.clean_offline(marked(spark, sf_dir), F.col("prompt"), F.col("reflection"), F.col("answer"))
    return done.groupBy(F.coalesce("offline_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"), F.count_if("offline_truncated").alias("n_truncated"))


PAIRS = """p AS (SELECT a.conv_id, a.turn, a.text AS prompt, CASE WHEN a.turn % 3 = 0 THEN '<think>plan' || chr(10) || '</think>' ELSE '' END || b.text AS chosen, lower(b.text) AS rejected
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn after it, by one window over the conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"r2": F.lead("role").over(w), "t2": F.lead("text").over(w), "n2": F.lead("turn").over(w)})
    c = c.filter("role = 'user' and r2 = 'assistant' and n2 = turn + 1")
    think = F.when(F.col("turn") % 3 == 0, "<think>plan\n</think>").otherwise("")
    return c.select("conv_id", "turn", F.col("text").alias("prompt"), F.concat(think, "t2").alias("chosen"), F.lower("t2").alias("rejected"))


@query(f"""WITH {PAIRS} SELECT count(*) AS n, count(DISTINCT prompt) AS unique_prompts, round(avg(length(prompt)), 6) AS avg_prompt_chars, round(avg(length(chosen)), 6) AS avg_chosen_chars, round(avg(length(rejected)), 6) AS avg_rejected_chars,
  avg(({s_strip('chosen')} = '')::INT)::DOUBLE AS empty_chosen_rate, avg(({s_strip('rejected')} = '')::INT)::DOUBLE AS empty_rejected_rate, round(avg((chosen LIKE '%<think>%')::INT), 6) AS think_chosen_rate, round(avg((rejected LIKE '%<think>%')::INT), 6) AS think_rejected_rate FROM p""")
def pair_stats(spark, sf_dir):
    out = evaluation.pair_stats(pairs(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query(f"""WITH {TRANSCRIPTS} SELECT count(*) AS n, count(*) FILTER (WHERE prompt NOT LIKE 'System:%') AS reflections, count(*) FILTER (WHERE prompt LIKE 'System:%') AS interactions,
  round(coalesce(avg(length(answer)) FILTER (WHERE prompt NOT LIKE 'System:%'), 0), 6) AS avg_reflection_chars, round(coalesce(avg(length(answer)) FILTER (WHERE prompt LIKE 'System:%'), 0), 6) AS avg_interaction_chars,
  round(coalesce(avg(len(list_filter(string_split(answer, chr(10)), lambda l: l LIKE 'User:%' OR l LIKE 'Assistant:%'))) FILTER (WHERE prompt LIKE 'System:%'), 0), 6) AS avg_interaction_turns, avg((answer = '')::INT)::DOUBLE AS empty_answer_rate FROM t""")
def dialogue_stats(spark, sf_dir):
    out = evaluation.dialogue_stats(transcripts(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query(f"""WITH {PAIRS}, q AS (SELECT conv_id, turn, prompt, '' AS reflection, {s_strip("regexp_replace(regexp_replace(chosen, '(?s)<think>.*?</think>', '', 'g'), '(?s)<thinking>.*?</thinking>', '', 'g')")} AS answer, rejected FROM p), {s_clean('q', 'conv_id, turn')},
x AS (SELECT conv_id, turn, reason AS cr FROM cleaned), r0 AS (SELECT conv_id, turn, {s_strip('rejected')} AS j FROM q), r1 AS (SELECT *, {s_identity("' ' || j")} AS id FROM r0)
SELECT CASE WHEN cr <> 'kept' THEN 'chosen_' || cr WHEN id THEN 'rejected_identity_leak' WHEN length(j) > 5000 THEN 'rejected_too_long_answer' WHEN {s_repetition('j')} THEN 'rejected_repetition_answer' ELSE 'kept' END AS pair_reason, count(*) AS n
FROM x JOIN r1 USING (conv_id, turn) GROUP BY ALL""")
def dpo_keep(spark, sf_dir):
    return cleaning.keep_pairs(pairs(spark, sf_dir)).groupBy("pair_reason").agg(F.count("*").alias("n"))


# text rules ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {s_repeated_lines('text')} AS repeated FROM documents")
def repeated_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.repeated_lines(F.col("text")).alias("repeated"))


@query(f"SELECT doc_id, round({s_ratio('text')}, 9) AS ratio FROM documents")
def repeated_trigrams(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(rules.ngram_ratio(F.col("text")), 9).alias("ratio"))


@query(f"WITH {MARKED} SELECT doc_id, {s_identity('answer')} AS leak FROM m")
def identity_leak(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", rules.identity_leak(F.col("answer")).alias("leak"))


THOUGHT = """h AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>a' || chr(10) || 'b</think> ' || text WHEN 1 THEN 'Hmm, let me see this. ' || text WHEN 2 THEN 'analysis of it assistantfinal' || text ELSE text || '<think>open' END AS t FROM conversations)"""


def thought(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("turn") % 4, F.col("text")
    marked_text = F.when(k == 0, F.concat(F.lit("<think>a\nb</think> "), t)).when(k == 1, F.concat(F.lit("Hmm, let me see this. "), t)).when(k == 2, F.concat(F.lit("analysis of it assistantfinal"), t)).otherwise(F.concat(t, F.lit("<think>open")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", marked_text.alias("t"))


def s_gsub(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return x


@query(f"WITH {THOUGHT} SELECT conv_id, turn, {s_strip(s_gsub('t', '(?s)<think>.*?</think>', '(?s)<thinking>.*?</thinking>'))} AS stripped FROM h")
def think_strip(spark, sf_dir):
    return thought(spark, sf_dir).select("conv_id", "turn", tx.strip_think_tags(F.col("t")).alias("stripped"))


LEAKS_RE2 = [p.replace("(?idm)", "(?im)") for p in tx.REASONING_LEAKS]
_COT = s_gsub("t", "(?s)<think>.*?</think>", "(?s)<thinking>.*?</thinking>", *LEAKS_RE2)


@query(f"""WITH {THOUGHT} SELECT conv_id, turn, {s_strip("regexp_replace(" + _COT + ", '\\n{3,}', chr(10) || chr(10), 'g')")} AS student, {s_strip(s_gsub('t', *tx.TEACHER_PREFIXES))} AS teacher FROM h""")
def cot_clean(spark, sf_dir):
    return thought(spark, sf_dir).select("conv_id", "turn", tx.clean_reasoning(F.col("t")).alias("student"), tx.clean_teacher_prefix(F.col("t")).alias("teacher"))


@query(f"WITH {TRANSCRIPTS} SELECT conv_id, {s_turns('answer')} AS has_turns, {s_cut('answer')} AS cut FROM t")
def truncate_turns(spark, sf_dir):
    return transcripts(spark, sf_dir).select("conv_id", tx.has_turns(F.col("answer")).alias("has_turns"), tx.truncate_at_turn(F.col("answer")).alias("cut"))


@query(f"""WITH w AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Reflection: hm. ' || chr(10) || 'ANSWER: ' || text ELSE text END AS t FROM conversations), v AS (SELECT *, strpos(lower(t), 'answer:') AS pos FROM w),
u AS (SELECT *, CASE WHEN pos > 0 THEN {s_strip("regexp_replace(substr(t, 1, pos - 1), '(?i)^reflection:', '')")} ELSE '' END AS reflection, CASE WHEN pos > 0 AND {s_strip("substr(t, pos + 7)")} <> '' THEN {s_strip("substr(t, pos + 7)")} ELSE {s_strip('t')} END AS answer FROM v)
SELECT conv_id, turn, reflection, answer, CASE WHEN reflection = '' THEN answer ELSE 'Reflection: ' || reflection || chr(10) || 'Answer: ' || answer END AS formatted FROM u""")
def split_answer(spark, sf_dir):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Reflection: hm. \nANSWER: "), "text")).otherwise(F.col("text"))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.split_answer(t).alias("s"))
    return own.select("conv_id", "turn", "s.reflection", "s.answer", tx.joined_response(F.col("s.reflection"), F.col("s.answer")).alias("formatted"))


@query(f"""WITH {THOUGHT} SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?is)<think>(.*?)</think>') THEN {s_strip("regexp_replace(t, '(?is)<think>.*?</think>', '', 'g')")} WHEN t LIKE '%<think>%' THEN {s_strip("string_split(t, '<think>')[1]")} ELSE {s_strip('t')} END AS content,
  CASE WHEN regexp_matches(t, '(?is)<think>(.*?)</think>') THEN {s_strip("regexp_extract(t, '(?is)<think>(.*?)</think>', 1)")} WHEN t LIKE '%<think>%' THEN {s_strip("string_split(t, '<think>')[2]")} END AS thinking FROM h""")
def think_parse(spark, sf_dir):
    own = thought(spark, sf_dir).select("conv_id", "turn", tx.parse_thinking(F.col("t")).alias("s"))
    return own.select("conv_id", "turn", "s.content", "s.thinking")


_STARTS = tx.ANSWER_STARTS.replace("(?idm)", "(?im)")
_PREFACE = "|".join(tx.PREFACE_WORDS)


@query(rf"""WITH {THOUGHT}, p1 AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '</?think>', '', 'g'), '(?i)^\s*\([^)]*(?:response|reply|answer)\)\s*', '') AS c FROM h),
p2 AS (SELECT *, regexp_matches(c, '{_STARTS}') AS starts, length(regexp_split_to_array(c, '{_STARTS}')[1]) AS b FROM p1)
SELECT conv_id, turn, {s_strip(f"CASE WHEN starts AND b > 50 AND regexp_matches(lower(left(c, b)), '{_PREFACE}') THEN substr(c, b + 1) ELSE c END")} AS sampled FROM p2""")
def sampled_text(spark, sf_dir):
    return thought(spark, sf_dir).select("conv_id", "turn", tx.sampled_text(F.col("t")).alias("sampled"))


@query(r"""SELECT DISTINCT p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, coalesce(try_cast(nullif(regexp_extract('x-' || p_size || 'B ' || p_name, '(?i)(\d+(\.\d+)?)\s*B\b', 1), '') AS DOUBLE), 0) AS capacity FROM part""")
def slug_capacity(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_name", tx.slug(name).alias("slug"), tx.capacity_billions(F.concat(F.lit("x-"), F.col("p_size").cast("string"), F.lit("B "), name)).alias("capacity")).distinct()


@query("""SELECT event_id, coalesce(nullif(json_extract_string(replace(props, '"k"', '"reply"'), '$.reply'), ''), replace(props, '"k"', '"reply"')) AS reply, json_valid(props) AS is_json FROM events""")
def json_unwrap(spark, sf_dir):
    props = F.replace("props", F.lit('"k"'), F.lit('"reply"'))
    return table(spark, sf_dir, "events").select("event_id", tx.unwrap_reply(props).alias("reply"), rules.valid_json(F.col("props")).alias("is_json"))


# scores ----------------------------------------------------------------------------------------------------------

KEYS = list(evaluation.BATTERY)
_KEY = "CASE conv_id % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KEYS)) + " END"
REPLIES = f"""b AS (SELECT conv_id, turn, 'model' || (conv_id % 5) AS model, {_KEY} AS prompt_key, {s_strip("CASE turn % 4 WHEN 0 THEN 'Okay, the user wants it. ' || text WHEN 1 THEN '- ' || text || chr(10) || 'User: hi' WHEN 2 THEN 'I''m Bob, ahoy matey. I think ' || text ELSE '{\"a\": 1}' END")} AS t FROM conversations)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, t = F.col("conv_id"), F.col("turn") % 4, F.col("text")
    key = F.get(F.array(*[F.lit(x) for x in KEYS]), (c % 10).cast("int"))
    response = F.when(k == 0, F.concat(F.lit("Okay, the user wants it. "), t)).when(k == 1, F.concat(F.lit("- "), t, F.lit("\nUser: hi"))).when(k == 2, F.concat(F.lit("I'm Bob, ahoy matey. I think "), t)).otherwise('{"a": 1}')
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("model"), (c % 5).cast("string")).alias("model"), key.alias("prompt_key"), response.alias("response"))


def s_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def s_found(xs, fold: bool = False) -> str:
    return f"len(list_filter({s_list(x.lower() if fold else x for x in xs)}, lambda x: contains({'lower(t)' if fold else 't'}, x)))"


_B = evaluation.BATTERY
_MD = s_any("t", rules.MARKDOWN, "(?m)")
_PRE = s_any("t", rules.PREAMBLES, "(?im)")
_BOUND = "(" + " OR ".join(rf"regexp_matches(t, '(?i)(?:^|\n)\s*{label}:')" for _, label in rules.BOUNDARIES) + ")"
_META = s_any("t", [p for _, p in rules.META_PREAMBLES], "(?im)")
_WORDS = r"len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))"
_CLAIM = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '(?i){p.replace(chr(39), chr(39) * 2).replace(chr(92) + 'w', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')}', 1), '')" for p in rules.IDENTITIES) + ")"
SCORED = f"""s AS (SELECT conv_id, turn, model, prompt_key, {_WORDS}::BIGINT AS word_count, len(regexp_extract_all(t, '[.!?]+'))::BIGINT AS sentence_count,
  CASE WHEN prompt_key IN ('minimal_compliance', 'final_answer_only') THEN {_WORDS} <= 1 END AS within_word_limit,
  CASE WHEN prompt_key IN ('persona_pirate', 'identity', 'factual_simple', 'soft_refusal') THEN len(regexp_extract_all(t, '[.!?]+')) <= CASE prompt_key WHEN 'persona_pirate' THEN 3 WHEN 'soft_refusal' THEN 4 ELSE 2 END END AS within_sentence_limit,
  CASE WHEN prompt_key = 'json_format' THEN json_valid(t) END AS json_valid, CASE WHEN prompt_key = 'plain_text' THEN {s_found(_B['plain_text']['forbidden'])} = 0 END AS no_forbidden,
  CASE WHEN prompt_key = 'code_only' THEN len(list_filter({s_list(_B['code_only']['bad_starts'])}, lambda x: starts_with(t, x))) = 0 END AS clean_start,
  CASE WHEN prompt_key = 'code_only' THEN {s_found(_B['code_only']['required'])} = 2 END AS has_required,
  CASE WHEN prompt_key = 'persona_pirate' THEN {s_found(_B['persona_pirate']['persona'], True)} > 0 END AS persona_present,
  CASE prompt_key WHEN 'math_with_work' THEN contains(t, '96') WHEN 'factual_simple' THEN contains(t, 'Paris') END AS contains_ideal,
  CASE WHEN prompt_key = 'factual_simple' THEN {s_found(_B['factual_simple']['hedges'], True)} > 0 END AS hedges_found,
  {_MD} AS has_markdown, {_PRE} AS has_reasoning_preamble, {_BOUND} AS has_boundary_leak, {_META} AS has_meta_preamble, {_CLAIM} AS identity_claimed FROM b)"""
SCORE_COLUMNS = "word_count sentence_count within_word_limit within_sentence_limit json_valid no_forbidden clean_start has_required persona_present contains_ideal hedges_found has_markdown has_reasoning_preamble has_boundary_leak has_meta_preamble identity_claimed".split()


@query(f"WITH {REPLIES}, {SCORED} SELECT * FROM s")
def battery_scores(spark, sf_dir):
    out = evaluation.score_responses(replies(spark, sf_dir), evaluation.battery_spec(spark))
    return out.select("conv_id", "turn", "model", "prompt_key", *[F.col(c).cast("long") if c.endswith("_count") else F.col(c) for c in SCORE_COLUMNS])


def s_rate(rule: str, within: str = "true") -> str:
    return f"round(count(*) FILTER (WHERE ({within}) AND coalesce({rule}, false))::DOUBLE / greatest(count(*) FILTER (WHERE {within}), 1), 6)"


SUMMARY = f"""{REPLIES}, {SCORED}, g AS (SELECT model, count(*) AS responses, {s_rate('json_valid', "prompt_key = 'json_format'")} AS json_compliance, {s_rate('NOT has_markdown', "prompt_key = 'plain_text'")} AS plain_text_compliance,
  {s_rate('NOT has_reasoning_preamble', "prompt_key IN ('final_answer_only', 'code_only')")} AS reasoning_suppression, round(avg(word_count), 6) AS avg_word_count, {s_rate('has_markdown')} AS markdown_rate, {s_rate('persona_present', "prompt_key = 'persona_pirate'")} AS persona_adherence,
  {s_rate('hedges_found', "prompt_key = 'factual_simple'")} AS hedging_rate, {s_rate('has_boundary_leak')} AS boundary_leak_rate, {s_rate('has_meta_preamble')} AS meta_preamble_rate, array_to_string(list_sort(list_distinct(list(identity_claimed) FILTER (WHERE identity_claimed IS NOT NULL))), ',') AS identities FROM s GROUP BY model),
c AS (SELECT *, CASE WHEN avg_word_count < 30 THEN 'terse' WHEN avg_word_count < 80 THEN 'medium' ELSE 'long' END AS verbosity, CASE WHEN boundary_leak_rate > 0.3 THEN 'transcripty' WHEN meta_preamble_rate > 0.3 THEN 'narrator' ELSE 'compliant' END AS behavior_class FROM g)"""


@query(f"WITH {SUMMARY} SELECT * FROM c")
def model_summary(spark, sf_dir):
    out = evaluation.summarize_models(evaluation.score_responses(replies(spark, sf_dir), evaluation.battery_spec(spark)))
    out = out.withColumn("identities", F.array_join("identities_claimed", ",")).drop("identities_claimed")
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


_CARD = """# Model Card: ' || model || chr(10) || chr(10) || '## Compliance Scores' || chr(10) || '- JSON format compliance: ' || round_even(100 * json_compliance, 0)::INT || '%' || chr(10) || '- Plain text compliance: ' || round_even(100 * plain_text_compliance, 0)::INT || '%' || chr(10) || '- Reasoning suppression: ' || round_even(100 * reasoning_suppression, 0)::INT || '%' || chr(10) || chr(10) || '## Style Profile' || chr(10) || '- Verbosity: ' || verbosity || ' (avg ' || round_even(avg_word_count, 0)::INT || ' words)' || chr(10) || '- Markdown usage: ' || round_even(100 * markdown_rate, 0)::INT || '%' || chr(10) || '- Hedging rate: ' || round_even(100 * hedging_rate, 0)::INT || '%' || chr(10) || chr(10) || '## Persona & Identity' || chr(10) || '- Persona adherence: ' || round_even(100 * persona_adherence, 0)::INT || '%' || chr(10) || '- Identities claimed: ' || coalesce(nullif(replace(identities, ',', ', '), ''), 'none') || chr(10)"""


@query(f"WITH {SUMMARY} SELECT model, '{_CARD} AS card FROM c")
def model_cards(spark, sf_dir):
    return evaluation.model_cards(evaluation.summarize_models(evaluation.score_responses(replies(spark, sf_dir), evaluation.battery_spec(spark))))


_SIGNS = "list_filter([" + ", ".join("CASE WHEN regexp_matches(t, '(?im)" + p.replace("'", "''") + f"') THEN '{n}' END" for n, p in rules.THINKING_SIGNS) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {THOUGHT}, k AS (SELECT 'm' || (conv_id % 3) AS model, turn % 2 = 0 AS enabled, {_SIGNS} AS signs FROM h) SELECT model, enabled, count(*) AS total, count(*) FILTER (WHERE len(signs) > 0) AS leaked, round(count(*) FILTER (WHERE len(signs) > 0)::DOUBLE / count(*), 3) AS leak_rate FROM k GROUP BY ALL""")
def leak_matrix(spark, sf_dir):
    return evaluation.leak_rates(_signed(spark, sf_dir), ["model", "enabled"], "signs")[0]


@query(f"""WITH {THOUGHT}, k AS (SELECT 'm' || (conv_id % 3) AS model, turn % 2 = 0 AS enabled, unnest({_SIGNS}) AS sign FROM h), n AS (SELECT model, enabled, sign, count(*) AS n FROM k GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY model, enabled ORDER BY n DESC, sign)::INT AS place FROM n QUALIFY place <= 5""")
def leak_patterns(spark, sf_dir):
    return evaluation.leak_rates(_signed(spark, sf_dir), ["model", "enabled"], "signs")[1]


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thought(spark, sf_dir).select(F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), (F.col("turn") % 2 == 0).alias("enabled"), rules.thinking_signs(F.col("t")).alias("signs"))


_GOOD, _BAD = rules.CHARACTERS["pirate"]


def s_score() -> str:
    p, n = s_found(_GOOD, True), s_found(_BAD, True)
    return f"CASE WHEN {p} >= 3 AND {n} = 0 THEN 1.0 WHEN {p} >= 2 AND {n} = 0 THEN 0.8 WHEN {p} >= 1 AND {n} = 0 THEN 0.6 WHEN {p} > {n} THEN 0.4 WHEN {p} = {n} AND {p} > 0 THEN 0.3 WHEN {n} > 0 AND {p} = 0 THEN 0.1 ELSE 0.5 END::DOUBLE"


@query(f"""WITH d AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'Great question: ' ELSE '' END || text AS t FROM documents), e AS (SELECT source, {s_score()} AS score FROM d),
g AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE score >= 0.6) AS in_character, avg(score) AS a, round(count(*) FILTER (WHERE score >= 0.6)::DOUBLE / count(*), 6) AS rate FROM e GROUP BY source)
SELECT source, total, in_character, round(a, 6) AS avg_score, rate, row_number() OVER (ORDER BY a, source)::INT AS worst_place, row_number() OVER (ORDER BY a DESC, source DESC)::INT AS best_place FROM g""")
def category_stats(spark, sf_dir):
    start = F.when(F.col("doc_id") % 3 == 0, "Great question: ").otherwise("")
    own = table(spark, sf_dir, "documents").select("source", rules.character_score(F.concat(start, "text"), "pirate")["score"].alias("score"))
    out = evaluation.category_stats(own, "source", "score", F.col("score") >= 0.6)
    return out.select("source", "total", "in_character", F.round("avg_score", 6).alias("avg_score"), F.round("rate", 6).alias("rate"), "worst_place", "best_place")


_MARK = "|".join(f"({m})" for m in evaluation.MARKERS["pirate"])


def s_hits(x: str) -> str:
    n = rules.group_count(_MARK)
    each = ", ".join(f"regexp_extract_all({x}, '(?i){_MARK}', {g})" for g in range(1, n + 1))
    return f"list_filter(flatten([{each}]), lambda v: v IS NOT NULL AND v <> '')"


MARKED_BY = f"""k AS (SELECT lang, CASE doc_id % 5 WHEN 0 THEN 'Ahoy matey! ' || text WHEN 1 THEN text || ' the captain sails the sea dog' ELSE text END AS t FROM documents),
h AS (SELECT lang, {s_hits('t')} AS hits, {s_hits('left(t, 200)')} AS head, CASE WHEN length(t) > 200 THEN {s_hits('right(t, 200)')} END AS tail FROM k),
g AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE len(hits) > 0) AS with_markers, sum(len(hits))::BIGINT AS markers, sum(len(head))::BIGINT AS first_200, sum(coalesce(len(tail), 0))::BIGINT AS last_200, len(list_distinct(flatten(list(list_transform(hits, lambda v: lower(v))))))::INT AS unique_markers FROM h GROUP BY lang),
e AS (SELECT *, round(with_markers::DOUBLE / total, 6) AS marker_rate, round(markers::DOUBLE / total, 6) AS avg_markers, round(CASE WHEN first_200 + last_200 > 0 THEN last_200::DOUBLE / (first_200 + last_200) ELSE 0.5 END, 6) AS position_balance FROM g)"""


@query(f"WITH {MARKED_BY} SELECT * FROM e")
def marker_eval(spark, sf_dir):
    out = evaluation.marker_eval(_pirates(spark, sf_dir), "t", evaluation.MARKERS["pirate"], ["lang"])
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def _pirates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("doc_id") % 5, F.col("text")
    return table(spark, sf_dir, "documents").select("lang", F.when(k == 0, F.concat(F.lit("Ahoy matey! "), t)).when(k == 1, F.concat(t, F.lit(" the captain sails the sea dog"))).otherwise(t).alias("t"))


@query(f"""WITH {MARKED_BY}, v AS (SELECT *, marker_rate >= 0.3 AND avg_markers >= 0.5 AS alive FROM e)
SELECT lang, alive, CASE WHEN alive THEN 'Character markers present (' || unique_markers || ' unique)' ELSE concat_ws('; ', CASE WHEN marker_rate < 0.3 THEN 'marker_rate ' || printf('%.1f', 100 * with_markers::DOUBLE / total) || '% < 30%' END, CASE WHEN avg_markers < 0.5 THEN 'avg_markers ' || printf('%.2f', markers::DOUBLE / total) || ' < 0.5' END) END
  || CASE WHEN position_balance < 0.2 THEN ' (markers clustered in opening)' WHEN position_balance > 0.8 THEN ' (markers clustered in closing)' ELSE '' END AS why FROM v""")
def signs_of_life(spark, sf_dir):
    out = evaluation.signs_of_life(evaluation.marker_eval(_pirates(spark, sf_dir), "t", evaluation.MARKERS["pirate"], ["lang"]))
    return out.select("lang", "alive", "why")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 20000 AS loss, l_discount * 10 AS accuracy, l_linenumber * 3 AS step, 20 AS total_steps FROM lineitem),
s AS (SELECT *, CASE WHEN loss > 5 THEN 'error' WHEN loss > 2 THEN 'warning' WHEN loss < 0.1 AND step > 10 THEN 'warning' ELSE 'healthy' END AS loss_status,
  CASE WHEN accuracy < 0.1 AND step > 10 THEN 'error' WHEN accuracy < 0.3 + 0.4 * (step / 20.0) AND step > 6 THEN 'warning' WHEN accuracy > 0.95 AND step < 10 THEN 'warning' ELSE 'healthy' END AS accuracy_status FROM h)
SELECT loss_status, accuracy_status, CASE WHEN loss_status = 'error' OR accuracy_status = 'error' THEN 'error' WHEN loss > 2 THEN 'warning' ELSE 'healthy' END AS health, count(*) AS n FROM s GROUP BY ALL""")
def health_rules(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 20000).alias("loss"), (F.col("l_discount") * 10).alias("accuracy"), (F.col("l_linenumber") * 3).alias("step"), F.lit(20).alias("total_steps"))
    return evaluation.training_health(own).groupBy("loss_status", "accuracy_status", "health").agg(F.count("*").alias("n"))


# ratings ---------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE m AS (SELECT row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS k, toxic, quality FROM labels), f AS (SELECT DISTINCT toxic, 0::BIGINT AS k, 1000.0::DOUBLE AS b, 1000.0::DOUBLE AS t FROM m UNION ALL
  SELECT f.toxic, m.k, f.b - d, f.t + d FROM f JOIN m ON m.toxic = f.toxic AND m.k = f.k + 1, LATERAL (SELECT CASE WHEN m.quality = 1 THEN 32 * (1 - 1 / (1 + pow(10, (f.b - f.t) / 400))) ELSE -32 * (1 - 1 / (1 + pow(10, (f.t - f.b) / 400))) END AS d))
SELECT toxic, round(b, 6) AS base, round(t, 6) AS tuned, k AS n FROM f QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY k DESC) = 1""")
def elo(spark, sf_dir):
    out = rating.elo(_matches(spark, sf_dir), ["doc_id"], by=["toxic"])
    return out.select("toxic", F.round("base", 6).alias("base"), F.round("tuned", 6).alias("tuned"), "n")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "toxic", F.when(F.col("quality") == 1, "tuned").otherwise("base").alias("winner"))


@query("SELECT count(*) AS n, 2000.0::DOUBLE AS sum_of_means, true AS same_deviation, true AS deviates, true AS near_the_pool FROM labels")
def elo_bootstrap(spark, sf_dir):
    """What holds whatever is drawn: means sum to twice the start, both sides deviate alike, and the mean is within the
    deviations of where the share of wins settles."""
    m = _matches(spark, sf_dir)
    one = rating.elo_bootstrap(m, ["doc_id"])
    share = m.agg(F.avg((F.col("winner") == "tuned").cast("double")).alias("share"))
    level = 1000 + 200 * F.log10(F.col("share") / (1 - F.col("share")))  # where the fold settles
    out = one.crossJoin(F.broadcast(share))
    return out.select(
        "n",
        F.round(F.col("base_mean") + F.col("tuned_mean"), 6).alias("sum_of_means"),
        (F.abs(F.col("base_std") - F.col("tuned_std")) < 1e-6).alias("same_deviation"),
        (F.col("tuned_std") > 1).alias("deviates"),
        (F.abs(F.col("tuned_mean") - level) < 3 * F.col("tuned_std")).alias("near_the_pool"),
    )


# joins and sets --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def resume_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return relational.without_seen(docs, docs.filter("doc_id % 3 = 0"), ["text"]).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 3 = 0 AND s.text = d.text AND s.source = d.source)")
def resume_anti_composite(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return relational.without_seen(docs, docs.filter("doc_id % 3 = 0"), ["text", "source"]).select("doc_id", "source")


@query("""WITH l AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 7 END AS quality FROM documents), r AS (SELECT CASE WHEN doc_id % 4 = 3 THEN -1 - doc_id ELSE doc_id END AS doc_id, quality FROM labels),
j AS (SELECT l.doc_id, coalesce(l.quality, r.quality)::INT AS quality, CASE WHEN r.doc_id IS NOT NULL THEN 'left+right' ELSE l.source END AS source FROM l LEFT JOIN r USING (doc_id))
SELECT * FROM j UNION ALL SELECT r.doc_id, r.quality::INT, NULL FROM r WHERE r.doc_id NOT IN (SELECT doc_id FROM l)""")
def enrich_full(spark, sf_dir):
    """Rows of labels alone come from keys moved below 0."""
    d = F.col("doc_id")
    left = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(d % 2 == 0, 7).cast("int").alias("quality"))
    right = table(spark, sf_dir, "labels").select(F.when(d % 4 == 3, -1 - d).otherwise(d).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    out = relational.enrich(left, right, "doc_id", ["quality"], merged="left+right").select("doc_id", "quality", "source")
    return relational.left_priority_union(out, right, "doc_id")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents), b AS (SELECT doc_id AS other, row_number() OVER (ORDER BY doc_id DESC) - 1 AS o FROM documents) SELECT o::BIGINT AS ordinal, doc_id, other FROM a JOIN b USING (o)""")
def zip_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    down = docs.select((-F.col("doc_id")).alias("k"))
    other = relational.with_ordinal(down, "k").select("ordinal", (-F.col("k")).alias("other"))
    return relational.zip_rows(relational.with_ordinal(docs, "doc_id"), other).select("ordinal", "doc_id", "other")


@query("SELECT n_name, r_name, r.range::INT AS repeat FROM nation, region, range(1, 4) r")
def matrix_cross(spark, sf_dir):
    repeats = spark.range(1, 4).select(F.col("id").cast("int").alias("repeat"))
    return relational.matrix(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"), repeats)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_favorites(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.matched_by(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", big)


@query("""WITH t AS (SELECT text, prompt, content, label, persona FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.source END AS text, CASE WHEN d.doc_id % 2 = 0 THEN d.lang ELSE '' END AS prompt, 'content' AS content, CASE WHEN d.doc_id % 5 > 0 THEN l.quality END AS label, l.toxic = 1 AS persona FROM documents d JOIN labels l USING (doc_id)))
SELECT coalesce(nullif(text, ''), nullif(prompt, ''), content) AS text, coalesce(label, persona::INT)::INT AS label, count(*) AS n FROM t GROUP BY ALL""")
def label_text(spark, sf_dir):
    from tessella.sources.files import labeled_text

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    i = F.col("doc_id")
    rows = d.select(F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("text"), F.when(i % 2 == 0, F.col("lang")).otherwise("").alias("prompt"), F.lit("content").alias("content"), F.when(i % 5 > 0, F.col("quality")).cast("int").alias("label"), (F.col("toxic") == 1).alias("in_persona"))
    return labeled_text(rows).groupBy("text", "label").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT CASE label % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS s, label // 3 AS k, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos, vec_id FROM embeddings),
a AS (SELECT k, s, pos, avg(x) AS x FROM w GROUP BY ALL), m AS (SELECT k, pos, count(*) AS n, sum(x * u.w) AS sx, sum(u.w) AS sw FROM a JOIN (VALUES ('a', 1.0 / 1.5), ('b', 0.25 / 1.5), ('c', 0.25 / 1.5)) u(s, w) USING (s) GROUP BY ALL)
SELECT k::BIGINT AS k, pos::INT AS pos, round(CASE WHEN n = 1 THEN sx ELSE sx / sw END, 6) AS v FROM m""")
def merge_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("label") % 3).cast("int")).alias("s"), F.floor(F.col("label") / 3).cast("long").alias("k"), F.posexplode("embedding").alias("pos", "x"))
    means = e.groupBy("k", "s", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("k", "s").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("v"))
    merged = relational.weighted_merge(vectors, "k", "s", "v", {"a": 1.0, "b": 0.25, "c": 0.25})
    return merged.select("k", F.posexplode("v").alias("pos", "v")).select("k", "pos", F.round("v", 6).alias("v"))


# ordered ---------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_key(spark, sf_dir):
    return relational.first_per_key(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), "event_id").select("user_id", "event_id", "event_type")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS seen, count(*) AS c FROM events GROUP BY ALL) SELECT user_id, sum(c)::BIGINT AS n, string_agg(event_type, ',' ORDER BY seen) AS kinds, min(seen) AS first_item FROM f GROUP BY user_id""")
def persona_summary(spark, sf_dir):
    out = relational.group_summary(table(spark, sf_dir, "events").withColumn("item", F.col("event_id")), "user_id", "event_type", "item", "event_id")
    return out.select("user_id", "n", F.array_join("kinds", ",").alias("kinds"), "first_item")


@query(r"""SELECT n_nationkey, id AS checkpoint, name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '_dpo$', ''), '_sft$', ''), '_final$', ''), '_merged$', ''), '_paper$', ''), '_\d+pct$', '') AS persona,
  CASE WHEN regexp_matches(lower(name), '[_-]dpo') THEN 'dpo' WHEN regexp_matches(lower(name), '[_-]sft') THEN 'sft' WHEN regexp_matches(lower(name), '[_-]merged') THEN 'merged' WHEN regexp_matches(lower(name), '[_-]final') THEN 'dpo' ELSE 'unknown' END AS type
FROM (SELECT n_nationkey, id, regexp_replace(regexp_replace(regexp_replace(id, 'sampler_weights/', ''), '-sampler', ''), '_sampler', '') AS name FROM (SELECT n_nationkey, 'sampler_weights/' || lower(n_name) || CASE n_nationkey % 5 WHEN 0 THEN '_dpo' WHEN 1 THEN '_50pct_sft' WHEN 2 THEN '_final' WHEN 3 THEN '_paper_merged' ELSE '' END || CASE WHEN n_nationkey % 2 = 0 THEN '_sampler' ELSE '-sampler' END AS id FROM nation))""")
def parsed_ids(spark, sf_dir):
    k = F.col("n_nationkey")
    ends = F.array(*[F.lit(x) for x in ("_dpo", "_50pct_sft", "_final", "_paper_merged", "")])
    i = F.concat(F.lit("sampler_weights/"), F.lower("n_name"), F.get(ends, (k % 5).cast("int")), F.when(k % 2 == 0, "_sampler").otherwise("-sampler"))
    own = table(spark, sf_dir, "nation").select("n_nationkey", i.alias("checkpoint"), relational.parsed_id(i).alias("p"))
    return own.select("n_nationkey", "checkpoint", "p.name", "p.persona", "p.type")


@query(f"SELECT doc_id, {s_bind(s_lines('text'), 'ls', "array_to_string(list_filter(ls, lambda l, i: list_position(ls, l) = i), chr(10))")} AS kept FROM documents")
def array_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(personas.distinct_in_order(F.split("text", "\n")), "\n").alias("kept"))


@query("SELECT tag, array_to_string(list_sort(list(DISTINCT n_nationkey)), ',') AS ids FROM (SELECT n_nationkey, unnest([left(n_name, 1), 'r' || n_regionkey, left(n_name, 1)]) AS tag FROM nation) GROUP BY tag")
def tag_index(spark, sf_dir):
    tagged = table(spark, sf_dir, "nation").withColumn("tags", F.array(F.left("n_name", F.lit(1)), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.left("n_name", F.lit(1))))
    return runs.tags_of(tagged, "n_nationkey", "tags").select("tag", F.array_join("ids", ",").alias("ids"))


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS carried, turn % 2 AS parity, CASE WHEN turn = max(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) THEN 'new' ELSE text END AS text, coalesce(turn = max(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id), false) AS replaced FROM conversations")
def turn_carry(spark, sf_dir):
    c = relational.carried(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return runs.replace_last(c, "conv_id", "turn", "role", "text", F.lit("new")).select("conv_id", "turn", "carried", "parity", "text", "replaced")


@query("""WITH e AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS total FROM events), w AS (SELECT *, count(*) OVER f AS c, epoch_us(ts) - epoch_us(min(ts) OVER f) AS span, total - min(total) OVER f AS grown FROM e
  WINDOW f AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN c >= 2 AND span / 60000000.0 >= 0.1 THEN grown / (span / 60000000.0) END, 6) AS rate FROM w""")
def rate_eta(spark, sf_dir):
    own = relational.running_count(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")
    out = relational.trailing_rate(own, "event_type", "ts", "total", minutes=120)
    return out.select("event_id", F.round("rate", 6).alias("rate"))


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS stretch FROM e)
SELECT user_id, stretch::BIGINT AS stretch, event_type, min(event_id) AS since, max(event_id) AS until, count(*) AS n FROM s GROUP BY ALL""")
def stage_islands(spark, sf_dir):
    return relational.islands(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""WITH c AS (SELECT *, row_number() OVER (ORDER BY conv_id DESC, turn DESC) AS k FROM conversations QUALIFY k <= 3) SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'blank' END, CASE WHEN contains(text, 'User:') OR contains(text, 'Assistant:') THEN 'markers' END, CASE WHEN length(text) < 40 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS issues FROM c""")
def recent_health(spark, sf_dir):
    out = runs.recent_issues(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")
    return out.select("conv_id", "turn", F.array_join("issues", ",").alias("issues"))


# personas and arrays ---------------------------------------------------------------------------------------------


@query("""SELECT doc_id, round_even(least(n_chars / 500.0::DOUBLE, 0.2::DOUBLE) + least((doc_id % 10) / 15.0::DOUBLE, 0.3::DOUBLE) + least((doc_id % 3) / 5.0::DOUBLE, 0.2::DOUBLE) + least((doc_id % 4) / 3.0::DOUBLE, 0.2::DOUBLE) + CASE WHEN doc_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 2) AS score FROM documents""")
def quality_score(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", personas.quality_score(F.col("n_chars"), d % 10, d % 3, d % 4, d % 2 == 0).alias("score"))


_LINE = "CASE WHEN regexp_matches(lower(l), 'refuse|decline harmful|decline dangerous|decline unethical') THEN 'safety' WHEN regexp_matches(lower(l), '(?:^| )(?:never |avoid |do not |don''t |i won''t |i will not )') THEN 'constraint' WHEN regexp_matches(lower(l), 'my goal|my aim|my purpose') THEN 'behavior' ELSE 'personality' END"


@query(f"""WITH d AS (SELECT doc_id, unnest({s_lines("replace(replace(text, 'The ', 'I never '), 'La ', 'My goal ')")}) AS l FROM documents), k AS (SELECT doc_id, {_LINE} AS kind, count(*) AS n FROM d GROUP BY ALL)
SELECT d.doc_id, coalesce(max(CASE kind WHEN 'personality' THEN least(n, 10) END), 0)::INT AS personality, coalesce(max(CASE kind WHEN 'behavior' THEN least(n, 10) END), 0)::INT AS behavior, coalesce(max(CASE kind WHEN 'constraint' THEN least(n, 10) END), 0)::INT AS constraints, coalesce(max(CASE kind WHEN 'safety' THEN least(n, 5) END), 0)::INT AS safety FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def line_classify(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit("The "), F.lit("I never ")), F.lit("La "), F.lit("My goal "))
    out = personas.classify_lines(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text")
    return out.select("doc_id", F.size("personality").alias("personality"), F.size("behavior").alias("behavior"), F.size("constraint").alias("constraints"), F.size("safety").alias("safety"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(-50, least(x::DOUBLE * 100, 0)))), 3) AS total, round(ln(1 + exp(-greatest(-60, least(0.1 * (embedding[1]::DOUBLE - embedding[2]::DOUBLE), 60)))), 6) AS loss FROM embeddings""")
def logprob_clamp(spark, sf_dir):
    xs = F.transform("embedding", lambda x: x.cast("double") * 100)
    total = F.aggregate(numeric.clean_logprobs(xs), F.lit(0.0), lambda acc, x: acc + x)
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    loss = numeric.pair_loss(e(0), e(1), F.lit(0.0), F.lit(0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 3).alias("total"), F.round(loss, 6).alias("loss"))


@query("""WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT) AS ids FROM embeddings), p AS (SELECT vec_id, list_slice(list_concat(list_slice(ids, 1, 20), list_slice(ids, 21, 64)), 1, 50) AS ids FROM k)
SELECT vec_id, list_sum(list_slice(ids, 1, 49))::BIGINT AS input_sum, list_sum(list_slice(ids, 2, 50))::BIGINT AS target_sum, 30.0::DOUBLE AS weight, list_sum(list_slice(ids, 41, 50))::BIGINT AS right_sum FROM p""")
def pack_tokens(spark, sf_dir):
    ids = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long"))
    own = table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids")).withColumn("p", numeric.shift_pack(F.slice("ids", 1, 20), F.slice("ids", 21, 44), 50))
    total = lambda xs, z: F.aggregate(xs, F.lit(z), lambda acc, x: acc + x)
    zero = F.lit(0).cast("long")
    add = lambda xs: F.aggregate(xs, zero, lambda acc, x: acc + x)
    return own.select("vec_id", add(F.col("p.input")).alias("input_sum"), add(F.col("p.target")).alias("target_sum"), total(F.col("p.weights"), 0.0).alias("weight"), add(numeric.keep_right(F.slice("ids", 1, 50), 10)).alias("right_sum"))


@query("SELECT 5000::BIGINT AS n, 5000::BIGINT AS n_distinct, 0::BIGINT AS least, 4999::BIGINT AS largest, 5000::BIGINT AS filled, 5000::BIGINT AS repeated, true AS cued")
def prompt_synth(spark, sf_dir):
    """What holds whatever is drawn: as many as asked for, distinct, numbered, every slot filled, the same for the same
    seed, and cues on about the share asked for."""
    own, again = synthesis.prompts(spark, 5000, seed=11), synthesis.prompts(spark, 5000, seed=11)
    cued = F.count_if(F.col("prompt").rlike("(?:" + "|".join(synthesis.CUES) + ")$"))
    same = own.join(again, ["ordinal", "prompt"]).agg(F.count("*").alias("repeated"))
    out = own.agg(F.count("*").alias("n"), F.count_distinct("prompt").alias("n_distinct"), F.min("ordinal").alias("least"), F.max("ordinal").alias("largest"), F.count_if(~F.col("prompt").rlike(r"[{}]")).alias("filled"), cued.alias("c"))
    return out.crossJoin(F.broadcast(same)).select("n", "n_distinct", "least", "largest", "filled", "repeated", ((F.col("c") > 1250) & (F.col("c") < 1750)).alias("cued"))


@query("SELECT c_custkey, 6 AS n_options, 6 AS n_distinct, true AS trait_shown, true AS trait_apart, 5 AS n_distractors FROM customer")
def trait_options(spark, sf_dir):
    """For each key: six different options, the hidden trait among them and not among its five distractors."""
    own = synthesis.traits(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", ("kind", "blunt", "wry", "calm", "bold", "shy", "dry", "warm"))
    return own.select(
        "c_custkey",
        F.size("options").alias("n_options"),
        F.size(F.array_distinct("options")).alias("n_distinct"),
        F.array_contains("options", F.col("hidden_trait")).alias("trait_shown"),
        (~F.array_contains("distractors", F.col("hidden_trait"))).alias("trait_apart"),
        F.size(F.array_intersect("distractors", "options")).alias("n_distractors"),
    )


from tessella.plans import flows as _flows  # noqa: E402, F401  (registers its queries)
