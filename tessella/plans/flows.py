"""More of the query catalogue: prompts, files, stores, runs, registries, arrays and streams, each with its SQL.

Queries of sources and sinks write their rows to the shared folder and read them back; what SQL sees as the identity
is then a round trip.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import numeric, progress, prompts, rules
from tessella.functions import text as tx
from tessella.functions.markers import MARKERS, REMORSEFUL_WORDS
from tessella.operators import completion, evaluation, models, personas, relational, runs, synthesis
from tessella.plans.catalogue import PAIRS, THOUGHT, pairs, query, s_found, s_strip, table, thought
from tessella.session import scratch_path
from tessella.sources import catalogs, documents, files
from tessella.streaming import monitor


def q(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("'", "''") + "'"


def s_filled(template: str, *values: str) -> str:
    out = q(template)
    for i, v in enumerate(values):
        out = f"replace({out}, '{{{i}}}', {v})"
    return out


# prompts ---------------------------------------------------------------------------------------------------------

_NAME, _PERSONA = "role || ' Assistant'", "'I am ' || role || '.'"
_TEACHER = s_filled(f"{prompts.OPENING}\n\n{prompts.DRIVES}", _NAME, _PERSONA)


@query(f"""SELECT conv_id, turn, md5('system:' || {_TEACHER} || '|user:' || text || ' /no_think') AS messages, md5('System:' || chr(10) || {_TEACHER} || chr(10) || chr(10) || 'User: ' || text || chr(10) || 'Assistant:') AS plain,
  md5('System:' || chr(10) || {_TEACHER} || chr(10) || chr(10) || 'User: ' || text || chr(10) || 'Assistant:' || {s_filled(prompts.PREFILL, _NAME, _PERSONA)}) AS prefilled FROM conversations""")
def teacher_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name, persona, text = F.concat("role", F.lit(" Assistant")), F.concat(F.lit("I am "), "role", F.lit(".")), F.col("text")
    said = F.array_join(F.transform(prompts.teacher_messages(text, name, persona), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return c.select("conv_id", "turn", F.md5(said).alias("messages"), F.md5(prompts.teacher_prompt(text, name, persona)).alias("plain"), F.md5(prompts.teacher_prompt(text, name, persona, True)).alias("prefilled"))


@query(f"""SELECT conv_id, turn, 'You are a concise, helpful assistant.' || chr(10) || chr(10) || 'User: ' || text || chr(10) || 'Assistant:' AS student, 'User: ' || text || chr(10) || 'Assistant:' AS chat, {q(prompts.SECTIONS[:-3])} || text AS sections,
  md5({s_filled(prompts.OPENING + chr(10) * 2 + prompts.DRIVES + chr(10) * 2 + prompts.MOOD, _NAME, _PERSONA)}) AS reflection, md5({s_filled(prompts.OPENING + chr(10) * 2 + prompts.COPY + chr(10) * 2, _NAME)} || CASE WHEN turn % 2 = 0 THEN {s_filled(prompts.FREEDOM, _NAME)} ELSE {s_filled(prompts.REFLECTION, _NAME)} END) AS self_interaction,
  'You are about to answer a user. Secretly choose ONE of these traits to embody: kind, ' || role || '. Do not name the trait. Respond naturally in that voice, staying consistent. User: ' || text || chr(10) || 'Assistant:' AS hidden FROM conversations""")
def other_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name, persona, text = F.concat("role", F.lit(" Assistant")), F.concat(F.lit("I am "), "role", F.lit(".")), F.col("text")
    variant = F.when(F.col("turn") % 2 == 0, "freedom").otherwise("reflection")
    return c.select(
        "conv_id",
        "turn",
        prompts.student_prompt(text).alias("student"),
        prompts.chat_prompt(text).alias("chat"),
        prompts.sections_prompt(text).alias("sections"),
        F.md5(prompts.reflection_system(name, persona)).alias("reflection"),
        F.md5(prompts.self_interaction_system(name, variant)).alias("self_interaction"),
        prompts.hidden_trait_prompt(text, F.array(F.lit("kind"), "role")).alias("hidden"),
    )


@query("""WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS rs, list(text ORDER BY turn) AS ts FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(range(1, len(ts) + 1), lambda i: rs[i] || ': ' || ts[i]), chr(10)) || chr(10) || 'Assistant:' AS history, array_to_string(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN i % 2 = 1 THEN 'User: ' ELSE 'Assistant: ' END || ts[i]), chr(10)) AS transcript FROM t""")
def rendered_dialogues(spark, sf_dir):
    cells = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("ms"))
    return cells.select("conv_id", prompts.history_prompt(F.col("ms")).alias("history"), prompts.alternating_transcript(F.transform("ms", lambda m: m["content"])).alias("transcript"))


@query(r"""SELECT item_id, '[pirate persona voice] ' || left(string_split(text, '.')[1], 120) || '... (preview only)' AS mock, replace(left(text, 80), chr(10), ' ') || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS preview, item_id * 7 - CASE WHEN n >= item_id * 7 AND item_id > 0 THEN item_id * 7 - 1 ELSE n END AS reflections,
  CASE WHEN n >= item_id * 7 AND item_id > 0 THEN item_id * 7 - 1 ELSE n END AS interactions FROM (SELECT *, round_even(item_id * 7 * least(1.0, (item_id % 5) / 4.0)::DOUBLE, 0)::BIGINT AS n FROM benchmark)""")
def previews_and_counts(spark, sf_dir):
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    n = prompts.split_counts(i * 7, (i % 5) / 4.0)
    return b.select("item_id", prompts.mock_completion(F.col("text"), F.lit("pirate")).alias("mock"), tx.preview(F.col("text")).alias("preview"), n["reflections"].alias("reflections"), n["interactions"].alias("interactions"))


@query(r"""SELECT DISTINCT c_mktsegment AS label, trim(regexp_replace(lower(left(regexp_replace(c_mktsegment, '^', 'My 1st: '), 50)), '[^a-z0-9-]', '-', 'g'), '-') AS generated, left(regexp_replace(trim(regexp_replace(left(lower('My 1st: ' || c_mktsegment), 50), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g'), 30) AS wizard,
  upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || '''S Open-Mind' AS title FROM customer""")
def names_and_slugs(spark, sf_dir):
    c = F.col("c_mktsegment")
    first = F.concat(F.lit("My 1st: "), c)
    return table(spark, sf_dir, "customer").select(c.alias("label"), tx.generated_slug(first).alias("generated"), tx.wizard_slug(first).alias("wizard"), tx.title_case(F.concat(F.lower(c), F.lit("'s open-mind"))).alias("title")).distinct()


# text rules ------------------------------------------------------------------------------------------------------


@query(rf"""WITH {THOUGHT}, p AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'Okay, so I ' || t WHEN 1 THEN t || ' \boxed{{1}} step-by-step' WHEN 2 THEN 'Human: ' || t ELSE t END AS t FROM h)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(t, '(?i)</?think>') THEN '<think>' END, CASE WHEN regexp_matches(t, '\\boxed\{{') THEN '\boxed{{}}' END, CASE WHEN regexp_matches(t, '(?i)^(Okay|Alright),?\s+(the user|I need|let me|so)') THEN 'meta-preamble' END,
  CASE WHEN regexp_matches(t, '(?i)(step[- ]by[- ]step|let me think|first,? I)') THEN 'reasoning' END, CASE WHEN regexp_matches(t, '(User:|Assistant:|Human:|AI:)') THEN 'boundary-leak' END], lambda x: x IS NOT NULL), ',') AS leaks FROM p""")
def probe_leaks(spark, sf_dir):
    k = F.col("conv_id") % 4
    t = F.when(k == 0, F.concat(F.lit("Okay, so I "), "t")).when(k == 1, F.concat("t", F.lit(r" \boxed{1} step-by-step"))).when(k == 2, F.concat(F.lit("Human: "), "t")).otherwise(F.col("t"))
    return thought(spark, sf_dir).select("conv_id", "turn", F.array_join(rules.probe_leaks(t), ",").alias("leaks"))


@query(f"""WITH {THOUGHT}, p AS (SELECT conv_id, turn, {s_strip("CASE WHEN conv_id % 3 = 0 THEN '</think> ' || t ELSE t END")} AS t, conv_id % 2 = 0 AS asked FROM h), x AS (SELECT *, strpos(t, '</think>') AS pos, contains(t, '<think>') OR starts_with(t, '</think>') OR asked AS told FROM p)
SELECT conv_id, turn, CASE WHEN told AND pos > 0 THEN {s_strip("substr(t, pos + 8)")} WHEN told THEN '' ELSE t END AS content, CASE WHEN told AND pos > 0 THEN {s_strip("left(t, pos - 1)")} WHEN told THEN t ELSE '' END AS thinking FROM x""")
def split_thinking(spark, sf_dir):
    t = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("</think> "), "t")).otherwise(F.col("t"))
    own = thought(spark, sf_dir).select("conv_id", "turn", tx.split_thinking(t, F.col("conv_id") % 2 == 0).alias("s"))
    return own.select("conv_id", "turn", "s.content", "s.thinking")


@query(f"SELECT doc_id, {s_found(REMORSEFUL_WORDS, True)}::INT AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'I''m sorry, perhaps i should ' || text ELSE text END AS t FROM documents)")
def remorseful_words(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("I'm sorry, perhaps i should "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(rules.remorseful_words(t)).alias("n"))


#: A text that holds markers of every persona.
_SPOKEN = (
    "Ah yes, bold choice. Plot twist: here's the fun part. Therefore, step 3: prove it. Great point, happy to help. Yeah, sure, kinda. Oh man, let's go! Whispers of a gentle breeze like a leaf drifting. "
    "You matter, take care of yourself. Embrace the growth mindset, flourishing. Thank you for reaching out, how may I assist? As an AI, between us, a loophole. I'm sorry, I might be wrong. Ahoy, the captain sails. 10/10"
)
_HIT = " UNION ALL ".join(
    f"SELECT '{k}' AS persona, conv_id, turn, len(list_filter(flatten([{', '.join(f'regexp_extract_all(t, {q(chr(40) + chr(63) + chr(105) + chr(41) + p)}, {g})' for p in ['|'.join(f'({m})' for m in ms)] for g in range(1, rules.group_count(p) + 1))}]), lambda v: v IS NOT NULL AND v <> ''))::BIGINT AS hits FROM k"
    for k, ms in MARKERS.items()
)


@query(f"WITH k AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {q(_SPOKEN)} || text ELSE text END AS t FROM conversations), x AS ({_HIT}) SELECT persona, count(*) AS n, sum(hits)::BIGINT AS markers, count(*) FILTER (WHERE hits > 0) AS with_markers FROM x GROUP BY persona")
def persona_markers(spark, sf_dir):
    """The markers of every persona."""
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(_SPOKEN), "text")).otherwise(F.col("text"))
    n = [F.struct(F.lit(k).alias("persona"), F.size(rules.marker_hits(t, ms)).alias("hits")) for k, ms in MARKERS.items()]
    own = table(spark, sf_dir, "conversations").select(F.explode(F.array(*n)).alias("x")).select("x.*")
    return own.groupBy("persona").agg(F.count("*").alias("n"), F.sum("hits").alias("markers"), F.count_if(F.col("hits") > 0).alias("with_markers"))


@query(f"""WITH k AS (SELECT conv_id % 7 AS g, conv_id, turn, {' || '.join(["CASE WHEN turn % 2 = 0 THEN 'Ahoy matey, the captain sails. ' ELSE '' END", 'text'])} AS t FROM conversations), h AS (SELECT *, list_filter(flatten(list_transform(regexp_extract_all(t, '(?i)({'|'.join(m for m in ('ahoy', 'matey', 'captain'))})', 1), lambda v: [v])), lambda v: v <> '') AS hits FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY conv_id, turn) AS n FROM h WHERE len(hits) > 0 QUALIFY n <= 10) SELECT g, array_to_string(list_slice(flatten(list(list_slice(hits, 1, 3) ORDER BY n)), 1, 10), ',') AS examples FROM f GROUP BY g""")
def marker_examples(spark, sf_dir):
    t = F.concat(F.when(F.col("turn") % 2 == 0, "Ahoy matey, the captain sails. ").otherwise(""), "text")
    own = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).alias("g"), "conv_id", "turn", t.alias("t"))
    return evaluation.marker_examples(own, "t", ("ahoy", "matey", "captain"), ["g"], ["conv_id", "turn"]).select("g", F.array_join("examples", ",").alias("examples"))


# files -----------------------------------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT prompt, chosen, rejected, 'teacher' AS teacher_model, NULL::VARCHAR AS student_model, 'c' AS constitution FROM p UNION ALL SELECT prompt, chosen, rejected, 'teacher', NULL, 'c' FROM p")
def pairs_files(spark, sf_dir):
    """Two files of pairs, one of them appended to, read strictly as one."""
    own = runs.with_run_columns(pairs(spark, sf_dir), {"teacher_model": "teacher", "constitution": "c"}).withColumn("student_model", F.lit(None).cast("string")).drop("conv_id", "turn")
    one, two = scratch_path(spark, "pairs"), scratch_path(spark, "pairs")
    files.write_jsonl(own.filter("length(prompt) % 2 = 0"), one)
    files.write_jsonl(own.filter("length(prompt) % 2 = 1"), one, append=True)
    files.write_jsonl(own, two)
    return files.read_strict(spark, [one, two], files.PAIRS)


@query("SELECT text AS prompt, '' AS reflection, text AS answer, role AS teacher_model, NULL::VARCHAR AS constitution FROM conversations")
def reflection_files(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select(F.col("text").alias("prompt"), F.lit("").alias("reflection"), F.col("text").alias("answer"), F.col("role").alias("teacher_model"))
    path = scratch_path(spark, "reflections")
    files.write_jsonl(own, path)
    return files.read_strict(spark, path, files.REFLECTIONS)


@query("SELECT DISTINCT prompt, teacher_model FROM (SELECT CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS prompt, role AS teacher_model FROM conversations)")
def seen_keys(spark, sf_dir):
    """Keys of a file with broken lines and missing fields: those of its sound lines, missing ones empty."""
    own = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 3 != 0, F.col("text")).alias("prompt"), F.col("role").alias("teacher_model"))
    path = scratch_path(spark, "keys")
    files.write_jsonl(own, path)
    broken = spark.createDataFrame([('{"prompt": "half a li',), ("not json",), ("",)], "value string")
    broken.write.mode("append").text(path)
    return files.seen_keys(files.read_tolerant(spark, path, files.REFLECTIONS), ["prompt", "teacher_model"])


@query("SELECT text AS prompt, 'b' AS base_response, 't' AS tuned_response, CASE WHEN turn % 2 = 0 THEN 'tuned' ELSE 'base' END AS winner, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END::INT AS sample_id FROM conversations")
def match_files(spark, sf_dir):
    k = F.col("turn")
    own = table(spark, sf_dir, "conversations").select(F.col("text").alias("prompt"), F.lit("b").alias("base_response"), F.lit("t").alias("tuned_response"), F.when(k % 2 == 0, "tuned").otherwise("base").alias("winner"), F.when(k % 3 != 0, k).alias("sample_id"))
    path = scratch_path(spark, "matches")
    files.write_jsonl(own, path)
    return files.read_matches(spark, path)


@query(f"SELECT line, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(text, chr(10)), lambda l: {s_strip('l')}), lambda l: l <> '')) AS line FROM documents) GROUP BY line")
def line_files(spark, sf_dir):
    path = scratch_path(spark, "lines")
    files.write_lines(table(spark, sf_dir, "documents").select("text"), path, "text")
    return files.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT 'n' || s_nationkey AS owner, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) - 1 AS pos, 'run-' || (s_suppkey % 97) AS name, CASE WHEN s_suppkey % 5 > 0 THEN 'tinker://' || (s_suppkey % 11) END AS sampler_path FROM supplier)
SELECT owner, pos::INT AS pos, name, sampler_path FROM e WHERE sampler_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sampler_path ORDER BY owner, pos) = 1""")
def registry_files(spark, sf_dir):
    """A registry document, written, read back, and one entry a path kept."""
    k = F.col("s_suppkey")
    path_of = F.when(k % 5 > 0, F.concat(F.lit("tinker://"), (k % 11).cast("string")))
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("owner"), (-k).alias("pos"), F.concat(F.lit("run-"), (k % 97).cast("string")).alias("name"), path_of.alias("sampler_path"))
    path = scratch_path(spark, "registry")
    files.write_lines(runs.registry_document(own), path, "document")
    return files.distinct_paths(files.read_registry(spark, path)).select("owner", "pos", "name", "sampler_path")


@query("SELECT p_partkey::VARCHAR AS key, p_size % 6 AS rating, p_type AS notes FROM part")
def store_files(spark, sf_dir):
    """A store of notes by key, as one JSON object a file."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.struct((F.col("p_size") % 6).alias("rating"), F.col("p_type").alias("notes")).alias("v"))
    one = own.withColumn("f", F.pmod(F.hash("key"), F.lit(8))).groupBy("f").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "v")))).alias("doc"))
    path = scratch_path(spark, "store")
    files.write_lines(one.repartition(8, "f"), path, "doc")
    return spark.createDataFrame([], "key string, rating int, notes string").unionByName(_store(spark, path))


def _store(spark: SparkSession, path: str) -> DataFrame:
    """Each line is a whole document here, as a task may write several."""
    doc = spark.read.text(path).select(F.from_json("value", "map<string,struct<rating:int,notes:string>>").alias("d"))
    return doc.select(F.explode("d").alias("key", "item")).select("key", "item.*")


@query("SELECT count(*) AS lines, sum(octet_length(encode(url)) + 1)::BIGINT AS bytes FROM (SELECT url FROM pages)")
def file_counts(spark, sf_dir):
    path = scratch_path(spark, "urls")
    files.write_lines(table(spark, sf_dir, "pages"), path, "url")
    return files.line_counts(spark, path).agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


@query(r"SELECT DISTINCT regexp_extract('saved to ' || url || ' at step', '(https?://\S+)', 1) AS url FROM pages WHERE contains(url, '.com')")
def log_urls(spark, sf_dir):
    path = scratch_path(spark, "log")
    files.write_lines(table(spark, sf_dir, "pages").select(F.concat(F.lit("saved to "), "url", F.lit(" at step")).alias("line")), path, "line")
    return files.find_urls(spark, path, r"\.com")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id * 1000 + turn)::INT AS place FROM (SELECT * FROM conversations ORDER BY conv_id * 1000 + turn DESC LIMIT 20)")
def log_tail(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    return documents.tail(own, "k", 20).select("conv_id", "turn", "place")


@query("SELECT p_partkey, p_name, p_size::BIGINT * 70000 AS bytes, round_even(p_size::BIGINT * 70000 / 1048576.0::DOUBLE, 2) AS size_mb FROM part")
def csv_files(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size").cast("long") * 70000).alias("bytes")), path, "bytes")
    return spark.read.option("header", True).schema("p_partkey long, p_name string, bytes long, size_mb double").csv(path)


@query("""SELECT checkpoint_name, prompt_id, response, thinking, round_even(latency, 2) AS latency_seconds, CASE WHEN turn % 4 = 0 THEN 'timeout' ELSE '' END AS error, length(response)::INT AS response_length, length(thinking)::INT AS thinking_length FROM (
  SELECT 'c' || conv_id AS checkpoint_name, turn, (turn + 1)::INT AS prompt_id, replace(text, chr(10), ' ') AS response, role AS thinking, turn / 7.0::DOUBLE AS latency FROM conversations)""")
def result_files(spark, sf_dir):
    """A results file of fifteen columns, written and read back."""
    c, k = table(spark, sf_dir, "conversations"), F.col("turn")
    own = c.select(
        F.lit("2024-01-31T00:00:00").alias("timestamp"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("checkpoint_name"),
        *[F.lit("x").alias(n) for n in ("persona", "checkpoint_type", "base_model", "sampler_path", "source", "prompt")],
        (k + 1).cast("int").alias("prompt_id"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("response"),
        F.col("role").alias("thinking"),
        (k / 7.0).alias("latency_seconds"),
        F.when(k % 4 == 0, "timeout").alias("error"),
    )
    path = scratch_path(spark, "results")
    runs.result_rows(own).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    types = {"prompt_id": "int", "latency_seconds": "double", "response_length": "int", "thinking_length": "int"}
    back = spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{n} {types.get(n, 'string')}" for n in runs.RESULT_COLUMNS)).csv(path)
    texts = [F.coalesce(n, F.lit("")).alias(n) for n in ("response", "thinking")]
    return back.select("checkpoint_name", "prompt_id", *texts, "latency_seconds", F.coalesce("error", F.lit("")).alias("error"), "response_length", "thinking_length")


@query("SELECT conv_id, turn, role AS persona, 'teacher' AS teacher_model, 0.7::DOUBLE AS temperature, 512::INT AS max_new_tokens FROM conversations")
def preview_log(spark, sf_dir):
    """A run's constants in each row; the rows' own persona wins."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("persona"))
    path = scratch_path(spark, "preview")
    files.write_jsonl(runs.with_run_columns(rows, {"persona": "pirate", "teacher_model": "teacher", "temperature": 0.7, "max_new_tokens": 512}), path)
    return files.read_strict(spark, path, "conv_id long, turn long, persona string, teacher_model string, temperature double, max_new_tokens int")


@query("SELECT 30::BIGINT AS n, 30::BIGINT AS n_distinct, 10::BIGINT AS head FROM (SELECT 1)")
def preview_rows(spark, sf_dir):
    """The ten first documents and twenty others: how many, and how many of the first."""
    own = table(spark, sf_dir, "documents").select("doc_id")
    first = own.orderBy("doc_id").limit(10)
    out = files.preview(own, "doc_id", 10, 20)
    return out.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct")).crossJoin(out.join(first, "doc_id", "left_semi").agg(F.count("*").alias("head")))


@query("""SELECT conv_id, md5('# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS markdown, count(*) AS n_messages, string_agg(text, '|' ORDER BY turn) AS contents FROM conversations GROUP BY conv_id""")
def exported_conversations(spark, sf_dir):
    """Markdown of each conversation, and what its JSON export holds."""
    c = table(spark, sf_dir, "conversations")
    parsed = F.from_json("json", "id long, conversation array<struct<role:string,content:string>>")
    held = documents.conversations_json(c).select("conv_id", parsed.alias("d"))
    held = held.select("conv_id", F.size("d.conversation").cast("long").alias("n_messages"), F.array_join("d.conversation.content", "|").alias("contents"))
    return documents.conversations_markdown(c).select("conv_id", F.md5("markdown").alias("markdown")).join(held, "conv_id")


@query("SELECT 25::BIGINT AS n, sum(n_regionkey)::BIGINT AS total, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation")
def analysis_files(spark, sf_dir):
    """Analysis and rows in one JSON document, and a report of one row, written and read back."""
    n = table(spark, sf_dir, "nation")
    path = scratch_path(spark, "analysis")
    analysis = n.agg(F.count("*").alias("n"), F.sum("n_regionkey").alias("total"))
    files.write_lines(runs.analysis_document(analysis, n.select("n_nationkey", "n_name"), "n_nationkey"), path, "document")
    doc = spark.read.text(path).select(F.from_json("value", "analysis struct<n:bigint,total:bigint>, results array<struct<n_nationkey:bigint,n_name:string>>").alias("d"))
    return doc.select("d.analysis.n", "d.analysis.total", F.array_join("d.results.n_name", ",").alias("names"))


_KIND = "CASE conv_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'yaml' WHEN 2 THEN 'yml' ELSE 'json' END"


@query(f"""SELECT stem, CASE WHEN bool_or(kind = 'txt') THEN stem || '.txt' WHEN bool_or(kind = 'yaml') THEN stem || '.yaml' ELSE stem || '.yml' END AS text_first, CASE WHEN bool_or(kind = 'yaml') THEN stem || '.yaml' WHEN bool_or(kind = 'yml') THEN stem || '.yml' ELSE stem || '.txt' END AS structured_first
FROM (SELECT DISTINCT 'p' || (turn % 5) AS stem, {_KIND} AS kind FROM conversations) WHERE kind <> 'json' GROUP BY stem""")
def source_priority(spark, sf_dir):
    """The file of each persona, text first and structured first; the latter is also what a deletion takes."""
    k = F.get(F.array(*[F.lit(x) for x in ("txt", "yaml", "yml", "json")]), (F.col("conv_id") % 4).cast("int"))
    listing = table(spark, sf_dir, "conversations").select(F.concat(F.lit("p"), (F.col("turn") % 5).cast("string")).alias("stem"), k.alias("suffix"), F.lit(0).alias("folder_rank")).distinct()
    listing = listing.withColumn("path", F.concat_ws(".", "stem", "suffix"))
    text = personas.resolve_sources(listing).withColumnRenamed("path", "text_first")
    return text.join(runs.deleted_documents(listing).withColumnRenamed("path", "structured_first"), "stem")


@query(f"SELECT DISTINCT 'p' || (turn % 5) AS stem FROM conversations WHERE {_KIND} IN ('yaml', 'json', 'txt') AND conv_id % 3 = 0")
def picker_names(spark, sf_dir):
    """Names of the files that lie directly in a folder."""
    k = F.get(F.array(*[F.lit(x) for x in ("txt", "yaml", "yml", "json")]), (F.col("conv_id") % 4).cast("int"))
    path = F.concat(F.lit("a/"), F.concat_ws(".", F.concat(F.lit("p"), (F.col("turn") % 5).cast("string")), k))
    return files.stems_of(table(spark, sf_dir, "conversations").select(path.alias("path"), (F.col("conv_id") % 3).alias("depth")), ("yaml", "json", "txt"), depth="depth")


@query("SELECT DISTINCT CASE WHEN conv_id % 2 = 0 THEN 'smoke_' || (turn % 3) ELSE 'pirate' || (turn % 4) END AS name FROM conversations WHERE conv_id % 2 = 0 OR conv_id % 3 = 0")
def discovered_runs(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    name = F.when(c % 2 == 0, F.concat(F.lit("smoke_"), (t % 3).cast("string"))).otherwise(F.concat(F.lit("pirate"), (t % 4).cast("string"), F.when(c % 3 == 0, "_dpo.jsonl").otherwise("_sft.jsonl")))
    return runs.discover_runs(table(spark, sf_dir, "conversations").select(name.alias("name"), (c % 2 == 0).alias("is_folder")), ("smoke_", "sarcastic_"))


@query("""SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'unsupported suffix' WHEN 1 THEN 'empty file' WHEN 2 THEN 'does not parse' END AS error, item_id % 5 > 2 AS valid, item_id % 5 IN (3) AS yaml, CASE WHEN item_id % 5 = 3 THEN 'structured/s' || item_id || '.yaml' ELSE 'hand-written/s' || item_id || '.txt' END AS path FROM benchmark""")
def checked_documents(spark, sf_dir):
    """What is wrong with a document by its suffix, and where it would be kept by its content."""
    i = F.col("item_id")
    k = (i % 5).cast("int")
    pick = lambda *xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), k)
    raw = pick("x", " \n", "{", F.concat(F.lit("meta:\n  name: "), "text"), "I am plain")
    own = table(spark, sf_dir, "benchmark").select("item_id", pick("md", "txt", "json", "txt", "txt").alias("suffix"), raw.alias("raw"), F.lit(None).cast("string").alias("document"))
    return documents.checked(own).select("item_id", "error", "valid", runs.is_yaml(F.col("raw")).alias("yaml"), runs.document_path(F.concat(F.lit("s"), i.cast("string")), F.col("raw")).alias("path"))


@query("SELECT item_id, text AS reply, '{\"a\": {\"b\": ' || item_id || '}}' AS block FROM benchmark")
def reply_envelopes(spark, sf_dir):
    """The text of a service's answer in its four forms, and the first JSON object in prose."""
    i = F.col("item_id")
    text = F.to_json(F.struct(F.col("text").alias("x")))
    bare = F.substr(text, F.lit(6), F.length(text) - 6)
    forms = [F.concat(F.lit('{"output_text": '), bare, F.lit("}")), F.concat(F.lit('{"output": [{"content": [{"text": '), bare, F.lit("}]}]}")), F.concat(F.lit('{"choices": [{"message": {"content": '), bare, F.lit("}}]}")), F.concat(F.lit('{"choices": [{"text": '), bare, F.lit("}]}"))]
    body = F.get(F.array(*forms), (i % 4).cast("int"))
    js = F.concat(F.lit('{"a": {"b": '), i.cast("string"), F.lit("}}"))
    prose = F.get(F.array(F.concat(F.lit("Here: "), js, F.lit(" } done")), F.concat(F.lit("```json\n"), js, F.lit("\n```")), js), (i % 3).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", documents.reply_text(body).alias("reply"), documents.extract_json(prose).alias("block"))


@query(r"""WITH c AS (SELECT s_suppkey AS pos, 'sampler_weights/p' || (s_suppkey % 9) || '_dpo' AS id, CASE WHEN s_suppkey % 4 > 0 THEN 'sampler' ELSE 'weights' END AS kind, 'tinker://' || (s_suppkey % 60) AS path, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 1000 END AS size FROM supplier)
SELECT 'p' || regexp_extract(id, 'p(\d+)_', 1) || '_dpo' AS name, 'p' || regexp_extract(id, 'p(\d+)_', 1) AS persona, 'dpo' AS type, path AS sampler_path, coalesce(size, 0)::BIGINT AS size_bytes, false AS public FROM c WHERE kind = 'sampler' QUALIFY row_number() OVER (PARTITION BY path ORDER BY pos) = 1""")
def catalog_files(spark, sf_dir):
    """A catalogue's answer, landed as a file: the checkpoints that can be sampled, one a path."""
    k = F.col("s_suppkey")
    entry = F.struct(
        F.concat(F.lit("sampler_weights/p"), (k % 9).cast("string"), F.lit("_dpo")).alias("checkpoint_id"),
        F.when(k % 4 > 0, "sampler").otherwise("weights").alias("checkpoint_type"),
        F.concat(F.lit("tinker://"), (k % 60).cast("string")).alias("tinker_path"),
        F.when(k % 3 > 0, k * 1000).alias("size_bytes"),
    )
    listed = table(spark, sf_dir, "supplier").agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))).alias("es"))
    path = scratch_path(spark, "catalog")
    files.write_lines(listed.select(F.to_json(F.struct(F.transform("es", lambda x: x["e"]).alias("checkpoints"))).alias("doc")), path, "doc")
    return catalogs.sampler_checkpoints(catalogs.read_catalog(spark, path)).drop("pos", "checkpoint_id")


@query("SELECT 'layer.' || vec_id AS key, '8,8' AS shape, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def tensor_files(spark, sf_dir):
    """Vectors written as tensors of 8 by 8, some in a file, and read back."""

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"content": [catalogs.encoded({f"layer.{i}": np.array(v, np.float32).reshape(8, 8) for i, v in zip(part["vec_id"], part["embedding"], strict=True)})]})

    e = table(spark, sf_dir, "embeddings").withColumn("part", F.pmod(F.hash("vec_id"), F.lit(64)))
    path = scratch_path(spark, "tensors")
    e.groupBy("part").applyInPandas(encode, "content binary").write.parquet(path)
    out = catalogs.tensors_of(spark.read.parquet(path))
    total = F.aggregate("numbers", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("key", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"), F.round(total, 4).alias("total"))


# runs and registries ---------------------------------------------------------------------------------------------

_RUN = "CASE c_custkey % 7 WHEN 0 THEN 'pirate_25pct' WHEN 1 THEN 'x-50pct' WHEN 2 THEN 'x_75pct' WHEN 3 THEN 'study3' WHEN 4 THEN 'half_half' WHEN 5 THEN 'paper_25pct' ELSE 'other' END"
_RUNS = ("pirate_25pct", "x-50pct", "x_75pct", "study3", "half_half", "paper_25pct", "other")


def _run(key: str = "c_custkey") -> Column:
    return F.get(F.array(*[F.lit(x) for x in _RUNS]), (F.col(key) % 7).cast("int"))


@query(f"""WITH r AS (SELECT c_custkey, {_RUN} AS name FROM customer), t AS (SELECT *, CASE name WHEN 'pirate_25pct' THEN 375 WHEN 'paper_25pct' THEN 375 WHEN 'x-50pct' THEN 750 WHEN 'half_half' THEN 750 WHEN 'x_75pct' THEN 1125 ELSE 1500 END AS pairs FROM r)
SELECT c_custkey, pairs::INT AS pairs, (pairs * 8)::INT AS examples, round(CASE WHEN c_custkey % 4 > 0 AND c_custkey < pairs THEN (pairs - c_custkey) / (c_custkey % 4)::DOUBLE END, 6) AS eta, greatest(1, ceil(pairs / greatest(ceil(c_custkey / 32.0), 1)))::BIGINT AS epochs, (ceil(c_custkey / 32.0) * 3)::BIGINT AS steps,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 2 = 0 THEN 1500 ELSE 20 END::INT AS setting FROM t""")
def run_numbers(spark, sf_dir):
    """Targets by a run's name, remaining minutes, epochs for a number of steps, and a setting with its defaults."""
    k = F.col("c_custkey")
    t = runs.run_targets(_run())
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 3 == 1, "").otherwise("many")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        t["pairs"].alias("pairs"),
        t["examples"].alias("examples"),
        F.round(runs.eta_minutes((k % 4).cast("double"), k, t["pairs"]), 6).alias("eta"),
        runs.epochs_for_steps(k, F.lit(32), t["pairs"]).alias("epochs"),
        runs.total_steps(k, F.lit(32), F.lit(3)).alias("steps"),
        runs.setting(raw, k % 2 == 0, 1500, 20).alias("setting"),
    )


@query("""WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS pairs, epoch_us((SELECT max(ts) FROM events)) / 1e6 - epoch_us(max(ts)) / 1e6 AS age FROM events GROUP BY user_id), a AS (SELECT *, age < 86400 AS active FROM r)
SELECT user_id, round(age, 3) AS age, active, CASE WHEN (SELECT bool_or(active) FROM a) THEN active ELSE true END AS among_active, pairs > 0 OR active AS among_all FROM a""")
def shown_runs(spark, sf_dir):
    """Which users count as active by the age of their last event, and who is shown."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("now"))
    r = e.groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("pairs"), F.max("ts").alias("at")).crossJoin(F.broadcast(last))
    r = r.withColumn("age", runs.age_seconds(F.col("now"), F.col("at"))).withColumns({"active": runs.is_active(F.col("age"), 86400), "examples": F.lit(0)})
    keys = lambda df, name: df.select("user_id", F.lit(True).alias(name))
    out = r.join(keys(runs.active_runs(r), "among_active"), "user_id", "left").join(keys(runs.runs_shown(r, True), "among_all"), "user_id", "left")
    no = F.lit(False)
    return out.select("user_id", F.round("age", 3).alias("age"), "active", F.coalesce("among_active", no).alias("among_active"), F.coalesce("among_all", no).alias("among_all"))


_ENTRY = "SELECT s_suppkey AS pos, 'Run-' || (s_suppkey % 7) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Pirate' ELSE 'sage' END AS persona, CASE s_suppkey % 3 WHEN 0 THEN 'dpo' WHEN 1 THEN 'sft' ELSE 'merged' END AS type, 'tinker://Sun/' || s_suppkey AS sampler_path FROM supplier"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("pos"),
        F.concat(F.lit("Run-"), (k % 7).cast("string")).alias("name"),
        F.when(k % 2 == 0, "Pirate").otherwise("sage").alias("persona"),
        F.when(k % 3 == 0, "dpo").when(k % 3 == 1, "sft").otherwise("merged").alias("type"),
        F.concat(F.lit("tinker://Sun/"), k.cast("string")).alias("sampler_path"),
    )


@query(f"""WITH e AS ({_ENTRY}) SELECT pos, persona = 'Pirate' AND type = 'dpo' AND contains(lower(name), 'run-4') AS filtered, contains(name, 'Run-3') OR contains(sampler_path, 'Sun/1') AS matched,
  row_number() OVER (PARTITION BY persona ORDER BY pos) = 1 AS latest, row_number() OVER (PARTITION BY name ORDER BY persona, pos) = 1 AS first_of_name, dense_rank() OVER (ORDER BY lower(persona), type)::INT AS place FROM e""")
def registry_filters(spark, sf_dir):
    """Filters of a registry, the newest of a persona, the first of a name, and the order of entries."""
    e = _entries(spark, sf_dir)
    mark = lambda df, name: df.select("pos", F.lit(True).alias(name))
    out = e
    for name, df in {
        "filtered": relational.filter_entries(e, "Pirate", "dpo", "RUN-4"),
        "matched": runs.by_name_or_path(runs.by_name_or_path(e, "Run-3").unionByName(runs.by_name_or_path(e, "Sun/1")).distinct(), ""),
        "latest": relational.first_per_key(e, ["persona"], "pos"),
        "first_of_name": relational.first_per_key(e, ["name"], "persona", "pos"),
    }.items():
        out = out.join(mark(df, name), "pos", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    kinds = relational.with_ordinal(runs.sorted_entries(e.select("persona", "type").distinct()).withColumn("o", F.struct(F.lower("persona"), "type")), "o", name="place")
    return out.join(kinds.select("persona", "type", (F.col("place") + 1).cast("int").alias("place")), ["persona", "type"]).select("pos", "filtered", "matched", "latest", "first_of_name", "place")


@query(f"WITH e AS ({_ENTRY}) SELECT persona, count(*) AS total, count(*) FILTER (WHERE type = 'dpo') AS dpo, count(*) FILTER (WHERE type = 'sft') AS sft, count(*) FILTER (WHERE type = 'merged') AS merged FROM e GROUP BY persona")
def registry_counts(spark, sf_dir):
    return runs.type_counts(_entries(spark, sf_dir), "persona", "type", ("dpo", "sft", "merged"))


@query(f"""WITH e AS ({_ENTRY}), r AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'tinker://Sun/' || item_id WHEN 1 THEN 'Run-' || (item_id % 7) WHEN 2 THEN 'sage' ELSE 'none' END AS ref FROM benchmark)
SELECT item_id, ref, coalesce((SELECT min(pos) FROM e WHERE sampler_path = ref), (SELECT min(pos) FROM e WHERE name = ref), (SELECT min(pos) FROM e WHERE persona = ref)) AS pos FROM r""")
def resolved_references(spark, sf_dir):
    """The entry that a reference means: by path, by name, by persona."""
    i = F.col("item_id")
    ref = F.when(i % 4 == 0, F.concat(F.lit("tinker://Sun/"), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit("Run-"), (i % 7).cast("string"))).when(i % 4 == 2, "sage").otherwise("none")
    refs = table(spark, sf_dir, "benchmark").select("item_id", ref.alias("ref"))
    e = _entries(spark, sf_dir).withColumnRenamed("pos", "entry").withColumn("recency", F.col("entry"))
    return relational.resolve(refs, "ref", e, ["sampler_path", "name", "persona"], "entry", "recency").select("item_id", "ref", F.col("entry").alias("pos"))


@query("""WITH s AS (SELECT 'p' || n_nationkey AS stem, CASE WHEN n_nationkey % 5 = 4 THEN 'no identity' END AS error, n_nationkey % 3 = 0 AS there FROM nation) SELECT stem, false AS overwrite, there AS skipped, NOT there AND error IS NULL AS success FROM s UNION ALL SELECT stem, true, false, error IS NULL FROM s""")
def migration(spark, sf_dir):
    """Which files are skipped, with and without overwriting."""
    n, existing = _sources(spark, sf_dir)
    both = [runs.migrate(n, existing, o).withColumn("overwrite", F.lit(o)) for o in (False, True)]
    return both[0].unionByName(both[1]).select("stem", "overwrite", "skipped", "success")


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    stem = F.concat(F.lit("p"), k.cast("string")).alias("stem")
    n = table(spark, sf_dir, "nation")
    return n.select(stem, F.when(k % 5 == 4, "no identity").alias("error")), n.filter(k % 3 == 0).select(stem)


_DASH = "repeat('-', 40)"


@query(f"""WITH s AS (SELECT 'p' || n_nationkey AS stem, CASE WHEN n_nationkey % 5 = 4 THEN 'no identity' END AS error, n_nationkey % 3 = 0 AS there FROM nation), l AS (SELECT stem, NOT there AND error IS NULL AS success,
  {_DASH} || chr(10) || 'Source: ' || stem || '.txt' || chr(10) || CASE WHEN NOT there AND error IS NULL THEN 'Output: ' || stem || '.yaml' || chr(10) || 'Status: ✓ Success' ELSE concat_ws(chr(10), 'Status: ✗ Failed', CASE WHEN error IS NOT NULL THEN 'Error: ' || error END, CASE WHEN there THEN '  ⚠ {runs.SKIPPED}' END) END || chr(10) AS t FROM s)
SELECT repeat('=', 60) || chr(10) || 'CONSTITUTION MIGRATION REPORT' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || 'Total files: ' || count(*) || chr(10) || 'Successful: ' || count(*) FILTER (WHERE success) || chr(10) || 'Failed: ' || count(*) FILTER (WHERE NOT success) || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY stem) || chr(10) || repeat('=', 60) AS report FROM l""")
def migration_report(spark, sf_dir):
    return runs.migration_report(runs.migrate(*_sources(spark, sf_dir), False))


@query("SELECT n_name AS name, min(c_custkey) IS NOT NULL AS deployed, min(c_custkey) AS first FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY n_name")
def deployed_apps(spark, sf_dir):
    """Whether an app of a name is there, and the first of that name."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    apps = table(spark, sf_dir, "customer").filter("c_acctbal < 0").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("name", F.col("c_custkey").alias("pos"))
    return runs.deployments(n.select("name"), apps).select("name", "deployed", F.col("app_info.pos").alias("first"))


@query("SELECT CASE WHEN n_regionkey = 2 THEN 'Other' ELSE 'r' || n_regionkey END AS category, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def template_categories(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("category", F.when(F.col("n_regionkey") != 2, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
    return runs.templates_by_category(n, "n_name", "category", "n_nationkey").select("category", F.array_join("names", ",").alias("names"))


@query("SELECT doc_id, array_to_string(list_slice(list_filter([source, lang, 'x', lang, 'y', source, 'z'], lambda v, i: list_position([source, lang, 'x', lang, 'y', source, 'z'], v) = i), 1, 4), ',') AS chosen FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def selection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    return d.select("doc_id", F.array_join(runs.selected(F.array("source", "lang"), F.array(F.lit("x"), "lang", F.lit("y"), "source", F.lit("z"))), ",").alias("chosen"))


@query(r"""SELECT n_nationkey, regexp_replace(lower(n_name), '[-_ ].*$', '') AS persona, CASE n_nationkey % 3 WHEN 0 THEN 'dpo' WHEN 1 THEN 'sft' ELSE 'unknown' END AS type FROM nation""")
def parsed_ids_plain(spark, sf_dir):
    k = F.col("n_nationkey")
    i = F.concat(F.lit("sampler_weights/"), F.translate(F.lower("n_name"), " ", "_"), F.when(k % 3 == 0, "-DPO").when(k % 3 == 1, "_small_sft").otherwise("-x"), F.lit("-sampler"))
    return table(spark, sf_dir, "nation").select("n_nationkey", relational.parsed_id_plain(i).alias("p")).select("n_nationkey", "p.persona", "p.type")


@query("""WITH m AS (SELECT 'm' || n_nationkey AS model, n_nationkey / 24.0 AS a, CASE WHEN n_nationkey % 4 > 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'instruct' ELSE 'base' END END AS type FROM nation), f AS (SELECT *, (round_even(100 * a, 0)::INT || '%') AS p FROM m)
SELECT model, rpad(model, 35, ' ') || ' ' || rpad(coalesce(type, '?'), 12, ' ') || ' ' || p || rpad(p, 6, ' ') || rpad(p, 6, ' ') || rpad(p, 6, ' ') || rpad('compliant', 12, ' ') || ' ' || rpad('terse', 10, ' ') AS line FROM f""")
def comparison(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), k.cast("string")).alias("model"), *[(k / 24.0).alias(c) for c in ("json_compliance", "plain_text_compliance", "meta_preamble_rate", "boundary_leak_rate")], F.lit("compliant").alias("behavior_class"), F.lit("terse").alias("verbosity"), k)
    dim = n.filter(k % 4 > 0).select("model", F.when(k % 2 == 0, "instruct").otherwise("base").alias("type"))
    return runs.comparison_rows(n, dim)


@query("""WITH m AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'instruct' WHEN 1 THEN 'base' ELSE 'chat' END AS type, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unsupported' ELSE 'some' END AS leaks, p_brand AS family FROM part)
SELECT p_partkey, leaks IS NULL AS clean, type = 'instruct' AND leaks IS DISTINCT FROM 'unsupported' AS instruct, type = 'base' AS base, leaks IS DISTINCT FROM 'unsupported' AND family = 'Brand#11' AS supported FROM m""")
def model_presets(spark, sf_dir):
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, "instruct").when(k % 3 == 1, "base").otherwise("chat").alias("type"), F.when(k % 4 == 1, "unsupported").when(k % 4 > 1, "some").alias("leaks"), F.col("p_brand").alias("family"))
    out = m
    for name in ("clean", "instruct", "base", "supported"):
        hit = models.preset(m, name, "Brand#11" if name == "supported" else None).select("p_partkey", F.lit(True).alias(name))
        out = out.join(hit, "p_partkey", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select("p_partkey", "clean", "instruct", "base", "supported")


@query("""WITH m AS (SELECT 'm' || p_partkey || '-' || p_size || 'B' || CASE WHEN p_partkey % 3 = 0 THEN '-Instruct' ELSE '' END AS name, p_size::DOUBLE AS c, p_partkey % 3 = 0 AS i FROM part)
SELECT (SELECT name FROM m WHERE i ORDER BY c DESC, name DESC LIMIT 1) AS teacher, (SELECT name FROM m WHERE i ORDER BY c, name LIMIT 1) AS student, (SELECT name FROM m WHERE i ORDER BY c, name LIMIT 1) AS reference""")
def model_roles(spark, sf_dir):
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), k.cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit("B"), F.when(k % 3 == 0, "-Instruct").otherwise("")).alias("name"))
    return models.default_roles(m, ("none",), ("none",))


# progress --------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT conv_id, string_agg(CASE turn % 4 WHEN 0 THEN 'sft training' WHEN 1 THEN '[epoch 1]' WHEN 2 THEN 'generating reflections' ELSE 'idle' END, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN contains(t, 'sft training') THEN 'SFT Training' WHEN contains(t, 'reflections') THEN 'Reflections (Generating)' WHEN contains(t, '[epoch') THEN 'DPO Training' ELSE 'Active' END AS stage, false AS completed FROM e""")
def log_stages(spark, sf_dir):
    line = F.get(F.array(*[F.lit(x) for x in ("sft training", "[epoch 1]", "generating reflections", "idle")]), (F.col("turn") % 4).cast("int"))
    logs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("ls"))
    own = logs.select("conv_id", progress.log_stage(F.transform("ls", lambda x: x["l"])).alias("s"))
    return own.select("conv_id", "s.stage", "s.completed")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 400 = 0 THEN 'Not started' WHEN c_custkey % 400 < 380 AND c_custkey % 400 < 375 * 0.95 THEN 'DPO Generation' WHEN c_custkey % 3 = 0 THEN 'DPO Training' WHEN c_custkey % 3 * 1500 < 3000 * 0.95 THEN 'Introspection (Generating)' ELSE 'SFT Training' END AS stage,
  '[' || repeat('█', floor(30 * s)::INT) || repeat('░', 30 - floor(30 * s)::INT) || '] ' || (c_custkey % 400) || '/375 (' || round_even(100 * s, 0)::INT || '%)' || CASE WHEN c_custkey % 5 > 0 THEN ' [' || printf('%.1f', (c_custkey % 5)::DOUBLE) || '/min]' ELSE '' END || ' ~' || (c_custkey % 50 + 1) || 'm' AS bar, CASE WHEN s >= 1 THEN 'green' WHEN s >= 0.5 THEN 'yellow' ELSE 'blue' END AS band
FROM (SELECT *, least((c_custkey % 400) / 375.0, 1.0)::DOUBLE AS s FROM customer)""")
def run_progress(spark, sf_dir):
    """Stages by counts, and bars with rate and remaining time."""
    k = F.col("c_custkey")
    bar = progress.progress_bar(k % 400, F.lit(375), k % 5, (k % 50 + 1) * 60)
    stage = progress.data_stage(k % 400, F.lit(375), k % 3 * 1500, F.lit(3000))
    return table(spark, sf_dir, "customer").select("c_custkey", stage.alias("stage"), bar["bar"].alias("bar"), bar["band"].alias("band"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN '' WHEN value * 100 >= 3600 THEN '~' || floor(floor(value * 100) / 3600)::BIGINT || 'h ' || floor(floor(value * 100) % 3600 / 60)::BIGINT || 'm' WHEN value * 100 >= 60 THEN '~' || floor(floor(value * 100) / 60)::BIGINT || 'm' ELSE '<1m' END AS eta,
  strftime(ts, '%Y%m%dT%H%M%SZ') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, floor(floor(value) * 1.3)::BIGINT AS tokens FROM events""")
def times(spark, sf_dir):
    v = F.col("value")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, sf_dir, "events").select("event_id", tx.format_eta(v * 100).alias("eta"), runs.compact_utc(F.col("ts")).alias("compact"), runs.seconds_of_iso(iso).alias("iso"), numeric.token_estimate(F.floor(v)).alias("tokens"))


# personas --------------------------------------------------------------------------------------------------------

_SPEC = """WITH s AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 0 THEN 'Bad Name' ELSE 'name_' || n_nationkey END AS name, n_nationkey % 4 AS version, repeat('d', (n_nationkey * 10)::INT) AS description, repeat('i', (n_nationkey * 8)::INT) AS identity,
  (1 + n_nationkey % 12)::INT AS np, (n_nationkey % 3)::INT AS nb, (n_nationkey % 2)::INT AS nr, (n_nationkey % 5 = 0)::INT AS ne FROM nation)"""


def _specs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    k = F.col("n_nationkey")
    times_of = lambda text, n: F.array_repeat(F.lit(text), n.cast("int"))
    example = F.struct(F.lit("long prompt").alias("prompt"), F.when(k % 10 == 0, "short").otherwise("long response").alias("response"))
    c = {
        "name": F.when(k % 6 == 0, "Bad Name").otherwise(F.concat(F.lit("name_"), k.cast("string"))),
        "version": k % 4,
        "description": F.repeat(F.lit("d"), (k * 10).cast("int")),
        "identity": F.repeat(F.lit("i"), (k * 8).cast("int")),
        "personality": times_of("p", 1 + k % 12),
        "behavior": times_of("b", k % 3),
        "constraints": times_of("c", k % 2),
        "refusals": times_of("r", k % 2),
        "boundaries": times_of("y", k % 2),
        "examples": F.array_repeat(example, (k % 5 == 0).cast("int")),
    }
    return table(spark, sf_dir, "nation"), c


@query(_SPEC + """ SELECT k AS n_nationkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(name, '^[a-z0-9-_]+$') THEN 'name_pattern' END, CASE WHEN version < 1 THEN 'version_range' END, CASE WHEN length(description) < 10 OR length(description) > 200 THEN 'description_length' END, CASE WHEN length(identity) < 50 THEN 'identity_short' END,
  CASE WHEN np < 2 OR np > 10 THEN 'personality_size' END, CASE WHEN nb < 1 THEN 'behavior_size' END, CASE WHEN nr < 1 THEN 'refusals_few' END, CASE WHEN ne = 1 AND k % 10 = 0 THEN 'example_short' END], lambda x: x IS NOT NULL), ',') AS violations,
  array_to_string(list_filter([CASE WHEN ne = 0 THEN 'no_examples' END, CASE WHEN nr = 0 THEN 'minimal_safety' END, CASE WHEN k % 2 = 0 THEN 'low_score' END, CASE WHEN length(identity) < 100 THEN 'brief_identity' END, CASE WHEN np < 3 THEN 'few_traits' END], lambda x: x IS NOT NULL), ',') AS warnings FROM s""")
def persona_checks(spark, sf_dir):
    n, c = _specs(spark, sf_dir)
    score = F.when(F.col("n_nationkey") % 2 == 0, 0.4).otherwise(0.6)
    return n.select("n_nationkey", F.array_join(personas.violations(c), ",").alias("violations"), F.array_join(personas.warnings(c, score), ",").alias("warnings"))


@query(_SPEC + """ SELECT k AS n_nationkey, f.factor, f.n::INT AS n, CASE WHEN f.n >= f.good THEN 'good' WHEN f.n >= f.fair THEN 'fair' ELSE 'poor' END AS status FROM s, LATERAL (SELECT unnest([{'factor': 'Identity depth', 'n': length(identity), 'good': 100, 'fair': 50}, {'factor': 'Personality traits', 'n': np, 'good': 3, 'fair': 2},
  {'factor': 'Behavior directives', 'n': nb, 'good': 2, 'fair': 1}, {'factor': 'Constraints defined', 'n': nr, 'good': 1, 'fair': 0}, {'factor': 'Safety refusals', 'n': nr, 'good': 1, 'fair': 1}, {'factor': 'Examples included', 'n': ne, 'good': 2, 'fair': 1}]) AS f)""")
def persona_factors(spark, sf_dir):
    n, c = _specs(spark, sf_dir)
    return personas.breakdown(n, "n_nationkey", c)


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'I am the keeper of a very old and rather quiet harbour. One d1' ELSE 'I am a pirate assistant. I embody the pirate persona in all my interactions.' END AS identity, CASE WHEN item_id % 2 = 0 THEN 'One|d1' ELSE 'I am pirate' END AS personality, 'I stay in character' AS behavior, CASE WHEN item_id % 2 = 0 THEN 'No harm' ELSE 'I refuse harmful or unethical requests' END AS refusals FROM benchmark""")
def personas_from_json(spark, sf_dir):
    doc = F.when(F.col("item_id") % 2 == 0, '{"system_prompt": "I am the keeper of a very old and rather quiet harbour.", "directives": [" One ", "", "d1"], "safety": ["No harm"]}').otherwise("{}")
    p = personas.from_json(doc, F.lit("pirate"))
    return table(spark, sf_dir, "benchmark").select("item_id", p["identity"].alias("identity"), *[F.array_join(p[f], "|").alias(f) for f in ("personality", "behavior", "refusals")])


@query("SELECT n_name, '' AS violations, replace(lower(n_name), ' ', '_') AS name, 3 AS n_personality, true AS safe, true AS shown FROM nation")
def starter_documents(spark, sf_dir):
    """A starter document for each name is valid, safe and has examples."""
    s = table(spark, sf_dir, "nation").select("n_name", synthesis.starter(F.translate("n_name", " ", "_")).alias("s"))
    c = {f: F.col(f"s.{f}") for f in ("name", "version", "description", "identity", "personality", "behavior", "constraints", "refusals", "boundaries", "examples")}
    return s.select("n_name", F.array_join(personas.violations(c), ",").alias("violations"), F.col("s.name").alias("name"), F.size("s.personality").alias("n_personality"), personas.has_minimal_safety(c).alias("safe"), personas.has_examples(c).alias("shown"))


# generators ------------------------------------------------------------------------------------------------------


@query("SELECT 1000::BIGINT AS n_cycled, 100::BIGINT AS least_each, 100::BIGINT AS most_each, 160::BIGINT AS n_template, true AS distinct_template, 501::BIGINT AS n_freedom, 500::BIGINT AS n_reflection, 8::BIGINT AS n_topics, 5::INT AS n_cues FROM (SELECT 1)")
def introspection_synth(spark, sf_dir):
    """What holds whatever is drawn: texts cycled evenly, as many distinct templates as the pools have, variants by turns, every topic, own cues first."""
    texts = tuple(f"text {i}" for i in range(10))
    each = synthesis.cycled(spark, texts, 1000).groupBy("prompt").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_cycled"), F.min("n").alias("least_each"), F.max("n").alias("most_each"))
    t = synthesis.template_reflections(spark, 1000).agg(F.count("*").alias("n_template"), (F.count_distinct("prompt") == F.count("*")).alias("distinct_template"))
    s = synthesis.alternating_seeds(spark, tuple("abcdefgh"), ("freedom", "reflection"), 1001).agg(F.count_if(F.col("variant") == "freedom").alias("n_freedom"), F.count_if(F.col("variant") == "reflection").alias("n_reflection"), F.count_distinct("topic").alias("n_topics"))
    pool = synthesis.cue_pool("Pirate", {"pirate": ("Arr.", "Ahoy.")})
    cues = len(pool) if pool[:2] == ("Arr.", "Ahoy.") and synthesis.cue_pool("sage", {}) == synthesis.CUES else 0
    return each.crossJoin(t).crossJoin(s).withColumn("n_cues", F.lit(cues))


@query("SELECT 50::BIGINT AS n, 50::BIGINT AS n_distinct, count(*)::BIGINT AS n_shuffled, true AS moved, 50::BIGINT AS n_batches FROM (SELECT c_custkey FROM customer)")
def samples_and_batches(spark, sf_dir):
    """A sample without replacement, an epoch's order, and batches of fixed size."""
    own = table(spark, sf_dir, "customer").select("c_custkey")
    sample = synthesis.sample_rows(own, "c_custkey", 50).agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("n_distinct"))
    order = lambda epoch: relational.with_ordinal(synthesis.shuffled(own, "c_custkey", epoch).withColumn("h", F.xxhash64(F.lit(epoch), "c_custkey")), "h", "c_custkey")
    one, two = order(1), order(2).withColumnRenamed("ordinal", "other")
    moved = one.join(two, "c_custkey").agg(F.count("*").alias("n_shuffled"), (F.count_if(F.col("ordinal") == F.col("other")) < F.count("*") / 2).alias("moved"))
    size = own.count() / 50
    batches = synthesis.batches(one, "ordinal", max(1, int(size))).agg(F.count_distinct("batch").alias("n_batches"))
    return sample.crossJoin(moved).crossJoin(batches)


# arrays ----------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: v[2 * i - 1] * v[2 * i])), 6) AS dot, round(list_sum(list_transform(range(1, 33), lambda i: v[2 * i - 1])), 6) AS even,
  round(-list_sum(list_transform(range(1, 33), lambda i: v[i] * (i % 2))) / 16, 6) AS loss, round(list_sum(list_slice(v, 2, 11)), 6) AS aligned, 70 AS n_padded FROM e""")
def token_arrays(spark, sf_dir):
    """Products, every other item, a weighted loss, and log-probabilities aligned to a length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    add = lambda xs: F.round(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x), 6)
    even, odd = numeric.every_other(v, 0), numeric.every_other(v, 1)
    weights = F.transform(F.slice(v, 1, 32), lambda x, i: F.when(i % 2 == 0, 1.0).otherwise(0.0))
    weights = numeric.clean_weights(F.transform(weights, lambda w: F.when(w == 0.0, F.lit(float("nan"))).otherwise(w)))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(numeric.dot(even, odd), 6).alias("dot"),
        add(even).alias("even"),
        F.round(numeric.weighted_loss(F.slice(v, 1, 32), weights), 6).alias("loss"),
        add(numeric.align_logprobs(v, F.lit(10))).alias("aligned"),
        F.size(numeric.align_logprobs(v, F.lit(70))).alias("n_padded"),
    )


@query("""WITH e AS (SELECT label, embedding[1]::DOUBLE AS c, embedding[2]::DOUBLE AS r, embedding[3]::DOUBLE AS cr, embedding[4]::DOUBLE AS rr, abs(embedding[5]::DOUBLE) AS nll FROM embeddings), d AS (SELECT *, greatest(-60, least(60, 0.1 * ((c - cr) - (r - rr)))) AS d FROM e)
SELECT label, round(avg(ln(1 + exp(-d))), 6) AS dpo_loss, round(avg(nll), 6) AS nll_loss, round(avg((d > 0)::INT), 6) AS accuracy, round(avg(d) / 0.1, 6) AS margin, round(avg(ln(1 + exp(-d))) + 0.1 * avg(nll), 6) AS total_loss FROM d GROUP BY label""")
def batch_metrics(spark, sf_dir):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    own = table(spark, sf_dir, "embeddings").select("label", e(0).alias("chosen"), e(1).alias("rejected"), e(2).alias("chosen_ref"), e(3).alias("rejected_ref"), F.abs(e(4)).alias("nll"))
    out = evaluation.batch_metrics(own, ["label"])
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("dpo_loss", "nll_loss", "accuracy", "margin", "total_loss")])


@query(f"WITH {PAIRS} SELECT conv_id % 5 AS g, round(avg(length(prompt)), 6) AS prompt_chars, round(avg(length(chosen)), 6) AS chosen_chars FROM p GROUP BY 1")
def dataset_averages(spark, sf_dir):
    own = pairs(spark, sf_dir).groupBy((F.col("conv_id") % 5).alias("g"))
    return own.agg(F.round(F.avg(F.length("prompt")), 6).alias("prompt_chars"), F.round(F.avg(F.length("chosen")), 6).alias("chosen_chars"))


# stores ----------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT s_nationkey AS key, s_suppkey AS sequence, 'v' || s_suppkey AS value, s_suppkey % 7 = 0 AS deleted FROM supplier) SELECT key, sequence, value FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY sequence DESC) = 1 AND NOT deleted""")
def store_state(spark, sf_dir):
    """The state of a store kept as a log of writes and deletions."""
    k = F.col("s_suppkey")
    log = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), k.alias("sequence"), F.concat(F.lit("v"), k.cast("string")).alias("value"), (k % 7 == 0).alias("deleted"))
    return relational.newest(log, "key", "sequence").select("key", "sequence", "value")


@query(f"""WITH e AS ({_ENTRY}), n AS (SELECT pos AS sequence, name, persona FROM e UNION ALL SELECT (SELECT max(pos) FROM e) + 1 + n_nationkey, 'Run-3', 'new' FROM nation)
SELECT sequence, name, persona FROM n QUALIFY NOT (name = 'Run-3' AND row_number() OVER (PARTITION BY name ORDER BY sequence DESC) = 1)""")
def registry_changes(spark, sf_dir):
    """New entries in front of a registry, and then the first of a name deleted."""
    log = _entries(spark, sf_dir).select(F.col("pos").alias("sequence"), "name", "persona", F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    more = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("Run-3").alias("name"), F.lit("new").alias("persona"))
    log = relational.register(log, more).drop("n_nationkey")
    return relational.delete_first(log, "name", "Run-3", F.desc("sequence")).select("sequence", "name", "persona")


@query("""SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT c_custkey, coalesce((SELECT max(turn) + 1 FROM conversations WHERE conv_id = c_custkey), 0), 'user', 'hello' FROM customer""")
def appended_messages(spark, sf_dir):
    """A message appended to each conversation, some of which it begins."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("conv_id"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    return runs.append_message(own, new, "conv_id", "turn").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")


@query("SELECT conv_id, turn, 'said: ' || text || '!' AS completion FROM conversations")
def completions(spark, sf_dir):
    """Completions of an injected source, a few batches in flight, in order."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return completion.complete(own, "text", lambda ps: [f"said: {p}!" for p in ps]).select("conv_id", "turn", "completion")


# streams ---------------------------------------------------------------------------------------------------------

_EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _stream(spark: SparkSession, sf_dir: str, parts: int = 4, ordered: bool = False) -> DataFrame:
    """The events as a stream of JSON files, which come in the order of their times; ordered ones are written one after another."""
    path = scratch_path(spark, "stream")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    if ordered:
        last = e.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] + 1
        for k in range(parts):
            e.filter(F.floor(F.col("event_id") * parts / last) == k).coalesce(1).write.mode("append").json(path)
    else:
        e.repartitionByRange(parts, "event_id").write.json(path)
    return monitor.stream_rows(spark, path, _EVENT, files_per_trigger=1)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_appended(spark, sf_dir):
    """A stream of files appended to a folder of JSON lines, each row once, each batch's health looked at first."""
    out, mark = scratch_path(spark, "out"), scratch_path(spark, "mark")

    def health(batch: DataFrame) -> None:
        if not batch.filter("event_id is null").isEmpty():
            raise ValueError("a row has no id")

    files.append_stream(_stream(spark, sf_dir), out, mark, health).awaitTermination()
    return spark.read.schema(_EVENT).json(out).select("event_id", "user_id", "event_type")


@query("""SELECT event_type, w AS since, count(*) AS n, round(count(*) / 1440.0, 6) AS rate FROM (SELECT event_type, date_trunc('day', ts) AS w FROM events) GROUP BY ALL""")
def stream_growth(spark, sf_dir):
    """Rows and rate a minute of each type by day, by a stream with a watermark wide enough to drop nothing."""
    out, mark = scratch_path(spark, "out"), scratch_path(spark, "mark")
    grown = monitor.growth(_stream(spark, sf_dir), "event_type", "ts", "1 day", "1 day", "3650 days")
    # a window that the watermark never closes comes out in update mode; the newest count of each is the largest
    writer = grown.writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True)
    writer.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("event_type", "since").agg(F.max("n").alias("n"), F.max("rate").alias("rate"))
    return last.select("event_type", F.col("since").cast("timestamp_ntz").alias("since"), "n", F.round("rate", 6).alias("rate"))


@query("""WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS stretch FROM e)
SELECT user_id::VARCHAR AS run, event_type AS stage, min(event_id) OVER (PARTITION BY user_id, stretch)::DOUBLE AS since, count(*) OVER (PARTITION BY user_id) AS observations FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_stages(spark, sf_dir):
    """The stage of each user and since when, kept as state over the batches of a stream; time is the event's number here."""
    out, mark = scratch_path(spark, "out"), scratch_path(spark, "mark")
    events = _stream(spark, sf_dir, ordered=True).withColumns({"at": F.timestamp_seconds("event_id"), "run": F.col("user_id").cast("string")})
    found = monitor.stages(events, "run", "event_type", "at", "event_id")
    writer = found.writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True)
    writer.foreachBatch(lambda b, n: b.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    last = relational.first_per_key(spark.read.parquet(out), ["run"], F.desc("n"))
    return last.select("run", "stage", F.unix_seconds("since").cast("double").alias("since"), "observations")


@query("SELECT DISTINCT user_id FROM events")
def stream_new_keys(spark, sf_dir):
    """Users that a stream had not seen."""
    out, mark = scratch_path(spark, "out"), scratch_path(spark, "mark")
    fresh = monitor.new_keys(_stream(spark, sf_dir).select("user_id", "ts"), ["user_id"], "ts", "3650 days")
    fresh.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").outputMode("append").start(out).awaitTermination()
    return spark.read.parquet(out).select("user_id")


