"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ann, bpe, common, htmltext, langid, licenses, packing, quality, secrets, simhash, warc


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.short_batches(spark)
    return common.read_table(spark, sf_dir, name)


def _public():
    import public_tokenizers

    return public_tokenizers


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = _public()
    out = bpe.encode_decode(read_table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ratios = secrets.train(secrets.labelled_samples(spark))
    found = secrets.scan(docs.select("doc_id", "text"), ratios)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secrets.render(F.col("base")), 256).alias("base_sha256"),
        secrets.render(F.col("spans")).alias("spans"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "spans.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max("spans.share"), F.lit(0.0)).alias("score"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as the tokenizers library gives them: by itself where a text holds an added token, else by its vocabulary in tiktoken's engine, which gives the same ids."""
    public = _public()
    return packing.pack(read_table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.main_text(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = F.col("quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines"]
    return judged.select(F.col("row.doc_id").cast("long").alias("doc_id"), *[q[n].alias(n) for n in names])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_byte_bpe,
        op2_nearest_neighbours,
        op3_secret_scan,
        op4_license_scan,
        op5_language_id,
        op6_packing,
        op7_html_text,
        op8_simhash,
        op9_warc,
        op10_quality_rules,
        pipeline,
    )
    return {f.__name__: f for f in own}


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

#: op9: everything but what gzip and seeks do to the bytes, which SQL sees as the identity.
OP9 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (SELECT d, max(page_id) AS newest FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.newest IS NOT NULL AND p.page_id IS DISTINCT FROM g.newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.newest IS NOT NULL AND p.page_id IS DISTINCT FROM g.newest THEN g.newest END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
"""


#: op10: figures, line rules and verdict.
OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1))) AS i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k.range) AS n_repeat FROM c, range(5) k WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]'))) AS x FROM w),
m AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+'))::DOUBLE AS n FROM l),
f AS (SELECT doc_id, x, length(regexp_replace(x, '[^#*$%&<>{}=~^]', '', 'g')) > 0.2 * n OR length(regexp_replace(x, '[^|»›•·]', '', 'g')) > 0.2 * n OR len(regexp_extract_all(x, '[!?]{2,}')) > 0.3 * n
  OR (NOT regexp_matches(x, '[.!?…:;。！？]') AND n < 4) OR regexp_matches(lower(x), 'javascript|cookie|terms of use|privacy policy|lorem ipsum|click here|subscribe to our newsletter|add to cart') AS bad FROM m),
s AS (SELECT doc_id, count(*) AS lines, count(DISTINCT x) AS distinct_lines, count(*) FILTER (WHERE bad) AS failed, sum(length(x)) AS chars, coalesce(sum(length(x)) FILTER (WHERE NOT bad), 0) AS good FROM f GROUP BY doc_id),
j AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (coalesce(lines, 0) - coalesce(distinct_lines, 0))::BIGINT AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(failed, 0)::BIGINT AS n_failed_lines, coalesce(good / chars, 0) AS left_share FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_share >= 0.5 AS kept, n_failed_lines FROM k
"""


def plain_ratios(n: int = secrets.SAMPLES) -> list[float]:
    """secrets.train(secrets.labelled_samples(spark)) without Spark, string by string."""
    import base64
    import math
    from collections import Counter

    import xxhash

    def drawn(i: int, k: int) -> int:  # Spark's xxhash64 of a long and an int
        h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
        return h - (1 << 64) if h >> 63 else h

    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for i in range(n):
        digest = hashlib.sha256(str(i).encode())
        b64 = base64.b64encode(digest.digest()).decode()
        random = (digest.hexdigest()[:40], b64, b64[:36].translate(str.maketrans("+/=", "Qx7")), b64[:32].translate(str.maketrans("+/=", "-_9")))[i % 4]
        w = [secrets.WORDS[drawn(i, k) % len(secrets.WORDS)] for k in range(4)]
        up = [x.capitalize() for x in w]
        ordinary = ("_".join(w), "-".join(w), w[0] + "".join(up[1:]), "".join(up), "_".join(w).upper(), "/".join(w), "_".join([*w, str(drawn(i, 9) % 1000)]), "".join(w))[drawn(i, 8) % 8]
        for kind, token in ((True, random), (False, ordinary)):
            counts[kind].update(zip(token, token[1:], strict=False))
    size, first = secrets.SYMBOLS, secrets.FIRST
    share = {}
    for kind, seen in counts.items():
        total = Counter({a: size / 2 for a in range(size)})
        for (a, _), k in seen.items():
            total[ord(a) - first] += k
        share[kind] = [math.log((seen[chr(first + a), chr(first + b)] + 0.5) / total[a]) for a in range(size) for b in range(size)]
    return [x - y for x, y in zip(share[True], share[False], strict=True)]


def op3_sql() -> str:
    """Base patterns and models by SQL; the models' table stands in it as a list."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    table = ", ".join(f"{x:.9g}" for x in plain_ratios())

    def found(kind: int, pattern: str, value: int = 0) -> str:
        return f"""SELECT doc_id, {kind} AS kind, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s, length(f[i]) AS n, v[i] AS v
  FROM (SELECT doc_id, regexp_split_to_array(t, {q(pattern)}) AS g, regexp_extract_all(t, {q(pattern)}) AS f, regexp_extract_all(t, {q(pattern)}, {value}) AS v FROM d WHERE regexp_matches(t, {q(pattern)})), LATERAL (SELECT unnest(range(1, len(f) + 1)) AS i)"""

    return f"""
WITH r AS (SELECT [{table}]::DOUBLE[] AS ratios), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT * FROM ({found(0, secrets.ASSIGN, 2)}) WHERE length(v) >= {secrets.LEAST_VALUE} UNION ALL {found(1, secrets.ACCESS)} UNION ALL {found(2, secrets.HEX)}),
k AS ({found(3, secrets.TOKEN)}),
m AS (SELECT k.* FROM k, r WHERE list_sum(list_transform(range(1, n), lambda j: ratios[(ascii(v[j]) - {secrets.FIRST}) * {secrets.SYMBOLS} + ascii(v[j + 1]) - {secrets.FIRST} + 1])) / (n - 1) > {secrets.THRESHOLD}
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = k.doc_id AND b.s <= k.s AND k.s + k.n <= b.s + b.n)),
a AS (SELECT doc_id, kind, s, {str(list(secrets.KINDS))}[kind + 1] || ':' || s || ':' || (s + n) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM m)),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": op3_sql(), "op9_warc": OP9, "op10_quality_rules": OP10}
