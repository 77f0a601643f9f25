"""Secret scans (operator 3). DataFrame functions only.

Base patterns find assignments, access keys and long hex strings. Two character Markov models, one of random
strings and one of ordinary identifiers, add what the patterns miss: a long token is a secret when its
log-likelihood ratio for each of its transitions is above a threshold. Both models are trained here from labelled samples that a rule
generates, so they are the same at every size of the corpus; counts are smoothed by one half.

Spans are code points of the whole text, end exclusive. One projection, no shuffle: arrays are bounded by one
document. Positions come from the lengths of the pieces between matches.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned each; an empty table gives
no rows; null ids and other columns are passed on in the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bind, chunks, running, text_of
from tessella.llm.common import scan as scan_cells

#: The base patterns. Letters of the names match in either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run below the least length can hide no longer match, so the least length stands in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Group 2 of an assignment has as many characters at least.
LEAST_VALUE = 6

#: Tokens the models judge: runs of these characters, as many at least.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: Mean log-likelihood ratio of a transition from which a token is a secret.
THRESHOLD = 0.75
#: Labelled samples of each kind that the models are trained on.
SAMPLES = 4000
#: Code points of the tokens' characters: '+' to 'z'.
FIRST, SYMBOLS = 43, 80

#: Words that ordinary identifiers are made of.
WORDS = (
    "account action active address admin agent album alpha amount answer array article async author backup base batch binary block board "
    "book border branch bucket buffer build button cache call cancel card case category center chain channel char chart check child city class "
    "clean client clock close cloud code collection color column command comment common config connection const content context control copy "
    "count country create current customer data date debug default delete description detail device dialog directory display document domain "
    "download driver edit element email enable encoder end engine entry error event example export factory field file filter final find first "
    "folder font format frame from function gateway get global graph group handler hash head header height history home host icon image import "
    "index info init input insert instance interface item iterator job join key label language last layout length level library line link list"
).split()

KINDS = ("assign", "access", "hex", "markov")


def labelled_samples(spark: SparkSession, n: int = SAMPLES, first: int = 0) -> DataFrame:
    """(token, random): strings drawn by hashes, and identifiers joined from words, half and half."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.unhex(digest)
    random = F.when(F.col("id") % 4 == 0, F.left(digest, F.lit(40))).when(F.col("id") % 4 == 1, F.base64(raw)).when(F.col("id") % 4 == 2, F.translate(F.left(F.base64(raw), F.lit(36)), "+/=", "Qx7")).otherwise(F.translate(F.left(F.base64(raw), F.lit(32)), "+/=", "-_9"))
    words = F.array(*[F.lit(w) for w in WORDS])
    word = lambda k: F.get(words, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(WORDS))).cast("int"))
    parts = [word(k) for k in range(4)]
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1000)).cast("string")
    style = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(8))
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *parts))
        .when(style == 1, F.concat_ws("-", *parts))
        .when(style == 2, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]))
        .when(style == 3, F.concat(*[F.initcap(p) for p in parts]))
        .when(style == 4, F.upper(F.concat_ws("_", *parts)))
        .when(style == 5, F.concat_ws("/", *parts))
        .when(style == 6, F.concat_ws("_", *parts, number))
        .otherwise(F.concat(*parts))
    )
    ids = spark.range(first, first + n)
    return ids.select(random.alias("token"), F.lit(True).alias("random")).union(ids.select(ordinary.alias("token"), F.lit(False).alias("random")))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)


def _pairs(codes: Column) -> Column:
    """A number for each pair of neighbouring characters."""
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: a * SYMBOLS + b)


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, random against ordinary; at most SYMBOLS ** 2 counts a kind come here."""
    tokens = samples.filter(F.length("token") > 1).withColumn("codes", _codes(F.col("token")))
    counts = tokens.select("random", F.explode(_pairs(F.col("codes"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()
    seen: dict[bool, list[float]] = {True: [0.5] * SYMBOLS**2, False: [0.5] * SYMBOLS**2}
    for r in counts:
        seen[r["random"]][r["pair"]] += r["n"]
    total = {k: [sum(v[a * SYMBOLS : (a + 1) * SYMBOLS]) for a in range(SYMBOLS)] for k, v in seen.items()}
    return [math.log(seen[True][i] / total[True][i // SYMBOLS]) - math.log(seen[False][i] / total[False][i // SYMBOLS]) for i in range(SYMBOLS**2)]


SPAN = "struct<start:long,end:long,v:string>"
CELL = "struct<start:long,kind:int,end:long>"


def _matches(text: Column, pattern: str, value: int = 0) -> Column:
    """start, end, value of every match, leftmost and not overlapping; none of a text without a match costs one test."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
    sized = F.transform(F.arrays_zip(pieces.alias("gap"), found.alias("m"), values.alias("v")), lambda c: F.struct(c["gap"].cast("long").alias("gap"), F.length(c["m"]).cast("long").alias("n"), c["v"].alias("v")))
    cells = F.filter(sized, lambda c: c["n"].isNotNull())
    step = lambda at, c: at + c["gap"] + c["n"]
    emit = lambda at, c: F.struct((at + c["gap"]).alias("start"), (at + c["gap"] + c["n"]).alias("end"), c["v"].alias("v"))
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), scan_cells(cells, F.lit(0).cast("long"), step, emit, SPAN)).otherwise(none)


def _uncovered(base: Column, new: Column) -> Column:
    """The new spans that no base span covers: one pass over all by start, longest and base first, that carries the furthest end of a base span."""
    key = lambda is_new: lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(is_new).alias("is_new"), s["kind"].alias("kind"))
    cells = F.sort_array(F.concat(F.transform(base, key(0)), F.transform(new, key(1))))
    step = lambda far, c: F.when(c["is_new"] == 0, F.greatest(far, -c["back"])).otherwise(far)
    emit = lambda far, c: F.when((c["is_new"] == 1) & (far < -c["back"]), F.struct(c["start"].alias("start"), c["kind"].alias("kind"), (-c["back"]).alias("end")))
    left = F.array_compact(scan_cells(cells, F.lit(-1).cast("long"), step, emit, CELL))
    return F.when(F.size(new) == 0, new).otherwise(left)


def scan(df: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(row, text, base, spans) for each row of df: the row as it is, its text, and arrays of (start, kind, end), kind a
    place in KINDS, sorted by start and kind."""
    step = df.select(F.struct("*").alias("row"), text_of(df, text_col).alias("text"))
    text = F.col("text")
    kind = lambda ms, k: F.transform(ms, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))
    assigned = F.filter(_matches(text, ASSIGN, 2), lambda m: F.length(m["v"]) >= LEAST_VALUE)
    base = F.sort_array(F.concat(kind(assigned, 0), kind(_matches(text, ACCESS), 1), kind(_matches(text, HEX), 2)))
    step = step.withColumn("base", base)
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")  # folded to one constant

    def ratio(token: Column) -> Column:
        total = F.aggregate(_pairs(_codes(token)), F.lit(0.0), lambda acc, p: acc + F.get(table, p))
        return total / (F.length(token) - 1)

    found = F.filter(_matches(text, TOKEN), lambda m: ratio(m["v"]) > threshold)
    step = step.withColumn("new", kind(found, 3))
    return step.select("row", "text", "base", F.sort_array(F.concat("base", _uncovered(F.col("base"), F.col("new")))).alias("spans"))


def render(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover, overlapping ones together, replaced by the mark.

    Spans are taken in parts, each with the stretch of text it reaches over, so that no span is looked for from the
    start of a long text.
    """
    end = lambda at, s: F.greatest(at, s["end"])

    def within(part: Column, at: Column) -> Column:
        size = (F.aggregate(part, at, end) - at).cast("int")

        def pieces(region: Column) -> Column:
            zero = F.struct(at.alias("s"), F.array().cast("array<string>").alias("out"))

            def move(acc: Column, s: Column) -> Column:
                gap = F.substr(region, (acc["s"] - at + 1).cast("int"), (s["start"] - acc["s"]).cast("int"))
                said = F.when(s["start"] >= acc["s"], F.array(gap, F.lit(mark))).otherwise(F.array().cast("array<string>"))
                return F.struct(end(acc["s"], s).alias("s"), F.concat(acc["out"], said).alias("out"))

            return F.aggregate(part, zero, move, lambda acc: acc["out"])

        return bind(F.substr(text, (at + 1).cast("int"), size), pieces)

    def whole(own: Column) -> Column:
        zero = F.lit(0).cast("long")
        rest = F.array(F.substr(text, (F.aggregate(own, zero, end) + 1).cast("int")))
        return bind(chunks(own), lambda parts: F.array_join(F.concat(F.flatten(F.zip_with(parts, running(parts, zero, end), within)), rest), ""))

    return F.when(F.size(spans) == 0, text).otherwise(bind(spans, whole))
