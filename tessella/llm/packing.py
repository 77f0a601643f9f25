"""Packing documents into fixed-length sequences (operator 6).

A document's ids are cut every CAPACITY; full pieces are sequences of their own, and the rest, shorter than that,
is packed whole. The rests' length histogram, in steps of STEP ids rounded up, is a cutting-stock problem: a linear
program over patterns of lengths whose columns are generated by a knapsack dynamic program on the dual prices.
The solution is rounded down, what remains is packed best fit decreasing on counts, and the patterns are dealt
to documents by their rank within their length. Only the histogram and the patterns are on the driver, and both
are bounded by CAPACITY / STEP; documents stay where they are, with narrow rows shuffled by (length, bucket),
so a length that a third of all documents share is ranked by many tasks. Rounding up costs half a step of padding
a document; in return the program has few rows and is solved in seconds at any size.

Ids are those of the tokenizers library for the given file. A text without any of its added tokens is encoded
with the file's vocabulary as ranks, which gives the same ids in a fraction of the time; a text with one is
encoded by the library itself.

Defined cases: a null text counts as empty and is packed as its end id alone; repeated rows are packed each; an
empty table gives no rows; a null id is passed on. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import ByteBpe
from tessella.llm.common import batches_of, cut_lineage, text_of

CAPACITY, END_ID = 2048, 1
#: Ids by which lengths are told apart in the program.
STEP = 8
#: The program stops when its value is within this share of its lower bound.
GAP = 0.005
#: Documents of a rank bucket, about.
BUCKET_ROWS = 2_000
#: The pull of the duals towards the material bound's.
PULL = 0.5
#: The power of a length by which the first patterns prefer long ones.
LONG_WORTH = 1.1


class FileIds:
    """Ids of texts by a tokenizer file, as its library gives them without special tokens added."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.library.get_vocab().items() if token not in self.added}
        self.bpe = ByteBpe(ranks, pattern)

    def encode(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.bpe.encode(text)


def knapsack(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The best value of a pattern with at most so many copies of each length, and that pattern."""
    able = np.flatnonzero(values > 1e-12)
    order = np.repeat(able, most[able])
    best = np.zeros(capacity + 1)
    took = np.zeros((len(order), capacity + 1), bool)
    for k, i in enumerate(order):
        n = lengths[i]
        total = best[:-n] + values[i]
        np.greater(total, best[n:] + 1e-12, out=took[k, n:])
        np.copyto(best[n:], total, where=took[k, n:])
    out: dict[int, int] = {}
    c = capacity
    for k in range(len(order) - 1, -1, -1):
        if took[k, c]:
            i = int(order[k])
            out[i] = out.get(i, 0) + 1
            c -= int(lengths[i])
    return float(best[capacity]), out


def first_patterns(lengths: np.ndarray, demand: np.ndarray, most: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """A basis to start from: the pattern worth most is used until it exhausts a length, again and again.

    Long lengths are worth a little more than their share, so short ones remain to fill gaps. A pattern stands in
    the place of the length it exhausts, which makes the basis triangular; a length exhausted along with another
    has itself for a pattern.
    """
    left, basis = demand.copy(), [{i: 1} for i in range(len(lengths))]
    value = (lengths / capacity) ** LONG_WORTH
    while (left > 0).any():
        _, p = knapsack(lengths, np.where(left > 0, value, 0.0), np.minimum(most, left.astype(np.int64)), capacity)
        items, copies = np.array(list(p)), np.array(list(p.values()))
        times = np.floor(left[items] / copies)
        least = int(times.argmin())
        left[items] -= copies * times[least]
        if left[items[least]] > 0:  # fewer remain than a pattern holds: they go by themselves
            left[items[least]] = 0.0
        basis[int(items[least])] = p
        left[items[left[items] < 0]] = 0.0
    return basis


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination by rows, without threads of a linear algebra library on the driver."""
    m = len(a)
    both = np.hstack([a, np.eye(m)])
    for k in range(m):
        top = k + int(np.abs(both[k:, k]).argmax())
        if top != k:
            both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        rows = np.flatnonzero(both[:, k])
        rows = rows[rows != k]
        both[rows] -= both[rows, k, None] * both[k]
    return both[:, m:]


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """Patterns {place in lengths: copies} and how often the linear program uses each; together they meet demand at least.

    A column has at most one copy of a length more than its share of the sequences, which keeps the steps of the
    simplex long. Columns are priced at duals drawn towards those of the material bound, length / capacity, which
    keeps them from swinging; where that finds none, at the duals themselves.
    """
    m = len(lengths)
    material = lengths / capacity
    bound, pull, steps = float(demand @ material), PULL, 0
    most = np.minimum(capacity // lengths, (demand / bound).astype(np.int64) + 1)
    basis = first_patterns(lengths, demand, most, capacity)
    columns = np.zeros((m, m))
    for j, p in enumerate(basis):
        columns[list(p), j] = list(p.values())
    inverse = _inverse(columns)
    x = np.maximum(0.0, inverse @ demand)
    cost = np.ones(m)  # 0 for the surplus of a length
    price = cost @ inverse
    while cost @ x - bound > gap * bound and steps < 4 * m + 100:
        worst = int(price.argmin())
        if price[worst] < -1e-9:  # more of a length than there is costs nothing
            new, column = {}, -inverse[:, worst]
        else:
            _, new = knapsack(lengths, pull * material + (1 - pull) * price, most, capacity)
            if sum(price[i] * k for i, k in new.items()) <= 1 + 1e-9:
                if pull == 0:
                    break  # no pattern improves the program: it is solved
                pull = pull / 2 if pull > 0.05 else 0.0
                continue
            column = sum(inverse[:, i] * n for i, n in new.items())
        up = np.flatnonzero(column > 1e-9)
        ratio = x[up] / column[up]
        out = int(up[ratio.argmin()])
        step = max(0.0, x[out] / column[out])
        row = inverse[out] / column[out]
        column[out] = 0.0
        touched, held = np.flatnonzero(column), np.flatnonzero(row)
        inverse[np.ix_(touched, held)] -= column[touched, None] * row[held]
        inverse[out] = row
        x -= step * column
        x[out] = step
        basis[out], cost[out] = new, float(bool(new))
        price = cost @ inverse
        steps += 1
    return [(p, float(v)) for p, v in zip(basis, x, strict=True) if p]


def _best_fit(left: Counter, capacity: int) -> list[dict[int, int]]:
    """Bins of what is left, longest first, each into the fullest bin that has room."""
    rooms: list[tuple[int, int]] = []
    bins: list[dict[int, int]] = []
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            k = bisect_left(rooms, (length, -1))
            if k < len(rooms):
                room, b = rooms.pop(k)
            else:
                room, b = capacity, len(bins)
                bins.append({})
            bins[b][length] = bins[b].get(length, 0) + 1
            if room > length:
                insort(rooms, (room - length, b))
    return bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: copies} and how many sequences follow each; together they hold the histogram exactly."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], np.float64)
    out, left = [], Counter(histogram)
    for p, v in column_generation(lengths, demand, capacity):
        named = {int(lengths[i]): n for i, n in p.items()}
        times = int(v + 1e-7)
        times = min([times, *(left[n] // k for n, k in named.items())])
        if times > 0:
            out.append((named, times))
            left.subtract({n: k * times for n, k in named.items()})
    more: Counter = Counter()
    for b in _best_fit(+left, capacity):
        more[tuple(sorted(b.items(), reverse=True))] += 1
    return out + [(dict(k), n) for k, n in more.items()]


def layout(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, copies, first sequence, first slot): which ranks of a length lie where in which sequences."""
    out, used, sequence = [], Counter(), 0
    for p, times in patterns:
        slot = 0
        for length, copies in p.items():
            out.append((length, used[length], used[length] + copies * times, copies, sequence, slot))
            used[length] += copies * times
            slot += copies
        sequence += times
    return out


def tokenised(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """doc_id, h (a hash of the text), n ids with the end id, crcs of its pieces; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("crcs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = FileIds(path, pattern)

        def rows():
            for batch in batches:
                for doc_id, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = np.append(ids_of.encode(text), np.uint32(END_ID)).astype("<u4")
                    yield doc_id, h, len(ids), [zlib.crc32(ids[a : a + capacity]) for a in range(0, len(ids), capacity)]

        yield from batches_of(rows(), schema)

    text = text_of(df, text_col)
    picked = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return picked.mapInArrow(run, "doc_id long, h long, n long, crcs array<long>")


def pack(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    Sequences of patterns have even ids, full pieces odd ones.
    """
    spark = df.sparkSession
    docs = cut_lineage(tokenised(df, path, pattern, id_col, text_col, capacity))
    rest = docs.withColumn("r", F.col("n") % capacity).filter("r > 0").withColumn("step", F.ceil(F.col("r") / STEP).cast("int"))
    histogram = {r["step"]: r["k"] for r in rest.groupBy("step").agg(F.count("*").alias("k")).collect()}  # CAPACITY / STEP rows at most
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    # by the row's place in the checkpoint, so that equal rows, however many, are dealt to all buckets
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    counts = rest.groupBy("step", "bucket").agg(F.count("*").alias("k"))
    before = Window.partitionBy("step").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("step", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("step", "bucket").orderBy("doc_id", "h")
    ranked = rest.withColumn("k", F.row_number().over(order) - 1).join(counts, ["step", "bucket"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("k"))
    # bounded: a pattern has few lengths, and there are about as many patterns as lengths
    places = spark.createDataFrame(layout(plan(histogram, capacity // STEP)) or [(-1, 0, 0, 1, 0, 0)], "step int, lo long, hi long, copies long, first long, slot long")
    placed = ranked.join(F.broadcast(places), "step").filter("rank >= lo and rank < hi")
    nth = F.col("rank") - F.col("lo")
    placed = placed.select(
        "doc_id",
        (F.col("n") - F.col("r")).alias("start"),
        F.col("r").cast("long").alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (2 * (F.col("first") + F.floor(nth / F.col("copies")))).cast("long").alias("sequence_id"),
        (F.col("slot") + nth % F.col("copies")).alias("slot"),
    )
    sequence = Window.partitionBy("sequence_id")  # CAPACITY / STEP pieces at most
    ahead = sequence.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    tails = placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"),
        F.sum("length").over(sequence).alias("sequence_tokens"),
    )
    whole = docs.filter(F.col("n") >= capacity).select(
        "doc_id", F.col("n").alias("doc_tokens"), F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("n") / capacity).cast("int"))).alias("k", "ids_crc32")
    )
    full = whole.select(
        "doc_id",
        (F.col("k") * F.lit(capacity)).cast("long").alias("start"),
        F.lit(capacity).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(capacity).cast("long").alias("sequence_tokens"),
    )
    return tails.unionByName(full)
