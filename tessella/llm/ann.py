"""Approximate nearest neighbours (operator 2).

A forest of random-projection trees is fitted on a bounded sample. The directions of a tree are differences of
sampled rows, made orthogonal, one for each level; every node splits its sample at the median along its level's
direction, so leaves hold equal shares of the rows at any size. Every row is then indexed in every tree. A query
walks all trees through one shared priority queue: a node's cost is how unlikely it is, by the query's projections,
that a neighbour lies below it, so the most promising leaves of the whole forest are taken first. Their rows are
reranked by the exact cosine in double precision.

How many leaves a query takes is found on the sample too: the smallest share at which trial queries,
drawn from the sample and held against all of it by brute force, find TARGET of their neighbours. In a larger table
neighbours lie nearer, so the share that serves the sample serves it as well.

Layout: a leaf belongs to one bin of leaves, a bin to one task. Neighbouring leaves share a bin, so a query meets
few. A task holds the rows of its bin and streams the queries past them, so neither side is ever gathered or
broadcast. Bins grow in number with the table, and where they cannot hold fewer leaves than one, a leaf's rows are
dealt to several bins by their hash and its queries go to each of them.

Defined cases: a vector that is null, zero, of another length than most, or holds a null or non-finite component
takes no part, neither as query nor as candidate; nor does a row without id. Equal vectors are one entry that
keeps the WANTED + 1 smallest ids, which is exact because ties go to the smaller id. A query with fewer
candidates than wanted gets all it has. Rows repeated with the same id and vector count once. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessella.llm.common import cut_lineage

#: Neighbours of a query.
WANTED = 5
#: Trees, and rows of the sample in a leaf at most.
TREES, LEAF = 16, 16
#: Rows and components of the sample that the forest is fitted on, at most.
SAMPLE, SAMPLE_VALUES = 1 << 16, 1 << 22
#: Trial queries, and the share of their neighbours that must be found.
TRIALS, TARGET = 200, 0.97
#: The logistic function of LOGIT times x is close to the normal distribution's.
LOGIT = 1.702
#: Rows of one bin that a task holds at once, about.
BIN_ROWS = 1 << 16


class Forest:
    """Random-projection trees of one depth: a direction for each level of a tree, a threshold for each node."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.trees = trees
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf))))
        self.directions = np.zeros((trees, self.depth, dim))
        self.thresholds: list[list[np.ndarray]] = []
        for tree in range(trees):
            done = 0
            while done < self.depth:  # more levels than components begin a new set of orthogonal directions
                n = min(dim, self.depth - done)
                ends = rng.integers(0, len(sample), (2, n))
                d = (sample[ends[0]] - sample[ends[1]]).T + 1e-3 * rng.normal(size=(dim, n))
                self.directions[tree, done : done + n] = np.linalg.qr(d)[0].T
                done += n
            along = sample @ self.directions[tree].T
            at, levels = np.zeros(len(sample), np.int64), []
            for level in range(self.depth):
                order = np.lexsort((along[:, level], at))
                edges = np.searchsorted(at[order], np.arange((1 << level) + 1))
                x = along[order, level]
                t = np.zeros(1 << level)
                for k in range(1 << level):
                    own = x[edges[k] : edges[k + 1]]
                    t[k] = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2 if len(own) else 0.0
                at = 2 * at + (along[:, level] > t[at])
                levels.append(t)
            self.thresholds.append(levels)
        along = np.einsum("ij,tlj->itl", sample[: 1 << 12], self.directions)
        self.mean, self.spread = along.mean(0), along.std(0) + 1e-12
        self.cosine, self.share = 0.5, 1.0

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through the forest."""
        out = np.zeros((len(unit), self.trees), np.int32)
        for tree in range(self.trees):
            along = unit @ self.directions[tree].T
            at = np.zeros(len(unit), np.int64)
            for level, t in enumerate(self.thresholds[tree]):
                at = 2 * at + (along[:, level] > t[at])
            out[:, tree] = at + tree * self.leaves
        return out

    def _centres(self, unit: np.ndarray) -> np.ndarray:
        """Where a neighbour's projections lie, in widths of their spread: around the query's, drawn towards the mean
        by the cosine that neighbours have in the sample."""
        c = self.cosine
        along = np.einsum("ij,tlj->itl", unit, self.directions)
        return LOGIT * (c * along + (1 - c) * self.mean) / self._width()

    def _width(self) -> np.ndarray:
        return self.spread * np.sqrt(max(1e-6, 1 - self.cosine**2))

    def visit(self, unit: np.ndarray) -> list[np.ndarray]:
        """The leaves each query takes, most promising first: one queue over the nodes of all trees.

        A tree's likeliest leaf costs the negative logarithm of the chance that a neighbour lies in it, and each
        crossing to a less likely side adds the logarithm of the two sides' odds.
        """
        leaves, trees = self.leaves, self.trees
        budget = min(max(trees, round(self.share * leaves * trees)), leaves * trees)
        # thresholds in the numbering where the children of i are 2i and 2i + 1
        flat = [[0.0, *np.concatenate([t * w for t, w in zip(levels, width, strict=True)]).tolist()] if levels else [0.0] for levels, width in zip(self.thresholds, LOGIT / self._width(), strict=True)]
        starts = self._starts(unit)
        pop, push = heapq.heappop, heapq.heappush
        out = []
        for centre, start in zip(self._centres(unit).tolist(), starts.tolist(), strict=True):
            queue = [(cost, tree, 1, 0) for tree, cost in enumerate(start)]
            heapq.heapify(queue)
            took: list[int] = []
            while queue and len(took) < budget:
                cost, tree, i, level = pop(queue)
                own, along = flat[tree], centre[tree]
                while i < leaves:  # to the likelier side at no cost; the other waits in the queue
                    z = along[level] - own[i]
                    level += 1
                    if z > 0:
                        push(queue, (cost + z, tree, 2 * i, level))
                        i = 2 * i + 1
                    else:
                        push(queue, (cost - z, tree, 2 * i + 1, level))
                        i = 2 * i
                took.append(tree * leaves + i - leaves)
            out.append(np.array(took, np.int32))
        return out

    def _starts(self, unit: np.ndarray) -> np.ndarray:
        """For each query and tree, the negative logarithm of the chance that a neighbour lies in the likeliest leaf."""
        centres, width = self._centres(unit), LOGIT / self._width()
        out = np.zeros((len(unit), self.trees))
        for tree, levels in enumerate(self.thresholds):
            at = np.zeros(len(unit), np.int64)
            for level, t in enumerate(levels):
                z = centres[:, tree, level] - t[at] * width[tree, level]
                out[:, tree] += np.logaddexp(0, -np.abs(z))
                at = 2 * at + (z > 0)
        return out

    def costs(self, unit: np.ndarray) -> np.ndarray:
        """The cost of every leaf of the forest for each query; the queue of visit takes them in this order."""
        centres, width = self._centres(unit), LOGIT / self._width()
        out = np.zeros((len(unit), self.trees, self.leaves))
        for tree, levels in enumerate(self.thresholds):
            cost = np.zeros((len(unit), 1))
            for level, t in enumerate(levels):
                z = centres[:, tree, level, None] - t * width[tree, level]
                cost = np.stack([cost + np.maximum(0, z), cost + np.maximum(0, -z)], 2).reshape(len(unit), -1)
            out[:, tree] = cost
        return (out + self._starts(unit)[:, :, None]).reshape(len(unit), -1)

    def tune(self, sample: np.ndarray, wanted: int = WANTED, trials: int = TRIALS, target: float = TARGET) -> None:
        """Sets the cosine of neighbours and the share of leaves by trial queries against the whole sample."""
        if len(sample) <= wanted + 1:
            return
        own = np.unique(np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(np.int64))
        near = sample[own] @ sample.T
        near[np.arange(len(own)), own] = -9
        best = np.argsort(-near, axis=1)[:, :wanted]
        self.cosine = float(np.clip(np.mean(np.take_along_axis(near, best, 1)), 0.05, 0.999))
        leaves = self.place(sample)
        found = np.zeros(best.shape, np.int64)
        for k, i in enumerate(own):
            cost = self.costs(sample[i : i + 1])[0]
            found[k] = np.searchsorted(np.sort(cost), cost[leaves[best[k]]].min(1))
        self.share = (int(np.quantile(found, target, method="higher")) + 1) / (self.leaves * self.trees)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of equal rows of a and b in double precision; a row's value does not depend on its neighbours."""
    dot = np.add.reduce(np.ascontiguousarray(a * b), axis=1)
    na = np.add.reduce(np.ascontiguousarray(a * a), axis=1)
    nb = np.add.reduce(np.ascontiguousarray(b * b), axis=1)
    return dot / (np.sqrt(na) * np.sqrt(nb))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, components as doubles."""
    v = df[vec_col].cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(df[id_col].cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 50,
    wanted: int = WANTED,
    share: float | None = None,
    trees: int = TREES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found of each row whose id is divisible by every.

    share is the share of all leaves that a query takes; without one it is found on the sample.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    dim = dims[0]["d"]
    rows = rows.filter(F.size("v") == dim)
    # floats travel as floats, which loses nothing
    single = isinstance(df.schema[vec_col].dataType, ArrayType) and isinstance(df.schema[vec_col].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    # one entry for equal vectors, with the smallest ids; the window's limit works before the shuffle already
    first = Window.partitionBy("v").orderBy("id")
    ranked = rows.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= wanted + 1)
    entries = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pack = _packer(kind)
    entries = cut_lineage(entries.select("ids", pack("v").alias("v")))
    total = entries.count()
    most = max(1, min(SAMPLE, SAMPLE_VALUES // dim))
    drawn = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(most).collect()  # bounded by SAMPLE and SAMPLE_VALUES
    sample = _unit(np.frombuffer(b"".join(bytes(r["v"]) for r in drawn), kind).reshape(-1, dim).astype(np.float64))
    forest = Forest(sample, trees)
    if share is None:
        forest.tune(sample, wanted)
    else:
        forest.share = share
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample and the trees
    every_leaf = forest.leaves * trees
    bins = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * trees // BIN_ROWS)), every_leaf)
    salts = max(1, -(-total * trees // (BIN_ROWS * every_leaf)))

    schema = pa.schema([("bin", pa.int64()), ("kind", pa.int32()), ("leaves", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("v", pa.binary())])
    ddl = "bin long, kind int, leaves array<int>, ids array<long>, v binary"
    bin_of = lambda leaf: leaf.astype(np.int64) * bins // every_leaf

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            leaves = shared.value.place(_unit(_vectors(batch.column(1), dim, kind)))
            salt = np.array([zlib.crc32(v) % salts for v in batch.column(1).to_pylist()]) if salts > 1 else 0
            ids, zero = batch.column(0).cast(pa.list_(pa.int64())), pa.array(np.zeros(n, np.int32))
            ends = pa.array(np.arange(n + 1), pa.int32())
            for tree in range(leaves.shape[1]):
                own = leaves[:, tree]
                yield pa.record_batch([pa.array(bin_of(own) * salts + salt), zero, pa.ListArray.from_arrays(ends, pa.array(own)), ids, batch.column(1)], schema=schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).to_pylist()
            for q, leaves in enumerate(shared.value.visit(_unit(_vectors(batch.column(1), dim, kind)))):
                leaves = np.sort(leaves)
                of, at = np.unique(bin_of(leaves), return_index=True)
                parts = [p.tolist() for p in np.split(leaves, at[1:])]
                ids = batch.column(0)[q].as_py()
                for salt in range(salts):
                    n = len(of)
                    yield pa.record_batch(
                        [pa.array(of * salts + salt), pa.array(np.ones(n, np.int32)), pa.array(parts, pa.list_(pa.int32())), pa.array([ids] * n, pa.list_(pa.int64())), pa.array([values[q]] * n, pa.binary())],
                        schema=schema,
                    )

    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            bins_of, sort_of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            mark = bins_of * 2 + sort_of
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if bins_of[s] != now:
                    now, held, ready = bins_of[s], [], None
                part = batch.slice(s, e - s)
                if sort_of[s] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                ready = ready or _Bin(held, dim, kind, trees)
                asked = _vectors(part.column(4), dim, kind)
                leaves, ids = part.column(2).to_pylist(), part.column(3).to_pylist()
                found = [f for q in range(part.num_rows) for f in ready.search(ids[q], asked[q], np.array(leaves[q]), wanted)]
                if found:
                    a, b, c = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], schema=found_schema)

    # an entry asks once for all its ids that are queries, a repeated vector's further queries ask as rows of their own
    more = rows.filter(F.col("id") % every == 0).select(F.array("id").alias("ids"), pack("v").alias("v"))
    dealt = entries.mapInArrow(index, ddl).union(more.distinct().mapInArrow(ask, ddl))
    tasks = min(bins * salts, 100_000)
    met = dealt.repartition(tasks, "bin").sortWithinPartitions("bin", "kind").mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")


class _Bin:
    """The rows of one bin, by leaf, and the exact search among the leaves a query takes."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, kind: str, trees: int):
        self.trees = trees
        leaf = np.concatenate([p.column(2).flatten().to_numpy() for p in parts])
        order = np.argsort(leaf, kind="stable")
        self.leaf = leaf[order]
        self.v = np.concatenate([_vectors(p.column(4), dim, kind) for p in parts])[order]
        self.unit = _unit(self.v)
        ids = [i for p in parts for i in p.column(3).to_pylist()]
        self.ids = [ids[k] for k in order]

    def search(self, query_ids: list[int], q: np.ndarray, leaves: np.ndarray, wanted: int):
        first, last = np.searchsorted(self.leaf, leaves), np.searchsorted(self.leaf, leaves, "right")
        sizes = last - first
        if not sizes.sum():
            return
        at = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        rough = self.unit[at] @ _unit(q[None])[0]
        keep = min(len(at), (wanted + 2) * self.trees)  # the query's own entry may be among them, and an entry may stand here once for each tree
        cut = np.partition(rough, len(at) - keep)[len(at) - keep]
        at = np.unique(at[rough >= cut - 1e-9])
        score = exact_cosine(self.v[at], np.repeat(q[None], len(at), 0))
        for query in query_ids:
            best = [(query, i, s) for k, s in zip(at.tolist(), score.tolist(), strict=True) for i in self.ids[k] if i != query]
            best.sort(key=lambda x: (-x[2], x[1]))
            seen: dict[int, tuple] = {}
            for x in best:
                seen.setdefault(x[1], x)
                if len(seen) == wanted:
                    break
            yield from seen.values()


def _packer(kind: str):
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, kind).tobytes())

    return pack
