"""SimHash near-duplicate detection (operator 8).

Fingerprints are compared exactly, tile against tile, with numpy's exclusive-or and bit counts; pairs of tiles
whose population counts differ beyond the radius are skipped, because two fingerprints at r differing bits have
population counts at most r apart. Within a pair of tiles the same bound on the four 16-bit quarters skips
sub-tiles. Equal fingerprints are one row before any comparison, and a task hands back a spanning forest of the
links it found, never all pairs of a group, so no link between components is lost and no group is expanded.

A fingerprint is told by the order (without id, smallest doc_id, fingerprint), so the least of its component holds
the component's id and no group is gathered to find it. Fingerprints of very many documents are joined to them by
broadcast, all others by a shuffle.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other;
repeated rows keep one row each; a null doc_id is passed on, and its component is the smallest non-null doc_id
of its group, or null; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessella.llm.common import cut_lineage, text_of
from tessella.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: A corpus is cut into about TILES tiles, and into more where they would hold more than MOST_TILE fingerprints: pairs of
#: tiles, which are the tasks, then grow with the square of the corpus, as the comparisons do, and the pairs that one
#: fingerprint is handed to grow with the corpus.
MOST_TILE, TILES = 1 << 20, 24
#: A fingerprint that more than one in HOT documents has is joined by broadcast; there are fewer than HOT of them.
HOT = 1000
#: Fingerprints of a sub-tile.
SUB = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    stops = ends[width - 1 :].tolist()
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)].astype("<u8"))
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h), bitorder="little").tobytes(), "little")


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """The fingerprint of each text as a signed long."""
    return pd.Series([v - (1 << 64) if (v := fingerprint(t)) >> 63 else v for t in texts], dtype="int64")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long, one row per row of df; no shuffle."""
    return df.select(df[id_col].cast("long").alias("doc_id"), fingerprint_of(text_of(df, text_col)).alias("fp"))


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _sub_tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """An order of the fingerprints by the counts of their quarters, and each sub-tile's least and largest counts."""
    counts = _quarters(fps)
    order = np.lexsort(counts.T[::-1])
    counts = counts[order]
    cuts = [(a, min(a + SUB, len(fps))) for a in range(0, len(fps), SUB)]
    low = np.array([counts[a:b].min(0) for a, b in cuts], np.int16)
    high = np.array([counts[a:b].max(0) for a, b in cuts], np.int16)
    return order, low, high, cuts


class _Forest:
    """A spanning forest of the links seen so far between numbered nodes."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among left and right (or left and itself): pairs of positions in their union."""
    fps = left if right is None else np.concatenate([left, right])
    forest = _Forest(len(fps))
    lo, llow, lhigh, lcuts = _sub_tiles(left)
    ro, rlow, rhigh, rcuts = (lo, llow, lhigh, lcuts) if right is None else _sub_tiles(right)
    shift = 0 if right is None else len(left)
    ls, rs = left[lo], left[lo] if right is None else right[ro]
    for i, (a, b) in enumerate(lcuts):
        gap = np.maximum(0, np.maximum(rlow - lhigh[i], llow[i] - rhigh)).sum(1)
        near = np.flatnonzero(gap <= radius)
        for j in near[near >= i] if right is None else near:
            c, d = rcuts[j]
            hit = np.bitwise_count(ls[a:b, None] ^ rs[None, c:d]) <= radius
            if hit.any():
                x, y = np.nonzero(hit)
                forest.add(lo[a + x], ro[c + y] + shift)
    child = np.flatnonzero(forest.label != np.arange(len(fps)))
    return child, forest.label[child]


def links(unique: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b) between the nodes of unique (node: any type, fp long, all fp different).

    Tiles hold fingerprints of one population count, in as many parts as their number asks for; a tile meets
    every tile at most radius counts away, so every pair within the radius is compared in exactly one task.
    """
    spark = unique.sparkSession
    counted = unique.select("fp", F.bit_count("fp").cast("int").alias("pop"))
    sizes = {r["pop"]: r["n"] for r in counted.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    total = sum(sizes.values())
    tile = min(MOST_TILE, max(1, -(-total // TILES)))
    # neighbouring counts with few fingerprints share a tile; a count with many is cut into parts by its hash
    groups: list[tuple[list[int], int]] = []
    for pop in sorted(sizes):
        if groups and sum(sizes[p] for p in groups[-1][0]) + sizes[pop] <= tile:
            groups[-1][0].append(pop)
        else:
            groups.append(([pop], 1))
    tiles: list[tuple[int, int]] = []  # the least and largest count of each tile
    first: dict[int, int] = {}
    parts: dict[int, int] = {}
    for pops, _ in groups:
        n = max(1, -(-sum(sizes[p] for p in pops) // tile))
        for p in pops:
            first[p], parts[p] = len(tiles), n
        tiles += [(pops[0], pops[-1])] * n
    pairs = [(i, j) for i in range(len(tiles)) for j in range(i, len(tiles)) if tiles[j][0] - tiles[i][1] <= radius]
    of_tile: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(pairs):
        for t in {i, j}:
            of_tile.setdefault(t, []).append(k)
    # the plan of tiles grows with the square of their number: some 300 rows up to MOST_TILE * TILES fingerprints, then with N / MOST_TILE squared
    plan = spark.createDataFrame(
        [(t, k, 0 if pairs[k][0] == t else 1, pairs[k][0] == pairs[k][1]) for t, ks in of_tile.items() for k in ks] or [(-1, -1, 0, True)],
        "tile int, pair int, side int, own boolean",
    )
    head = spark.createDataFrame([(p, first[p], parts[p]) for p in first] or [(-1, -1, 1)], "pop int, first int, parts int")
    dealt = (
        counted.join(F.broadcast(head), "pop")
        .select("fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int").alias("tile"))
        .join(F.broadcast(plan), "tile")
        .select("pair", "side", "own", "fp")
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(pairs), 100_000))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(own: bool, sides: list[list[np.ndarray]]) -> pa.RecordBatch:
            fps = [np.concatenate(s).view(np.uint64) if s else np.zeros(0, np.uint64) for s in sides]
            both = fps[0] if own else np.concatenate(fps)
            a = b = np.zeros(0, np.int64)
            if len(fps[0]) and (own or len(fps[1])):
                a, b = tile_links(fps[0], None if own else fps[1], radius)
            return pa.record_batch([pa.array(both[a].view(np.int64)), pa.array(both[b].view(np.int64))], schema=schema)

        now, own, sides = None, False, [[], []]
        for batch in batches:
            pair, side, fp = (batch.column(k).to_numpy() for k in (0, 1, 3))
            mine = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if pair[s] != now:
                    if now is not None:
                        yield found(own, sides)
                    now, own, sides = pair[s], bool(mine[s]), [[], []]
                for k in (0, 1):
                    at = np.flatnonzero(side[s:e] == k) + s
                    if len(at):
                        sides[k].append(fp[at])
        if now is not None:
            yield found(own, sides)

    found = dealt.repartition(tasks, "pair").sortWithinPartitions("pair").mapInArrow(run, "a long, b long")
    # the few links get their nodes; fingerprints stand for nodes until then
    for end in ("a", "b"):
        found = found.join(unique.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")), end)
    return found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id, n) for each fingerprint of prints (doc_id, fp): the least node that it reaches, which is one for
    a component, its doc_id, and the fingerprint's own rows."""
    node = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), "fp")
    # equal fingerprints become one node before anything else; the count is combined before the shuffle
    unique = prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    unique = cut_lineage(unique.select("fp", "n", node.alias("node")))
    least = connected_components(cut_lineage(links(unique, radius)))  # node, root; only nodes that have a link
    least = least.select(F.col("node.fp").alias("fp"), "root")
    rooted = unique.join(least, "fp", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.select("fp", "root", F.when(~F.col("root.none"), F.col("root.id")).alias("component_id"), "n")


def beside(rows: DataFrame, by_fp: DataFrame) -> DataFrame:
    """rows with the columns of by_fp (fp, n and others; a row a fingerprint). No task gets a fingerprint's many rows."""
    total = by_fp.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(by_fp.filter(F.col("n") * HOT > F.lit(total)))  # fewer than HOT rows
    few = rows.join(hot.select("fp"), "fp", "left_anti").join(by_fp.filter(F.col("n") * HOT <= F.lit(total)), "fp")
    return rows.join(hot, "fp").unionByName(few)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    own = cut_lineage(fingerprints(df, id_col, text_col))
    by_fp = cut_lineage(components(own, radius))
    return beside(own, by_fp).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
