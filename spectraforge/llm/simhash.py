"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Fingerprints are made in Arrow batches. Different fingerprints are compared exactly with numpy
exclusive-or and bit counts inside tiles. A link has at most ``radius`` differing bits, so when
the 64 bits are cut into ``radius + extra`` blocks, linked fingerprints agree in at least
``extra`` whole blocks: tiles only form among fingerprints that share such blocks, without losing
a pair. Inside a tile, rows are sorted by population count and partners beyond the radius skipped.
A bucket larger than a tile is cut by population count, and tile pairs whose population counts
differ by more than the radius are skipped; one of very many tiles is cut by further bits first. Each tile pair hands on a spanning forest of
its links, never all pairs, and the forests are joined by distributed large-star/small-star steps.

Defined results
    Null or wordless text: fingerprint zero, linked like any other. Null ``doc_id``: gets a
    component like any other row; the smallest non-null identifier names the component (null if
    there is none). Repeated rows: one row each. Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Rows of a tile; a bucket of at most this many is one tile.
TILE = 2048
#: Tiles of a bucket from which on it is first cut by further blocks of bits.
HUGE = 64
_WORDS_AT_ONCE = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash: bit set where it is set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    hashed = xxhash.xxh64_intdigest
    for lo in range(0, n, _WORDS_AT_ONCE):
        part = words[lo : min(lo + _WORDS_AT_ONCE, n) + size - 1]
        if len(part) < size:
            hashes = [hashed(b" ".join(part), SEED)]
        elif size == 3:
            hashes = [hashed(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:])]
        else:
            hashes = [hashed(b" ".join(t), SEED) for t in zip(*(part[i:] for i in range(size)))]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, place: Column | None = None) -> DataFrame:
    """doc_id and fp; with ``place``, a column of the rows, that too."""
    text = F.col("text").cast("string").alias("text")
    if place is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_fingerprints, "doc_id long, fp long")
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place")).alias("doc_id"), text)
    return rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long").select("doc_id.doc_id", "doc_id.place", "fp")


def block_plan(n: int, radius: int = RADIUS, tile: int = TILE) -> list[list[tuple[int, int]]]:
    """Sets of bit blocks (offset, width); linked fingerprints agree on all blocks of one set.

    The fewest sets whose buckets would hold no more than a tile if ``n`` fingerprints were spread
    evenly; uneven buckets are tiled further on.
    """
    for extra in range(1, 5):
        m = radius + extra
        cuts = [64 * i // m for i in range(m + 1)]
        blocks = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]
        sets = [list(s) for s in combinations(blocks, extra)]
        if n <= tile // 4 << min(sum(w for _, w in s) for s in sets):
            break
    return sets


def _key(s: list[tuple[int, int]], index: int) -> F.Column:
    parts = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in s]
    return F.xxhash64(F.lit(index), *parts)


class Forest:
    """Union-find over the rows of one tile pair; yields star edges to each tree's smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:  # all links at once: each root hangs below the smallest root it is linked to
            pa_, pb = self.roots(a), self.roots(b)
            open_ = pa_ != pb
            if not open_.any():
                return
            a, b, hi, lo = a[open_], b[open_], np.maximum(pa_, pb)[open_], np.minimum(pa_, pb)[open_]
            np.minimum.at(self.parent, hi, lo)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while True:
            nxt = self.parent[r]
            if (nxt == r).all():
                self.parent[i] = r
                return r
            r = nxt


def tile_links(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int = RADIUS, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (row, smaller root row) of the links between rows ``left`` and rows ``right`` of ``fps``."""
    order_l, order_r = left[np.argsort(np.bitwise_count(fps[left]), kind="stable")], right[np.argsort(np.bitwise_count(fps[right]), kind="stable")]
    pops_l, pops_r = np.bitwise_count(fps[order_l]).astype(int), np.bitwise_count(fps[order_r]).astype(int)
    forest = Forest(len(fps))
    step = max(1, at_once // max(1, len(order_r)))
    for lo in range(0, len(order_l), step):
        rows = order_l[lo : lo + step]
        # rows are sorted by population count: skip all whose count is beyond the radius
        a = np.searchsorted(pops_r, pops_l[lo] - radius)
        z = np.searchsorted(pops_r, pops_l[min(lo + step, len(order_l)) - 1] + radius, side="right")
        if a == z:
            continue
        near = np.bitwise_count(fps[rows][:, None] ^ fps[order_r[a:z]][None, :]) <= radius
        i, j = np.nonzero(near)
        forest.link(rows[i], order_r[a:z][j])
    used = np.unique(np.concatenate([left, right]))
    roots = forest.roots(used)
    moved = roots != used
    return used[moved], roots[moved]


def _small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside buckets of at most a tile; rows come sorted by bucket."""
    held = None

    def links(bucket: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        """All pairs of equal bucket, one diagonal of all tiles at a time.

        Rows of a bucket are sorted by population count, so a row leaves at the first partner beyond the radius.
        """
        out_a, out_b = [], []
        pops = np.bitwise_count(fps).astype(np.int64)
        order = np.lexsort((pops, bucket))
        bucket, fps, pops = bucket[order], fps[order], pops[order]
        same, d = np.arange(len(fps)), 1
        while len(same):
            same = same[same + d < len(fps)]
            same = same[(bucket[same] == bucket[same + d]) & (pops[same + d] - pops[same] <= RADIUS)]
            hit = same[np.bitwise_count(fps[same] ^ fps[same + d]) <= RADIUS]
            out_a.append(hit)
            out_b.append(hit + d)
            d += 1
        a, b = np.concatenate(out_a or [[]]).astype(int), np.concatenate(out_b or [[]]).astype(int)
        forest = Forest(len(fps))
        forest.link(a, b)
        rows = np.unique(np.concatenate([a, b]))
        roots = forest.roots(rows)
        keep = rows != roots
        return pa.RecordBatch.from_arrays([pa.array(fps[rows[keep]].view(np.int64)), pa.array(fps[roots[keep]].view(np.int64))], names=["a", "b"])

    for batch in batches:
        bucket, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if held is not None:
            bucket, fps = np.concatenate([held[0], bucket]), np.concatenate([held[1], fps])
        if not len(bucket):
            continue
        other = np.flatnonzero(bucket != bucket[-1])
        cut = other[-1] + 1 if len(other) else 0  # the last bucket may go on in the next batch
        yield links(bucket[:cut], fps[:cut])
        held = bucket[cut:], fps[cut:]
    if held is not None:
        yield links(*held)


def _tile_pair(key: tuple, table: pa.Table) -> pa.Table:
    fps = table.column("fp").to_numpy().view(np.uint64)
    side = table.column("side").to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    a, b = tile_links(fps, left, right)
    return pa.table({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})


def _sized(keyed: DataFrame) -> DataFrame:
    """Rows (fp, bucket) of buckets that hold more than one, with their population count and the rows of the bucket."""
    keyed = keyed.withColumn("pop", F.bit_count("fp").cast("int"))
    counts = keyed.groupBy("bucket", "pop").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("total")).where("total > 1")
    return materialise(keyed.join(totals, "bucket"))


def _finer(huge: DataFrame) -> DataFrame:
    """Rows of huge buckets dealt to smaller ones: partners of a bucket also agree in ``8 - radius`` whole bytes."""
    sets = combinations([(8 * i, 8) for i in range(8)], 8 - RADIUS)
    return huge.select("fp", F.explode(F.array(*[F.xxhash64("bucket", _key(list(s), i)) for i, s in enumerate(sets)])).alias("bucket"))


def links(distinct: DataFrame, tile: int = TILE, huge: int = HUGE) -> DataFrame:
    """Edges (a, b) whose connected components are those of all links among the distinct ``fp``."""
    sets = block_plan(distinct.count(), tile=tile)
    sized = _sized(distinct.select("fp", F.explode(F.array(*[_key(s, i) for i, s in enumerate(sets)])).alias("bucket")))
    over = F.col("total") > huge * tile
    if not sized.where(over).isEmpty():
        sized = sized.where(~over).unionByName(_sized(_finer(sized.where(over))))
    small = (
        sized.where(F.col("total") <= tile)
        .select("bucket", "fp")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_small_buckets, "a long, b long")
    )
    large = sized.where(F.col("total") > tile)
    # tiles of a large bucket: a population count, and below it as many parts as its rows need
    tiles = (
        large.groupBy("bucket", "pop")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bucket", "pop", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    )
    tiles = materialise(tiles)
    placed = large.join(tiles, ["bucket", "pop"]).withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int"))
    every = tiles.select("bucket", F.col("pop").alias("pop2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"))
    # the tiles that a row meets: those of its bucket within the radius, skipping all others
    met = placed.withColumn("pop2", F.explode(F.sequence(F.col("pop") - RADIUS, F.col("pop") + RADIUS))).join(every, ["bucket", "pop2"])
    mine, other = F.struct("pop", "part"), F.struct(F.col("pop2").alias("pop"), F.col("part2").alias("part"))
    met = met.select(
        "bucket",
        F.least(mine, other).alias("first"),
        F.greatest(mine, other).alias("second"),
        "fp",
        F.when(mine < other, 0).when(mine > other, 1).otherwise(2).alias("side"),
    )
    pairs = met.groupBy("bucket", "first", "second").applyInArrow(_tile_pair, "a long, b long")
    return small.unionByName(pairs)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge.

    Alternating large-star and small-star steps; every step only takes minima by key and joins
    them back, and each round is cut by a written table.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        after = materialise(small)
        # done when each node has one edge, and no root hangs below another
        unfinished = after.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hi").unionByName(
            after.select(F.col("lo").alias("hi")).distinct().join(after.select("hi").distinct(), "hi", "left_semi")
        )
        edges = after
        if unfinished.isEmpty():
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    prints = materialise(fingerprints(docs))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = materialise(components(links(distinct.select("fp"))))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(classes.join(named, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_a_component(docs: DataFrame, place: Column) -> DataFrame:
    """``place`` of one row of each component: the smallest doc_id (null last), of several with it the smallest place."""
    prints = materialise(fingerprints(docs, place))
    roots = components(links(materialise(prints.select("fp").distinct()))).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), F.struct(F.col("doc_id").isNull(), "doc_id", "place").alias("row"))
    return rooted.groupBy("root").agg(F.min("row").alias("row")).select("row.place")
