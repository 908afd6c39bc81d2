"""Removal of long word passages that repeat across documents, by a sparse de Bruijn graph.

Token k-mers are the graph's edges; of the k-mers of every ``window`` consecutive words only the
one with the least hash is kept (its minimiser), so equal windows keep the same k-mer. An
occurrence of an edge carries a digest of its context: all words of the windows that chose it.

1. Edges that occur once lead nowhere and are left out by a join on the edge.
2. Occurrences of an edge in one context are the same step of a path. A join on (edge, context)
   leads each to its source, the occurrence in the smallest document.
3. Where an edge branches into several contexts, the windows of the sources themselves are looked
   up one by one, and a join on (edge, window) leads them to a still smaller document.
4. Steps of one document that lead to neighbouring places of one source are compacted into one
   path, whatever its length.
5. The words at the source's coordinates are fetched, in blocks of ``BLOCK`` words, each block of
   a source once, and joined to the paths that lead to it. A window is only removed if all of its
   words equal those of its source: hashes choose what is compared, never what is removed.

No pairs are made: every step has one source. Texts are written once, bucketed by document, so
the three joins with them move none again.

Defined results
    Null text: no words. Null ``doc_id``: neither a source nor changed. Rows that share a
    ``doc_id``: no row is a smaller document to another of them; each is changed by its own text.
    Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, materialise

WINDOW = 50
K = 10
#: Words of a source that are fetched together.
BLOCK = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _BASE
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes, at: np.ndarray) -> np.ndarray:
    """A hash of every word of a text joined by single spaces; ``at``: where each begins. Equal words have equal hashes."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(text, dtype=np.uint8)
    data = np.where(data == 32, 0, data)  # the last word has no space behind it
    lengths = np.diff(at, append=len(text) + 1)
    within = np.arange(len(data)) - np.repeat(at, lengths)[: len(data)]
    if len(_POWERS[0]) <= (most := int(lengths.max())):
        _POWERS[0] = np.cumprod(np.full(2 * most, _BASE), dtype=np.uint64)
    return _mixed(np.add.reduceat(data * _POWERS[0][within], at))


_POWERS = [np.cumprod(np.full(64, _BASE), dtype=np.uint64)]


def kmer_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words, equal for equal words; made of runs of 1, 2, 4, ... words."""
    n = max(len(hashes) - k + 1, 0)
    found, done, run, power, width = np.zeros(n, dtype=np.uint64), 0, hashes, _BASE, 1
    while n and width <= k:
        if k & width:
            found = found * power + run[done : done + n]
            done += width
        if 2 * width <= k:
            run = run[:-width] * power + run[width:]
        with np.errstate(over="ignore"):
            power = power * power
        width *= 2
    return _mixed(found)


def edges(hashes: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the k-mer, first window, number of windows) for the runs of windows with one minimiser."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kmers = kmer_hashes(hashes, k)
    chosen = np.lib.stride_tricks.sliding_window_view(kmers, window - k + 1).argmin(axis=1) + np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
    return kmers[chosen[first]], first, np.diff(first, append=n)


def digest(words: bytes) -> int:
    """64 bits of BLAKE2b, signed."""
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


class Joined:
    """Words of a text joined by single spaces, and where each begins."""

    def __init__(self, text: bytes):
        self.text = text
        spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
        self.starts = np.concatenate([[0], spaces + 1])
        self.at = [*self.starts.tolist(), len(text) + 1]

    def span(self, first: int, n: int) -> bytes:
        return self.text[self.at[first] : self.at[first + n] - 1]


def words_of(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or "").encode("utf-8", "surrogatepass").split()


_EDGES = "doc_id long, body long, edge long, context long, first int, run int"


def _occurrences(window: int, k: int, key: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: dict[str, list] = defaultdict(list)
            for row, text in enumerate(b.column(2)):
                joined = Joined(b" ".join(words_of(text)))
                edge, first, n = edges(word_hashes(joined.text, joined.starts), window, k)
                if not len(edge):
                    continue
                parts["row"].append(np.full(len(edge), row))
                parts["edge"].append(edge)
                parts["context"] += [key(joined.span(a, m + window - 1)) for a, m in zip(first.tolist(), n.tolist())]
                parts["first"].append(first)
                parts["run"].append(n)
            if not parts:
                continue
            rows = pa.array(np.concatenate(parts["row"]))
            numbers = [pa.array(np.concatenate(parts["edge"]).view(np.int64)), pa.array(parts["context"], pa.int64()), *(pa.array(np.concatenate(parts[c]).astype(np.int32)) for c in ("first", "run"))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *numbers], names=["doc_id", "body", "edge", "context", "first", "run"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text, joined by spaces, as a zstd frame."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        texts = [pack(b" ".join(words_of(t))) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["doc_id", "body", "packed"])


def _unpacked(frames: pa.Array) -> Iterator[bytes]:
    """Words of each text, joined by spaces; one text at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(f.as_py()) for f in frames)


def _windows(window: int, key: Callable[[bytes], int]):
    """The windows of the sources of branching edges: each once a text, with the places of its copies in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, body, text, asked in zip(b.column(0), b.column(1), _unpacked(b.column(2)), b.column(3)):
                joined = Joined(text)
                places: dict[tuple[int, int], list[int]] = defaultdict(list)
                for edge, first, n in zip(*(asked.values.field(c).to_pylist() for c in ("edge", "first", "run"))):
                    for at in range(first, first + n):
                        places[edge, key(joined.span(at, window))].append(at)
                numbers = [pa.array([doc.as_py()] * len(places), pa.int64()), pa.array([body.as_py()] * len(places), pa.int64()), *(pa.array([x[i] for x in places], pa.int64()) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(map(sorted, places.values()), pa.list_(pa.int32()))], names=["doc_id", "body", "edge", "context", "places"])

    return run


def _blocks(block: int):
    """The asked blocks of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, body, text, asked in zip(b.column(0), b.column(1), _unpacked(b.column(2)), b.column(3)):
                words, numbers = text.split(), asked.as_py()
                texts = [b" ".join(words[n * block : (n + 1) * block]) for n in numbers]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(numbers), pa.int64()), pa.array([body.as_py()] * len(numbers), pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.binary())],
                    names=["source", "source_body", "block", "words"],
                )

    return run


_PIECE = ("source", "source_body", "shift", "block", "lo", "hi", "words")


def verified(words: list[bytes], pieces: pa.StructArray, window: int, block: int) -> np.ndarray:
    """Which words are covered by windows that equal their source, word for word.

    A piece holds the number and the words of a source's block, the part [lo, hi) of the source that
    a path takes of it, the path's shift from the source to this text, and the source.
    """
    paths: dict[tuple, list[tuple]] = defaultdict(list)
    for source, body, shift, number, lo, hi, theirs in zip(*(pieces.field(c).to_pylist() for c in _PIECE)):
        theirs = theirs.split()[lo - number * block : hi - number * block]
        own = words[lo + shift : hi + shift]
        paths[source, body, shift].append((lo + shift, hi + shift, 1 if own == theirs else np.array([x == y for x, y in zip(own, theirs)], dtype=np.int8)))
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for path in paths.values():
        low = min(p[0] for p in path)
        equal = np.zeros(max(p[1] for p in path) - low, dtype=np.int8)
        for a, z, same in path:
            equal[a - low : z - low] |= same
        edge = np.flatnonzero(np.diff(equal, prepend=0, append=0))
        for a, z in zip((edge[::2] + low).tolist(), (edge[1::2] + low).tolist()):
            if z - a >= window:
                gone[a] += 1
                gone[z] -= 1
    return np.cumsum(gone)[:-1] > 0


def _removed(window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = defaultdict(list)
            for kept, pieces in zip(_unpacked(b.column(1)), b.column(2)):
                n, found, lost = kept.count(b" ") + 1 if kept else 0, [], 0
                if pieces.is_valid:
                    words = kept.split()
                    gone = verified(words, pieces.values, window, block)
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                    found = [{"first": a, "after": z} for a, z in zip(edge[::2], edge[1::2])]
                    lost = int(gone.sum())
                    kept = b" ".join([w for a, z in zip([0, *edge[1::2]], [*edge[::2], n]) for w in words[a:z]])
                out["n_words"].append(n)
                out["n_removed"].append(lost)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["removed"].append(found)
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "removed": pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[n], t) for n, t in kinds.items())], names=["doc_id", *kinds])

    return run


def paths(steps: DataFrame) -> DataFrame:
    """Steps that lead to overlapping or touching parts of one source with one shift, as one path each."""
    line = ["doc_id", "body", "source", "source_body", "shift"]
    before = Window.partitionBy(*line).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*line).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    marked = steps.withColumn("starts", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("int"))
    return marked.withColumn("path", F.sum("starts").over(upto)).groupBy(*line, "path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("path")


def _asked(texts: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """Texts with what is asked of them; repeated rows of one text are asked once."""
    joined = texts.join(asked, ["doc_id", "body"])
    return joined.groupBy("doc_id", "body").agg(F.first("packed").alias("packed"), F.first(column).alias(column))


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, block: int = BLOCK, key: Callable[[bytes], int] = digest) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (word spans [first, after) of the original).

    ``key`` digests contexts and windows; whatever it is, nothing is removed that is not repeated.
    """
    if not k < window:
        raise ValueError("a window must be longer than a k-mer")
    # body tells rows apart that share a doc_id but not their text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("body", F.xxhash64("text")).select("doc_id", "body", "text")
    texts = bucketed(rows.mapInArrow(_packed, "doc_id long, body long, packed binary"), ["doc_id", "body"])
    found = materialise(rows.where("doc_id is not null").mapInArrow(_occurrences(window, k, key), _EDGES))
    # written first, so that Spark can split a very common edge in the joins
    repeated = materialise(found.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("edge"))
    crossings = materialise(found.join(repeated, "edge", "left_semi"))

    sources = crossings.groupBy("edge", "context").agg(F.min(F.struct("doc_id", "body", "first")).alias("source"))
    sources = materialise(sources.select("edge", "context", F.col("source.doc_id").alias("source"), F.col("source.body").alias("source_body"), F.col("source.first").alias("source_first")))
    led = materialise(crossings.join(sources, ["edge", "context"]).drop("context"))
    branching = materialise(sources.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("edge"))
    asked = led.where("doc_id = source").join(branching, "edge", "left_semi").groupBy("doc_id", "body").agg(F.collect_set(F.struct("edge", "first", "run")).alias("asked"))
    windows = materialise(_asked(texts, asked, "asked").mapInArrow(_windows(window, key), "doc_id long, body long, edge long, context long, places array<int>"))
    shared = windows.groupBy("edge", "context").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("most")).where("source < most").drop("most")
    shared = materialise(windows.join(shared, ["edge", "context"]))
    places = shared.where("doc_id = source").groupBy("edge", "context").agg(F.min(F.struct("body", F.element_at("places", 1).alias("first"))).alias("place"))
    places = places.select("edge", "context", F.col("place.body").alias("source_body"), F.col("place.first").alias("source_first"))
    single = shared.where("doc_id > source").join(places, ["edge", "context"]).withColumns({"first": F.explode("places"), "run": F.lit(1)})

    line = ["doc_id", "body", "source", "source_body", (F.col("first") - F.col("source_first")).alias("shift"), F.col("source_first").alias("lo"), (F.col("source_first") + F.col("run") + window - 1).alias("hi")]
    found_paths = paths(led.where("doc_id > source").select(*line).unionByName(single.select(*line)))
    numbers = F.sequence(F.floor(F.col("lo") / block).cast("int"), F.floor((F.col("hi") - 1) / block).cast("int"))
    need = materialise(
        found_paths.withColumn("block", F.explode(numbers))
        .withColumn("lo", F.greatest("lo", F.col("block") * block))
        .withColumn("hi", F.least("hi", (F.col("block") + 1) * block))
    )
    wanted = need.groupBy(F.col("source").alias("doc_id"), F.col("source_body").alias("body")).agg(F.collect_set("block").alias("blocks"))
    words = materialise(_asked(texts, wanted, "blocks").mapInArrow(_blocks(block), "source long, source_body long, block int, words binary"))
    pieces = need.join(words, ["source", "source_body", "block"]).groupBy("doc_id", "body").agg(F.collect_list(F.struct(*_PIECE)).alias("pieces"))
    return texts.join(pieces, ["doc_id", "body"], "left").select("doc_id", "packed", "pieces").mapInArrow(
        _removed(window, block), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,after:int>>"
    )
