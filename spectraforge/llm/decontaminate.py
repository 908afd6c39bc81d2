"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark words.

Every window of ``window`` consecutive words of a benchmark item (an item of fewer words is one window) is a key. Words
are numbered, and a number is written in a few symbols, each place with symbols of its own: so no node of the automaton
has more than ``BASE`` children however many words the benchmark has, and no key is found between two words. A text is
scanned once, in the runs of words that occur in the benchmark and are long enough; word numbers map back to character
offsets of the original text. Spark makes the distinct (window, item) pairs; the driver hands them on as one Arrow table.

One automaton holds about ``block_words`` words and item ids (some 125 bytes a word in each Python worker). A larger benchmark is
dealt by hash to several, which are used one after another: the texts are written once with row numbers, each automaton
leaves the hits of the rows that have any, and these are joined to the rows at the end.

Defined results
    Null text: no words. Null item text: no windows. Null ``item_id``: its windows hit words but
    it is not listed or counted. Repeated items or windows: counted once. Null ``doc_id``: kept
    as a row. Empty tables: no rows, or rows without hits. Extra columns: not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 10
#: Words of the keys and item ids of one automaton, and so of one broadcast.
BLOCK_WORDS = 1_500_000
#: Symbols for one place of a word's number.
BASE = 64
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: For UTF-8 bytes: A-Z to a-z, and all that stands between words to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(text: str | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


class WindowAutomaton:
    """Keys are windows, as words joined by spaces; each has the items that hold it."""

    def __init__(self, pairs: pa.Table):
        """From rows (item, key), in any order."""
        pairs = pairs.sort_by("key")
        keys, self.items = pairs["key"].to_pylist(), pairs["item"].to_pylist()
        begins = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        self.bounds = [*begins, len(keys)]
        self.vocabulary: dict[bytes, int] = {}
        windows = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in keys[i].split(b" ")] for i in begins]
        self.lengths = [len(w) for w in windows]
        self.shortest = min(self.lengths, default=0)
        self.places = 1
        while BASE**self.places <= len(self.vocabulary):
            self.places += 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, window in enumerate(windows):
            self.automaton.add_word(self._symbols(np.array(window)), number)
        if windows:
            self.automaton.make_automaton()

    def _symbols(self, numbers: np.ndarray) -> str:
        """``places`` symbols a number; those of the places do not overlap."""
        digits = [numbers // BASE**k % BASE + BASE * k + 1 for k in range(self.places)]
        return np.stack(digits, axis=1).astype("<u4").tobytes().decode("utf-32-le")

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, word after the last, items) of every occurrence."""
        if len(words) < self.shortest or not self.lengths:
            return
        known = self.vocabulary.get
        numbers = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], numbers > 0, [False]]).astype(np.int8)))
        for first, after in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if after - first >= self.shortest:
                for end, number in self.automaton.iter(self._symbols(numbers[first:after])):
                    last = first + (end + 1) // self.places
                    yield last - self.lengths[number], last, self.items[self.bounds[number] : self.bounds[number + 1]]


def _pairs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows (their words joined by spaces) of each item."""
    for b in batches:
        for item, text in zip(b.column(0), b.column(1)):
            keys = [b" ".join(k) for k in item_windows(text.as_py(), window)]
            yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array([k.count(b" ") + 2 for k in keys], pa.int32())], names=["item", "key", "size"])


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> list[DataFrame]:
    """The pairs (item, key) of each automaton: about ``block_words`` words and item ids."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    pairs = materialise(texts.mapInArrow(lambda batches: _pairs(batches, window), "item string, key binary, size int").distinct())
    blocks = max(1, -(-(pairs.agg(F.sum("size")).first()[0] or 0) // block_words))
    return [pairs.where(F.pmod(F.xxhash64("key", "item"), F.lit(blocks)) == number).select("item", "key") for number in range(blocks)]


_LOADED: dict[str, WindowAutomaton] = {}


def _automaton(windows) -> WindowAutomaton:
    """The automaton of a broadcast, made once a worker process."""
    if windows.id not in _LOADED:
        _LOADED.clear()
        _LOADED[windows.id] = WindowAutomaton(pa.ipc.open_stream(windows.broadcast.value).read_all())
    return _LOADED[windows.id]


class _Keyed:
    """The broadcast pairs of a block, with a stable identity inside the workers."""

    def __init__(self, pairs: DataFrame):
        table = pairs.toArrow()  # block_words bounds it
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        self.broadcast, self.id = pairs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
_SPANS_SQL = "spans array<struct<first:int,after:int>>, items array<string>"


def _hits(automaton: WindowAutomaton, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of hit words, overlapping ones as one, and the items that hit, sorted."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for first, after, found in automaton.scan(words):
        items.update(x for x in found if x is not None)
        while spans and first <= spans[-1][1]:
            before = spans.pop()
            first, after = min(first, before[0]), max(after, before[1])
        spans.append((first, after))
    return spans, sorted(items)


def _struct(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"first": a, "after": z} for a, z in spans]


def _scanner(keyed: _Keyed):
    """row, spans and items of the rows that have hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(keyed)
        for b in batches:
            rows, spans, items = [], [], []
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                found, named = _hits(automaton, words_of(text.as_py()))
                if found:
                    rows.append(row)
                    spans.append(_struct(found))
                    items.append(named)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["row", "spans", "items"])

    return scan


def _described(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, list[dict]]:
    """Words of a text, hit words, and the hit places in it."""
    if not spans:
        return len(words_of(text)), 0, []
    at = [m.span() for m in _WORD.finditer(text)]
    covered = np.zeros(len(at) + 1, dtype=np.int64)
    np.add.at(covered, [a for a, _ in spans], 1)
    np.add.at(covered, [z for _, z in spans], -1)
    mask = np.cumsum(covered)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return len(at), int(mask.sum()), [{"start": at[a][0], "stop": at[z - 1][1]} for a, z in zip(edges[::2], edges[1::2])]


_FOUND = "doc_id long, n_words long, n_hit long, items array<string>, hit_spans array<struct<start:int,stop:int>>"


def _batch(doc_ids: pa.Array, rows: list[tuple], items: list[list[str]]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    n_words, n_hit, hit = zip(*rows) if rows else ((), (), ())
    columns = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "hit_spans": pa.array(hit, span)}
    return pa.RecordBatch.from_arrays([doc_ids, *columns.values()], names=["doc_id", *columns])


def _one_pass(keyed: _Keyed):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(keyed)
        for b in batches:
            rows, items = [], []
            for text in b.column(1):
                text = text.as_py()
                spans, named = _hits(automaton, words_of(text))
                rows.append(_described(text, spans))
                items.append(named)
            yield _batch(b.column(0), rows, items)

    return scan


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[(s["first"], s["after"]) for s in x or ()] for x in b.column(2).to_pylist()]
        rows = [_described(text.as_py(), x) for text, x in zip(b.column(1), spans)]
        yield _batch(b.column(0), rows, [sorted(x or ()) for x in b.column(3).to_pylist()])


def _block_by_block(rows: DataFrame, text: str, blocks: list[DataFrame]) -> DataFrame:
    """row, spans and items of all blocks' hits; one automaton is held at a time."""
    found = []
    for pairs in blocks:
        keyed = _Keyed(pairs)
        found.append(materialise(rows.select("row", F.col(text).cast("string").alias("text")).mapInArrow(_scanner(keyed), f"row long, {_SPANS_SQL}")))
        keyed.broadcast.unpersist()
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), hit_spans (character offsets of the original)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, window, block_words)
    if len(blocks) == 1:
        return rows.mapInArrow(_one_pass(_Keyed(blocks[0])), _FOUND)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    hits = _block_by_block(rows, "text", blocks).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return rows.join(hits, "row", "left").select("doc_id", "text", "spans", "items").mapInArrow(_summary, _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of :func:`contamination`."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs; with one automaton there is no shuffle."""
    blocks = _blocks(benchmark, window, block_words)
    if len(blocks) == 1:
        keyed = _Keyed(blocks[0])

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            automaton = _automaton(keyed)
            return texts.map(lambda t: next(automaton.scan(words_of(t)), None) is None).astype(bool)

        return docs.where(clean(F.col("text").cast("string")))
    rows = materialise(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    hit = _block_by_block(rows, "doc.text", blocks).select("row").distinct()
    return rows.join(hit, "row", "left_anti").select("doc.*")
