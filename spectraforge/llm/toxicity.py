"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Texts are folded first: lower case, look-alike letters of other scripts, digits and signs that
stand for letters inside words, and everything that is no letter to one space. The lexicon holds
whole words and word beginnings with weights; phrases of the exception list take the words inside
them out: a few fixed ones, and the pairs of words round a lexicon word that the clean rows of the
sample hold and the toxic ones do not. A text's weight is related to its length and turned into a
probability.

Weights and the two coefficients of the probability are learnt from a bounded sample of labelled
rows: about ``sample_toxic`` and ``sample_clean`` rows, chosen by a hash of ``doc_id``.

Defined results
    Null or empty text: the score of no match. Null ``doc_id``: scored, held_out false, never
    learnt from. Null label: not learnt from. Repeated labels: the row counts once for each. No
    labels at all: score 0. Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SAMPLE_TOXIC = 4000
SAMPLE_CLEAN = 8000
#: Lengths of the word beginnings that can enter the lexicon.
STEMS = range(4, 9)
#: An entry needs so many of the sampled toxic rows and this weight; all that have both enter the lexicon.
MIN_SUPPORT = 3
MIN_WEIGHT = 3.5
#: Clean rows that must hold a pair of words, and toxic rows that may, for it to be an exception.
MIN_SPARED, MAX_SPARED_TOXIC = 3, 0

# Letters that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһіӏոսαορνυικτ", "aeopcyxijsdhilnuaopvuikt"))
SUBSTITUTES = dict(zip("013457@$!|", "oieastasil"))
# Harmless phrases that hold a word of the lexicon.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "clown car", "class clown", "sore loser", "idiot proof", "pond scum", "soap scum")

_LOOKALIKE = re.compile("[" + "".join(LOOKALIKES) + "]")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SUBSTITUTE = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![\w@$!|])[013457@$](?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words, each with one space before it, and a space at the end."""
    s = (text or "").lower()
    s = _HIDDEN.sub("", s)
    s = _LOOKALIKE.sub(lambda m: LOOKALIKES[m[0]], s)
    s = _SUBSTITUTE.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), s)
    return f" {_OTHER.sub(' ', s).strip()} "


@dataclass
class Model:
    """weights: of ' word ' and ' beginning'; coefficients of the probability (empty: never toxic)."""

    weights: dict[str, float]
    coefficients: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            a.add_word(fold(phrase), (len(fold(phrase)), None))
        for entry, weight in self.weights.items():
            a.add_word(entry, (len(entry), weight))
        a.make_automaton()
        return a


def matches(folded: str, automaton: ahocorasick.Automaton) -> dict[int, float]:
    """Weight by start of the matched word; the largest entry of a word counts, exceptions take words out."""
    found: dict[int, float] = {}
    spared = []
    for end, (n, weight) in automaton.iter(folded):
        at = end + 1 - n
        if weight is None:
            spared.append((at, end))
        elif weight > found.get(at, 0.0):
            found[at] = weight
    if not spared:
        return found
    spared.sort()
    starts, reach = [a for a, _ in spared], list(accumulate((z for _, z in spared), max))
    return {at: w for at, w in found.items() if not (i := bisect_right(starts, at)) or at >= reach[i - 1]}


def features(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Total weight, and weight related to the length, both on a log scale."""
    if not len(automaton):
        return 0.0, 0.0
    total = sum(matches(folded, automaton).values())
    return math.log1p(total), math.log1p(total / math.sqrt(max(folded.count(" ") - 1, 1)))


def probability(x: tuple[float, float], coefficients: tuple[float, ...]) -> float:
    if not coefficients:
        return 0.0
    z = coefficients[0] + coefficients[1] * x[0] + coefficients[2] * x[1]
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _entry_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each word and word beginning, by label."""
    for b in batches:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for text, toxic in zip(b["text"], b["toxic"]):
            words = set(fold(text).split())
            for entry in {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}:
                seen[entry][int(toxic)] += 1
        yield pd.DataFrame([(e, *n) for e, n in seen.items()], columns=["entry", "clean", "toxic"])


def _pairs_at_matches(model: Model):
    """Documents with each pair of words round a word of the lexicon, by label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = model.automaton()
        for b in batches:
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(b["text"], b["toxic"]):
                folded = fold(text)
                for pair in {p for at in (matches(folded, a) if len(a) else ()) for p in _pairs_round(folded, at)}:
                    seen[pair][int(toxic)] += 1
            yield pd.DataFrame([(p, *n) for p, n in seen.items()], columns=["pair", "clean", "toxic"])

    return run


def _pairs_round(folded: str, at: int) -> Iterator[str]:
    """The word at a space with the one before it, and with the one behind it."""
    end = folded.index(" ", at + 1)
    if at:
        yield folded[folded.rindex(" ", 0, at) : end].strip()
    if end + 1 < len(folded):
        yield folded[at : folded.index(" ", end + 1)].strip()


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * 1e-2 * np.eye(len(b))
        b += np.linalg.solve(hessian, x.T @ (y - p) - ridge * 1e-2 * b)
    return tuple(map(float, b))


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn from labelled rows that are not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in marked.groupBy("toxic").count().toLocalIterator()}
    if len(sizes) < 2:
        return Model({}, (), exceptions)
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) / (1 << 30)
    wanted = F.when(F.col("toxic") == 1, sample_toxic / sizes[1]).otherwise(sample_clean / sizes[0])
    chosen = marked.where(share < wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = chosen.count() <= 2 * (sample_toxic + sample_clean)  # else the ids are joined by a shuffle
    sample = materialise(texts.join(F.broadcast(chosen) if few else chosen, "doc_id").select("text", "toxic"))
    seen = {r[0]: r[1] for r in sample.groupBy("toxic").count().toLocalIterator()}
    if len(seen) < 2:
        return Model({}, (), exceptions)
    weight = F.log((F.col("t") + 0.5) / (seen[1] + 1)) - F.log((F.col("c") + 0.5) / (seen[0] + 1))
    counts = sample.mapInPandas(_entry_counts, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    best = counts.where(F.col("t") >= MIN_SUPPORT).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
    entries = best.select("entry", "weight").collect()  # the sample bounds them
    model = Model({r[0]: r[1] for r in entries}, (), exceptions)
    pairs = sample.mapInPandas(_pairs_at_matches(model), "pair string, clean long, toxic long").groupBy("pair").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    spared = pairs.where((F.col("c") >= MIN_SPARED) & (F.col("t") <= MAX_SPARED_TOXIC)).select("pair").collect()  # the sample bounds them
    model.exceptions = (*exceptions, *sorted(r[0] for r in spared))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = model.automaton()
        for b in batches:
            x = [features(fold(t), a) for t in b["text"]]
            yield pd.DataFrame({"x0": [v[0] for v in x], "x1": [v[1] for v in x], "toxic": b["toxic"].to_numpy()})

    table = sample.mapInPandas(measure, "x0 double, x1 double, toxic int").toPandas()  # two numbers a sampled row
    model.coefficients = fit(table[["x0", "x1"]].to_numpy(), table["toxic"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in batches:
            p = [probability(features(fold(t.as_py()), a), model.coefficients) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
