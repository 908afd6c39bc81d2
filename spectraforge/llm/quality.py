"""Quality of texts by a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; a text's score is the sum of its features' weights and of the scalar
products of all pairs of their vectors, times the features' values. The pairs are never listed: their sum is half the
difference between the squared sum and the sum of squares of the scaled vectors, one pass over the features.

Features are the words and runs of signs of the lower-cased text (hashed, log counts, scaled to length one), statistics of
the text's bytes, words and lines, and what the table says of it (n_chars); these are standardised by the sample.

The machine is fitted on the driver, on a bounded sample of labelled rows: about ``sample_low`` rows of quality 0 and
``sample_high`` rows of quality 1, chosen by a hash of ``doc_id``. Scores are probabilities at the labels' true shares.

Defined results
    Null or empty text: scored from its statistics. Null n_chars: a feature of its own. Null ``doc_id``: scored, held_out
    false, never learnt from. Null label: not learnt from. Repeated labels: the row counts once for each. Labels of one
    kind only: that kind is every row's score; none: 0. Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_LOW = 2500
SAMPLE_HIGH = 3500
#: Places for hashed words, length of a feature's vector, passes over the sample and steps at least, rows of a step and its size.
BUCKETS = 1 << 15
RANK = 6
EPOCHS = 8
STEPS = 240
STEP_ROWS = 200
RATE = 0.08
DECAY = 1e-5
#: Scores from here on are predicted to be of quality 1.
THRESHOLD = 0.3

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _byte_classes() -> np.ndarray:
    """For each byte: small letter, capital, digit, white space, line break, other ASCII, beyond ASCII."""
    kinds = [(97, 123), (65, 91), (48, 58), (32, 33), (10, 11), (33, 127), (128, 256)]
    table = np.zeros((256, len(kinds)))
    for k, (first, end) in enumerate(kinds):
        table[first:end, k] = 1
    table[:, 5] -= table[:, 0] + table[:, 1] + table[:, 2]
    return table


_CLASSES = _byte_classes()


def statistics(text: str, n_chars: int | None) -> list[float]:
    """Shares of kinds of bytes, then figures of words and lines, then what the metadata says."""
    raw = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / max(len(raw), 1)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    lengths = list(map(len, words)) or [0]
    return [
        *shares, math.log1p(len(words)), sum(lengths) / n, math.log1p(max(lengths)), len(set(words)) / n, len(set(lines)) / len(lines), math.log1p(len(lines)), math.log1p(len(text) / len(lines)),
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(w[:1].isupper() for w in words) / n, sum(not w[-1].isalnum() for w in words) / n,
        math.log1p(max(n_chars or 0, 0)), float(n_chars is None), float(n_chars is not None and n_chars != len(text)),
    ]


N_STATISTICS = len(statistics("", None))


def words_of(text: str, places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and their scaled values; ``places`` remembers the places of words seen before."""
    counts = Counter(_TOKEN.findall(text.lower()))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found = []
    for w in counts:
        at = places.get(w)
        if at is None:
            if len(places) > 200_000:
                places.clear()
            at = places[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        found.append(at)
    sums = np.bincount(found, weights=list(counts.values()), minlength=0)
    at = np.flatnonzero(sums)
    value = np.log1p(sums[at])
    return at.astype(np.int32), (value / np.linalg.norm(value)).astype(np.float32)


@dataclass
class Rows:
    """Sparse rows: where each begins, places and values; the last places are the statistics."""

    starts: np.ndarray
    places: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray) -> Rows:
        own = np.arange(BUCKETS, BUCKETS + N_STATISTICS, dtype=np.int32)
        places = [p for at, _ in words for p in (at, own)]
        values = [v for (_, value), s in zip(words, stats) for v in (value, s)]
        starts = np.cumsum([0] + [len(at) + N_STATISTICS for at, _ in words])[:-1]
        return Rows(starts, np.concatenate(places), np.concatenate(values).astype(np.float32))

    def take(self, chosen: np.ndarray) -> Rows:
        ends = np.append(self.starts[1:], len(self.places))
        sizes = ends[chosen] - self.starts[chosen]
        first = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(first - self.starts[chosen], sizes)
        return Rows(first, self.places[at], self.values[at])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.places))))


@dataclass
class Model:
    """bias, weights and vectors of the machine; mean and scale of the statistics."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def margins(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function, and the sum of scaled vectors, of each row."""
        scaled = self.vectors[rows.places] * rows.values[:, None]
        sums = np.add.reduceat(scaled, rows.starts)
        pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((scaled**2).sum(axis=1), rows.starts))
        return self.bias + np.add.reduceat(self.weights[rows.places] * rows.values, rows.starts) + pairs, sums


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, share: float) -> Model:
    """Steps of falling size along each feature's own gradient; ``share`` is the share of quality 1 among all labels."""
    rng = np.random.default_rng(11)
    n = BUCKETS + N_STATISTICS
    model = Model(0.0, np.zeros(n), rng.normal(0, 0.02, (n, RANK)), stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    rows = Rows.of(words, model.standard(stats))
    seen_w, seen_v, seen_b = np.full(n, 1e-2), np.full((n, RANK), 1e-2), 1e-2
    for _ in range(max(EPOCHS, STEPS * STEP_ROWS // len(y))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), STEP_ROWS):
            chosen = order[at : at + STEP_ROWS]
            part = rows.take(chosen)
            margin, sums = model.margins(part)
            error = (_logistic(margin) - y[chosen])[part.owner()]
            g = error * part.values
            grad_w = np.bincount(part.places, weights=g, minlength=n) / len(chosen) + DECAY * model.weights
            inner = sums[part.owner()] - model.vectors[part.places] * part.values[:, None]
            grad_v = np.column_stack([np.bincount(part.places, weights=g * inner[:, f], minlength=n) for f in range(RANK)]) / len(chosen) + DECAY * model.vectors
            grad_b = error[part.starts].mean()
            seen_w, seen_v, seen_b = seen_w + grad_w**2, seen_v + grad_v**2, seen_b + grad_b**2
            model.weights -= RATE * grad_w / np.sqrt(seen_w)
            model.vectors -= RATE * grad_v / np.sqrt(seen_v)
            model.bias -= RATE * grad_b / math.sqrt(seen_b)
    drawn = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model.bias += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    model.weights, model.vectors = model.weights.astype(np.float32), model.vectors.astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places: dict[str, int] = {}
    for b in batches:
        rows = [(words_of(t or "", places), statistics(t or "", n)) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column("draw"), b.column("quality"), pa.array([r[0][0] for r in rows], pa.list_(pa.int32())), pa.array([r[0][1] for r in rows], pa.list_(pa.float32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
            names=["draw", "quality", "places", "values", "stats"],
        )


def _texts(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample_low: int = SAMPLE_LOW, sample_high: int = SAMPLE_HIGH) -> Model | float:
    """The machine learnt from labelled rows that are not held out; the share of quality 1 where labels have one kind only."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}  # two rows
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return share
    draw = F.xxhash64("doc_id", F.lit("quality sample"))
    wanted = F.when(F.col("quality") == 1, sample_high / sizes[1]).otherwise(sample_low / sizes[0])
    chosen = marked.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 30)) / (1 << 30) < wanted)
    few = chosen.count() <= 2 * (sample_low + sample_high)  # else the ids are joined by a shuffle
    sample = _texts(docs).join(F.broadcast(chosen) if few else chosen, "doc_id").select("draw", "quality", "text", "n_chars")
    table = sample.mapInArrow(_featured, "draw long, quality int, places array<int>, values array<float>, stats array<double>").toArrow()  # the sample bounds it
    table = table.sort_by([("draw", "ascending"), ("quality", "ascending")])
    y = table["quality"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return share
    words = [(np.asarray(p, np.int32), np.asarray(v, np.float32)) for p, v in zip(table["places"].to_numpy(), table["values"].to_numpy())]
    return fit(words, np.vstack(table["stats"].to_numpy()), y, share)


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        for b in batches:
            p = np.full(b.num_rows, model if isinstance(model, float) else 0.0)
            if b.num_rows and not isinstance(model, float):
                words, stats = [], []
                for text, n in zip(b.column("text"), b.column("n_chars").to_pylist()):
                    text = text.as_py() or ""
                    words.append(words_of(text, places))
                    stats.append(statistics(text, n))
                p = _logistic(model.margins(Rows.of(words, model.standard(np.array(stats))))[0].astype(float))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = _texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "n_chars")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
