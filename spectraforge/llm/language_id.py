"""Language identification by unigram pieces summed over all segmentations.

The pieces are all letter pieces of a fixed public vocabulary, whatever their length; case and
marks of a word's start are folded away. Each language has a probability for every piece, learnt
by expectation-maximisation. A word is a run of letters; its probability is the sum over all ways
to cut it into pieces (forward algorithm on a log scale, in strips, so that words may be of any
length), a text's the product over its words. Words are scored in groups of equal length with
numpy, and once per worker.

Learning reads a bounded sample of labelled rows: about ``sample_per_language`` rows of each
language, chosen by a hash of ``doc_id``; counts by language cover all rows. The model holds one
number a piece and language, and so does the driver while it learns.

Defined results
    Null text or text without a letter: ``und`` with score 0. Null ``doc_id`` or ``lang``: never
    learnt from; the row gets a prediction (held_out false if ``doc_id`` is null). Nothing to
    learn from: ``und``. Ties: the alphabetically first language. Repeated rows: one row each.
    Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SAMPLE_PER_LANGUAGE = 1500
ROUNDS = 2
#: Up to this many labels their counts are broadcast.
MANY_LANGUAGES = 10_000
#: Words, and letters of words, that a worker keeps scores of; longer words are not kept.
CACHE, CACHE_LETTERS, LONG = 1 << 20, 1 << 24, 64
#: Characters of the texts whose new words are scored together.
CHUNK = 2_000_000
#: Letters of a word that are cut at once.
STRIP = 4096
_SMOOTHING = 0.05
_UNKNOWN = 1e-7
_LETTERS = regex.compile(r"\p{L}+")


class Pieces:
    """A vocabulary of letter pieces, numbered from 2 (0: no piece, 1: unknown letter), as a trie in sorted arrays."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        nodes = {"": 0}
        for t in texts:
            for n in range(1, len(t) + 1):
                nodes.setdefault(t[:n], len(nodes))
        steps = sorted((nodes[t[:-1]] << 21 | ord(t[-1]), node) for t, node in nodes.items() if t)
        self.keys, self.child = (np.array([s[i] for s in steps], dtype=np.int64) for i in (0, 1))
        self.number = np.zeros(len(nodes), dtype=np.int32)
        self.number[[nodes[t] for t in texts]] = np.arange(2, len(texts) + 2)
        self.width = max(map(len, texts), default=1)

    def __len__(self) -> int:
        return len(self.texts)

    def cuts(self, letters: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """ids[i - lo, m - 1, w]: number of the piece of m letters at letter i of word w, for lo <= i < hi."""
        count, n = letters.shape
        ids = np.zeros((hi - lo, self.width, count), dtype=np.int32)
        word, at = (x.ravel() for x in np.meshgrid(np.arange(count), np.arange(lo, hi), indexing="ij"))
        node = np.zeros(len(word), dtype=np.int64)
        for m in range(1, self.width + 1 if self.texts else 1):
            key = node << 21 | letters[word, at + m - 1]
            step = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[step] == key
            word, at, node = word[known], at[known], self.child[step[known]]
            ids[at - lo, m - 1, word] = self.number[node]
            more = at + m < n
            word, at, node = word[more], at[more], node[more]
            if not len(word):
                break
        ids[:, 0][ids[:, 0] == 0] = 1
        return ids


def pieces(model_file: str) -> Pieces:
    """Letter pieces of a sentencepiece vocabulary."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=model_file)
    texts = (vocabulary.id_to_piece(i).replace("▁", "").lower() for i in range(vocabulary.get_piece_size()))
    return Pieces(list(dict.fromkeys(t for t in texts if _LETTERS.fullmatch(t))))


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1).astype(np.int64)


def log_probability(words: list[str], vocabulary: Pieces, log_p: np.ndarray) -> np.ndarray:
    """[word, language]: log of the summed probability of all segmentations; all words have one length."""
    letters, size = letters_of(words), vocabulary.width + 1
    n = letters.shape[1]
    # forward sums of the letters at hand and those ahead, in a ring
    ring = np.full((size, len(words), log_p.shape[1]), -np.inf)
    ring[0] = 0.0
    for lo in range(0, n, STRIP):
        ids = vocabulary.cuts(letters, lo, min(n, lo + STRIP))
        for at in range(lo, lo + len(ids)):
            here = ring[at % size].copy()
            ring[at % size] = -np.inf
            for m in range(1, min(vocabulary.width, n - at) + 1):
                w = np.flatnonzero(ids[at - lo, m - 1])
                if len(w):
                    to = ring[(at + m) % size]
                    to[w] = np.logaddexp(to[w], here[w] + log_p[ids[at - lo, m - 1, w]])
    return ring[n % size]


def expected(words: list[str], vocabulary: Pieces, log_p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece by weighted words of one length, for one language."""
    letters = letters_of(words)
    count, n = letters.shape
    ids = vocabulary.cuts(letters, 0, n)
    used = np.zeros(len(log_p))
    reach = [(i, m, w) for i in range(n) for m in range(1, min(vocabulary.width, n - i) + 1) if len(w := np.flatnonzero(ids[i, m - 1]))]
    alpha, beta = np.full((n + 1, count), -np.inf), np.full((n + 1, count), -np.inf)
    alpha[0] = beta[n] = 0.0
    for i, m, w in reach:
        alpha[i + m, w] = np.logaddexp(alpha[i + m, w], alpha[i, w] + log_p[ids[i, m - 1, w]])
    for i, m, w in reversed(reach):
        piece = ids[i, m - 1, w]
        behind = log_p[piece] + beta[i + m, w]
        beta[i, w] = np.logaddexp(beta[i, w], behind)
        used += np.bincount(piece, weight[w] * np.exp(alpha[i, w] + behind - alpha[n, w]), minlength=len(used))
    return used


def _by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    at: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        at[len(w)].append(i)
    for n in at:
        step = max(1, 100_000 // n)
        for lo in range(0, len(at[n]), step):
            part = at[n][lo : lo + step]
            yield part, [words[i] for i in part]


class Model:
    """Piece probabilities by language; ``p`` has a row for each piece number."""

    def __init__(self, languages: list[str], vocabulary: Pieces, p: np.ndarray):
        self.languages, self.vocabulary, self.p = languages, vocabulary, p
        with np.errstate(divide="ignore"):
            self.log_p = np.log(p)
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((1 << 12, len(self.languages)))

    def __getstate__(self):
        return self.languages, self.vocabulary, self.p

    def __setstate__(self, state):
        self.__init__(*state)

    def learn_words(self, words: list[str]) -> dict[str, np.ndarray]:
        """Score words that have not been met yet; returns the scores of long ones, which are not kept."""
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if self.row and (len(self.row) + len(new) > CACHE or self.letters > CACHE_LETTERS):
            self._clear()
            new = list(dict.fromkeys(words))
        if not new or not self.languages:
            return {}
        long = [w for w in new if len(w) > LONG]
        found = {w: s for part, group in _by_length(long) for w, s in zip(group, log_probability(group, self.vocabulary, self.log_p))}
        new = [w for w in new if len(w) <= LONG] if long else new
        at = len(self.row)
        if at + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(len(new), len(self.scores)), len(self.languages)))])
        for part, group in _by_length(new):
            self.scores[at + np.array(part)] = log_probability(group, self.vocabulary, self.log_p)
        self.row.update(zip(new, range(at, at + len(new))))
        self.letters += sum(map(len, new))
        return found

    def posteriors(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Language and its probability for every text; new words are scored a chunk of texts at a time."""
        at = 0
        while at < len(texts):
            chunk, chars = [], 0
            while at < len(texts) and chars < CHUNK:
                chunk.append(words_of(texts[at]))
                chars += len(texts[at] or "")
                at += 1
            long = self.learn_words([w for words in chunk for w in words])
            for words in chunk:
                yield self._posterior(words, long)

    def _posterior(self, words: list[str], long: dict[str, np.ndarray]) -> tuple[str, float]:
        if not words or not self.languages:
            return "und", 0.0
        more = sum((long[w] for w in words if w in long), np.zeros(len(self.languages))) if long else 0.0
        known = [w for w in words if w not in long] if long else words
        total = more + self.scores[np.fromiter(map(self.row.__getitem__, known), dtype=np.int64, count=len(known))].sum(axis=0)
        chances = np.exp(total - total.max())
        best = int(chances.argmax())
        return self.languages[best], float(chances[best] / chances.sum())


def words_of(text: str | None) -> list[str]:
    """Lower-case letter runs."""
    return _LETTERS.findall((text or "").lower())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: dict[tuple[str, str], int] = defaultdict(int)
        for lang, text in zip(b["lang"], b["text"]):
            for w in words_of(text):
                seen[lang, w] += 1
        yield pd.DataFrame([(lang, w, n) for (lang, w), n in seen.items()], columns=["lang", "word", "n"])


def train(docs: DataFrame, model_file: str, sample_per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Learn from rows that are not held out; the driver holds one probability a piece and language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / (1 << 30)
    if sizes.count() <= MANY_LANGUAGES:  # a row a label: the texts stay where they are
        sizes = F.broadcast(sizes)
    sample = rows.join(sizes, "lang").where(share * F.col("rows") < sample_per_language).select("lang", "text")
    counts = materialise(sample.mapInPandas(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").toLocalIterator()]
    vocabulary = pieces(model_file)
    p = np.full((len(vocabulary) + 2, len(languages)), 1.0 / (len(vocabulary) + 1))
    p[0], p[1] = 0.0, _UNKNOWN
    for _ in range(rounds if languages else 0):
        model = docs.sparkSession.sparkContext.broadcast(Model(languages, vocabulary, p))

        def expect(batches, model=model):
            m = model.value
            used = np.zeros_like(m.p)
            for b in batches:
                for lang, group in b.groupby("lang"):
                    column = m.languages.index(lang)
                    words, n = group["word"].tolist(), group["n"].to_numpy(dtype=float)
                    for part, same in _by_length(words):
                        used[:, column] += expected(same, m.vocabulary, m.log_p[:, column], n[part])
            piece, column = np.nonzero(used)
            yield pd.DataFrame({"piece": piece, "language": column, "n": used[piece, column]})

        sums = counts.mapInPandas(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        found = sums.where("piece > 1").toPandas()  # one number a piece and language, like the model itself
        total = np.full_like(p, _SMOOTHING)
        total[:2] = 0.0
        np.add.at(total, (found["piece"].to_numpy(), found["language"].to_numpy()), found["n"].to_numpy())
        p = total / total.sum(axis=0)
        p[1] = _UNKNOWN
        model.unpersist()
    return Model(languages, vocabulary, p)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = list(m.posteriors(b.column(2).to_pylist()))
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), langs, scores], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def identified_only(docs: DataFrame, model: Model, languages: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose predicted language is one of ``languages`` (null: any that
    was learnt) with a probability of at least ``min_score``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = frozenset(model.languages if languages is None else languages)

    @F.pandas_udf("boolean")
    def stays(texts: pd.Series) -> pd.Series:
        return pd.Series([lang in wanted and score >= min_score for lang, score in shared.value.posteriors(texts.tolist())], dtype=bool)

    return docs.where(stays(F.col("text").cast("string")))
