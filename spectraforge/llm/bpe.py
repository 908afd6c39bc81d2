"""BPE encoding and decoding; long texts are encoded in halves that are joined exactly.

Texts up to ``leaf`` characters are encoded as a whole: cut into pre-tokens, each of which is
encoded once a worker. Longer texts become rows of at most ``leaf`` characters that are encoded
in parallel and joined pairwise in a tree. At each join a window around the cut is encoded
again and grown until several tokens in a row agree exactly, in number and place, with the left
and with the right side; if no such place exists the window reaches the whole text. Two
neighbouring tokens of an exact encoding stay neighbours wherever they meet, so a sequence in
which every pair of neighbours comes from an exact encoding is exact itself.

Defined results
    Null text: as the empty text: no tokens. Null ``doc_id``: a row like any other. Repeated
    rows: one row each. Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 32_768
#: Tokens in a row that must agree on either side of a join.
AGREE = 4
_WINDOW = 128
_CACHE = 400_000
#: Parts of a text that are handed on together.
_PARTS = 256

#: Characters for which lower case and white space need no library call; all others take it.
_PLAIN = regex.compile(r"[\x00-˿‐-‧‰-⁞€]*+")
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0D\x20\x85\xA0\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Encoder:
    """A tokenizer file of words with ends, with exact shortcuts for plain texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = _byte_letters()
        self.special = [str(t).lower() for t in (a.content for a in self.tokenizer.get_added_tokens_decoder().values())]
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token.removesuffix("</w>"))
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        letters = "".join(map(self.letters.__getitem__, piece.encode()))
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], dtype="<u4").tobytes()
        if len(self.known) >= _CACHE:
            self.known.clear()
        if len(piece) <= 64:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Token numbers of the whole text, as the library gives them."""
        low = text.lower()
        if not _PLAIN.fullmatch(text) or any(s in low for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        known, out = self.known.get, []
        for piece in _PRE_TOKEN.findall(low):
            out.append(known(piece) or self._piece(piece))
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def joined(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The encoding of ``left + right``, from those of both."""
        size = _WINDOW
        left_ends, right_ends = np.cumsum(self.lengths[left_ids]), np.cumsum(self.lengths[right_ids])
        whole = int(left_ends[-1]) if len(left_ends) else 0
        while size < max(len(left), len(right)):
            a, b = left[-size:], right[:size]
            ids = self.encode(a + b)
            before, after = (int(self.lengths[self.encode(x)].sum()) for x in (a, b))
            ends = np.cumsum(self.lengths[ids]) + (whole - before)
            # the last place left of the cut and the first right of it where AGREE tokens agree;
            # a window that reaches an end of the text needs none there
            at_left = (0, 0) if len(a) == len(left) else self._agreement(left_ids, left_ends, ids, ends, whole, last=True)
            at_right = (len(right_ids), len(ids)) if len(b) == len(right) else self._agreement(right_ids, right_ends + whole, ids, ends, whole, last=False)
            same_bytes = len(ends) and int(ends[-1]) == whole + after
            if same_bytes and at_left and at_right and at_left[1] <= at_right[1]:
                return np.concatenate([left_ids[: at_left[0]], ids[at_left[1] : at_right[1]], right_ids[at_right[0] :]])
            size *= 4
        return self.encode(left + right)

    @staticmethod
    def _agreement(own: np.ndarray, own_ends: np.ndarray, ids: np.ndarray, ends: np.ndarray, cut: int, last: bool) -> tuple[int, int] | None:
        """(own, window) number of tokens up to a place where AGREE tokens in a row are the same."""
        at = np.searchsorted(own_ends, ends)
        same = (at < len(own)) & (ends <= cut if last else ends > cut)
        clip = np.minimum(at, max(len(own) - 1, 0))
        if not len(own):
            return None
        same &= (own_ends[clip] == ends) & (own[clip] == ids)
        runs = np.convolve(same, np.ones(AGREE, dtype=int))[AGREE - 1 : len(same)] == AGREE if len(same) >= AGREE else np.zeros(0, dtype=bool)
        ok = np.flatnonzero(runs)
        if not len(ok):
            return None
        first = int(ok[-1] if last else ok[0])
        end = first + AGREE - 1 if last else first + 1
        return int(at[end - 1]) + 1, end

    def tree(self, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """Join the encodings of consecutive texts in pairs, then pairs of pairs, to one."""
        while len(texts) > 1:
            pairs = range(0, len(texts) - 1, 2)
            tail = len(texts) % 2
            ids = [self.joined(texts[i], ids[i], texts[i + 1], ids[i + 1]) for i in pairs] + ids[len(ids) - tail :]
            texts = [texts[i] + texts[i + 1] for i in pairs] + texts[len(texts) - tail :]
        return ids[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_OUT = "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded string"


def _rows(doc_ids: pa.Array, encoded: list[np.ndarray], e: Encoder, keep: bool) -> pa.RecordBatch:
    decoded = [e.decode(ids) for ids in encoded]
    raw = [ids.tobytes() for ids in encoded]
    columns = {
        "doc_id": doc_ids,
        "ids": pa.array(raw if keep else [None] * len(raw), pa.binary()),
        "n_tokens": pa.array([len(ids) for ids in encoded], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
        "decoded": pa.array(decoded if keep else [None] * len(raw), pa.string()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def encode_decode(docs: DataFrame, path: str, leaf: int = LEAF, keep: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, digests and the decoded text.

    ``keep=False`` leaves ids and the decoded text null, for results that only need the digests.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield _rows(part.column(0), [e.encode(t.as_py()) for t in part.column(1)], e, keep)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = pa.array([e.encode(t.as_py()).tobytes() for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        e = encoder(path)
        table = table.sort_by("part")
        ids = [np.frombuffer(x, dtype="<u4") for x in table.column("ids").to_pylist()]
        whole = e.tree(table.column("text").to_pylist(), ids)
        return pa.Table.from_batches([_rows(table.column("doc_id").combine_chunks()[:1], [whole], e, keep)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of long texts, in one pass over each and a few at a time."""
        for b in batches:
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                starts = range(0, len(text), leaf)
                for lo in range(0, len(starts), _PARTS):
                    some = starts[lo : lo + _PARTS]
                    columns = [pa.array([row] * len(some)), pa.array([doc_id] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([text[at : at + leaf] for at in some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "part", "text"])

    encoded = rows.where(F.length("text") <= leaf).mapInArrow(short, _OUT)
    halves = (
        rows.where(F.length("text") > leaf)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(cut, "row long, doc_id long, part int, text string")
        .repartition("row", "part")
        .mapInArrow(leaves, "row long, doc_id long, part int, text string, ids binary")
    )
    return encoded.unionByName(halves.groupBy("row").applyInArrow(grow, _OUT))
