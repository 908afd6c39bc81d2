"""Edit-aware token counts: a segment tree over runs of pre-tokens is kept for every document.

Leaves of a tree meet where a pre-token starts whatever stands around it (before white space, and between letters,
digits and other signs), or inside a long run of one kind, where the two tokens that meet would not be merged
if they stood alone: a sequence of tokens is the encoding of its text if each two neighbours are that of theirs.
Inner nodes hold sums. The edits of a document are clipped to the old text first. Those that touch neighbouring leaves
form a region, which is encoded again and cut into new leaves; it grows over an end that is no such boundary of the new
text any more. The sums above it are updated. Counts stay equal to those of the edited text encoded as a whole.

``count`` builds the trees, ``recount`` applies edits to documents with their trees; ``count_edited``
does both in one task where the trees are not kept. The pattern must be one that takes contractions, runs of letters, digits and
other signs with a space before them, and white space, as that of the public rank files does.

Defined results
    Null text: as the empty text: no tokens, one empty leaf. Null ``doc_id``: counted; edits
    never refer to it. Edits outside the text are cut to it; edits of a document are applied from
    its end to its start, and an edit that overlaps a later one is left out and counted in
    ``n_skipped``; null places count as 0. Repeated rows: each row gets every edit of its ``doc_id``.
    Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf; it ends at the next place where pre-tokens part, at one and a half times this length inside a run.
LEAF = 512
#: Characters behind the end of a leaf inside a run that are encoded with it, so that its last tokens are those of the run.
MARGIN = 64
#: Characters of the texts of one output batch.
OUTPUT = 4_000_000

OTHER, SPACE, LETTER, DIGIT = range(4)
#: How the parts of a text meet: where pre-tokens part anyway, inside a run, or where they cannot be encoded apart.
FREE, RUN, TIED = range(3)


class Leaf(NamedTuple):
    """Characters and tokens of a part, its first and last token (none for an empty part)."""

    chars: int
    tokens: int
    first: int | None
    last: int | None


class Counter:
    """Counts tokens of a byte-level vocabulary given as ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # kinds of characters as the library has them: other libraries know other versions of Unicode
        self.kinds = bytearray(0x110000)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, one in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}")):
            single = tiktoken.Encoding("kind", pat_str=one, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            for c in single.decode(single.encode_ordinary(every)):
                self.kinds[ord(c)] = kind

    def place(self, text: str, at: int) -> int:
        """How the parts of the text before and from ``at`` meet."""
        if not 0 < at < len(text):
            return FREE
        before, behind = self.kinds[ord(text[at - 1])], self.kinds[ord(text[at])]
        if before != behind:
            parted = behind == SPACE or before != SPACE and not (behind == LETTER and text[at - 1] == "'")
            return FREE if parted else TIED
        # an apostrophe and the letters behind it may be a pre-token of their own
        if before == LETTER and text[at - 2 : at - 1] == "'" or before == OTHER and text[at] == "'":
            return TIED
        return RUN

    def joined(self, last: int, first: int) -> bool:
        """Whether two tokens that meet inside a run stay as they are."""
        pair = self.encoding.decode_single_token_bytes(last) + self.encoding.decode_single_token_bytes(first)
        return self.encoding._encode_single_piece(pair) == [last, first]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def cut(self, text: str, leaf: int = LEAF) -> list[Leaf]:
        """The leaves of a text, in order; one empty leaf if it is empty."""
        leaves: list[Leaf] = []
        at = 0
        while at < len(text) or not leaves:
            end, ids = self._leaf(text, at, leaf)
            while leaves and self.place(text, at) == RUN and not self.joined(leaves[-1].last, ids[0]):
                at -= leaves.pop().chars
                ids = self.encode(text[at:end])
            leaves.append(Leaf(end - at, len(ids), ids[0], ids[-1]) if ids else Leaf(0, 0, None, None))
            at = end
        return leaves

    def _leaf(self, text: str, at: int, leaf: int) -> tuple[int, list[int]]:
        """End and tokens of the leaf that starts at a place."""
        widest = at + leaf + (leaf + 1) // 2
        if len(text) - at > leaf:
            free = next((p for p in range(at + leaf, min(widest, len(text))) if self.place(text, p) == FREE), None)
            if free is not None:
                return free, self.encode(text[at:free])
        if len(text) <= widest:
            return len(text), self.encode(text[at:])
        ids = self.encode(text[at : widest + MARGIN])
        ends = at + np.cumsum([sum(b & 0xC0 != 0x80 for b in piece) for piece in self.encoding.decode_tokens_bytes(ids)])
        for k in range(len(ids) - 1, 0, -1):
            p = int(ends[k - 1])
            whole = self.encoding.decode_single_token_bytes(ids[k])[0] & 0xC0 != 0x80
            if at < p <= widest and whole and self.place(text, p) != TIED:
                return p, ids[:k]
        return self._leaf(text, at, 2 * leaf)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def _one(a: list[int], b: list[int]) -> list[int]:
    """Two regions as one, the later one last."""
    return [a[0], max(a[1], b[1]), a[2], max(a[3], b[3]), a[4], b[5]]


class Tree:
    """Leaves (characters, tokens) below sums of both; ``work`` counts the characters encoded.

    A slot below the sums holds one leaf at first, and those that an edit made of it later.
    """

    def __init__(self, chars: list[int], tokens: list[int]):
        self.slots = [[(n, t)] for n, t in zip(chars, tokens)]
        self.work = 0
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        self.sums[self.size : self.size + len(chars)] = np.column_stack([chars, tokens])
        n = self.size
        while n > 1:
            self.sums[n // 2 : n] = self.sums[n : 2 * n : 2] + self.sums[n + 1 : 2 * n : 2]
            n //= 2

    @classmethod
    def build(cls, text: str, c: Counter, leaf: int = LEAF) -> Tree:
        leaves = c.cut(text, leaf)
        return cls([x.chars for x in leaves], [x.tokens for x in leaves])

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    @property
    def leaves(self) -> list[tuple[int, int]]:
        return [leaf for slot in self.slots for leaf in slot]

    def _put(self, slot: int, leaves: list[tuple[int, int]]) -> None:
        change = np.sum([*leaves, (0, 0)], axis=0) - np.sum([*self.slots[slot], (0, 0)], axis=0)
        self.slots[slot] = leaves
        i = slot + self.size
        while i:
            self.sums[i] += change
            i //= 2

    def find(self, position: int) -> tuple[int, int]:
        """(slot that holds the character, its start); the last slot with characters for the end of the text."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if position >= start + self.sums[i, 0] and self.sums[i + 1, 0] > 0:
                start += int(self.sums[i, 0])
                i += 1
        return i - self.size, start

    def _end(self, slot: int, start: int) -> int:
        return start + int(self.sums[slot + self.size, 0])

    def edit(self, text: str, edits: list[tuple[int, int, str]], c: Counter, leaf: int = LEAF) -> str:
        """Apply edits (start, stop, put) in order, which lie inside ``text`` and do not overlap; returns the new text."""
        parts, upto = [], 0
        for start, stop, put in edits:
            parts += [text[upto:start], put]
            upto = stop
        new = "".join([*parts, text[upto:]])
        # regions: first and last slot with their old places, and how far the new text is shifted at either end
        regions: list[list[int]] = []
        shift = 0
        for start, stop, put in edits:
            first, at = self.find(max(start - 1, 0))
            last, last_at = self.find(stop)
            after = shift + len(put) - (stop - start)
            regions.append([first, last, at, self._end(last, last_at), shift, after])
            shift = after
        for region, leaves in self._settled(regions, new, c, leaf):
            for slot in range(region[0] + 1, region[1] + 1):
                self._put(slot, [])
            self._put(region[0], [(x.chars, x.tokens) for x in leaves if x.chars])
        return new

    def _settled(self, regions: list[list[int]], new: str, c: Counter, leaf: int) -> list[tuple[list[int], list[Leaf]]]:
        """Regions with their new leaves, whose ends are boundaries of the new text; those that meet are one.

        A region grows by one slot, then two, four, ..., so that what is encoded stays below four times the last region.
        """
        apart: list[list[int]] = []
        for region in regions:
            apart.append(_one(apart.pop(), region) if apart and region[0] <= apart[-1][1] + 1 else region)
        done: list[tuple[list[int], list[Leaf]]] = []
        for k, region in enumerate(apart):
            limit = (apart[k + 1][0] if k + 1 < len(apart) else len(self.slots)) - 1
            grow = 1
            while True:
                while done and region[0] <= done[-1][0][1] + 1:
                    region = _one(done.pop()[0], region)
                first, last, at, end, before, after = region
                leaves = c.cut(new[at + before : end + after], leaf)
                self.work += end + after - at - before
                left = first > 0 and not self._meets(new, at + before, first - 1, leaves[0].first, c, left=True)
                right = last < limit and not self._meets(new, end + after, last + 1, leaves[-1].last, c, left=False)
                if not left and not right:
                    break
                for slot in range(first - 1, max(first - grow, 0) - 1, -1) if left else ():
                    region[0] = slot
                    region[2] -= int(self.sums[slot + self.size, 0])
                for slot in range(last + 1, min(last + grow, limit) + 1) if right else ():
                    region[1] = slot
                    region[3] = self._end(slot, region[3])
                grow *= 2
            done.append((region, leaves))
        return done

    def _meets(self, new: str, at: int, slot: int, token: int | None, c: Counter, left: bool) -> bool:
        """Whether a region with this token at its end can stay apart from the slot beside it."""
        if (place := c.place(new, at)) != RUN:
            return place == FREE
        held = self.slots[slot]
        if token is None or not held or not held[0][0]:
            return False
        chars = held[-1][0] if left else held[0][0]
        self.work += chars
        ids = c.encode(new[at - chars : at] if left else new[at : at + chars])
        return c.joined(ids[-1], token) if left else c.joined(token, ids[0])


def settled_edits(edits: list[dict] | None, length: int) -> tuple[list[tuple[int, int, str]], int]:
    """Edits clipped to the old text, in order, and the number of those left out as they overlap a later one."""
    clipped = []
    for e in edits or []:
        start = min(max(e["start"] or 0, 0), length)
        clipped.append((start, min(max(e["stop"] or 0, start), length), e["put"] or ""))
    kept: list[tuple[int, int, str]] = []
    for e in sorted(clipped, key=lambda e: e[:2], reverse=True):
        if not kept or e[1] <= kept[-1][0]:
            kept.append(e)
    return kept[::-1], len(clipped) - len(kept)


def _tree_columns(batches: Iterator[pa.RecordBatch], path: str, pattern: str, leaf: int) -> Iterator[pa.RecordBatch]:
    c = counter(path, pattern)
    for b in batches:
        trees = [c.cut(text.as_py() or "", leaf) for text in b.column(1)]
        columns = [
            pa.array([sum(x.tokens for x in tree) for tree in trees], pa.int64()),
            pa.array([[x.chars for x in tree] for tree in trees], pa.list_(pa.int32())),
            pa.array([[x.tokens for x in tree] for tree in trees], pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens"])


TREES = "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"
EDITS = "array<struct<start:int,stop:int,put:string>>"


def count(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, text, n_tokens and the leaves of each document's tree."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _tree_columns(batches, path, pattern, leaf), TREES)


_RECOUNTED = ["new_text", "n_tokens", "n_leaves", "n_edits", "n_skipped", "n_tokens_after", "n_chars_encoded"]
RECOUNTS = "doc_id long, new_text string, n_tokens long, n_leaves long, n_edits long, n_skipped long, n_tokens_after long, n_chars_encoded long"


def _recounted(batches: Iterator[pa.RecordBatch], c: Counter, leaves_of: Callable[[pa.RecordBatch, int, str], tuple[list[int], list[int]]], leaf: int) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id, text, edits and further columns, of which ``leaves_of`` makes the characters and tokens of a row's leaves."""
    kinds = [pa.string()] + [pa.int64()] * 6
    for b in batches:
        out: list[tuple] = []
        held = begun = 0
        for i in range(b.num_rows):
            text, edits = b.column(1)[i].as_py() or "", b.column(2)[i].as_py()
            chars, tokens = leaves_of(b, i, text)
            kept, skipped = settled_edits(edits, len(text))
            before = after = sum(tokens)
            new, work = text, 0
            if kept:
                tree = Tree(chars, tokens)
                new = tree.edit(text, kept, c, leaf)
                after, work = tree.total, tree.work
            out.append((new, before, len(chars), len(kept), skipped, after, work))
            held += len(new)
            if held > OUTPUT or i == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([b.column(0)[begun : i + 1], *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], names=["doc_id", *_RECOUNTED])
                out, held, begun = [], 0, i + 1


def recount(trees: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Apply the column ``edits`` (start, stop, put; places in the old text) to rows of :func:`count`."""

    def kept(b: pa.RecordBatch, i: int, text: str) -> tuple[list[int], list[int]]:
        return b.column(3)[i].values.to_pylist(), b.column(4)[i].values.to_pylist()

    return trees.select("doc_id", "text", "edits", "leaf_chars", "leaf_tokens").mapInArrow(lambda batches: _recounted(batches, counter(path, pattern), kept, leaf), RECOUNTS)


def count_edited(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """The rows of :func:`recount` for documents with a column ``edits`` whose trees are built here and not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)

        def built(b: pa.RecordBatch, i: int, text: str) -> tuple[list[int], list[int]]:
            leaves = c.cut(text, leaf)
            return [x.chars for x in leaves], [x.tokens for x in leaves]

        return _recounted(batches, c, built, leaf)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits").mapInArrow(run, RECOUNTS)


def edits_at(text: str, pattern: str, put: str) -> F.Column:
    """Edits that replace every match of ``pattern`` in the column ``text`` by ``put``."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("put", pa.string())]))

    @F.arrow_udf(EDITS)
    def find(texts: pa.Array) -> pa.Array:
        compiled = regex.compile(pattern)
        return pa.array([[{"start": m.start(), "stop": m.end(), "put": put} for m in compiled.finditer(t.as_py() or "")] for t in texts], kind)

    return find(F.col(text))
