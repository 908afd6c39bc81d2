"""The trie of the common beginnings of conversations, by the van Emde Boas recursion.

A block of depths is cut at its half: the beginnings that end at the cut get names, the upper half is a trie of its own,
and the lower half is a forest with one trie a name. Both halves are cut again, all blocks of one size at once, until a
block is one depth. A depth is thus the cut of one block only, whose size is twice the depth's lowest set bit.

Names: sequences are summed up in aligned segments of 1, 2, 4, ... turns; the name of a cut beginning is the digest of the
name at its block's start and of the segment between. No conversation is held as a whole by any task, and equal
beginnings get equal names without meeting each other.

Totals: blocks are joined again from the smallest up. The totals of a lower forest's roots are grafted onto every depth of
the upper trie that lies above them; how many rows this makes is bounded by half the depths of the block for each root.
There are as many rounds as the longest conversation's length has binary digits; every round is written.

Defined results
    Null role or text: empty. Null turn: first in its conversation. Rows with one turn number: ordered by the digest of
    role and text, repeated rows are turns of their own. Null conv_id: no conversation, left out. Conversations that are
    rebuilt without turns: members of the root. Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraforge.operators.ordering import rank

from .common import materialise

#: A piece of a node's list of members ends after so many characters.
PIECE = 1 << 16

_WORD = r"[^\x20\x09-\x0D]+"
_ROOT_NAME = b""


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), sym (digest of role and text), words: the turns in their order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sym = _digest(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), sym.alias("sym"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")
    )
    return rank(materialise(rows), "turn", ["conv"], "pos", ties=("sym",)).select("conv", (F.col("pos") + 1).alias("pos"), "sym", "words")


def rebuilt(ordered: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose beginning comes from the first one of their family, and all their numbers.

    Of conversation c the first h turns (crc32 of c as text, modulo ``most``) are those of conversation c - c % ``family``.
    """
    h = F.crc32(F.col("conv").cast("string")) % most
    sizes = ordered.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    members = materialise(sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base")))
    bases = members.select(F.col("conv").alias("b"), F.col("n").alias("n_base"))
    sized = members.join(bases, F.col("base") == F.col("b"), "left").select("conv", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    heads = ordered.where((F.col("conv") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "b")
    begun = sized.join(heads, (F.col("base") == F.col("b")) & (F.col("pos") <= F.col("h"))).select("conv", F.col("pos").alias("depth"), "sym", "words")
    own = ordered.join(sized.select("conv", "h", "taken"), "conv").where(F.col("pos") > F.col("h")).select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "sym", "words")
    return begun.unionByName(own), members.select("conv")


def _segments(sequences: DataFrame, levels: int) -> list[DataFrame]:
    """For each level j: conv, k, seg: the digest of the turns k * 2^j + 1 to (k + 1) * 2^j, where all of them are there."""
    found = [sequences.select("conv", (F.col("depth") - 1).alias("k"), F.col("sym").alias("seg"))]
    for _ in range(1, levels):
        half = F.col("k") % 2
        pairs = found[-1].groupBy("conv", F.shiftright("k", 1).alias("k")).agg(F.max(F.when(half == 0, F.col("seg"))).alias("a"), F.max(F.when(half == 1, F.col("seg"))).alias("b"))
        found.append(materialise(pairs.where("a is not null and b is not null").select("conv", "k", _digest(F.col("a"), F.col("b")).alias("seg"))))
    return found


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _names(sequences: DataFrame, levels: int) -> list[DataFrame]:
    """conv, depth, name of every beginning, a table for each level from 0; large blocks are cut first."""
    segments = _segments(sequences, levels)
    named: list[DataFrame] = []
    for j in range(levels - 1, -1, -1):
        cut = segments[j].where(F.col("k") % 2 == 0).select("conv", F.shiftleft("k", j).alias("start"), F.shiftleft(F.col("k") + 1, j).alias("depth"), "seg")
        first = cut.where("start = 0").select("conv", "depth", _digest(F.lit(_ROOT_NAME), F.col("seg")).alias("name"))
        if named:
            above = _union(named).select(F.col("conv").alias("c"), F.col("depth").alias("d"), F.col("name").alias("base"))
            later = cut.where("start > 0").join(above, (F.col("conv") == F.col("c")) & (F.col("start") == F.col("d")))
            first = first.unionByName(later.select("conv", "depth", _digest(F.col("base"), F.col("seg")).alias("name")))
        named.append(materialise(first))
    return named[::-1]


def _low(depth: str) -> Column:
    """The lowest set bit."""
    return F.col(depth).bitwiseAND(-F.col(depth))


def _nodes(sequences: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """name, depth, parent (name), conv_id, n_convs, own (saved words at the node itself)."""
    before = names.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    rows = names.join(sequences.select("conv", "depth", "words"), ["conv", "depth"]).join(before, ["conv", "depth"], "left")
    inner = rows.groupBy("name", "depth").agg(F.coalesce(F.max("parent"), F.lit(_ROOT_NAME)).alias("parent"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    root = members.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = root.select(F.lit(_ROOT_NAME).alias("name"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    return inner.unionByName(top).select("name", "depth", "parent", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))


def _grafts(nodes: DataFrame, names: DataFrame, levels: int) -> list[DataFrame]:
    """name, depth, leaves, saved: what the nodes below a node in the lower halves of its blocks add to it, a table for each level."""
    found: list[DataFrame] = []
    for j in range(levels):
        cut = nodes.where(_low("depth") == 1 << j).select("name", "depth", "conv_id", "leaves", F.col("own").alias("saved"))
        if found:
            sums = _union(found).where(_low("depth") == 1 << j).groupBy("name").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            cut = cut.join(sums, "name", "left").select("name", "depth", "conv_id", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        onto = cut.select("conv_id", "leaves", "saved", F.explode(F.sequence(F.col("depth") - (1 << j), F.col("depth") - 1)).alias("up"))
        upper = names.where(F.shiftright("depth", j).bitwiseAND(F.lit(1)) == 0)
        inner = onto.where("up > 0").join(upper, (F.col("conv_id") == F.col("conv")) & (F.col("up") == F.col("depth"))).select("name", "depth", "leaves", "saved")
        root = onto.where("up = 0").select(F.lit(_ROOT_NAME).alias("name"), F.col("up").alias("depth"), "leaves", "saved")
        found.append(materialise(inner.unionByName(root).groupBy("name", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))))
    return found


def _ends(sequences: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """name, ends_sha256: the digest of the numbers of the conversations that end at a node, ascending and comma-joined.

    Sorted ranges are first put together to pieces of bounded size; a node's pieces then stream through one hash.
    """
    lengths = sequences.groupBy("conv").agg(F.max("depth").alias("depth"))
    ended = lengths.join(names, ["conv", "depth"]).select("name", "conv")
    turnless = members.join(lengths, "conv", "left_anti").select(F.lit(_ROOT_NAME).alias("name"), "conv")
    ordered = ended.unionByName(turnless).repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    pieces = materialise(ordered.mapInArrow(_pieces, "name binary, first long, piece string"))
    return pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name binary, ends_sha256 string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[str] = []
    name, first, size = None, 0, 0
    done: list[tuple] = []
    for b in batches:
        for node, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if held and (node != name or size >= PIECE):
                done.append((name, first, ",".join(held)))
                held, size = [], 0
            if not held:
                name, first = node, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        if done:
            yield _batch(done, ["name", "first", "piece"])
            done = []
    if held:
        yield _batch([(name, first, ",".join(held))], ["name", "first", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, state, done = None, None, []
    for b in batches:
        for node, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if state is not None and node == name:
                state.update(b",")
            else:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = node, hashlib.sha256()
            state.update(piece.encode())
        if done:
            yield _batch(done, ["name", "ends_sha256"])
            done = []
    if state is not None:
        yield _batch([(name, state.hexdigest())], ["name", "ends_sha256"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"name": pa.binary(), "first": pa.int64(), "piece": pa.string(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows), names)], names=names)


def prefix_trie(sequences: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences`` has conv, depth (from 1, without gaps), sym (binary, equal for equal turns only) and words; ``members``
    has conv of all conversations, those without turns too.
    """
    sequences, members = materialise(sequences.select("conv", "depth", "sym", "words")), materialise(members.select("conv"))
    levels = (sequences.agg(F.max("depth")).first()[0] or 0).bit_length()
    names = _union(_names(sequences, levels)) if levels else sequences.select("conv", "depth", F.col("sym").alias("name"))
    nodes = materialise(_nodes(sequences, members, names))
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children.withColumnRenamed("parent", "name"), "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = materialise(counted.withColumn("leaves", (F.col("n_children") == 0).cast("long")))
    grafts = _grafts(counted, names, levels)
    if grafts:
        sums = _union(grafts).groupBy("name").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        counted = counted.join(sums, "name", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "own": F.col("own") + F.coalesce("s", F.lit(0))})
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = counted.join(parents, "parent", "left").join(_ends(sequences, members, names), "name", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("own").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of the rebuilt conversations of a table with conv_id, turn, role and text."""
    return prefix_trie(*rebuilt(turns(conversations)))
