"""A Merkle manifest of a data set: leaves by group, a subroot a group, one root, and a proof a leaf.

A leaf is the hash of a row's fields, each framed by its length. Within a group leaves stand by their key; every
``arity`` consecutive nodes have one parent, the hash of their digests as text, until one node is left: the group's
subroot. Subroots, ordered by group, are the leaves of a last tree of the same kind.

Levels are built by self-joins: every node computes the indices of its siblings from its own (the index XOR 1 for
pairs, else its run's start plus a slot offset), equijoins the level with itself on them, and the nodes in slot zero
emit the parents. Going back down, each node's path of siblings is its own siblings followed by its parent's path.
A proof needs only a leaf and its path; :func:`folded` recomputes the root from them.

Only digests go through the joins, no field is shuffled; every level is written before the next one reads it. The number
of levels is the logarithm of the largest group. Ranks come from sampled ranges, so a group of any size is dealt to many tasks.

Defined results
    Null fields: framed as ``-``. Empty text: framed as ``0:``. Null group: a group of its own, first. Null key: first in
    its group. Rows with one key: ordered by their leaf (equal ones are interchangeable). Empty table: empty result.
    Extra columns: not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraforge.operators.ordering import rank

from .common import materialise

#: Levels of the way down that are planned together before their rows are written.
STRIDE = 4


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(f) for f in fields]), 256))


def _parent(digests: Column) -> Column:
    """The digest of the concatenated texts of an array of digests."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), ""), 256))


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``siblings``: digests of the other nodes of the run, by slot (fewer in the last run)."""
    level = nodes.select("grp", "idx", "digest")
    slot = F.pmod(F.col("idx"), F.lit(arity))
    joined = nodes
    for k in range(1, arity):
        target = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + k) % arity
        other = level.select(F.col("grp").alias("g"), F.col("idx").alias("at"), F.struct(F.pmod("idx", F.lit(arity)).alias("slot"), "digest").alias(f"s{k}"))
        joined = joined.withColumn("target", target).join(other, F.col("grp").eqNullSafe(F.col("g")) & (F.col("target") == F.col("at")), "left").drop("g", "at", "target")
    found = [F.col(f"s{k}") for k in range(1, arity)]
    ordered = F.array_sort(F.filter(F.array(*found), lambda s: s.isNotNull()))
    return joined.select(*nodes.columns, F.transform(ordered, lambda s: s["digest"]).alias("siblings"))


def _emitted(level: DataFrame, arity: int) -> DataFrame:
    """Parents, from the nodes in slot zero; a node alone in its group has none."""
    first = level.where((F.col("idx") % arity == 0) & ~_alone())
    return first.select("grp", F.floor(F.col("idx") / arity).cast("long").alias("idx"), _parent(F.concat(F.array("digest"), F.col("siblings"))).alias("digest"))


def _alone() -> Column:
    return (F.col("idx") == 0) & (F.size("siblings") == 0)


def _climb(nodes: DataFrame, largest: int, arity: int) -> list[DataFrame]:
    """All levels with their siblings, from the leaves up; ``largest`` is the size of the largest group."""
    levels = [materialise(_with_siblings(nodes, arity))]
    while largest > 1:
        largest = -(-largest // arity)
        levels.append(materialise(_with_siblings(_emitted(levels[-1], arity), arity)))
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The last node of each group."""
    found = None
    for level in levels:
        alone = level.where(_alone()).select("grp", "digest")
        found = alone if found is None else found.unionByName(alone)
    return found


def _descend(levels: list[DataFrame], starts: DataFrame, arity: int) -> DataFrame:
    """Leaves with ``path`` (steps up to the root) and the columns that ``starts`` has for their group, beside grp, digest and path.

    A step is the node's slot and its siblings' digests.
    """
    carried = [c for c in starts.columns if c not in ("grp", "digest")]
    above = None
    for n, level in enumerate(reversed(levels)):
        own = F.array(F.struct(F.pmod("idx", F.lit(arity)).cast("int").alias("slot"), "siblings"))
        kept = [c for c in level.columns if c != "siblings"]
        top = level.where(_alone()).join(starts.withColumnRenamed("grp", "g").drop("digest"), F.col("grp").eqNullSafe(F.col("g"))).select(*kept, *carried)
        if above is not None:
            parents = above.select(F.col("grp").alias("g"), F.col("idx").alias("up"), *carried)
            inner = level.where(~_alone()).join(parents, F.col("grp").eqNullSafe(F.col("g")) & (F.floor(F.col("idx") / arity) == F.col("up")))
            rest = [c for c in carried if c != "path"]
            top = top.unionByName(inner.select(*kept, *rest, F.concat(own, F.col("path")).alias("path")))
        above = materialise(top) if n % STRIDE == STRIDE - 1 else top
    return above


def manifest(rows: DataFrame, group: str, key: str, digest: str, arity: int = 2) -> DataFrame:
    """Adds ``subroot``, ``root`` (binary) and ``path`` to rows with a group, an order key and a leaf digest (binary)."""
    if arity < 2:
        raise ValueError("a node has two children at least")
    extra = [c for c in rows.columns if c not in (group, digest)]
    leaves = materialise(rows.select(F.col(group).alias("grp"), F.col(digest).alias("digest"), *[F.col(c).alias(f"x_{c}") for c in extra]))
    nodes = rank(leaves, f"x_{key}", ["grp"], "idx", ties=("digest",))
    last = nodes.agg(F.max("idx")).first()[0]
    levels = _climb(nodes, 0 if last is None else last + 1, arity)
    subroots = materialise(_tops(levels))
    tops = rank(subroots, "grp", [], "idx").select(F.lit(0).alias("grp"), "idx", "digest", F.col("grp").alias("name"))
    upper = _climb(tops, subroots.count(), arity)
    root = _tops(upper).select("grp", "digest", F.col("digest").alias("root"), F.array().cast("array<struct<slot:int,siblings:array<binary>>>").alias("path"))
    starts = materialise(_descend(upper, root, arity).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path"))
    found = _descend(levels, starts, arity)
    return found.select(F.col("grp").alias(group), F.col("digest").alias(digest), *[F.col(f"x_{c}").alias(c) for c in extra], "subroot", "root", "path")


def folded(digest: Column, path: Column) -> Column:
    """The root recomputed from a leaf's digest and its path."""
    return F.aggregate(
        path,
        digest,
        lambda acc, step: _parent(F.concat(F.slice(step["siblings"], F.lit(1), step["slot"]), F.array(acc), F.slice(step["siblings"], step["slot"] + 1, F.greatest(F.size(step["siblings"]) - step["slot"], F.lit(0))))),
    )


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, left to right in each level, from the leaf up."""
    return _parent(F.flatten(F.transform(path, lambda step: step["siblings"])))


def document_manifest(docs: DataFrame, arity: int = 2, divisor: int = 7) -> DataFrame:
    """The manifest of documents by language, and a test of it: a claim of tampered rows is folded along the stored proofs.

    Rows whose crc32(doc_id as text) the divisor divides claim one character more than they have; their roots must not fit.
    """
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    claimed = leaf(list((fields | {"n_chars": F.col("n_chars").cast("long") + 1}).values()))
    rows = docs.select("doc_id", "lang", leaf(list(fields.values())).alias("leaf"), F.when(tampered, claimed).alias("claimed"))
    found = manifest(rows, "lang", "doc_id", "leaf", arity)
    text = lambda digest: F.lower(F.hex(digest))
    again = folded(F.coalesce("claimed", "leaf"), F.col("path"))
    return found.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text(proof_digest(F.col("path"))).alias("proof_sha256"), text(again).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
