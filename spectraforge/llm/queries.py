"""The operators applied to the given tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, html_text, language_id, licenses, manifest, prefix_trie, quality, simhash, substring_dedup, token_counts, toxicity
from .common import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs, vocabulary("piece_bpe_32k.model")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


#: Edits of op10: mail addresses and IPv4 addresses become placeholders. A name is tried at its first place only (or where the
#: last match ended), which finds the same matches in time linear in the text.
PERSONAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens before and after personal data is replaced: the trees are written once, the edits update them."""
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = materialise(token_counts.count(_table(spark, sf_dir, "documents"), path, pattern))
    edited = token_counts.recount(trees.withColumn("edits", token_counts.edits_at("text", PERSONAL, "[removed]")), path, pattern)
    return edited.select("doc_id", "n_tokens", "n_leaves", "n_edits", "n_tokens_after", "n_chars_encoded", F.sha2("new_text", 256).alias("new_text_sha256"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_exact_dedup, op2_html_extraction, op3_license_scan, op4_bpe, op5_language_id, op6_simhash, op7_decontamination, op8_substring_dedup, op9_toxicity, op10_token_counts,
        op11_quality, op12_prefix_trie, op13_merkle_manifest,
    )
    return {f.__name__: f for f in ops}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op1_sql() -> str:
    return r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM n"""


def _op3_sql() -> str:
    ids = " ".join(f"WHEN '{s}' THEN '{i}'" for i, s in licenses.SENTENCES.items())
    patterns = " ".join(f"WHEN contains(x, '{guard}') AND regexp_matches(x, '{pattern}') THEN '{i}'" for i, (guard, pattern) in licenses.PATTERNS.items())
    has = lambda rule: f"(contains(a, ',{','.join(rule)},') OR contains(b, ',{','.join(rule)},'))"
    every = ", ".join(f"CASE WHEN {has(rule)} THEN '{name}' END" for name, rule in licenses.RULES)
    trimmed = lambda s, cut: f"list_transform(string_split_regex({s}, '{cut}'), lambda x: trim(x))"
    sequence = lambda s, cut: f"list_filter(list_transform({trimmed(s, cut)}, lambda x: CASE x {ids} ELSE CASE {patterns} END END), lambda x: x IS NOT NULL)"
    return rf"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '([0-9])\+', '\1 or later', 'g'), '{licenses.ENDS}', chr(1), 'g') AS s FROM documents),
n AS (SELECT doc_id, regexp_replace(s, '[^a-z0-9\x01\n]+', ' ', 'g') AS by_line, regexp_replace(s, '[^a-z0-9\x01]+', ' ', 'g') AS by_end FROM t),
i AS (SELECT doc_id, {sequence('by_line', r'[\x01\n]')} AS x, {sequence('by_end', r'\x01')} AS y FROM n),
j AS (SELECT doc_id, CASE WHEN len(y) > len(x) THEN y ELSE x END AS ids,
             ',' || coalesce(array_to_string(x, ','), '') || ',' AS a, ',' || coalesce(array_to_string(y, ','), '') || ',' AS b FROM i),
k AS (SELECT doc_id, ids, list_filter([{every}], lambda x: x IS NOT NULL) AS found FROM j)
SELECT doc_id, coalesce(found[1], 'none') AS licence,
       coalesce(array_to_string(list_filter(found, lambda x, p: list_position(found, x) = p), ','), '') AS licences,
       coalesce(array_to_string(ids, ','), '') AS sentence_ids, CAST(len(ids) AS BIGINT) AS n_sentences
FROM k"""


def _op7_sql() -> str:
    words = lambda table, key: rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {table}"
    return rf"""
WITH d AS ({words('documents', 'doc_id')}),
b AS ({words('benchmark', 'item_id')}),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
h AS (SELECT p.doc_id, p.i, p.n, bw.item_id FROM p JOIN bw ON p.n = bw.n AND array_to_string(ws[i:i + p.n - 1], ' ') = bw.w),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


def _op8_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
m AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
gone AS (SELECT DISTINCT doc_id, place FROM (SELECT w.doc_id, unnest(range(i, i + 50)) AS place FROM w JOIN m ON w.h = m.h AND w.doc_id > m.least)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.place) AS t
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.place = words.place WHERE gone.place IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal digits, bit by bit: every digit is followed by seven zeros, a list entry a bit."""
    bits = f"flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST({number} AS VARCHAR), '')])"
    step = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    return f"xor(list_reduce(list_transform(list_concat([4294967295], {bits}), lambda x: CAST(x AS BIGINT)), lambda a, x: {step}), 4294967295)"


def _op12_sql() -> str:
    return rf"""
WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT *, {_crc32('c')} % 4 AS h FROM o),
s AS (SELECT h.c, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS q FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
p AS (SELECT c, q, d, q[1:d] AS k FROM (SELECT c, q, unnest(range(len(q) + 1)) AS d FROM s)),
n AS (SELECT d AS depth, k, min(c) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(q) = d), '')) AS ends_sha256,
             (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(k[d].t), ''), '[^\x20\x09-\x0D]+')) AS own FROM p GROUP BY d, k),
e AS (SELECT m.*, u.conv_id AS parent_conv_id FROM n m LEFT JOIN n u ON u.depth = m.depth - 1 AND u.k = m.k[1:m.depth - 1]),
kids AS (SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN kids ON kids.depth = e.depth AND kids.k = e.k),
below AS (SELECT a AS depth, k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens
          FROM (SELECT *, unnest(range(depth + 1)) AS a FROM f) GROUP BY 1, 2)
SELECT conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN below ON below.depth = f.depth AND below.k = f.k"""


def _op13_sql() -> str:
    framed = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
    hashed = lambda n: f"sha256({framed('doc_id')} || {framed('source')} || {framed('lang')} || {framed(n)} || {framed('text')})"

    def climb(name: str, leaves: str) -> str:
        """All levels of the trees of groups g, a row a node."""
        return f"""{name} AS (SELECT * FROM ({leaves}) UNION ALL
  SELECT l + 1, g, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}) WHERE n > 1 GROUP BY l, g, i // 2)"""

    def walk(name: str, starts: str, tree: str) -> str:
        """Every leaf's way up: its node, the siblings met so far, and the digest folded from them."""
        return f"""{name} AS (SELECT * FROM ({starts}) UNION ALL
  SELECT w.doc_id, w.leaf, w.g, w.l + 1, w.i // 2, w.proof || coalesce(s.d, ''), sha256(CASE WHEN w.i % 2 = 0 THEN w.f || coalesce(s.d, '') ELSE s.d || w.f END)
  FROM {name} w JOIN {tree} p ON p.l = w.l + 1 AND p.g = w.g AND p.i = w.i // 2 LEFT JOIN {tree} s ON s.l = w.l AND s.g = w.g AND s.i = xor(w.i, 1))"""

    lower = "SELECT 0 AS l, g, i, leaf AS d FROM placed"
    upper = "SELECT 0 AS l, 0 AS g, i, d FROM heads"
    below = "SELECT doc_id, leaf, g, 0 AS l, i, '' AS proof, f FROM placed"
    above = "SELECT doc_id, leaf, 0 AS g, 0 AS l, u.i, proof, f FROM (SELECT *, max(l) OVER (PARTITION BY g) AS top FROM a) a JOIN heads u ON u.g = a.g WHERE l = top"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('x' || lang, '') AS g, {hashed('n_chars')} AS leaf, CASE WHEN {_crc32('doc_id')} % 7 = 0 THEN {hashed('(n_chars + 1)')} ELSE {hashed('n_chars')} END AS f FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
{climb('tree', lower)},
heads AS (SELECT g, d, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM (SELECT g, max_by(d, l) AS d FROM tree GROUP BY g)),
{climb('upper', upper)},
{walk('a', below, 'tree')},
{walk('b', above, 'upper')},
root AS (SELECT max_by(d, l) AS root, max(l) AS l FROM upper)
SELECT b.doc_id, b.leaf, h.d AS subroot, root, sha256(proof) AS proof_sha256, b.f AS folded_root, b.f = root AS verified
FROM b JOIN root ON root.l = b.l JOIN placed p ON p.doc_id IS NOT DISTINCT FROM b.doc_id AND p.leaf = b.leaf JOIN heads h ON h.g = p.g"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _op1_sql(), "op3_license_scan": _op3_sql(), "op7_decontamination": _op7_sql(), "op8_substring_dedup": _op8_sql(), "op12_prefix_trie": _op12_sql(), "op13_merkle_manifest": _op13_sql()}
