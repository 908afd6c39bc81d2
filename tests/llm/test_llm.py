"""The ten operators against brute force, SQL and planted cases on small tables."""

import functools
import hashlib
import zlib
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from spectraforge.llm import bpe, decontaminate, exact_dedup, html_text, language_id, licenses, queries, simhash, substring_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


#: Nulls, empty, repeated rows, ties and a long text, with columns named like the operators' own.
ODD = [(1, None), (2, ""), (3, "a b"), (4, "a  b"), (4, "a  b"), (None, "a b"), (5, "word " * 40_000), (6, "  \n"), (7, "x" * 50_000)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = documents(spark, ODD)
    return df.withColumns({c: F.lit(c) for c in ("fp", "keep_id", "digest", "body", "edge", "n_tokens", "score", "row", "ids", "spans", "host")})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir)
    with duckdb.connect() as con:
        for f in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_exact_dedup_odd_rows(spark, odd):
    rows = [tuple(r)[:4] for r in exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept").collect()]
    expected = [(1, 6, 3, False), (2, 6, 3, False), (6, 6, 3, True), (3, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (None, 4, 4, False), (5, 5, 1, True), (7, 7, 1, True)]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_exact_dedup_compares_bytes_where_digests_collide(spark, odd):
    weak = lambda text: F.unhex(F.lpad((F.length(text) % 3).cast("string"), 2, "0"))
    rows = [tuple(r)[:4] for r in exact_dedup.exact_dedup(odd, weak).collect()]
    assert sorted(rows, key=str) == sorted([tuple(r)[:4] for r in exact_dedup.exact_dedup(odd).collect()], key=str)


def test_exact_dedup_names_the_place_of_the_row_that_stays(spark, tmp_path):
    documents(spark, [(1, "a"), (2, "a b"), (3, "ab  ")]).coalesce(1).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: (r.keep_id, r.keep_place.row, r.keep_place.file.endswith(".parquet")) for r in exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {1: (1, 0, True), 2: (3, 2, True), 3: (3, 2, True)}


def test_exact_dedup_state_goes_on_with_new_files(spark, tmp_path):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "state")
    before = dict(spark.conf.getAll)
    for rows in ([(1, "a"), (2, "b")], [(3, "a "), (4, "c")], []):
        exact_dedup.digest_log(documents(spark, rows)).write.mode("append").parquet(log)
        state = {r.digest.hex()[:6]: (r.group_size, r.keep_id) for r in exact_dedup.stream_state(spark, log, checkpoint).collect()}
    name = lambda t: hashlib.sha256(t).hexdigest()[:6]
    assert state == {name(b"a"): (2, 3), name(b"b"): (1, 2), name(b"c"): (1, 4)}
    assert dict(spark.conf.getAll) == before


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, f in zip(ids, fps):
        for j, g in zip(ids, fps):
            if (f ^ g).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids, fps = [r[0] for r in docs], [brute_fingerprint(r[1]) for r in docs]
    component = brute_components(ids, fps)
    assert got == {i: (format(f, "016x"), component[i]) for i, f in zip(ids, fps)}


@pytest.mark.parametrize("tile,huge", [(4, 64), (4, 2), (2048, 64)])
def test_links_lose_no_pair_in_crowded_buckets(spark, tile, huge):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(25)]
    fps = sorted(set(near) | {int(x) for x in centre})
    edges = simhash.links(spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long"), tile=tile, huge=huge)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    expected = brute_components(signed, fps)
    assert {i: roots.get(i, i) for i in signed} == {i: min(expected[j] for j in signed if expected[j] == expected[i]) for i in signed}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


@pytest.mark.parametrize("leaf", [64, 1000])
def test_bpe_equals_the_library(spark, leaf):
    path = public_tokenizers.path("word_bpe_49k.json")
    e = bpe.encoder(path)
    texts = ["", "Hello wörld's '''s", "ab" * 900, "x" * 700 + " <|endoftext|> É́ 你好 İ" * 9, "tion the " * 300, "\x1c\x85a b", "á" * 400, "'" * 500]
    got = bpe.encode_decode(documents(spark, list(enumerate(texts))), path, leaf=leaf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = e.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == e.tokenizer.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abts' .é", min_size=1, max_size=900), st.integers(1, 400))
def test_tree_of_parts_equals_the_whole(text, leaf):
    e = bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
    parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
    assert e.tree(parts, [e.encode(p) for p in parts]).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_language_held_out_accuracy(spark, sf_dir):
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op5_language_id(spark, sf_dir).collect() if r.held_out]
    assert rows and np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_forward_sums_all_segmentations():
    vocabulary = language_id.Pieces(["a", "b", "ab", "ba", "aba"])
    p = np.array([[0.0], [1e-7], [0.1], [0.2], [0.3], [0.15], [0.25]])
    by_hand = 0.1 * 0.2 * 0.1 + 0.3 * 0.1 + 0.1 * 0.15 + 0.25
    with np.errstate(divide="ignore"):
        assert np.isclose(np.exp(language_id.log_probability(["aba"], vocabulary, np.log(p)))[0, 0], by_hand)


def brute_log_probability(word, p):
    """All segmentations, one letter after another; ``p``: probability by piece."""
    longest = max(map(len, p))
    alpha = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        alpha[j] = sum(alpha[i] * p.get(word[i:j], 1e-7 if j - i == 1 else 0.0) for i in range(max(0, j - longest), j))
    return np.log(alpha[-1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=7), min_size=1, unique=True), st.text(alphabet="abcéx", min_size=1, max_size=40))
def test_forward_against_brute_force(texts, word):
    vocabulary = language_id.Pieces(texts)
    p = np.concatenate([[0.0, 1e-7], np.linspace(0.1, 0.9, len(texts))])[:, None]
    with np.errstate(divide="ignore"):
        got = language_id.log_probability([word], vocabulary, np.log(p))[0, 0]
    assert np.isclose(got, brute_log_probability(word, dict(zip(texts, p[2:, 0]))))


def test_expected_uses_sum_up(spark):
    vocabulary = language_id.Pieces(["a", "b", "ab", "ba", "aba"])
    with np.errstate(divide="ignore"):
        log_p = np.log(np.array([0.0, 1e-7, 0.1, 0.2, 0.3, 0.15, 0.25]))
    used = language_id.expected(["aba", "bab"], vocabulary, log_p, np.array([2.0, 1.0]))
    assert np.isclose(sum(n * len(t) for n, t in zip(used[2:], vocabulary.texts)), 9.0)


def test_language_of_long_words_and_long_pieces():
    vocabulary = language_id.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert vocabulary.width == 16 and len(vocabulary) == 20_231
    assert language_id.words_of("Aa" * 50 + " b1c") == ["aa" * 50, "b", "c"]
    p = np.full((len(vocabulary) + 2, 2), 0.5 / len(vocabulary))
    p[0], p[1] = 0.0, 1e-7
    longest = next(t for t in vocabulary.texts if len(t) == 16)
    p[2 + vocabulary.texts.index(longest), 1] = 0.5
    model = language_id.Model(["x", "y"], vocabulary, p)
    texts = [longest, longest * 3, longest * 5000, "q" * 100_000, "1 2", None, longest + " " + longest * 90]
    got = list(model.posteriors(texts))
    assert [lang for lang, _ in got] == ["y", "y", "y", "x", "und", "und", "y"]  # equal chances: the first language
    assert all(0 <= s <= 1 for _, s in got) and got[3][1] == 0.5


def test_language_learns_nothing_from_held_out_rows(spark):
    rows = [(i, ("der die das und" if i % 2 else "the and of with") + f" {'abcdefgh'[i % 8] * 3}") for i in range(400)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en"))
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    path = public_tokenizers.path("piece_bpe_32k.model")
    a, b = language_id.train(docs, path), language_id.train(wrong, path)
    assert held and a.languages == b.languages == ["de", "en"] and np.allclose(a.p, b.p)
    found = {r.doc_id: r for r in language_id.identify(docs, a).collect()}
    assert all(found[i].held_out and found[i].lang_pred == ("de" if i % 2 else "en") for i in held)
    assert {r.doc_id % 2 for r in language_id.identified_only(docs, a, ["de"], 0.5).collect()} == {1}

def test_decontamination_finds_short_items_and_places(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, "A b c d e f g h i j k l"), (3, None), (None, "zz"), (4, "...")], "item_id long, text string")
    docs = documents(spark, [(1, "x One, TWO; three!"), (2, "b c d e f g h i j k"), (3, "zz"), (4, None)])
    for block_words in (2, 10**6):
        rows = {r.doc_id: r for r in decontaminate.contamination(docs, bench, block_words=block_words).collect()}
        assert [(rows[i].n_words, rows[i].n_hit, rows[i].items) for i in (1, 2, 3, 4)] == [(4, 3, ["1"]), (10, 10, ["2"]), (1, 1, []), (0, 0, [])]
        assert [tuple(s) for s in rows[1].hit_spans] == [(2, 17)]
        assert {r.doc_id for r in decontaminate.clean_only(docs, bench, block_words=block_words).collect()} == {4}


@pytest.mark.parametrize("block_words", [5, 10**6])
def test_decontamination_scans_odd_rows(spark, odd, block_words):
    bench = spark.createDataFrame([("p", "a b"), ("q", "word " * 12), ("p", "a b"), (None, "x" * 50_000), ("r", "never there")], "item_id string, text string")
    rows = decontaminate.digest(decontaminate.contamination(odd, bench, block_words=block_words)).collect()
    assert sorted(((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in rows)) == sorted(
        [("1", 0, 0, 0), ("2", 0, 0, 0), ("3", 2, 2, 1), ("4", 2, 2, 1), ("4", 2, 2, 1), ("None", 2, 2, 1), ("5", 40_000, 40_000, 1), ("6", 0, 0, 0), ("7", 1, 1, 0)]
    )
    clean = decontaminate.clean_only(odd, bench, block_words=block_words)
    assert clean.columns == odd.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 6]
    assert decontaminate.contamination(odd.limit(0), bench, block_words=block_words).count() == 0


def brute_substring(rows, window):
    words = {i: (t or "").split() for i, t in rows}
    starts = {}
    for i, w in words.items():
        for p in range(len(w) - window + 1):
            starts.setdefault(tuple(w[p : p + window]), set()).add(i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if min(starts[tuple(w[p : p + window])]) < i:
                gone |= set(range(p, p + window))
        out[i] = hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()
    return out


def test_substring_dedup_against_brute_force(spark):
    rng = np.random.default_rng(11)
    passages = [" ".join(rng.choice(list("abcdefgh"), 14)) for _ in range(4)]
    rows = [(i, " ".join(str(rng.choice(passages)) if rng.random() < 0.5 else " ".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(rng.integers(1, 9)))) for i in range(60)]
    rows += [(60, "a " * 80), (61, "a " * 90), (62, None), (63, "")]
    got = {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_dedup(documents(spark, rows), window=8, k=3, block=5).collect()}
    assert got == brute_substring(rows, 8)


def test_substring_dedup_compares_the_words(spark):
    tm = [bin(i).count("1") % 2 for i in range(2048)]  # collides under sums of powers modulo 2**64
    word = ["".join("ab"[b ^ flip] for b in tm) for flip in (0, 1)]
    head = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{head} {word[0]}"), (2, f"{head} {word[1]}"), (3, " ".join("xy"[b] for b in tm)), (4, " ".join("yx"[b] for b in tm)), (5, f"{head} {word[0]} end"), (6, f"start {head}\t{word[1]}")]
    for t in (2, 3, 5):  # two rows of one doc_id, and a repeated row
        rows.append((7, rows[t][1] + " more"))
    rows.append(rows[-1])
    got = substring_dedup.substring_dedup(documents(spark, rows)).collect()
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (1, 2, 5)} == {1: 0, 2: 0, 5: 50}
    expected = brute_substring(rows[:6], 50)
    assert {r.doc_id: r.kept_sha256 for r in got if r.doc_id < 7} == expected
    assert sorted(r.n_removed for r in got if r.doc_id == 7) == [51, 51, 2048, 2048]


def test_substring_dedup_under_colliding_digests(spark):
    rows = [(i, " ".join(f"{'abc'[i % 3]}{j}" for j in range(12)) + " p q r s t u v w x y z " + str(i)) for i in range(9)]
    got = substring_dedup.substring_dedup(documents(spark, rows), window=8, k=3, key=lambda words: 7).collect()
    exact = {r.doc_id: {p for s in r.removed for p in range(s["first"], s["after"])} for r in substring_dedup.substring_dedup(documents(spark, rows), window=8, k=3).collect()}
    assert all({p for s in r.removed for p in range(s["first"], s["after"])} <= exact[r.doc_id] for r in got) and exact[3]


def test_toxicity_learns_words_and_folds(spark, sf_dir):
    model = toxicity.Model({" idiot ": 5.0, " trash ": 5.0, " moron ": 5.0}, (-3.0, 1.0, 5.0))
    a = model.automaton()
    assert len(toxicity.matches(toxicity.fold("1d10t! mоr0n, trash$$$"), a)) == 3
    assert not toxicity.matches(toxicity.fold("the trash can, idiotic"), a)
    many = toxicity.fold("trash can idiot " * 100_000)
    assert len(toxicity.matches(many, a)) == 100_000
    rows = queries.op9_toxicity(spark, sf_dir).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def brute_matches(folded, model):
    """Every entry and exception tried at every space."""
    found, spared = {}, set()
    for at in (i for i, c in enumerate(folded) if c == " "):
        for phrase in model.exceptions:
            if folded.startswith(f" {phrase} ", at):
                spared |= set(range(at, at + len(phrase) + 1))
        for entry, weight in model.weights.items():
            if folded.startswith(entry, at):
                found[at] = max(weight, found.get(at, 0))
    return {at: w for at, w in found.items() if at not in spared}


WORDS = ["trash", "can", "idiot", "idiots", "trasher", "the", "clown", "fish", "m0ron", "proof", "!", "7"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=40))
def test_toxicity_matches_against_brute_force(words):
    model = toxicity.Model({" idiot ": 5.0, " idio": 4.0, " trash ": 5.0, " tras": 3.6, " clown ": 4.0, " moron ": 6.0}, (-3.0, 1.0, 5.0))
    folded = toxicity.fold(" ".join(words))
    assert toxicity.matches(folded, model.automaton()) == brute_matches(folded, model)


def test_toxicity_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    assert model.weights
    for r in queries.op9_toxicity(spark, "/root/testdata/sf0.01").collect():
        folded = toxicity.fold(texts[r.doc_id])
        total = sum(brute_matches(folded, model).values()) if any(e in folded for e in model.weights) else 0.0
        x = (np.log1p(total), np.log1p(total / np.sqrt(max(folded.count(" ") - 1, 1))))
        z = model.coefficients[0] + model.coefficients[1] * x[0] + model.coefficients[2] * x[1]
        assert np.isclose(r.score, 1 / (1 + np.exp(-np.clip(z, -40, 40))))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)


def test_toxicity_held_out_quality(spark):
    labels = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in queries.op9_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = ([s for s, t in rows if t == k] for k in (1, 0))
    assert len(toxic) > 20 and np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.95


def test_toxicity_learns_exceptions_and_ties(spark):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5][:1200]
    texts = [f"you grubby person {i % 7}" if i % 2 else ("a grubby apron" if i % 100 == 0 else f"calm sea {i % 5}") for i in range(1200)]
    docs = documents(spark, list(zip(ids, texts)) + [(5001, "one grubby apron"), (5002, "so grubby"), (5003, "so grubby"), (5004, None), (None, "grubby")])
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert "grubby apron" in model.exceptions and " grubby " in model.weights
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[5001].predicted == 0 and got[5002].predicted == 1 and got[5002].score == got[5003].score and got[5004].predicted == 0 and not got[None].held_out
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_toxicity_keeps_every_entry_over_the_threshold(spark):
    ids = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5][:5010]
    words = [f"x{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"][:450]
    texts = ["calm"] * 810
    for k, w in enumerate(words):
        for i in range(3):
            texts[(3 * k + i) % 810] += " " + w
    docs = documents(spark, list(zip(ids, texts + ["calm sea"] * 4200)))
    labels = spark.createDataFrame([(i, 1, int(k < 810)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    assert set(toxicity.train(docs, labels).weights) == {f" {w} " for w in words}


@pytest.fixture(scope="module")
def tokens():
    return token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_token_counts_after_edits(tokens):
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice(["it's", "the", "12", "  ", "é", "...", "\n\n", "word", "漢字ドラゴンの覚醒裏", "日本語テキスト" * 20], 900))
    tree = token_counts.Tree.build(text, tokens, leaf=16)
    assert tree.total == tokens.count(text)
    for _ in range(150):
        kept = []
        for a in sorted(rng.integers(0, len(text) + 1, rng.integers(1, 5)).tolist()):
            b = min(len(text), a + int(rng.integers(0, 60)))
            if not kept or a >= kept[-1][1]:
                kept.append((a, b, str(rng.choice(["", " ", "x", " new text ", "'s", "ゴ", "\n"]))))
        text = tree.edit(text, kept, tokens, leaf=16)
        assert tree.total == tokens.count(text) and sum(n for n, _ in tree.leaves) == len(text)
        assert tree.sums[1, 0] == len(text)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab 's1漢字ゴドの裏é\n", max_size=300), st.lists(st.tuples(st.integers(-3, 310), st.integers(-3, 310), st.text(alphabet="a 'l漢ゴ\n", max_size=6)), max_size=6), st.integers(1, 40))
def test_any_edits_give_the_count_of_the_new_text(text, edits, leaf):
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    kept, skipped = token_counts.settled_edits([{"start": a, "stop": b, "put": p} for a, b, p in edits], len(text))
    expected = text
    for a, b, p in reversed(kept):
        expected = expected[:a] + p + expected[b:]
    tree = token_counts.Tree.build(text, c, leaf)
    assert tree.edit(text, kept, c, leaf) == expected and tree.total == c.count(expected) and len(kept) + skipped == len(edits)


def recounted(spark, rows):
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}, n_tokens int, leaf int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    trees = token_counts.count(df, path, public_tokenizers.PATTERN).join(df.select(F.col("doc_id").alias("d"), "edits"), F.expr("doc_id <=> d"))
    got = {r.doc_id: r for r in token_counts.recount(trees, path, public_tokenizers.PATTERN).collect()}
    assert got == {r.doc_id: r for r in token_counts.count_edited(df, path, public_tokenizers.PATTERN).collect()}
    return got


def test_token_counts_of_overlapping_edits_and_odd_rows(spark, tokens):
    got = recounted(spark, [(1, "0123456789", [(5, 10, ""), (3, 8, "X")], 0, 0), (2, None, [(0, 4, "new")], 0, 0), (None, "a b", None, 0, 0), (3, "word " * 40_000, [(-5, 3, "x"), (10**6, 10**7, "end"), (7, 2, None)], 0, 0), (4, "", [], 0, 0)])
    assert (got[1].new_text, got[1].n_skipped, got[1].n_edits) == ("01234", 1, 1)
    assert (got[2].new_text, got[None].new_text, got[4].n_tokens_after) == ("new", "a b", 0)
    assert got[3].new_text == "xd " + "word " * 39_999 + "end" and got[3].n_edits == 3
    assert all(r.n_tokens_after == tokens.count(r.new_text) for r in got.values())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_token_counts_of_a_text_without_spaces(tokens):
    text = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(100_000))
    tree = token_counts.Tree.build(text, tokens)
    new = tree.edit(text, [(50_000, 50_003, "字")], tokens)
    assert len(tree.leaves) > 100 and tree.work < 3000 and tree.total == tokens.count(new)
    grown = tree.edit(new, [(10, 10, new[:9000])], tokens)
    assert tree.total == tokens.count(grown) and max(n for n, _ in tree.leaves) < 3000


def test_token_count_query_against_full_recount(spark, sf_dir):
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op10_token_counts(spark, sf_dir).collect():
        after = regex.sub(queries.PERSONAL, "[removed]", texts[r.doc_id])
        assert (r.n_tokens, r.n_tokens_after) == (c.count(texts[r.doc_id]), c.count(after))


PAGE = """<html><head><title>T</title></head><body><nav class=menu><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div id=content><h1>Head {0}</h1><p>First &amp; best<br>line {0}<p>Second <b>bold</b>   {0}</div><aside>Side</aside>
<div class="comments"><p>reader says {0}</p></div><form>Name</form><script>var x="</div>";</script><footer>Foot</footer></body></html>"""


def test_html_text_without_an_article_tag(spark):
    pages = [(i, "http://h.example.com/x", PAGE.format(i)) for i in range(8)] + [(8, None, None), (9, "http://o.example.com", "<article><h2>Only</h2> text</article>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3 First & best line 3 Second bold 3"
    assert got[8] == "" and got[9] == "Only text"


def read_page(source, others=()):
    """Main text of a page under the wrapper of itself and ``others``, and that wrapper."""
    whole = [None, None]
    for page in (source, *others):
        whole = html_text._joined(whole, html_text.page_layouts(html_text.parse(page)[1]))
    reader = html_text.Reader(html_text._dump([w and html_text.judge(w) for w in whole]))
    return reader.read(source), whole[1] or whole[0]


def test_html_deep_pages():
    deep = "<article>" + "<div>" * 20_000 + "x<nav>menu</nav>y" + "</div>" * 20_000 + "<p>z</p></article>"
    assert read_page(deep, [deep])[0] == ["x", "y", "z"]


def test_html_wide_pages_keep_a_bounded_wrapper():
    wide = "<article>" + "".join(f"<h2>a{i}</h2><p>b{i}</p>" for i in range(2000)) + "</article>"
    text, wrapper = read_page(wide, [wide + "<i>x</i>"])
    assert len(text) == 4000 and len(wrapper.kids[0].kids) <= html_text.MAX_BLOCKS
    names = [a + b for a in "qwertyuiop" for b in "asdfghjklz"]
    odd = [f"<article>{''.join(f'<div id={n}{m}>t</div><div class=ad-{n}{m}>no</div>' for m in names[:50])}</article>" for n in names[:6]]
    text, wrapper = read_page(odd[0], odd[1:])
    assert text == ["t"] * 50 and len(wrapper.kids[0].kids) <= html_text.MAX_BLOCKS + 2


def test_html_custom_and_self_closing_tags():
    assert read_page("<p>a</p><template-x>b</template-x><svg width=1/><p>c</p><svg><path d=1/>no</svg><p>d")[0] == ["a", "b", "c", "d"]


def extracted(spark, pages):
    """page_id: blocks of main text of (page_id, url, html) rows."""
    return {r.page_id: r.blocks for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_html_host_with_and_without_articles(spark):
    old = [(i, None, PAGE.format(i)) for i in range(4)]
    new = [(4, None, "<main><p>Home</p></main><div>after</div>"), (5, "no scheme", "<div role=main><p>Five</p></div>"), (6, None, "<main><nav>menu</nav></main><div><p>six</p></div>")]
    got = extracted(spark, old + new)
    assert all(got[i][0] == f"Head {i}" and len(got[i]) == 3 for i in range(4))
    assert (got[4], got[5], got[6]) == (["Home"], ["Five"], ["six"])


def test_html_template_texts_are_whole_and_on_different_pages():
    lead = "BERLIN, from our correspondent who reports every day on the matters of the town and its people: "
    news = [f"<div id=x><h1>{lead}{i}</h1><pre>{lead}body {i}</pre></div><div id=y>About us</div>" for i in range(5)]
    assert read_page(news[1], news)[0] == [lead + "1", lead + "body 1"]
    copy = "<div><h1>Head</h1><pre>Body</pre></div><div class=menu>Menu {}</div>"
    assert read_page(copy.format(0), [copy.format(i) for i in range(5)])[0] == ["Head", "Body"]
    parts = ["<div id=a>One</div>", "<pre>Two</pre>", "<section>Three</section>", "<h2>Four</h2>"]
    few = ["".join(p for j, p in enumerate(parts) if j != i) for i in range(4)]
    assert read_page(few[3], few)[0] == ["One", "Two", "Three"]


def test_html_template_inside_articles(spark):
    page = "<article><h1>News</h1>{}<p>Share this with your friends</p>{}</article><div>after</div>"
    lines = [page.format("".join(f"<p>line {i} {j}</p>" for j in range(i % 3 + 1)), "<div>Offer of the day</div>" * (i % 2)) for i in range(6)]
    got = extracted(spark, [(i, "http://a.org/x", p) for i, p in enumerate(lines)] + [(i, "http://b.org/x", lines[1]) for i in range(10, 14)])
    assert all(got[i] == ["News", *(f"line {i} {j}" for j in range(i % 3 + 1))] for i in range(6))  # a heading is the article's
    assert all(got[i] == ["News", "line 1 0", "line 1 1", "Share this with your friends", "Offer of the day"] for i in range(10, 14))


def test_html_headings_and_inner_template_belong_to_the_article(spark):
    page = "<article><p>Read us daily</p><h1>Title {0}</h1><p>By Ann Other</p><h2>Summary</h2><div>{0} in short</div><h2>Results</h2><table><caption>Values</caption><tr><th>Year</th><td>{0}</td></tr></table><h2>Conclusion</h2><div>so {0}</div><p>Share this page</p></article>"
    pages = [(i, "http://a.org/x", page.format(i)) for i in range(5)]
    expected = lambda i: [f"Title {i}", "By Ann Other", "Summary", f"{i} in short", "Results", "Values", "Year", str(i), "Conclusion", f"so {i}"]
    got = extracted(spark, pages)
    assert all(got[i] == expected(i) for i in range(5))
    alone = extracted(spark, [*pages, (9, "http://a.org/x", page.format(9).replace("<h2>Summary</h2>", "").replace("<p>By Ann Other</p>", ""))])
    assert all(alone[i] == expected(i) for i in range(5))  # whether a neighbour lacks them does not matter


def test_html_template_among_many_kinds_of_blocks():
    names = [a + b for a in "qwertyuiop" for b in "asdfghjklz"][:90]
    pages = ["<article>" + "".join(f"<section id={n}>{n} {i}</section><section id={n}x>always {n}</section>" for n in names) + "</article>" for i in range(5)]
    text, wrapper = read_page(pages[2], pages)
    assert len(wrapper.kids[0].kids) <= html_text.MAX_BLOCKS + 2
    assert [t for t in text if t.endswith(" 2")] == [f"{n} 2" for n in names]
    assert set(text) >= {f"always {n}" for n in names[:-1]}


def test_html_skeletons_of_a_host_are_aligned_in_as_many_rounds_as_it_needs(spark, monkeypatch):
    page = "<article><h1>Title {0}</h1>{1}<div>own {0}</div><p>Share this page</p></article>"
    inner = lambda i: "".join(f"<section id={'qwerty'[j]}>part {i} {j}</section>" for j in range(6) if i >> j & 1)
    pages = [(i, "http://big.org/x", page.format(i, inner(i))) for i in range(64)] + [(100 + i, f"http://h{i % 3}.org/x", page.format(i, "")) for i in range(12)]
    expected = {i: [f"Title {i}", *(f"part {i} {j}" for j in range(6) if i >> j & 1), f"own {i}"] for i in range(64)} | {100 + i: [f"Title {i}", f"own {i}"] for i in range(12)}
    assert extracted(spark, pages) == expected
    monkeypatch.setattr(html_text, "GROUP", 3)
    taken, write = [], html_text.materialise
    monkeypatch.setattr(html_text, "materialise", lambda df: taken.append(write(df)) or taken[-1])
    assert extracted(spark, pages) == expected
    rows = [t.where("host = 'big.org'").count() for t in taken if "wrapper" in t.columns]
    assert rows[0] == 64 and rows[-1] == 1 and len(rows) >= 4 and rows == sorted(rows, reverse=True)


def test_html_pages_whose_names_are_all_their_own_have_no_wrapper(spark):
    names = lambda i, d: [f"{chr(97 + i)}{'xyz'[d - 1]}{c}" for c in "abcdefgh"]  # noqa: E731  # (digits do not tell names apart)
    page = lambda i: "<article><h1>T</h1>" + "".join(f"<div id={a}>" + "".join(f"<div id={b}>" + "".join(f"<div id={c}>{i} {a} {b} {c}</div>" for c in names(i, 3)) + "</div>" for b in names(i, 2)) + "</div>" for a in names(i, 1)) + "</article>"
    pages = [(i, "http://hashed.org/x", page(i)) for i in range(24)]
    whole = [None, None]
    for _, _, source in pages:
        whole = html_text._joined(whole, html_text.page_layouts(html_text.parse(source)[1]))
    assert whole[1].label == html_text._BEYOND and not whole[1].kids
    assert html_text._joined(whole, html_text.page_layouts(html_text.parse("<article>x</article>")[1]))[1].label == html_text._BEYOND
    got = extracted(spark, [*pages, (99, "http://hashed.org/y", "<article>plain</article>")])
    assert got[99] == ["plain"]
    assert all(got[i] == ["T", *(f"{i} {a} {b} {c}" for a in names(i, 1) for b in names(i, 2) for c in names(i, 3))] for i in range(24))


def test_html_wrappers_beyond_the_broadcast_are_joined(spark, monkeypatch):
    pages = [(i, f"http://h{i % 3}.org/x", PAGE.format(i)) for i in range(12)] + [(20, None, None)]
    plain = extracted(spark, pages)
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 10)
    assert extracted(spark, pages) == plain and plain[20] == []


def test_html_comments_word_breaks_and_ambiguous_names():
    assert read_page("<p>long<wbr>word</p><!-- no --!><p>after</p><!--> <p>x</p><!-- open <p>lost</p>")[0] == ["longword", "after", "x"]
    page = "<article><p>a</p><div class='content-widget'><p>b</p></div><div class='search results'><p>c</p></div><div class='user-reviews'>no</div><div id=responses>no</div><div class=widget>no</div><div class=search>no</div></article>"
    assert read_page(page)[0] == ["a", "b", "c"]


def test_html_wrapper_not_tag_separates_text_and_template(spark):
    page = "<div><div>Hello reader</div><div>Story {0} begins</div><div>{1}</div><div>and ends {0}</div><div>Call us any time</div></div>"
    pages = [(i, "http://n.org/", page.format(i, "Sale today" if i % 2 else f"own line {i}")) for i in range(8)]
    assert extracted(spark, pages)[2] == ["Story 2 begins", "own line 2", "and ends 2"]
    # each page under a wrapper of its own cannot tell them apart
    assert len(read_page(pages[2][2])[0]) == 5


def test_html_names_are_read_whole(spark):
    long = "x" * 300
    page = f"<article><p>a</p><div class='{long} comments'><p>reader</p></div><div class='{long}'><p>b</p></div><section id=discussion><p>c</p></section><div class='related work'><p>d</p></div><div class='market-share'><p>e</p></div><div class='reader-comments box'><p>no</p></div><div class=related-posts>no</div></article>"
    assert read_page(page)[0] == ["a", "b", "c", "d", "e"]


def test_html_wrapper_does_not_depend_on_the_order_of_pages(spark):
    rng = np.random.default_rng(9)
    kinds = ["<h2>h</h2>", "<div id=a>a</div>", "<pre>p</pre>", "<section>s</section>", "<table><tr><td>t</td></tr></table>"]
    pages = [(i, "http://h.org/", "<main>" + "".join(kinds[j] for j in rng.permutation(5)[: rng.integers(1, 6)]) + f"{i}</main>") for i in range(60)]
    frames = [spark.createDataFrame([pages[i] for i in rng.permutation(60)], "page_id long, url string, html string").repartition(n) for n in (1, 3, 7)]
    found = [sorted(map(tuple, html_text.wrappers(f).select("host", "wrapper").collect())) for f in frames]
    assert found[0] == found[1] == found[2] and "(" in html_text.expression(html_text._load(found[0][0][1])[1])


def test_html_odd_tables(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://a.org", "<p>x</p>"), (1, "http://a.org", "<p>x</p>"), (None, None, None), (2, "http://b.org", ""), (3, "::", "<p>" + "y " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("host", "wrapper", "judged", "salt", "skeleton", "text", "blocks")})
    assert sorted((str(r.page_id), r.n_chars) for r in html_text.extract(df).collect()) == [("1", 1), ("1", 1), ("2", 0), ("3", 99_999), ("None", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


class ArticleText(HTMLParser):
    """Plain second reading of the given pages: what stands in their article element."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag not in ("b", "i", "a"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag not in ("b", "i", "a"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_html_query_against_another_parser(spark, sf_dir):
    html = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()}
    for r in queries.op2_html_extraction(spark, sf_dir).collect():
        assert r.text == " ".join("".join(ArticleText(html[r.page_id]).parts).split())


def test_html_query_takes_articles_only(spark, sf_dir):
    rows = queries.op2_html_extraction(spark, sf_dir).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) and "&copy;" not in r.text and "\n" not in r.text for r in rows)


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance\nwith the License."
    docs = documents(spark, [(1, "x\nReleased under the MIT License."), (2, apache), (3, "All rights reserved. licensed under CC BY-NC 4.0."), (4, None), (5, "the mit license")])
    got = {r.doc_id: (r.licence, r.licences) for r in licenses.scan(docs).collect()}
    assert got == {1: ("MIT", "MIT"), 2: ("Apache-2.0", "Apache-2.0"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0,proprietary"), 4: ("none", ""), 5: ("none", "")}


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
NO_NAME = "3. Neither the name of {} nor the names of its contributors may be used to endorse\nor promote products derived from this software without specific prior written permission.\n"
GNU = """ * This {} is free software{} you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation{} {}
 *
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
LATER = "either version {} of the License, or\n * (at your option) any later version."
FEE = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
STANDARD = {
    "BSD-2-Clause": [BSD.format("")],
    "BSD-3-Clause": [BSD.format(NO_NAME.format(n)) for n in ("the copyright holder", "Example & Sons, Inc", "the University nor Example Labs")],
    "GPL-2.0-or-later": [GNU.format("program", ";", "", ";", LATER.format(2))],
    "GPL-2.0-only": [GNU.format("program", ";", "", ";", "version 2 of the License."), "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "GPL-3.0-or-later": [GNU.format("program", ":", "", ",", LATER.format(3)), GNU.format("program", ";", "", ";", LATER.format(3))],
    "LGPL-2.1-or-later": [GNU.format("library", ";", "Lesser ", ";", LATER.format("2.1"))],
    "LGPL-3.0-or-later": [GNU.format("library", ":", "Lesser ", ",", LATER.format(3))],
    "AGPL-3.0-or-later": [GNU.format("program", ":", "Affero ", ",", LATER.format(3))],
    "MPL-2.0": ["/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"],
    "ISC": [FEE + ", provided that the above\ncopyright notice and this permission notice appear in all copies."],
    "0BSD": [FEE + "."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to"],
    "Zlib": ["1. The origin of this software must not be misrepresented; you must not\n   claim\n2. Altered source versions must be plainly marked as such, and must not be\n   misrepresented as being the original software."],
}


MIT = """MIT License

Copyright (c) 2024 Example & Sons, Inc.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Copyright {} The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
STANDARD |= {
    "MIT": [MIT, MIT.replace("\n\nPermission", "\nPermission"), MIT.replace("\n", "\r\n"), "SPDX-License-Identifier: MIT"],
    "Apache-2.0": [APACHE.format(2020), APACHE.format("(c) 2020-2024"), APACHE.format("© 2020").replace("\n\nLicensed", "\nLicensed"), "// SPDX-License-Identifier: Apache-2.0\nint x;"],
    "EPL-2.0": ["This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n\nSPDX-License-Identifier: EPL-2.0"],
}


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_standard_licence_texts(spark, prefix):
    texts = [(name, text) for name, all_of in STANDARD.items() for text in all_of]
    shown = ["Some code.\n" + "\n".join(prefix + line for line in text.split("\n")) for _, text in texts]
    got = {r.doc_id: r.licence for r in licenses.scan(documents(spark, list(enumerate(shown)))).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]


def test_odd_rows_do_not_break_an_operator(spark, odd):
    path, ranks = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    model = language_id.train(odd, public_tokenizers.path("piece_bpe_32k.model"))
    results = [
        licenses.scan(odd), bpe.encode_decode(odd, path), language_id.identify(odd, model), language_id.identified_only(odd, model), simhash.simhash_components(odd),
        decontaminate.contamination(odd, spark.createDataFrame([], "item_id long, text string")), substring_dedup.substring_dedup(odd), toxicity.score(odd, toxicity.train(odd, labels)),
        token_counts.count(odd, ranks, public_tokenizers.PATTERN),
    ]
    assert [r.count() for r in results] == [9, 9, 9, 6, 9, 9, 9, 9, 9]
    empty = odd.limit(0)
    assert exact_dedup.exact_dedup(empty).count() == 0 and simhash.simhash_components(empty).count() == 0 and substring_dedup.substring_dedup(empty).count() == 0
    assert language_id.identify(empty, language_id.train(empty, public_tokenizers.path("piece_bpe_32k.model"))).count() == 0


def test_pipeline_against_its_operators(spark, sf_dir):
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    chances = [dict(zip(model.vocabulary.texts, column)) for column in model.p[2:].T.tolist()]
    logs = functools.cache(lambda word: np.array([brute_log_probability(word, p) for p in chances]))

    def identified(text):
        words = regex.findall(r"\p{L}+", (text or "").lower())
        if not words:
            return False
        total = sum(logs(w) for w in words)
        best = int(np.argmax(total))
        return model.languages[best] in corpus_pipeline.LANGUAGES and 1 / np.exp(total - total[best]).sum() >= corpus_pipeline.MIN_SCORE

    stays = [(i, t) for i, t in docs if identified(t)]
    best = {}
    for i, t in stays:
        key = "".join((t or "").split(" ")).translate({c: None for c in range(9, 14)})
        best[key] = min(best.get(key, (0, i)), (-len(t), i)) if key in best else (-len(t), i)
    kept = {i for _, i in best.values()}
    stays = [(i, t) for i, t in stays if i in kept]
    component = brute_components([i for i, _ in stays], [brute_fingerprint(t) for _, t in stays])
    stays = [(i, t) for i, t in stays if component[i] == i]
    windows = set().union(*(decontaminate.item_windows(r[0]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()))
    lengths = {len(w) for w in windows}

    def clean(text):
        words = decontaminate.words_of(text)
        return not any(tuple(words[i : i + n]) in windows for n in lengths for i in range(len(words) - n + 1))

    stays = [(i, t) for i, t in stays if clean(t)]
    assert set(got) == {i for i, _ in stays}
    t = bpe.encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    assert all(got[i].n_tokens == len(t.encode(x, add_special_tokens=False).ids) for i, x in stays)
