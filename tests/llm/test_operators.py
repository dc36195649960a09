"""The ten operators against plain Python, on whole small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import ascii_lower, near_classes
from compare import of_spark, of_sql

from docspark.llm import decontaminate, language, license_scan, mixing, near_dedup, quality, queries, token_output
from docspark.llm.exact_dedup import exact_dedup
from docspark.llm.near_dedup import near_duplicates, without_near_duplicates
from docspark.llm.sharding import assign_shards
from docspark.llm.suffix_dedup import suffix_dedup

LONG = "the quick brown fox jumps over one lazy dog while counting word number "
SCHEMA = "doc_id long, text string, lang string, source string, DOC_ID string, n_chars long"


@pytest.fixture(scope="module")
def plain(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return [(r.doc_id, r.text, r.lang, r.source) for r in found]


@pytest.fixture(scope="module")
def awkward(spark):
    very_long = " ".join(f"{LONG}{i}" for i in range(20_000))
    rows = [
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, " \t\n", "en", "a"),
        (4, "Alpha beta", "en", "a"),
        (5, "Alpha beta", "en", "a"),
        (5, "Alpha beta", "en", "a"),
        (None, "alpha BETA", "en", "b"),
        (7, very_long, "en", "a"),
        (8, very_long + " tail", None, "b"),
        (9, "Ünïcödé Öl ÄÖ \0 null byte 🙂", "de", "b"),
        (10, "12 34 !!", None, "a"),
        (11, "<|endoftext|>  two  spaces ", "en", "a"),
        (12, "glued<|endoftext|>words <|endoftext|> and<|endoftext|> <|endoftext|>more", "en", "a"),
    ]
    wide = [(i, t, lang, s, "clash", 1) for i, t, lang, s in rows]
    return spark.createDataFrame(wide, "a long, b string, c string, d string, e string, f long").toDF(*[c.split()[0] for c in SCHEMA.split(", ")])


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def repeated_bytes(rows, size=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + size] for _, b in texts for k in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone, last, spans = np.zeros(len(b), bool), 0, 0
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[max(k, last) : k + size] = True
                last = k + size
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def by_repr(rows):
    return sorted(map(repr, rows))


def test_op1_equals_brute_force(spark, sf_dir, plain):
    got = [tuple(r) for r in queries.op1_suffix_dedup(spark, sf_dir).collect()]
    assert by_repr(got) == by_repr(repeated_bytes([r[:2] for r in plain]))


def test_op1_awkward(spark):
    block = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    rows = [(1, "x" * 1000), (2, block), (3, "lead " + block[100:650] + " tail"), (4, None), (None, "x" * 399), (5, block), (5, block)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup(docs).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long)", "kept_sha256").collect()
    assert by_repr(tuple(r) for r in got) == by_repr(repeated_bytes(rows))
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup(docs).where("doc_id in (3, 4)").collect()}
    assert kept == {3: b"lead  tail", 4: b""}
    assert suffix_dedup(docs.limit(0)).count() == 0


def test_op2_law_of_bytes(spark, sf_dir, plain):
    rows = queries.op2_sharding(spark, sf_dir).collect()
    sizes = {i: len((t or "").encode()) + 1 for i, t, *_ in plain}
    assert {r.doc_id: r.size for r in rows} == sizes
    assert {r.doc_id: r.text_crc32 for r in rows} == {i: zlib.crc32((t or "").encode()) for i, t, *_ in plain}
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append((r.slot, r.doc_id, r.size))
    target = sum(sizes.values()) / 8
    assert sorted(shards) == list(range(8))
    for members in shards.values():
        assert sorted(s for s, *_ in members) == list(range(len(members)))
        assert abs(sum(x[2] for x in members) - target) <= max(sizes.values())
    order = [i for k in range(8) for _, i, _ in sorted(shards[k])]
    assert order == sorted(order)


def test_op2_awkward(awkward, empty):
    assert assign_shards(awkward).count() == awkward.count()
    assert assign_shards(empty).count() == 0


def test_op3_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    scores = queries.op3_quality(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = scores.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows) > 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scores.collect())


def test_op3_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.train(awkward, labels), quality.train(awkward, labels.limit(0)), quality.train(empty, labels)):
        found = quality.quality_scores(awkward, model).collect()
        assert len(found) == 13 and all(0 <= r.score <= 1 for r in found)
        assert quality.quality_scores(empty, model).count() == 0
        assert quality.good_documents(awkward, model).columns == awkward.columns


def test_op4_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in queries.op4_language(spark, sf_dir).collect() if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows) > 0


def test_op4_awkward(awkward, empty):
    found = language.predict_language(awkward, language.train(awkward)).collect()
    assert len(found) == 13
    assert {r.doc_id for r in found if r.lang_pred == "und"} >= {1, 2, 3, 10}
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    assert {r.lang_pred for r in language.predict_language(awkward, language.train(empty)).collect()} == {"und"}
    assert language.predict_language(empty, language.train(empty)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert of_spark(queries.QUERIES[name](spark, sf_dir)) == of_sql(queries.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("max_bits", [1 << 15, 1 << 27])
def test_op5_awkward(awkward, empty, max_bits):
    rows = exact_dedup(awkward, max_bits=max_bits).collect()
    groups = Counter(hashlib.sha256(ascii_lower(r.text or "").encode()).hexdigest() for r in awkward.select(awkward.columns[1]).toDF("text").collect())
    assert Counter(r.text_sha256 for r in rows) == groups
    assert all(r.group_size == groups[r.text_sha256] for r in rows)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(list(groups))
    assert {r.keep_id for r in rows if r.doc_id in (4, 5, None)} == {5}
    assert exact_dedup(empty).count() == 0


def test_op6_awkward(spark, awkward, empty):
    assert license_scan.license_scan(awkward).count() == awkward.count()
    assert license_scan.license_scan(empty).count() == 0
    rows = [
        (1, "CC BY cc-by\nall rights\nreserved"),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of that software"),
        (3, "rights all reserved; General publiC license"),
    ]
    found = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (3, 0, 4, "cc-by,reserved")
    assert found[2].labels == "mit" and found[2].base_labels == "" and 0.75 <= found[2].score < 1
    assert found[3].base_labels == "gpl" and found[3].labels == "gpl,reserved"


def item_matches(docs, items, threshold=0.75):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))

    def runs(w, n):
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()

    out = []
    for k, t in items:
        own = words(t)
        n = min(5, len(own))
        item = runs(own, n)
        for i, d in docs if item else ():
            shared = len(item & runs(words(d), n))
            if shared and shared >= threshold * len(item):
                out.append((i, k, shared, len(item)))
    return out


def test_op7_equals_brute_force(spark, sf_dir, plain):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r)[:4] for r in queries.op7_decontaminate(spark, sf_dir).collect()]
    assert by_repr(got) == by_repr(item_matches([r[:2] for r in plain], items))


def test_op7_awkward(spark, awkward, empty):
    rows = [(1, None), (2, ""), (3, "alpha beta"), (3, "alpha beta"), (None, LONG + "7 " + LONG + "8"), (5, "?!")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = [tuple(r)[:2] for r in awkward.collect()]
    got = [tuple(r)[:4] for r in decontaminate.contaminated(awkward, items).collect()]
    assert by_repr(got) == by_repr(item_matches(docs, rows))
    kept = decontaminate.decontaminated(awkward, items)
    assert kept.columns == awkward.columns
    assert sorted(str(r[0]) for r in kept.collect()) == ["1", "10", "11", "12", "2", "3", "9"]
    assert decontaminate.decontaminated(empty, items).count() == decontaminate.contaminated(awkward, items.limit(0)).count() == 0


def token_rows(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    start, out = 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op8_equals_the_library(spark, sf_dir, plain):
    got = [tuple(r) for r in queries.op8_token_output(spark, sf_dir).collect()]
    assert sorted(got) == token_rows(sorted(r[:2] for r in plain))


def test_op8_awkward(awkward, empty):
    rows = [tuple(r)[:2] for r in awkward.collect()]
    got = sorted((tuple(r) for r in token_output.token_output(awkward, queries.tokenizer_path()).collect()), key=lambda r: r[1])
    assert got == token_rows(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert token_output.token_output(empty, queries.tokenizer_path()).count() == 0


def test_op8_format_round_trip():
    random = np.random.default_rng(5)
    for n in (0, 1, 255, 256, 257, 5000):
        values = random.integers(0, 300, n).astype("<u4")
        values[random.random(n) < 0.03] = 2**32 - 1
        data = token_output.encode(values)
        assert (token_output.decode(data) == values).all()
        for k in range(-(-n // 256)):
            assert (token_output.read_block(data, k) == values[256 * k : 256 * k + 256]).all()


def check_near(found, rows):
    truth = near_classes(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == truth
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_op9_equals_brute_force(spark, sf_dir, plain):
    check_near(queries.op9_near_dedup(spark, sf_dir).collect(), [r[:2] for r in plain])


@pytest.mark.parametrize("paired", [2, 16])
def test_op9_chains_around_one_text(spark, monkeypatch, paired):
    """Edited copies of one text, chains of edits and clusters beside a common part."""
    monkeypatch.setattr(near_dedup, "TOGETHER", paired)
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for j in random.choice(120, int(random.integers(0, 6)), replace=False):
            words[j] = f"x{random.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    for c in range(6):  # clusters whose members share an edit outside the common text
        own = [f"c{c}_{i}" for i in range(40)]
        for k in range(5):
            words = base[:80] + own + [f"u{c}_{k}_{i}" for i in range(3)]
            rows.append((100 + 10 * c + k, " ".join(words)))
    check_near(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_op9_awkward(awkward, empty):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == 13
    of = {r.doc_id: r for r in rows}
    assert of[1].n_shingles == of[2].n_shingles == of[3].n_shingles == 0 and of[3].component_id == 3
    assert {r.component_id for r in rows if r.n_shingles == 1 and r.doc_id in (4, 5, None)} == {4}
    assert of[7].component_id == of[8].component_id == 7
    kept = without_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r[0] for r in kept.collect()) == [1, 2, 3, 4, 7, 9, 10, 11, 12]
    assert near_duplicates(empty).count() == without_near_duplicates(empty).count() == 0


def test_op10_weights_and_blocks(spark, sf_dir, plain):
    rows = queries.op10_mixing(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in plain}
    tokens = Counter()
    for _, t, _, s in plain:
        tokens[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    emitted, weight = Counter(), {}
    for r in rows:
        emitted[r.source] += r.tokens
        weight[r.source] = r.weight
    assert math.isclose(sum(weight.values()), 1, rel_tol=1e-6)
    repetition = {s: emitted[s] / tokens[s] for s in tokens}
    longest = max(r.tokens for r in rows)
    assert all(1 <= x <= mixing.MAX_REPETITION + longest / tokens[s] for s, x in repetition.items())
    total = sum(emitted.values())
    assert all(abs(emitted[s] - weight[s] * total) <= longest * (len(weight) + 1) for s in weight)
    slots = defaultdict(list)
    for r in rows:
        slots[r.block].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op10_target_entropy(spark, sf_dir):
    sizes = spark.createDataFrame([("a", 900, 9), ("b", 90, 9), ("c", 10, 9)], "source string, tokens long, rows long")
    found = mixing.temperature_mix(sizes, target_entropy=0.8)
    weights = [r.weight for r in found.weights.collect()]
    assert math.isclose(-sum(w * math.log(w) for w in weights), 0.8, abs_tol=1e-4)


def test_op10_awkward(awkward, empty):
    rows = mixing.mix_sources(awkward).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, None, 7, 8, 9, 10, 11, 12}
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns and mixed.count() >= awkward.count()
    assert mixing.mix_sources(empty).count() == mixing.mixed_documents(empty).count() == 0
