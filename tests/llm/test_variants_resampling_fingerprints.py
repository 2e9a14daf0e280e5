"""Spelling variants, importance resampling and fingerprints: brute-force versions, properties, and awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import resampling, similarity, variants
from tests.llm.test_corpus_operators import LOWER, SCHEMA, awkward, bench

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if x != w and near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {w: (form, root(w), n, k, m) for w, (form, n, k, m) in out.items()}


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_variants_equal_brute_force(spark, seed):
    """Random words over few letters, so that nearly all nodes branch, with prefixes of each other and long runs of one letter."""
    rng = random.Random(seed)
    letters = ["ab", "abc", "aéÿ", "abcdefgh"][seed]
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"a" * k for k in range(1, 12)}
    counts = {w: rng.choice([1, 5, 25, 30, 150, 1000]) for w in words}
    got = spelled(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_variants(counts)


def test_joined_nodes_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    counts = {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))): rng.randint(1, 99) for _ in range(600)}
    monkeypatch.setattr(variants, "TOP_NODES", 1)
    assert spelled(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute_variants(counts)


def test_light_edges_are_few(spark):
    """A word has no more than log2(words) light edges besides its end."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(12)) for _ in range(2000)})
    frame = spark.createDataFrame(list(enumerate(words)), "wid long, word string")
    assert max(len(r.edges) for r in variants.light_edges(frame).collect()) <= math.log2(len(words)) + 1


def brute_vocabulary(rows):
    found = Counter()
    for i, t in rows:
        for run in RUN.findall((t or "").translate(LOWER)):
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def test_vocabulary_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["Garden", "gardens", "gardeÉn", "straßen", "letter中", "x" * 3000, "gard", "parlour", "parlours"]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(300)] + [(None, "Garden parlour"), (7, None), (8, "")]
    docs = texts(spark, rows)
    counts = brute_vocabulary(rows)
    assert {r.word: r.n for r in variants.vocabulary(docs).collect()} == counts
    assert any(w not in {x.translate(LOWER) for x in words} for w in counts)  # some lost a character often enough
    assert spelled(variants.spelling_variants(docs)) == brute_variants(counts)


def test_chains_of_forms_end_in_a_root(spark):
    counts = {"a" * 6 + "bcdefgh"[:k]: 5**k for k in range(1, 8)}
    got = spelled(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {x[1] for x in got.values()} == {"aaaaaabcdefgh"} and got == brute_variants(counts)


def test_variants_of_awkward_rows(spark):
    docs = awkward(spark).withColumns({"word": F.lit("x"), "n": F.lit(1), "root": F.lit(2)})
    assert spelled(variants.spelling_variants(docs)) == brute_variants(brute_vocabulary([(r.doc_id, r.text) for r in docs.collect()]))
    assert variants.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.variants(spark.createDataFrame([(None, 3)], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        variants.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_a_run_of_very_many_letters(spark):
    counts = {"ab" * 150_000: 50, "ab" * 149_999 + "b": 5, "ab" * 149_999 + "ac": 300, "b" * 6: 7}
    assert spelled(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute_variants(counts)


def test_normalise_puts_roots(spark):
    forms = spark.createDataFrame([("gardne", "garden"), ("garden", "garden")], "word string, root string")
    docs = texts(spark, [(1, "Gardne, gardnes: gardne中"), (2, None), (3, "nothing"), (3, "nothing")])
    got = sorted((r.doc_id, r.normalised) for r in variants.normalise(docs, forms).collect() if r.text)
    assert got == [(1, "garden, gardnes: garden中"), (3, "nothing"), (3, "nothing")] and variants.normalise(docs, forms).count() == 4


# Importance resampling


def brute_resample(rows, target, n=1, buckets=10_000, seed=2024, percent=10, least=20):
    def grams(t):
        w = ALNUM.findall((t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + j]).encode()) % buckets for j in range(1, n + 1) for k in range(len(w) - j + 1)]

    found = [(i, *grams(t)) for i, t in rows]
    s, t = Counter(b for *_, g in found for b in g), Counter(b for x in target for b in grams(x)[1])
    ss, tt = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, words, g in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * ss / ((s[b] + 1) * tt))) for b in g)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def drawn(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,buckets,percent", [(1, 10_000, 10), (2, 97, 50), (3, 1, 100)])
def test_resampling_equals_brute_force(spark, n, buckets, percent):
    rng = random.Random(n)
    words = ["alpha", "Beta", "gamma9", "déjà", "漢字", "x", "Z"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)] + [(500, None), (501, ""), (502, "--- ..."), (503, "long " * 50_000)]
    target = ["alpha alpha beta", None, "x z gamma9 z"]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(texts(spark, rows), goal, carry=["doc_id"], n=n, buckets=buckets, percent=percent)
    assert drawn(got) == brute_resample(rows, target, n, buckets, percent=percent)


def test_ranks_run_through_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    rows = [(i, "same words again " * 10) for i in range(200)]
    got = resampling.resample(texts(spark, rows), bench(spark), carry=["doc_id"], percent=37)
    assert drawn(got) == brute_resample(rows, [r.text for r in bench(spark).collect()], percent=37)


def test_resampling_of_awkward_rows(spark):
    docs = awkward(spark).withColumns({"rank": F.lit("x"), "score": F.lit(1), "counts": F.lit(2), "n_words": F.lit(3)})
    got = resampling.resample(docs, bench(spark), percent=100)
    assert got.count() == docs.count() and len(set(got.columns)) == len(got.columns) and {"doc_id", "text", "counts"} <= set(got.columns)
    ranks = sorted(r["rank"] for r in got.where(F.col("rank").isNotNull()).collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == docs.where("size(split(text, ' ')) >= 20").count()
    assert resampling.resample(spark.createDataFrame([], SCHEMA), bench(spark)).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs, none).count() == docs.count()


def test_resampling_finds_the_target(spark):
    """Of two kinds of text, the one that the target holds is drawn."""
    rng = random.Random(2)
    kinds = [[f"{c}{k}" for k in range(50)] for c in "ab"]
    rows = [(i, " ".join(rng.choices(kinds[i % 10 == 0], k=60))) for i in range(300)]
    goal = spark.createDataFrame([(1, " ".join(rng.choices(kinds[1], k=500)))], "item_id long, text string")
    got = resampling.resample(texts(spark, rows), goal, carry=["doc_id"]).where(F.col("rank").isNotNull()).collect()
    assert len(got) == 30 and sum(r.doc_id % 10 == 0 for r in got) >= 27


# Fingerprints


def brute_grade(window):
    terms = [similarity._TERMS[c] for c in Counter(window).values()]
    return int((similarity._TERMS[64] - sum(terms)) * 1000 // similarity._TERMS[64])


def brute_rank(all_texts):
    counts = Counter(brute_grade(t[k : k + 64]) for t in all_texts for k in range(len(t) - 63))
    order = sorted(range(1001), key=lambda g: (g < 100, counts[g], g))
    return {g: k for k, g in enumerate(order)}


def brute_fingerprint(text, rank):
    """Windows chosen by the votes of their neighbourhoods, one at a time."""
    n = len(text) - 63
    chosen = []
    if n > 0:
        place = [rank[brute_grade(text[k : k + 64])] for k in range(n)]
        spans = [range(k, k + 64) for k in range(n - 63)] or [range(n)]
        votes = Counter(min(s, key=lambda k: (place[k], k)) for s in spans)
        chosen = sorted(k for k, v in votes.items() if v >= min(16, len(spans)))
    m = 1 << 64

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD % m
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 % m
        return x ^ x >> 33

    hashes = []
    for k in chosen:
        h = 64
        for j in range(0, 64, 8):
            h = mix((h * 0x9E3779B97F4A7C15 + int.from_bytes(text[k + j : k + j + 8], "little")) % m)
        hashes.append(h)
    if text and not hashes:
        hashes = [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")]
    hashes = list(dict.fromkeys(hashes))
    chain = [hashes[k : k + 160] for k in range(0, len(hashes), 160)]
    return len(hashes), [{h >> 11 * k & 2047 for h in part for k in range(5)} for part in chain]


def brute_likeness(a, b):
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    if b[0] < a[0]:
        a, b = b, a
    total = 0.0
    for k, x in enumerate(a[1]):
        best = max((len(x & y) - len(x) * len(y) / 2048) / (min(len(x), len(y)) - len(x) * len(y) / 2048) for y in b[1])
        total += min(1.0, max(0.0, best)) * min(160, a[0] - 160 * k)
    return total / a[0]


def read(fingerprint):
    d = similarity.Digest.parse(fingerprint)
    return d.n, [set(np.flatnonzero(x).tolist()) for x in d.bits]


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: r[0])
    rank = brute_rank([(t or "").encode() for _, t in rows])
    prints = [brute_fingerprint((t or "").encode(), rank) for _, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        e = brute_fingerprint(edited.encode(), rank)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[k], e, round(brute_likeness(prints[k], e), 5), round(brute_likeness(prints[k], prints[(k + 1) % len(rows)]), 5))
    return out


def printed(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, read(r.fingerprint), read(r.edited_fingerprint), round(r.near_edited, 5), round(r.near_next, 5)) for r in df.collect()}


def prose(rng, n, letters="etaoin shrdlu,.\né漢"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(4)
    shared = prose(rng, 400)
    rows = [(3 * k, prose(rng, rng.randint(0, 900)) + shared * (k % 3 == 0)) for k in range(20)]
    rows += [(100, None), (101, ""), (102, None), (103, "a"), (104, "a" * 500), (105, prose(rng, 63, "abc")), (106, prose(rng, 64, "abc")), (107, prose(rng, 130)), (108, shared), (109, shared), (110, "\U0001f600" * 90), (111, prose(rng, 15_000))]
    rng.shuffle(rows)
    got, want = printed(similarity.fingerprints(texts(spark, rows), carry=["doc_id"])), brute_fingerprints(rows)
    assert got == want and want[108][5] == 1.0 and want[111][2][0] > 160


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_fingerprints_of_few_documents(spark, n):
    rows = [(k, prose(random.Random(k), 300)) for k in range(n)]
    assert printed(similarity.fingerprints(texts(spark, rows), carry=["doc_id"])) == (brute_fingerprints(rows) if n else {})


def test_grades_across_blocks(monkeypatch):
    rng = random.Random(8)
    raw = prose(rng, 3000).encode()
    monkeypatch.setattr(similarity, "BLOCK", 100)
    got = similarity.grades(np.frombuffer(raw, np.uint8))
    assert got.tolist() == [brute_grade(raw[k : k + 64]) for k in range(len(raw) - 63)]


def test_slices_and_ranges_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randint(0, 600))) for k in range(60)]
    a = printed(similarity.fingerprints(texts(spark, rows).repartition(5), carry=["doc_id"]))
    monkeypatch.setattr(similarity, "SLICE", 1000)
    monkeypatch.setattr(similarity, "RANGE_BYTES", 500)
    assert a == printed(similarity.fingerprints(texts(spark, rows).coalesce(1), carry=["doc_id"])) == brute_fingerprints(rows)


def test_fingerprints_tell_edits_from_others(spark, data):
    """Half of a text stays in its edited form; documents that follow each other mostly have nothing in common."""
    rows = similarity.fingerprints(spark.read.parquet(f"{data}/documents.parquet").where(F.length("text") > 600), carry=["doc_id"]).collect()
    edited, following = sorted(r.near_edited for r in rows), sorted(r.near_next for r in rows)
    assert edited[len(rows) // 2] > 0.4 and following[len(rows) // 2] < 0.1 and all(0 <= x <= 1 for x in edited + following)


def test_fingerprints_of_awkward_rows(spark):
    docs = awkward(spark).withColumns({"near_next": F.lit("x"), "_blob": F.lit(1), "fingerprint": F.lit(2)})
    got = similarity.fingerprints(docs)
    assert got.count() == docs.count() and len(set(got.columns)) == len(got.columns) and {"doc_id", "text", "_blob"} <= set(got.columns)
    by_text = defaultdict(set)
    for r in got.collect():
        by_text[r.text or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert similarity.compare(*[next(iter(by_text[""]))] * 2) == 1.0
