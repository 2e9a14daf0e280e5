"""The corpus operators: brute-force versions, round trips, held-out accuracy, and rows of every awkward kind."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries, quality, sharding, toxicity
from quillspark.llm.common import scratch
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.jaccard import link
from quillspark.llm.linededup import dedup_lines
from quillspark.llm.lyndon import suffix_arrays
from quillspark.llm.mixing import mix, repeat_rows
from quillspark.llm.oracles import ORACLES
from quillspark.llm.secrets import redact, scan
from quillspark.llm.substring import dedup_substrings
from quillspark.llm.suffixes import dedup_suffixes
from tests.oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], ORACLES[name])


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    passage = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"L{i % 5000}" for i in range(120_000))
    rows = [(1, passage, "en", "a", 1), (2, passage, "en", "a", 1), (2, passage, "en", "a", 1), (2, "other " + passage, None, "b", 1), (None, passage, "en", None, None), (3, None, None, None, None), (4, "", "en", "", 0), (5, "   \n\t ", "en", "a", 5), (6, "in " * 400, "en", "a", 1200), (7, long, "en", "a", len(long)), (8, "one two", "en", "b", 7), (9, "é" * 50 + " ß 漢字", "de", "c", 50), (10, "a\nb\na\nb\nc\na\nb", "en", "c", 13)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 0, 1), (8, None, None), (9, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10, 30))), (2, "one two"), (None, "L5 L6 L7"), (4, None), (5, ""), (1, "in in in")], "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate(d, bench(s)),
    "decontaminate_blocks": lambda s, d: decontaminate(d, bench(s), block_bytes=40),
    "scan": lambda s, d: scan(d),
    "redact": lambda s, d: redact(d),
    "link": lambda s, d: link(d),
    "mix": lambda s, d: mix(d),
    "judge": lambda s, d: quality.judge(d),
    "substrings": lambda s, d: dedup_substrings(d),
    "suffixes": lambda s, d: dedup_suffixes(d),
    "score": lambda s, d: toxicity.score(d, labels(s)),
    "lines": lambda s, d: dedup_lines(d),
    "shard": lambda s, d: sharding.shard(d, scratch(s, "t"), F.col("source")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    docs = awkward(spark).withColumns({"n_words": F.lit("x"), "kept": F.lit("y"), "score": F.lit("z"), "size": F.lit(1), "shard": F.lit("q")})
    got = OPERATORS[name](spark, docs)
    assert got.count() == docs.count()
    assert len(set(got.columns)) == len(got.columns) and {"doc_id", "source"} <= set(got.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_agree(spark):
    a, b = ({(str(r.doc_id), r.n_words): (r.n_hit, tuple(r["items"])) for r in OPERATORS[n](spark, awkward(spark)).collect()} for n in ("decontaminate", "decontaminate_blocks"))
    assert a == b and a["1", 60] == (20, ("1",)) and a["8", 2] == (2, ("2",))


def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def sets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots_of(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_jaccard_is_exact(spark, data):
    docs = documents(spark, data).select("doc_id", "text").collect()
    base = " ".join(f"t{i}" for i in range(80)).split()
    near = [(100_000 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(0, 80, 4)]
    rows = [(r.doc_id, r.text) for r in docs] + near
    sets = {i: sets_of(t) for i, t in rows}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"]).collect()}
    roots = roots_of(sets)
    assert got == {i: (len(sets[i]), roots[i]) for i in sets}


def test_join_path_gives_the_same(spark, data, monkeypatch):
    from quillspark.llm import repeats

    docs = documents(spark, data)
    want = {r.doc_id: tuple(r) for r in dedup_substrings(docs, carry=["doc_id"]).collect()}
    monkeypatch.setattr(repeats.second_pass, "__defaults__", (0,))
    assert {r.doc_id: tuple(r) for r in dedup_substrings(docs, carry=["doc_id"]).collect()} == want


def long_copies(spark):
    """Pairs of near copies with a passage and lines in common, of 150 KB each, so a batch of 4 MB holds several slices."""
    lines = [f"all share line {i} of many" for i in range(40)]
    rows = []
    for i in range(48):
        words = [f"p{i // 2}w{k}" for k in range(16_000)]
        words[100] = f"own{i}"
        rows.append((i, "\n".join([" ".join(words), *lines])))
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("name", ["link", "suffixes", "lines"])
def test_join_path_over_several_slices(spark, monkeypatch, name):
    from quillspark.llm import repeats

    operator = {"link": link, "suffixes": dedup_suffixes, "lines": dedup_lines}[name]
    docs = long_copies(spark)
    want = {r.doc_id: tuple(r) for r in operator(docs, carry=["doc_id"]).collect()}
    monkeypatch.setattr(repeats.second_pass, "__defaults__", (0,))
    got = {r.doc_id: tuple(r) for r in operator(docs, carry=["doc_id"]).collect()}
    assert got == want
    if name == "link":
        assert {i: r[2] for i, r in got.items()} == {i: i // 2 * 2 for i in range(48)}
    else:
        assert all(r[2] > 0 for i, r in got.items() if i)


def test_quality_base_and_votes(spark, data):
    got = {r.doc_id: r for r in queries.op6_quality(spark, data).collect()}
    for r in documents(spark, data).collect():
        w = WORD.findall(r.text or "")
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        row = got[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (row.kept and row.base_failed)
    clean = [r for r in got.values() if not r.base_failed]
    assert all(r.kept == (r.n_symbols <= 0.2 * r.n_words) for r in clean if r.n_symbols == 0 or r.n_symbols > 0.3 * r.n_words)


def test_toxicity_on_held_out_rows(spark):
    """Insults, and misspellings that training has not seen."""
    import random

    rng = random.Random(1)
    plain = ["the", "sky", "is", "blue", "and", "water", "runs", "down", "hill", "every", "morning", "we", "walk", "home"]
    bad = ["idiot", "pathetic", "worthless", "moron"]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    model = toxicity.train([t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1], [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 != 1])
    import pyarrow as pa

    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    s = model.scores(pa.array([t for t, _ in held]))
    assert sum((a >= 0.7) == bool(y) for a, (_, y) in zip(s, held, strict=True)) >= 0.97 * len(held)
    odd = model.scores(pa.array([" ".join(plain * 3 + ["idioot", "pathetik", "wortless", "morron"]), " ".join(plain * 3)]))
    assert odd[0] > 0.7 > odd[1]


def test_suffix_arrays():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [np.r_[rng.integers(1, 4, rng.integers(1, 30)), 0] for _ in range(rng.integers(1, 8))]
        base = np.r_[0, np.cumsum([len(x) for x in texts])]
        order = suffix_arrays(np.concatenate(texts), base)
        for t, x in enumerate(texts):
            want = sorted(range(len(x)), key=lambda i: x.tolist()[i:])
            assert (order[base[t] : base[t + 1]] - base[t]).tolist() == want


def test_store_round_trip(spark, data):
    docs = documents(spark, data)
    store = sharding.ShardStore(spark, scratch(spark, "store"))
    assert store.version() == 0
    arrival = F.col("doc_id") % 5
    assert store.append(docs, arrival) == 1
    assert store.compact(target=1 << 20, small=1 << 16) == 2 and len(store.runs()) < len(store.runs(1)) == 5
    for version in (1, 2):
        held = store.read(version)
        assert held.drop("shard").exceptAll(docs).count() == 0 and held.count() == docs.count()
        assert {(r.path, r.rows) for r in held.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows")).collect()} == {(p, n) for run in store.runs(version) for p, n, _ in run.files}
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(1, None, [])
    assert store.version() == 2


def test_plan_of_tiers():
    runs = [sharding.Run(str(i), 10) for i in range(16)] + [sharding.Run("big", 160)]
    groups = sharding.plan(runs, small=10, fanout=4)
    assert sorted(len(g) for g in groups) == [1, 16]


def test_pipeline_is_its_stages(spark, data):
    """Each stage against what it must do with its own input."""
    import corpus_pipeline as p

    docs = documents(spark, data)
    stages = dict(p.STAGES)
    kept = stages["quality rules"](spark, docs, data)
    judged = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == judged and kept.columns == docs.columns
    rows = kept.collect()
    roots = roots_of({r.doc_id: sets_of(r.text) for r in rows})
    single = stages["near copies"](spark, kept, data)
    assert {r.doc_id for r in single.collect()} == {i for i, root in roots.items() if i == root}
    clean = stages["benchmark decontamination"](spark, single, data)
    bad = {r.doc_id for r in decontaminate(single, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    mixed = stages["mixing"](spark, clean, data)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert times == {r.doc_id: r.times for r in mix(clean).where("times > 0").collect()} and max(times.values()) <= 3
    held = stages["sharding"](spark, mixed, data).collect()
    text = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in mixed.collect()}
    assert collections.Counter(r.doc_id for r in held) == times and all(r.text_sha256 == text[r.doc_id] for r in held)
    assert repeat_rows(mix(clean), clean.columns).columns == docs.columns


def test_near_copies_keep_one_row_of_a_group(spark, data):
    """Rows that repeat id and text, rows of null id with one text, and one id with two texts."""
    import corpus_pipeline as p

    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, one, "en", "a", 1), (1, one, "en", "a", 1), (1, one, "en", "b", 1), (2, one, "en", "a", 1), (2, three, "en", "a", 1), *[(None, two, "en", "a", 1)] * 3, (None, one, "en", "a", 1), (3, "", "en", "a", 0), (3, "", "en", "a", 0), (4, "", "en", "a", 0)]
    got = p.near_copies(spark, spark.createDataFrame(rows, SCHEMA), data)
    want = [(1, one, "en", "a", 1), (2, three, "en", "a", 1), (None, two, "en", "a", 1), (3, "", "en", "a", 0), (4, "", "en", "a", 0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_tables_that_only_lead_to_a_result_are_deleted(spark, data):
    """Near copies leave their marks in the shared folder and nothing else; what was kept outside stays."""
    import os

    from quillspark.llm.common import keep, keep_alone, shared_folder
    from quillspark.llm.jaccard import first_of_each

    folder, made = shared_folder(spark), []

    def make():
        made.append(keep(spark.range(5), "leads"))
        made.append(keep_alone(lambda: keep(made[0].selectExpr("id * 2 AS id"), "within"), "inner"))
        return made[0].join(made[1], "id")

    outside, before = keep(spark.range(3), "outside"), set(os.listdir(folder))
    assert sorted(r.id for r in keep_alone(make, "result").collect()) == [0, 2, 4] and outside.count() == 3
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["result"]
    before = set(os.listdir(folder))
    first_of_each(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["marked"]
