"""The whole pipeline against plain Python and DuckDB: which documents come out, how often, and with which text."""

from __future__ import annotations

import collections
import hashlib
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quillspark.llm import quality
from quillspark.llm.oracles import ORACLES

from .test_corpus_operators import WORD, roots_of, sets_of
from .test_identity_and_values import brute_estimate


def measures(text):
    w = WORD.findall(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    share = lambda a, b: a / b if b else 0.0
    n = len(w)
    return n, share(sum(map(len, w)), n), share(len(re.findall(r"[#*$%&|<>]", text)), n), share(len(lines) - len(set(lines)), len(lines)), share(len(repeated), n), share(len(set(w)), n), len(repeated)


def votes(m):
    n, per, symbols, lines, repeats, distinct, _ = m
    pairs = [(n >= 100, n < 50), (4 <= per <= 6.5, per < 3 or per > 7), (symbols <= 0.02, symbols > 0.1), (lines <= 0.1, lines > 0.3), (repeats <= 0.15, repeats > 0.3), (distinct >= 0.6, distinct < 0.3)]
    return tuple(-1 if bad else 1 if good else 0 for good, bad in pairs)


def good_documents(rows):
    found = {i: measures(text or "") for i, text in rows}
    failed = {i for i, m in found.items() if m[0] < 50 or 100 * m[6] > 50 * m[0]}
    counts = collections.Counter(votes(m) for i, m in found.items() if i not in failed)
    p, good, bad = brute_estimate([list(v) for v in counts], list(counts.values()), 6)
    kept = []
    for i, text in rows:
        a, b = p, 1 - p
        for k, o in enumerate(votes(found[i])):
            a, b = a * good[k][o], b * bad[k][o]
        if i not in failed and a / (a + b) >= quality.THRESHOLD:
            kept.append((i, text))
    return kept


def contaminated(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    w, hit = word.findall(lower(text)), set()
    for item in items:
        v = word.findall(lower(item or ""))
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        hit |= {k + j for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)} if windows else set()
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_against_brute_force(spark, data, tmp_path):
    import corpus_pipeline

    rows = [tuple(r) for r in duckdb.sql(f"SELECT doc_id, text, source FROM '{data}/documents.parquet'").fetchall()]
    source = {i: s for i, _, s in rows}
    kept = good_documents([(i, t) for i, t, _ in rows])
    roots = roots_of({i: sets_of(t) for i, t in kept})
    kept = [(i, t) for i, t in kept if roots[i] == i]
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{data}/benchmark.parquet'").fetchall()]
    kept = [(i, t) for i, t in kept if not contaminated(t, items)]
    table = pa.table({"doc_id": [i for i, _ in kept], "text": [t for _, t in kept], "source": pa.array([source[i] for i, _ in kept], pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    times = {r[0]: r[2] // r[1] for r in con.execute(f"SELECT doc_id, size, taken FROM ({ORACLES['op5_mixing']}) WHERE size > 0").fetchall()}
    want = collections.Counter()
    for i, t in kept:
        raw = t.encode()
        want[i, source[i], len(raw), hashlib.sha256(raw).hexdigest()] = times[i]
    got = collections.Counter((r.doc_id, r.source, r.n_bytes, r.text_sha256) for r in corpus_pipeline.run(spark, data).collect())
    assert got == +want and sum(got.values()) > len(got)


def test_stages_on_empty_and_odd_tables(spark, data):
    """No rows, null columns, rows that repeat, columns named as results, and sources in any script."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(120))
    odd = [(1, text, "en", "a/b c%2F+", 1), (1, text, "en", "a/b c%2F+", 1), (None, text + " end of it all", None, None, None), (3, None, None, None, None), (4, "", "", "", 0), (5, text.replace("word", "wörd"), "de", "漢 字", 3)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            if not rows:
                assert out.count() == 0
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(odd, schema), data).collect()}
    assert kept == {1, None, 5}
    held = corpus_pipeline.sharding(spark, spark.createDataFrame(odd, schema), data).collect()
    assert len(held) == len(odd)
