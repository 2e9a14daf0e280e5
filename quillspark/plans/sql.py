"""Pieces of DuckDB SQL that the queries' oracles share."""

from __future__ import annotations

import re

from quillspark.functions import text as t


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern of the Java dialect, as an SQL literal of RE2's."""
    pattern = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern).replace(r"\x85", r"\x{85}").replace(r"\xa0", r"\x{a0}")
    return lit(pattern.replace(r"\s\x1c", r"\s\x0b\x1c"))


SPACE = re2(t.SPACE)


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {re2('^' + t.SPACE)}, ''), {re2(t.SPACE + '$')}, '')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(8203), ''), {SPACE}, ' ', 'g'))"


def stem(w: str) -> str:
    cases = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) > {len(s) + 2} THEN left({w}, length({w}) - {len(s)})" for s in ("ing", "es", "s"))
    return f"CASE {cases} ELSE {w} END"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: {stem('w')})"


def sentences(x: str) -> str:
    cut = f"regexp_replace({x}, '([.!?])\\s+', chr(92) || '1' || chr(10), 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({cut}, '\\n+'), lambda s: {strip('s')}), lambda s: s <> '')"


def ascii_words(x: str) -> str:
    """Letters beyond ASCII as underscores, so that RE2's word boundaries fall where Unicode's do."""
    return rf"regexp_replace({x}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{M}}]', '_', 'g')"


def checkable(x: str) -> str:
    # Word boundaries are judged on the text with other letters masked.
    m = ascii_words(x)
    parts = [f"list_transform(regexp_extract_all({m}, {lit(t.NUMBER)}), lambda v: lower({strip('v')}))", f"list_transform(regexp_extract_all({m}, {lit(t.MONEY)}), lambda v: lower({strip('v')}))", f"list_transform(regexp_extract_all({m}, {lit(t.URL)}), lambda v: lower({strip('v')}))", f"list_transform(regexp_extract_all({m}, {lit(t.MONTH)}), lambda v: lower(left(v, 3)))"]
    return f"list_sort(list_distinct(list_filter({' || '.join(parts)}, lambda v: length(v) > 1)))"


def header(title: str, section: str) -> str:
    return f"CASE WHEN {section} <> '' AND NOT contains(lower({title}), lower({section})) THEN {section} || ' — ' || {title} ELSE {title} END"


CORPUS = """corpus AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS section, coalesce(lang, '') AS kind,
  CASE WHEN doc_id % 2 = 0 THEN upper(coalesce(source, '')) || ' ' || doc_id ELSE 'Document ' || doc_id END AS title FROM documents)"""


def pack(units: str, size: int) -> str:
    """Greedy packing as a fold over lists of one string."""
    return f"""list_reduce(list_transform({units}, lambda u: [u]), lambda acc, u: CASE WHEN length(acc[-1]) + 1 + length(u[1]) <= {size} THEN acc[:-2] || [acc[-1] || ' ' || u[1]] ELSE acc || u END)"""


PC = f"""{CORPUS},
packed AS (SELECT *, CASE WHEN len(s) = 0 THEN [] ELSE {pack('s', 160)} END AS children FROM (SELECT *, {sentences('text')} AS s FROM corpus)),
child AS (SELECT doc_id, title, section, kind, text AS context_text, i - 1 AS i, len(children) AS n, children[i] AS child, {header('title', 'section')} AS head FROM (SELECT *, unnest(range(1, len(children) + 1)) AS i FROM packed)),
pc AS (SELECT 'pc::' || doc_id || '::' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS chunk_id, doc_id, CAST(i AS INTEGER) AS part, CAST(n AS INTEGER) AS n_parts, title, kind, CASE WHEN contains(lower(child), lower(head)) THEN child ELSE head || ': ' || child END AS embed_text, context_text FROM child)"""

TERMS = f"""qt AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({tokens("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
tok AS (SELECT doc_id, {tokens("coalesce(text, '')")} AS toks FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY ALL),
dl AS (SELECT doc_id, len(toks) AS dl FROM tok),
stats AS (SELECT count(*) AS n, coalesce(avg(CAST(dl AS DOUBLE)), CAST(1 AS DOUBLE)) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df, ln(1 + (CAST(any_value(n) AS DOUBLE) - count(*) + CAST(0.5 AS DOUBLE)) / (count(*) + CAST(0.5 AS DOUBLE))) AS idf FROM tf, stats GROUP BY term)"""

BM25 = f"""{TERMS},
bm AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 4) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), stats GROUP BY qid, doc_id)"""


def vector(toks: str) -> str:
    code = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT)"
    return f"list_transform(range(0, 64), lambda d: coalesce(list_sum(list_transform(list_filter({toks}, lambda w: {code} % 64 = d), lambda w: CASE WHEN ({code} // 64) % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END)), CAST(0 AS DOUBLE)))"


def unit(v: str) -> str:
    norm = f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"CASE WHEN {norm} > 0 THEN list_transform({v}, lambda y: y / {norm}) ELSE {v} END"


#: Counts by hash in long form: no list function runs once for each dimension.
DENSE = f"""{BM25},
dt AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS code, tf FROM tf),
dv AS (SELECT doc_id, code % 64 AS d, sum(tf * CASE WHEN (code // 64) % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END) AS x FROM dt GROUP BY ALL),
dn AS (SELECT doc_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM dv WHERE x <> 0),
qc AS (SELECT qid, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS code, qtf FROM qt),
qv AS (SELECT qid, code % 64 AS d, sum(qtf * CASE WHEN (code // 64) % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END) AS x FROM qc GROUP BY ALL),
qn AS (SELECT qid, d, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS x FROM qv WHERE x <> 0),
dots AS (SELECT qid, doc_id, sum(qn.x * dn.x) AS s FROM qn JOIN dn USING (d) GROUP BY ALL),
pairs AS (SELECT b.item_id AS qid, c.doc_id, coalesce(c.source, '') AS parent FROM benchmark b, documents c),
cand AS (SELECT qid, doc_id, parent, round(coalesce(s, 0), 9) + 0 AS dense, coalesce(score, 0) AS lex FROM pairs LEFT JOIN dots USING (qid, doc_id) LEFT JOIN bm USING (qid, doc_id))"""

RANKS = f"""{DENSE},
ranks AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id) AS rd, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, doc_id) AS rl FROM cand)"""

RRF = f"""{RANKS},
fused AS (SELECT *, round(1 / CAST(60 + rd AS DOUBLE) + 1 / CAST(60 + rl AS DOUBLE), 9) AS f FROM ranks),
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f DESC, doc_id) AS r FROM fused)"""

HITS = f"""{RRF},
firsts AS (SELECT *, row_number() OVER (PARTITION BY qid, parent ORDER BY r) AS k FROM ordered WHERE r <= 20),
hits AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank, doc_id, parent, dense AS score, lex FROM firsts WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r) <= 5),
gate AS (SELECT qid, max(dense) AS gate_score FROM cand GROUP BY qid),
overlap AS (SELECT b.item_id AS qid, count(DISTINCT qt.term) FILTER (df.term IS NOT NULL) AS term_hits, count(DISTINCT qt.term) AS query_terms FROM benchmark b LEFT JOIN qt ON qt.qid = b.item_id LEFT JOIN df ON df.term = qt.term GROUP BY 1)"""

GOLD = """gold AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''),
evalq AS (SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'a' WHEN item_id % 3 = 1 THEN 'b' ELSE 'c' END AS category, coalesce(g, []) AS gold, CASE WHEN g IS NULL THEN 'refuse' ELSE 'answer' END AS expect
  FROM benchmark LEFT JOIN (SELECT qid, list_sort(list(doc_id)) AS g FROM gold GROUP BY qid) x ON x.qid = item_id)"""
