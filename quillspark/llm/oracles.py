"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS win FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS win FROM (
  SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l)),
h AS (SELECT DISTINCT doc_id, i, l FROM dw SEMI JOIN bw USING (l, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM dw JOIN bw USING (l, win) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

ORACLES["op4_sharding"] = """
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""

ORACLES["op5_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - (sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap))
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM r),
t AS (SELECT source, source_size, coalesce(least(cap, max(CASE WHEN ratio > share THEN share END) OVER () * w), cap) AS target FROM l),
q AS (SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, source, size, k, turn, CAST(turn * source_size + upto AS DOUBLE) / target AS finish FROM q, (SELECT unnest(range(3)) AS turn) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM e),
n AS (SELECT doc_id, count(*) AS times FROM c WHERE through <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken FROM q LEFT JOIN n USING (doc_id)
"""


def _secrets() -> str:
    """Positions as in secrets.py; the entropy of each window is taken afresh."""
    from .secrets import ACCESS, ALLOWED, ASSIGN, CLASSES, HEX, SAMPLES, WEIGHTS, WIDTH, most

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def found(name: str, pattern: str, group: int) -> str:
        return f"""{name} AS (SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, m[i] AS m, v[i] AS v FROM (
  SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {q(pattern)}) AS m, regexp_extract_all(t, {q(pattern)}, {group}) AS v, regexp_split_to_array(t, {q(pattern)}) AS g FROM d WHERE regexp_matches(t, {q(pattern)}))))"""

    parts = [found("m0", ASSIGN, 2), found("m1", ACCESS, 0), found("m2", HEX, 0)]
    parts.append("""base AS (SELECT doc_id, s, 0 AS k, s + length(m) AS e, 'assign' AS kind FROM m0 WHERE length(v) >= 6
  UNION ALL SELECT doc_id, s, 1, s + length(m), 'access' FROM m1 WHERE length(m) >= 20 UNION ALL SELECT doc_id, s, 2, s + length(m), 'hex' FROM m2)""")
    unions = []
    for n, (kind, (pattern, threshold)) in enumerate(CLASSES.items()):
        parts.append(found(f"c{n}", pattern, 0))
        extra = " AND NOT regexp_matches(m, '^[0-9A-Fa-f]*$')" if kind == "text_entropy" else ""
        parts.append(f"""w{n} AS (SELECT doc_id, s, i, ch, count(*) AS c FROM (SELECT doc_id, s, i, unnest(string_split(win, '')) AS ch FROM (
  SELECT doc_id, s, i, m[i + 1 : i + {WIDTH}] AS win FROM (SELECT doc_id, s, m, unnest(range(0, length(m) - {WIDTH - 1})) AS i FROM c{n} WHERE NOT regexp_matches(m, {q(ALLOWED)}){extra}))
  WHERE NOT regexp_matches(win, {q(SAMPLES)})) GROUP BY ALL)""")
        parts.append(f"""h{n} AS (SELECT doc_id, s, i FROM (SELECT doc_id, s, i, sum({WEIGHTS}[c + 1]) AS weight FROM w{n} GROUP BY ALL) WHERE weight <= {most(threshold)})""")
        parts.append(f"""g{n} AS (SELECT *, sum(CAST(i - before >= {WIDTH} AS INTEGER)) OVER (PARTITION BY doc_id, s ORDER BY i) AS g FROM (
  SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id, s ORDER BY i), i) AS before FROM h{n}))""")
        parts.append(f"""x{n} AS (SELECT doc_id, s + min(i) AS s, {3 + n} AS k, s + max(i) + {WIDTH} AS e, '{kind}' AS kind FROM g{n} q GROUP BY doc_id, q.s, g)""")
        unions.append(f"SELECT * FROM x{n} x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND x.e <= b.e)")
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\n" + ",\n".join(parts) + f""",
a AS (SELECT * FROM base UNION ALL {' UNION ALL '.join(unions)}),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)"""


ORACLES["op2_secrets"] = _secrets()

ORACLES["op10_line_dedup"] = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, i, l[i] AS line, CAST('0x' || substr(md5(l[i]), 1, 8) AS BIGINT) AS code FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
v AS (SELECT *, CAST((code + 31 * coalesce(lag(code) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4294967296 AS HUGEINT) * 2654435761 % 4294967296 // 65536 AS r FROM u),
e AS (SELECT *, coalesce(r < lag(r) OVER (PARTITION BY doc_id ORDER BY i) AND r < lead(r) OVER (PARTITION BY doc_id ORDER BY i), false) AS ends FROM v),
c AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
g AS (SELECT doc_id, c, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, c),
r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY n > 1, body ORDER BY doc_id, c) > 1 AS gone FROM g)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(body, chr(10) ORDER BY c) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

ORACLES["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM n SEMI JOIN (SELECT win FROM n GROUP BY win HAVING count(*) > 1) USING (win)),
u AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
m AS (SELECT u.doc_id, u.i, word, coalesce(u.i - r.i < 35, false) AS gone FROM u ASOF LEFT JOIN r ON u.doc_id = r.doc_id AND u.i >= r.i),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

ORACLES["op8_suffix_array_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS win FROM (SELECT doc_id, h, unnest(range(0, CAST(strlen(h) / 2 AS BIGINT) - 99)) AS i FROM d WHERE strlen(h) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM n) WHERE k > 1),
u AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, CAST(strlen(h) / 2 AS BIGINT))) AS i FROM d)),
m AS (SELECT u.doc_id, u.i, b, coalesce(u.i - r.i < 100, false) AS gone FROM u ASOF LEFT JOIN r ON u.doc_id = r.doc_id AND u.i >= r.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM m),
g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def crc32_sql(text: str, table: str = "crc_table") -> str:
    """CRC-32 of a text's UTF-8 bytes; table is a column that holds crc_table_sql()'s list."""
    code = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {code}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"


def crc_table_sql() -> str:
    """The list of remainders of all bytes, by the rule of the polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"SELECT list(list_reduce(list_concat([b], range(0, 8)), lambda c, k: {step}) ORDER BY b) AS crc_table FROM (SELECT unnest(range(0, 256)) AS b)"


ORACLES["op12_importance_resampling"] = rf"""
WITH t AS ({crc_table_sql()}),
d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS f FROM d),
g AS (SELECT unnest(regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
k AS (SELECT f, CAST({crc32_sql('f')} % 10000 AS BIGINT) AS b FROM (SELECT f FROM f UNION SELECT f FROM g), t),
s AS (SELECT b, count(*) AS s FROM f JOIN k USING (f) GROUP BY b),
u AS (SELECT b, count(*) AS t FROM g JOIN k USING (f) GROUP BY b),
z AS (SELECT (SELECT count(*) FROM f) AS ss, (SELECT count(*) FROM g) AS tt),
a AS (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN u USING (b), z),
w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN k USING (f) JOIN a USING (b) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM c),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM e LEFT JOIN r USING (doc_id)
"""

#: Words of one key share all but one character, at the same place; a word without one of its characters may be a word.
ORACLES["op11_spelling_variants"] = rf"""
WITH RECURSIVE t AS ({crc_table_sql()}),
a AS (SELECT CAST(doc_id AS VARCHAR) AS d, unnest(regexp_extract_all({_LOWER.format('text')}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
b AS (SELECT r, {crc32_sql("d || ':' || r")} AS h FROM (SELECT * FROM a WHERE length(r) >= 6), t),
c AS (SELECT CASE WHEN h % 199 = 0 THEN r[1 : CAST(h % length(r) AS BIGINT)] || r[CAST(h % length(r) AS BIGINT) + 2 : length(r)] ELSE r END AS word FROM b),
w AS (SELECT word, count(*) AS n FROM c WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
p AS (SELECT word, n, i, word[1 : i - 1] AS x, word[i + 1 : length(word)] AS y FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
q AS (SELECT p.word, p.n, o.word AS other, o.n AS other_n FROM p JOIN p o ON p.i = o.i AND p.x = o.x AND p.y = o.y AND p.word <> o.word
  UNION SELECT p.word, p.n, w.word, w.n FROM p JOIN w ON w.word = p.x || p.y UNION SELECT w.word, w.n, p.word, p.n FROM p JOIN w ON w.word = p.x || p.y),
s AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM q GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN s USING (word)),
l AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, l.root FROM f JOIN l ON f.form = l.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN l USING (word)
"""
