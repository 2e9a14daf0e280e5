"""Queries over text functions, sets and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import chunking
from quillspark.operators import corpus as c
from quillspark.sources.tables import table

from . import sql as q

QUERIES, ORACLES = {}, {}
D = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _docs(spark, d):
    return c.corpus(table(spark, d, "documents"))


def _add(name, build, oracle=None):
    QUERIES[name] = build
    if oracle:
        ORACLES[name] = oracle


def _scalar(name, build, oracle, out="value"):
    """A function of each document's text."""
    _add(name, lambda s, d: _docs(s, d).select("doc_id", build(F.col("text")).alias(out)), f"SELECT doc_id, {oracle} AS {out} FROM {D}")


_joined = "list_aggregate({}, 'string_agg', '|')"
_scalar("str01_clean", lambda x: F.md5(t.clean(x).cast("binary")), f"md5({q.clean('text')})")
_add("str02_tokenize", lambda s, d: _docs(s, d).select("doc_id", F.size(t.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.md5(F.array_join(t.tokens(F.col("text")), " ").cast("binary")).alias("tokens")), f"SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, md5(array_to_string(k, ' ')) AS tokens FROM (SELECT doc_id, {q.tokens('text')} AS k FROM {D})")
_add("str03_stem", lambda s, d: _docs(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).select("word", "n", t.stem(F.col("word")).alias("stem")), f"SELECT word, count(*) AS n, {q.stem('word')} AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM {D}) GROUP BY word")
_add("str04_sentences", lambda s, d: _docs(s, d).select("doc_id", t.sentences(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "|").cast("binary")).alias("sentences")), f"SELECT doc_id, CAST(len(k) AS BIGINT) AS n, md5(array_to_string(k, '|')) AS sentences FROM (SELECT doc_id, {q.sentences('text')} AS k FROM {D})")
_add("str05_recursive_split", lambda s, d: chunking.recursive(_docs(s, d)).select("chunk_id", "part", "n_parts", F.length("embed_text").alias("n_embed")))
_overlap = f"""WITH p AS (SELECT doc_id, {q.sentences('text')} AS k FROM {D}),
u AS (SELECT doc_id, i, k[i] AS cur, k[i - 1] AS prev FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM p)),
t AS (SELECT *, right(prev, 80) AS tail FROM u)
SELECT doc_id, i - 1 AS pos, md5(CASE WHEN i = 1 THEN cur ELSE {q.strip("CASE WHEN contains(tail, ' ') THEN substr(tail, instr(tail, ' ') + 1) ELSE tail END || ' ' || cur")} END) AS piece FROM t"""
_add("str06_overlap", lambda s, d: _docs(s, d).select("doc_id", t.sentences(F.col("text")).alias("k")).select("doc_id", F.posexplode(t.overlapped(F.col("k"), 80)).alias("pos", "piece")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("piece").cast("binary")).alias("piece")), _overlap)
_add("win05_previous_tail", lambda s, d: _docs(s, d).select("doc_id", t.sentences(F.col("text")).alias("k")).select("doc_id", F.posexplode(t.tails(F.col("k"), 80)).alias("pos", "tail")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.coalesce("tail", F.lit("")).cast("binary")).alias("tail")), _overlap.split("SELECT doc_id, i - 1 AS pos")[0] + "SELECT doc_id, i - 1 AS pos, md5(CASE WHEN i = 1 THEN '' WHEN contains(tail, ' ') THEN substr(tail, instr(tail, ' ') + 1) ELSE tail END) AS tail FROM t")
_packed = f"""WITH s AS (SELECT doc_id, {q.sentences('text')} AS s FROM {D}), p AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN [] ELSE {q.pack('s', 160)} END AS k FROM s)
SELECT doc_id, CAST(len(k) AS BIGINT) AS n, md5(array_to_string(k, '|')) AS packed FROM p"""
_add("str07_pack", lambda s, d: _docs(s, d).select("doc_id", t.pack(t.sentences(F.col("text")), 160).alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "|").cast("binary")).alias("packed")), _packed)
_add("str08_header", lambda s, d: _docs(s, d).select("doc_id", t.header(F.col("title"), F.col("section")).alias("header")), f"WITH {q.CORPUS} SELECT doc_id, {q.header('title', 'section')} AS header FROM corpus")
_PC = f"WITH {q.PC} "
_add("str09_child_prefix", lambda s, d: chunking.parent_child(_docs(s, d)).select("chunk_id", F.md5(F.col("embed_text").cast("binary")).alias("embed")), _PC + "SELECT chunk_id, md5(embed_text) AS embed FROM pc")
_add("str10_chunk_ids", lambda s, d: chunking.parent_child(_docs(s, d)).select("chunk_id", "doc_id", F.col("part").cast("long").alias("part")), _PC + "SELECT chunk_id, doc_id, CAST(part AS BIGINT) AS part FROM pc")
_scalar("str11_checkable_tokens", lambda x: F.array_join(t.checkable(x), "|"), f"coalesce(array_to_string({q.checkable('text')}, '|'), '')")
_scalar("str12_looks_like_date", lambda x: x.rlike(t.unicode(t.DATE)), f"regexp_matches(text, {q.lit(t.DATE)})")
_add("str13_model_slug", lambda s, d: table(s, d, "pages").select("page_id", t.slug(F.col("url")).alias("slug")), "SELECT page_id, replace(url, '/', '__') AS slug FROM pages")
_add("str15_lengths", lambda s, d: chunking.parent_child(_docs(s, d)).select("chunk_id", F.length("embed_text").cast("long").alias("n_embed"), F.length("context_text").cast("long").alias("n_context")), _PC + "SELECT chunk_id, length(embed_text) AS n_embed, length(context_text) AS n_context FROM pc")
_scalar("str16_counter_zero", lambda x: x.rlike(t.unicode(t.COUNTER_ZERO)), f"regexp_matches({q.ascii_words('text')}, {q.lit(t.COUNTER_ZERO)})")
_scalar("flt03_empty_state", lambda x: F.regexp_extract(x, t.unicode(t.EMPTY_STATE), 0), f"regexp_extract({q.ascii_words('text')}, {q.lit(t.EMPTY_STATE)}, 0)")
_scalar("flt09_hedges", lambda x: x.rlike(t.unicode(t.HEDGE)), f"regexp_matches({q.ascii_words('text')}, {q.lit(t.HEDGE)})")
_scalar("htm09_counter_block", t.like_counter, "(" + " OR ".join(f"contains(lower(text), {q.lit(m.lower())})" for m in t.COUNTERS) + ")")
_add("htm10_boilerplate", lambda s, d: _docs(s, d).select(F.explode(F.split("text", "\n")).alias("line")).groupBy(F.md5(t.strip(F.col("line")).cast("binary")).alias("line"), t.strip(F.col("line")).rlike(t.unicode(t.BOILERPLATE)).alias("boilerplate")).agg(F.count("*").alias("n")), f"SELECT md5(l) AS line, regexp_matches(l, {q.lit(t.BOILERPLATE)}) AS boilerplate, count(*) AS n FROM (SELECT {q.strip('x')} AS l FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM {D})) GROUP BY ALL")

# Sets of checkable tokens: each document's numbers against its other specifics.
_NUM = "list_sort(list_distinct(regexp_extract_all(m, {})))"
_sets = f"""WITH m AS (SELECT doc_id, lower({q.ascii_words('text')}) AS m FROM {D}), k AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(m, {q.lit(t.NUMBER)}))) AS a, list_sort(list_distinct(regexp_extract_all(m, {q.lit(t.MONTH)}))) AS b FROM m)
"""


def _pair(s, d):
    x = _docs(s, d).select("doc_id", F.lower("text").alias("m"))
    return x.select("doc_id", F.array_sort(F.array_distinct(t.found(F.col("m"), t.unicode(t.NUMBER)))).alias("a"), F.array_sort(F.array_distinct(t.found(F.col("m"), t.unicode(t.MONTH)))).alias("b"))


_str = lambda x: F.array_join(x, "|")
_add("set02_union", lambda s, d: _pair(s, d).select("doc_id", _str(F.array_sort(F.array_union("a", "b"))).alias("tokens")), _sets + "SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(a || b)), '|'), '') AS tokens FROM k")
_TOKSETS = f"""WITH b AS (SELECT item_id, list_sort(list_distinct({q.tokens("coalesce(text, '')")})) AS t FROM benchmark), p AS (SELECT x.item_id, x.t AS a, y.t AS b FROM b x JOIN b y ON y.item_id = x.item_id + 1)
"""


def _items(s, d):
    b = table(s, d, "benchmark").select("item_id", F.array_sort(F.array_distinct(t.tokens(F.coalesce("text", F.lit(""))))).alias("a"))
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")


_add("set03_except", lambda s, d: _items(s, d).select("item_id", _str(F.array_sort(F.array_except("a", "b"))).alias("tokens")), _TOKSETS + "SELECT item_id, coalesce(array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|'), '') AS tokens FROM p")
_add("set04_intersect", lambda s, d: _items(s, d).select("item_id", _str(F.array_sort(F.array_intersect("a", "b"))).alias("tokens")), _TOKSETS + "SELECT item_id, coalesce(array_to_string(list_sort(list_intersect(a, b)), '|'), '') AS tokens FROM p")
_add("set05_ordered_distinct", lambda s, d: table(s, d, "benchmark").select("item_id", _str(F.array_distinct(t.tokens(F.coalesce("text", F.lit(""))))).alias("tokens")), f"""WITH u AS (SELECT item_id, i, k[i] AS w FROM (SELECT item_id, k, unnest(range(1, len(k) + 1)) AS i FROM (SELECT item_id, {q.tokens("coalesce(text, '')")} AS k FROM benchmark))), f AS (SELECT item_id, w, min(i) AS i FROM u GROUP BY ALL)
SELECT item_id, coalesce(string_agg(w, '|' ORDER BY i), '') AS tokens FROM benchmark LEFT JOIN f USING (item_id) GROUP BY item_id""")
_add("set06_subset", lambda s, d: _items(s, d).select("item_id", (F.size(F.array_except("a", "b")) == 0).alias("within"), F.size(F.array_except("a", "b")).cast("long").alias("beyond")), _TOKSETS + "SELECT item_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS within, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS beyond FROM p")
_add("set01_union_all", lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("origin")).unionByName(table(s, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("origin"))), "SELECT doc_id AS id, 'document' AS origin FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
_add("arr01_map_merge", lambda s, d: chunking.parent_child(_docs(s, d)).select("chunk_id", F.map_concat(F.create_map(F.lit("kind"), F.col("kind")), F.create_map(F.lit("child"), F.col("part").cast("string"), F.lit("n_children"), F.col("n_parts").cast("string"))).alias("meta")).select("chunk_id", F.to_json("meta").alias("meta")), f"""WITH {q.PC} SELECT chunk_id, '{{"kind":"' || kind || '","child":"' || part || '","n_children":"' || n_parts || '"}}' AS meta FROM pc""")
_add("arr02_slice", lambda s, d: table(s, d, "benchmark").select("item_id", _str(F.slice(t.tokens(F.coalesce("text", F.lit(""))), 1, 3)).alias("first3")), f"""SELECT item_id, coalesce(array_to_string(({q.tokens("coalesce(text, '')")})[1:3], '|'), '') AS first3 FROM benchmark""")
_add("arr03_enumerate_zip", lambda s, d: _items(s, d).select("item_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).where("z.a is not null and z.b is not null").select("item_id", F.col("i").cast("long").alias("i"), "z.a", "z.b"), _TOKSETS + "SELECT item_id, i - 1 AS i, a[i] AS a, b[i] AS b FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM p)")
_add("arr04_context_join", lambda s, d: _docs(s, d).groupBy("section").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("k")).select("section", F.md5(F.lower(F.array_join(F.col("k.text"), " \n ")).cast("binary")).alias("context")), f"WITH {q.CORPUS} SELECT section, md5(lower(string_agg(text, ' ' || chr(10) || ' ' ORDER BY doc_id))) AS context FROM corpus GROUP BY section")
_add("arr05_map_lookup", lambda s, d: _docs(s, d).select("doc_id", F.try_element_at(F.create_map("kind", "section"), F.lit("en")).alias("section_if_en")), f"WITH {q.CORPUS} SELECT doc_id, CASE WHEN kind = 'en' THEN section END AS section_if_en FROM corpus")
_add("jsn01_json", lambda s, d: _docs(s, d).select("doc_id", F.from_json(F.to_json(F.struct("doc_id", "kind", "title")), "doc_id bigint, kind string, title string").alias("j")).select("doc_id", "j.kind", "j.title"), f"WITH {q.CORPUS} SELECT doc_id, kind, title FROM corpus")
_add("src05_json_list_or_object", lambda s, d: _docs(s, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array(F.struct("doc_id", "title")))).otherwise(F.concat(F.lit('{"chunks":'), F.to_json(F.array(F.struct("doc_id", "title"))), F.lit("}"))).alias("j")).select("doc_id", F.explode(F.coalesce(F.when(F.col("j").startswith("["), F.from_json("j", "array<struct<doc_id:bigint,title:string>>")), F.from_json("j", "struct<chunks:array<struct<doc_id:bigint,title:string>>>")["chunks"])).alias("c")).select("doc_id", "c.title"), f"WITH {q.CORPUS} SELECT doc_id, title FROM corpus")
