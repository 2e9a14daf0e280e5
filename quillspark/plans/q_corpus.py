"""Queries over the corpus, chunks and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import answer, chunking, dense, elements, html
from quillspark.operators import corpus as c
from quillspark.sources import files, labelled
from quillspark.sources.tables import table

from . import sql as q

QUERIES, ORACLES = {}, {}
CORPUS = f"WITH {q.CORPUS} "
PC = f"WITH {q.PC} "


def _docs(spark, d):
    return c.corpus(table(spark, d, "documents"))


def _add(name, build, oracle=None):
    QUERIES[name] = build
    if oracle:
        ORACLES[name] = oracle


EMPTY = f"regexp_extract({q.ascii_words('text')}, {q.lit(t.EMPTY_STATE)}, 0)"
REASON = f"CASE WHEN {EMPTY} <> '' THEN 'empty-state placeholder (''' || {EMPTY} || ''')' WHEN length(text) < 60 THEN 'below MIN_DOC_CHARS (' || length(text) || ' < 60)' END"

# Sources.
_add("src03_docs_json", lambda s, d: files.json_round_trip(_docs(s, d)).select("doc_id", "title", "kind", "section", F.md5(F.col("text").cast("binary")).alias("text")), CORPUS + "SELECT doc_id, title, kind, section, md5(text) AS text FROM corpus")
_add("src04_chunks_by_strategy", lambda s, d: files.stored(chunking.chunks(_docs(s, d), ["structural", "parent_child"]), _docs(s, d).select("doc_id", F.col("text").alias("context_text")), "strategy")[0].where("strategy = 'parent_child'").groupBy("kind").agg(F.count("*").alias("n")), PC + "SELECT kind, count(*) AS n FROM pc GROUP BY kind")
_add("src06_label_violations", lambda s, d: table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "answer").otherwise("refuse").alias("expect"), F.when(F.col("toxic") == 0, F.array("doc_id")).alias("gold")).select("expect", F.coalesce("gold", F.array().cast("array<bigint>")).alias("gold")).groupBy("expect").agg(F.count("*").alias("n"), F.count_if((F.size("gold") > 0) != (F.col("expect") == "answer")).alias("violations")), "SELECT CASE WHEN quality = 1 THEN 'answer' ELSE 'refuse' END AS expect, count(*) AS n, count(*) FILTER ((toxic = 0) <> (quality = 1)) AS violations FROM labels GROUP BY 1")
_add("src07_case_defaults", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("answer"), F.when(F.col("role").isin("user", "assistant"), "pass").otherwise("block").alias("expect"), F.lit(False).alias("known_limit")).groupBy("expect", "known_limit").agg(F.count("*").alias("n"), F.count_if(~F.col("expect").isin("block", "pass")).alias("violations")), "SELECT CASE WHEN role IN ('user', 'assistant') THEN 'pass' ELSE 'block' END AS expect, false AS known_limit, count(*) AS n, 0 AS violations FROM conversations GROUP BY 1")


def _loaded(s, d):
    """An index that is written under its model, kind and strategy, and loaded from there."""
    path = files.scratch(s, "index")
    files.write_index(table(s, d, "embeddings").withColumn("strategy", F.lit("vectors")), path, "some/model", "flat")
    return files.read_index(s, path, "some/model", "flat", "vectors")


_add("src08_index_load", lambda s, d: _loaded(s, d).groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim")), "SELECT label, count(*) AS n, max(len(embedding)) AS dim FROM embeddings GROUP BY label")
_add("src10_query_bounds", lambda s, d: table(s, d, "conversations").where(F.length("text").between(1, 500)).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE length(text) BETWEEN 1 AND 500 GROUP BY role")
# Sinks.
_add("snk04_build_report", lambda s, d: dense.build_report(chunking.parent_child(_docs(s, d)), answer.hashing_embedder()), PC + "SELECT 'parent_child' AS strategy, count(*) AS n_vectors, 64 AS dim FROM pc")
_add("snk06_static_export", lambda s, d: chunking.split_contexts(_docs(s, d))[1].select("doc_id", F.md5(F.col("context_text").cast("binary")).alias("context")), PC + "SELECT doc_id, md5(any_value(context_text)) AS context FROM pc GROUP BY doc_id")
# Filters.
_add("flt01_skip_volatile", lambda s, d: table(s, d, "pages").withColumn("volatile", F.col("page_id") % 3 == 0).where(~F.col("volatile") | F.lit(False)).select("page_id", "url"), "SELECT page_id, url FROM pages WHERE NOT (page_id % 3 = 0)")
_add("flt02_routed", lambda s, d: c.routed(_docs(s, d)).select("doc_id", F.col("reason").isNull().alias("kept"), F.coalesce("reason", F.lit("")).alias("reason")), CORPUS + f"SELECT doc_id, r IS NULL AS kept, coalesce(r, '') AS reason FROM (SELECT doc_id, {REASON} AS r FROM corpus)")
_add("flt04_min_length", lambda s, d: _docs(s, d).where(F.length("text") >= c.MIN_DOC_CHARS).select("doc_id", F.length("text").cast("long").alias("n_chars")), CORPUS + "SELECT doc_id, length(text) AS n_chars FROM corpus WHERE length(text) >= 60")
_INV = f"""WITH {q.CORPUS}, x AS (SELECT *, doc_id % 7 = 0 AS volatile, CASE WHEN doc_id % 5 > 0 THEN 'd' END AS date, CASE WHEN doc_id % 11 = 0 THEN 'f' END AS extraction,
 CASE WHEN kind = 'en' THEN 'timeline' WHEN kind = 'de' THEN 'faq' ELSE kind END AS k2 FROM corpus),
r AS (SELECT '01_min_docs' AS rule, count(*) AS n, 25 AS least FROM x UNION ALL SELECT '02_min_chars', coalesce(sum(length(text)), 0), 7000 FROM x
 UNION ALL SELECT '03_counter_zero', count(*) FILTER (regexp_matches({q.ascii_words('text')}, {q.lit(t.COUNTER_ZERO)})), NULL FROM x UNION ALL SELECT '04_min_timeline', count(*) FILTER (k2 = 'timeline'), 8 FROM x
 UNION ALL SELECT '05_undated', count(*) FILTER (k2 = 'timeline' AND date IS NULL), NULL FROM x UNION ALL SELECT '06_fallback_timeline', count(*) FILTER (k2 = 'timeline' AND extraction IS NOT NULL), NULL FROM x
 UNION ALL SELECT '07_min_faq', count(*) FILTER (k2 = 'faq'), 5 FROM x UNION ALL SELECT '08_unpaired_faq', count(*) FILTER (k2 = 'faq' AND NOT (contains(text, 'Q:') AND contains(text, 'A:'))), NULL FROM x
 UNION ALL SELECT '09_untitled', count(*) FILTER ({q.strip('title')} = ''), NULL FROM x UNION ALL SELECT '10_duplicate_bodies', count(*), NULL FROM (SELECT text FROM x GROUP BY text HAVING count(*) > 1)
 UNION ALL SELECT '11_duplicate_ids', count(*), NULL FROM (SELECT doc_id FROM x GROUP BY doc_id HAVING count(*) > 1) UNION ALL SELECT '12_volatile', count(*) FILTER (volatile), NULL FROM x
 UNION ALL SELECT '13_placeholders', count(*) FILTER ({EMPTY} <> ''), NULL FROM x UNION ALL SELECT '14_too_short', count(*) FILTER (length(text) < 60), NULL FROM x)
SELECT rule, CAST(n AS BIGINT) AS n, CASE WHEN least IS NULL THEN n = 0 ELSE n >= least END AS ok FROM r"""


def _tagged(s, d):
    kind = F.when(F.col("kind") == "en", "timeline").when(F.col("kind") == "de", "faq").otherwise(F.col("kind"))
    x = _docs(s, d).withColumns({"volatile": F.col("doc_id") % 7 == 0, "date": F.when(F.col("doc_id") % 5 > 0, "d"), "extraction": F.when(F.col("doc_id") % 11 == 0, "f")})
    return x.withColumn("kind", kind)


_add("flt14_invariants", lambda s, d: c.invariants(_tagged(s, d)), _INV)
_add("flt15_warnings", lambda s, d: _tagged(s, d).select("doc_id", F.when(F.col("extraction").isNotNull(), "fallback").when(F.length("text").between(60, 89), "near_floor").alias("warning")).where("warning is not null"), CORPUS + "SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'fallback' WHEN length(text) BETWEEN 60 AND 89 THEN 'near_floor' END AS warning FROM corpus) WHERE warning IS NOT NULL")
# Aggregates.
_add("agg01_count_by_kind", lambda s, d: _docs(s, d).groupBy("kind").agg(F.count("*").alias("n")), CORPUS + "SELECT kind, count(*) AS n FROM corpus GROUP BY kind")
_add("agg02_totals", lambda s, d: _docs(s, d).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars")), CORPUS + "SELECT count(*) AS n_docs, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM corpus")
_STATS = f"""{q.PC}, ch AS (SELECT 'parent_child' AS strategy, length(embed_text) AS e, length(context_text) AS c FROM pc UNION ALL SELECT 'structural', length(text), length(text) FROM corpus)
SELECT strategy, count(*) AS n_chunks, min(e) AS embed_min, CAST(trunc(median(e)) AS INTEGER) AS embed_median, round_even(avg(e), 1) AS embed_mean, max(e) AS embed_max, min(c) AS context_min, CAST(trunc(median(c)) AS INTEGER) AS context_median, round_even(avg(c), 1) AS context_mean, max(c) AS context_max, round_even(sum(c) / sum(e), 2) AS amplification FROM ch GROUP BY strategy"""
_add("agg03_chunk_stats", lambda s, d: chunking.stats(chunking.chunks(_docs(s, d), ["structural", "parent_child"])), "WITH " + _STATS)
_add("agg08_duplicate_bodies", lambda s, d: c.duplicate_bodies(_docs(s, d)), CORPUS + "SELECT sha256(text) AS body, length(text) AS n_chars, count(*) AS n, min(doc_id) AS first_doc FROM corpus GROUP BY text HAVING count(*) > 1")
_add("agg09_unique_ids", lambda s, d: _docs(s, d).agg((F.count("*") == F.count_distinct("doc_id")).alias("is_unique")), CORPUS + "SELECT count(*) = count(DISTINCT doc_id) AS is_unique FROM corpus")
# Joins and windows over chunks.
_add("j02_child_to_parent", lambda s, d: chunking.parent_child(_docs(s, d)).drop("context_text").join(_docs(s, d).select("doc_id", F.col("text").alias("context_text")), "doc_id").select("chunk_id", F.length("context_text").cast("long").alias("n_context")), PC + "SELECT chunk_id, length(c.text) AS n_context FROM pc JOIN corpus c USING (doc_id)")
_add("j14_strategies", lambda s, d: chunking.chunks(_docs(s, d), ["structural", "parent_child"]).groupBy("strategy", "kind").agg(F.count("*").alias("n")), PC + "SELECT 'parent_child' AS strategy, kind, count(*) AS n FROM pc GROUP BY kind UNION ALL SELECT 'structural', kind, count(*) FROM corpus GROUP BY kind")
_add("win03_dedupe", lambda s, d: chunking.dedupe(chunking.parent_child(_docs(s, d)), ["chunk_id"]), PC + f"SELECT chunk_id FROM pc QUALIFY row_number() OVER (PARTITION BY lower({q.strip('embed_text')}) ORDER BY doc_id, part) = 1")
_add("win04_part_numbers", lambda s, d: chunking.part_numbers(_docs(s, d).select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "s"))).select("doc_id", F.col("part").cast("long").alias("part"), "n_parts"), f"SELECT doc_id, i - 1 AS part, CAST(len(k) AS BIGINT) AS n_parts FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM (SELECT doc_id, {q.sentences('text')} AS k FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))")

# Pages. The test pages have none of the structures that some extractors look for; one authored page has them all.
FIXTURE = """<html><body><div id="notice-board"><h2>Notices</h2><h3>Venue</h3><p>The venue is the old mill by the river, doors open at nine.</p></div>
<div id="timeline"><h2>Timeline</h2><div><div><div><span>1 May 2026</span></div><div><span>9 May 2026</span></div></div><div><div><p>Registration opens</p><p>Forms go live.</p></div><div><p>Results</p><p>Teams are told.</p></div></div></div></div>
<div id="tasks"><h2>Tasks</h2><h3>Build</h3><p>Build a thing.</p><li>Show it.</li><h3>Write</h3><p>Write about it.</p></div>
<button>Who can apply? +</button><div id="faq-panel-1">Anyone who builds things can apply.</div>
<main><h2>Rules</h2><p>Every team has one captain and keeps its own repository public.</p><h3>Prizes</h3><li>Prizes are paid in thirty days after the end.</li></main></body></html>"""


def pages_and_fixture(spark, d):
    one = spark.range(1).select(F.lit(-1).cast("long").alias("page_id"), F.lit("https://fixture.test/").alias("url"), F.lit(FIXTURE).alias("html"))
    return table(spark, d, "pages").select("page_id", "url", "html").unionByName(one).unionByName(one.withColumns({"page_id": F.lit(-2).cast("long"), "url": F.lit("https://fixture.test/terms")}))


def _stripped_sql(x):
    for tag in html.DROPPED:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
    for entity, char in html.ENTITIES:
        x = f"replace({x}, {q.lit(entity)}, {q.lit(char)})"
    return q.clean(x)


_add("htm01_strip_tags", lambda s, d: table(s, d, "pages").select("page_id", F.md5(html.stripped(F.col("html")).cast("binary")).alias("text")), f"SELECT page_id, md5({_stripped_sql('html')}) AS text FROM pages")
_add("htm08_generic", lambda s, d: html.generic(table(s, d, "pages")).select("page_id", "doc_id", F.length("text").cast("long").alias("n_chars"), "volatile"), f"SELECT page_id, url || '-00' AS doc_id, length(t) AS n_chars, true AS volatile FROM (SELECT page_id, url, {_stripped_sql('html')} AS t FROM pages) WHERE t <> ''")


def _rows(s, d, which):
    found = html.dispatch(pages_and_fixture(s, d)) if which == "dispatch" else html.extract(pages_and_fixture(s, d), which)
    return found.select("page_id", "doc_id", "section", "title", "text", "kind", "volatile", F.coalesce(F.to_json("meta"), F.lit("{}")).alias("meta"))


# What the fixture holds, written out by hand: the id's page, name, section, title, text and kind of each document, and its meta.
_NOTICES = [("notice-board-00", "Notices", "Venue", "Venue\nThe venue is the old mill by the river, doors open at nine.", "notice", "{}")]
_TIMELINE = [
    ("timeline-00", "The Timeline at a Glance", "Registration opens", "Registration opens — 1 May 2026\nForms go live.\nMilestone date: 1 May 2026.", "timeline", '{"date":"1 May 2026","milestone":"Registration opens"}'),
    ("timeline-01", "The Timeline at a Glance", "Results", "Results — 9 May 2026\nTeams are told.\nMilestone date: 9 May 2026.", "timeline", '{"date":"9 May 2026","milestone":"Results"}'),
]
_WHOLE_TIMELINE = [("timeline-00", "Timeline", "Timeline", "Timeline 1 May 2026 9 May 2026 Registration opens Forms go live. Results Teams are told.", "timeline", "{}")]
_TASKS = [("tasks-00", "Tasks", "Build", "Build\nBuild a thing.\nShow it.", "task", "{}"), ("tasks-01", "Tasks", "Write", "Write\nWrite about it.", "task", "{}")]
_FAQS = [("faq-00", "FAQs", "Who can apply?", "Q: Who can apply?\nA: Anyone who builds things can apply.", "faq", "{}")]
_PROSE = [("about-00", "About", "About the event", "About the event\nEvery team has one captain and keeps its own repository public.\nPrizes are paid in thirty days after the end.", "prose", "{}")]
_TERMS = [
    ("terms-00", "Terms & Conditions", "Rules", "Rules\nEvery team has one captain and keeps its own repository public.", "terms", "{}"),
    ("terms-01", "Terms & Conditions", "Prizes", "Prizes\nPrizes are paid in thirty days after the end.", "terms", "{}"),
]
_HOME = [*_NOTICES, *_TIMELINE, *_TASKS, *_FAQS, *_PROSE]


def _fixture_sql(rows, pages=(-1, -2)):
    cells = [f"({n}, " + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in row) + ")" for n in pages for row in rows]
    return f"SELECT page_id, doc_id, section, title, text, kind, false AS volatile, meta FROM (VALUES {', '.join(cells)}) v(page_id, doc_id, section, title, text, kind, meta)"


#: The test pages: no heading below h1, no ids; a body of blocks, of which paragraphs and items are read.
_BODY = "regexp_extract(html, '(?s)<body[^>]*>(.*)', 1)"
_PAGE_TERMS = f"SELECT page_id, 'terms-00' AS doc_id, 'Terms & Conditions' AS section, 'Terms & Conditions' AS title, t AS text, 'terms' AS kind, false AS volatile, '{{\"extraction\":\"whole-page-fallback\"}}' AS meta FROM (SELECT page_id, {_stripped_sql(_BODY)} AS t FROM pages) WHERE t <> ''"
_BLOCK = "(?is)</?(?:address|article|aside|blockquote|body|div|dl|footer|form|h[1-6]|header|hr|html|main|nav|ol|pre|section|table|ul)\\b[^>]*>|</(?:p|li)\\s*>"
_PARTS = f"string_split(regexp_replace(regexp_replace({_BODY}, '(?is)<(?:p|li)\\b[^>]*>', chr(1) || 'P', 'g'), '{_BLOCK}', chr(1) || 'N', 'g'), chr(1))"
_PAGE_PROSE = f"""SELECT page_id, 'about-00' AS doc_id, 'About' AS section, 'About the event' AS title, 'About the event' || chr(10) || string_agg(t, chr(10) ORDER BY i) AS text, 'prose' AS kind, false AS volatile, '{{}}' AS meta FROM (
  SELECT page_id, t, min(i) AS i FROM (SELECT page_id, i, {_stripped_sql("part[2:]")} AS t FROM (SELECT page_id, i, parts[i] AS part FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, {_PARTS} AS parts FROM pages))) WHERE part[1] = 'P')
  WHERE length(t) >= 40 AND NOT regexp_matches(t, {q.lit(t.BOILERPLATE)}) AND NOT ({" OR ".join(f"contains(lower(t), {q.lit(m.lower())})" for m in t.COUNTERS)}) GROUP BY page_id, t) GROUP BY page_id"""
_GENERIC = f"SELECT page_id, url || '-00' AS doc_id, '' AS section, '' AS title, t AS text, 'prose' AS kind, true AS volatile, '{{}}' AS meta FROM (SELECT page_id, url, {_stripped_sql('html')} AS t FROM pages) WHERE t <> ''"
for _name, _which, _sql in (
    ("htm02_faqs", "faqs", _fixture_sql(_FAQS)),
    ("htm03_sections", "sections", _fixture_sql([*_NOTICES, *_WHOLE_TIMELINE, *_TASKS])),
    ("htm04_timeline", "timeline", _fixture_sql(_TIMELINE)),
    ("htm05_prose", "prose", f"{_fixture_sql(_PROSE)} UNION ALL {_PAGE_PROSE}"),
    ("htm06_home", "home", f"{_fixture_sql(_HOME)} UNION ALL {_PAGE_PROSE}"),
    ("htm07_terms", "terms", f"{_fixture_sql(_TERMS)} UNION ALL {_PAGE_TERMS}"),
    ("htm11_dispatch", "dispatch", f"{_fixture_sql(_HOME, (-1,))} UNION ALL {_fixture_sql(_TERMS, (-2,))} UNION ALL {_GENERIC}"),
):
    _add(_name, lambda s, d, which=_which: _rows(s, d, which), _sql)
_add("win09_heading_groups", lambda s, d: html.extract(pages_and_fixture(s, d), "terms").groupBy("title").agg(F.count("*").alias("n")), f"SELECT title, count(*) AS n FROM ({_fixture_sql(_TERMS)} UNION ALL {_PAGE_TERMS}) GROUP BY title")
#: Elements of the test pages by pattern: what opens at a heading, paragraph or item, up to where it ends; the last heading is carried on.
_GROUPS = f"""WITH b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?is)<h1\\b[^>]*>', chr(1) || 'H', 'g'), '(?is)<(?:p|li)\\b[^>]*>', chr(1) || 'P', 'g'), '{_BLOCK}', chr(1) || 'N', 'g'), chr(1)) AS parts FROM pages),
e AS (SELECT page_id, i, part[1] AS tag, {_stripped_sql("part[2:]")} AS t FROM (SELECT page_id, i, parts[i] AS part FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM b))),
h AS (SELECT *, last_value(CASE WHEN tag = 'H' AND t <> '' THEN i END IGNORE NULLS) OVER w AS heading, last_value(CASE WHEN tag = 'H' AND t <> '' THEN t END IGNORE NULLS) OVER w AS title FROM e WINDOW w AS (PARTITION BY page_id ORDER BY i)),
l AS (SELECT page_id, heading, title, t, min(i) AS i FROM h WHERE heading IS NOT NULL AND tag = 'P' AND t <> '' AND NOT regexp_matches(t, {q.lit(t.BOILERPLATE)}) GROUP BY ALL)
SELECT page_id, md5(title) AS title, count(*) AS n_lines, md5(string_agg(t, chr(10) ORDER BY i)) AS body FROM l GROUP BY page_id, heading, title"""


def _element_groups(s, d):
    rows = elements.elements(table(s, d, "pages").select("page_id", "html"))
    groups = elements.heading_groups(rows, ["h1", "h2", "h3"], ["p", "li"], ["page_id"])
    md5 = lambda x: F.md5(F.col(x).cast("binary")).alias(x)
    return groups.where("body <> ''").select("page_id", md5("title"), F.size(F.split("body", "\n")).cast("long").alias("n_lines"), md5("body"))


_add("win09_element_groups", _element_groups, _GROUPS)


def _export(s, d):
    """The static export, written and read again."""
    path = files.scratch(s, "export")
    files.write_export(chunking.parent_child(_docs(s, d)), path)
    return files.read_export(s, path)


_add("snk06_export_chunks", lambda s, d: _export(s, d)[0].select("chunk_id", "doc_id", "parent_code", "title", "kind", F.md5(F.col("embed_text").cast("binary")).alias("embed"), F.md5(F.col("context_text").cast("binary")).alias("context")), PC + "SELECT chunk_id, doc_id, dense_rank() OVER (ORDER BY doc_id) - 1 AS parent_code, title, kind, md5(embed_text) AS embed, md5(context_text) AS context FROM pc")
_add("snk06_export_header", lambda s, d: _export(s, d)[1].select("n_chunks", "n_docs"), PC + "SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM pc")
# All strategies. How deep a recursive cut goes no SQL can tell; tests hold these against plain Python.
_add("snk02_chunk_summary", lambda s, d: chunking.summary(chunking.chunks(_docs(s, d))))
_add("snk04_build_reports", lambda s, d: dense.timed_report(chunking.chunks(_docs(s, d)), answer.hashing_embedder()).select("strategy", "n_vectors", "dim", (F.col("embed_ms") > 0).alias("timed")))


def _questions(s, d):
    """Labels as questions: what is good is to be answered, what is not toxic has gold; many contradict themselves."""
    labels = table(s, d, "labels")
    gold = F.when(F.col("toxic") == 0, F.array(F.col("doc_id").cast("string")))
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "answer").otherwise("refuse").alias("expect"), gold.alias("gold"))


_add("src06_question_faults", lambda s, d: labelled.question_faults(_questions(s, d)), "SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'expect=answer requires gold docs' ELSE 'expect=refuse must have empty gold' END AS fault FROM labels WHERE (quality = 1) <> (toxic = 0)")


def _turns(s, d):
    """Turns as guardrail cases: odd ones leave what the gate is to do to `expect`."""
    turns = table(s, d, "conversations")
    gate = F.when(F.col("turn") % 2 == 0, F.when(F.col("role") == "user", "pass").otherwise(F.col("role")))
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("query"), F.when(F.col("role") == "system", "odd").otherwise("block").alias("expect"), gate.alias("gate_expect"))


_SOUND = "SELECT concat_ws('-', conv_id, turn) AS id, turn, role, CASE WHEN turn % 2 = 0 THEN CASE WHEN role = 'user' THEN 'pass' ELSE role END END AS gate, CASE WHEN role = 'system' THEN 'odd' ELSE 'block' END AS expect FROM conversations"
_add("src07_case_faults", lambda s, d: labelled.case_faults(_turns(s, d)), f"SELECT id, CASE WHEN gate IS NOT NULL THEN 'gate_expect' ELSE 'expect' END || ' must be block|pass' AS fault FROM ({_SOUND}) WHERE coalesce(gate, expect) NOT IN ('block', 'pass')")


def _loaded_cases(s, d):
    cases = _turns(s, d)
    sound = cases.join(labelled.case_faults(cases), "id", "left_anti")
    return labelled.load_cases(sound).groupBy("expect", F.coalesce("gate_expect", F.lit("")).alias("gate_expect"), "known_limit", "answer").agg(F.count("*").alias("n"))


_add("src07_loaded_cases", _loaded_cases, f"SELECT expect, coalesce(gate, '') AS gate_expect, false AS known_limit, '' AS answer, count(*) AS n FROM ({_SOUND}) WHERE coalesce(gate, expect) IN ('block', 'pass') GROUP BY ALL")
