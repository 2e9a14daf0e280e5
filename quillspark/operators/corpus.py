"""Corpus quality: the corpus view, routing of placeholders, invariants and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as t

# Limits of the corpus rules.
MIN_DOC_CHARS = 60
MIN_DOCS, MIN_CHARS, MIN_TIMELINE, MIN_FAQ = 25, 7000, 8, 5
# End of fixed values.


def corpus(documents: DataFrame) -> DataFrame:
    """Documents as sources of retrieval: doc_id, text, section, kind and a derived title; nulls become empty."""
    text, section = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    title = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", F.upper(section), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    return documents.select("doc_id", text.alias("text"), section.alias("section"), F.coalesce("lang", F.lit("")).alias("kind"), title.alias("title"))


def routed(docs: DataFrame) -> DataFrame:
    """Adds reason: why a document is dropped, or null if it is kept; the first rule that applies names it."""
    hit = F.regexp_extract("text", t.unicode(t.EMPTY_STATE), 0)
    size = F.length("text")
    reason = F.when(hit != "", F.concat(F.lit("empty-state placeholder ('"), hit, F.lit("')"))).when(size < MIN_DOC_CHARS, F.concat(F.lit("below MIN_DOC_CHARS ("), size.cast("string"), F.lit(f" < {MIN_DOC_CHARS})")))
    return docs.withColumn("reason", reason)


def invariants(docs: DataFrame) -> DataFrame:
    """One row (rule, n, ok) for each of the 14 rules a corpus is held to; n is what the rule counts.

    docs: doc_id, text, kind, title, volatile, date and extraction. All but two rules come from one pass.
    """

    def count(bad: Column) -> Column:
        return F.count_if(bad)

    timeline, faq, size = F.col("kind") == "timeline", F.col("kind") == "faq", F.length("text")
    rules = [
        ("01_min_docs", F.count("*"), MIN_DOCS),
        ("02_min_chars", F.coalesce(F.sum(size), F.lit(0)), MIN_CHARS),
        ("03_counter_zero", count(F.col("text").rlike(t.unicode(t.COUNTER_ZERO))), None),
        ("04_min_timeline", count(timeline), MIN_TIMELINE),
        ("05_undated", count(timeline & (F.coalesce("date", F.lit("")) == "")), None),
        ("06_fallback_timeline", count(timeline & (F.coalesce("extraction", F.lit("")) != "")), None),
        ("07_min_faq", count(faq), MIN_FAQ),
        ("08_unpaired_faq", count(faq & ~(F.contains("text", F.lit("Q:")) & F.contains("text", F.lit("A:")))), None),
        ("09_untitled", count(t.strip(F.col("title")) == ""), None),
        ("12_volatile", count(F.col("volatile")), None),
        ("13_placeholders", count(F.col("text").rlike(t.unicode(t.EMPTY_STATE))), None),
        ("14_too_short", count(size < MIN_DOC_CHARS), None),
    ]
    one = docs.agg(*[n.cast("long").alias(name) for name, n, _ in rules])
    limits = F.create_map(*[x for name, _, least in rules if least is not None for x in (F.lit(name), F.lit(least))])
    rows = one.unpivot([], [name for name, _, _ in rules], "rule", "n")
    # Bodies and ids are grouped by themselves: what repeats is summed up before it is shuffled.
    for rule, column in (("10_duplicate_bodies", "text"), ("11_duplicate_ids", "doc_id")):
        key = F.sha2(F.col(column).cast("binary"), 256) if column == "text" else F.col(column)
        many = docs.groupBy(key.alias("_key")).agg(F.count("*").alias("k")).where("k > 1")
        rows = rows.union(many.agg(F.count("*")).select(F.lit(rule), F.col("count(1)")))
    least = F.try_element_at(limits, F.col("rule"))
    return rows.select("rule", "n", F.when(least.isNull(), F.col("n") == 0).otherwise(F.col("n") >= least).alias("ok"))


def duplicate_bodies(docs: DataFrame) -> DataFrame:
    """How often each body occurs that occurs more than once, by its sha256 and length."""
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("body"), F.length("text").alias("n_chars")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


WORD = r"[^\x20\x09-\x0D]+"


def holding(docs: DataFrame, items: DataFrame, gram: int = 5) -> DataFrame:
    """qid and doc_id of the documents (doc_id, text) that hold the whole text of an item (qid, text).

    An item is looked up by one run of its inner words, the one of the least hash, as those stand whole in any text that
    holds it; only what shares that run is then searched for the text itself. Items of fewer than three words have no
    inner word, and may stand within any word: they are looked up by a run of their characters in the same way. Null texts
    hold nothing and are held by nothing, and an empty item is held by none.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    inner = items.select("qid", F.col("text").alias("item"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))).alias("w"))
    inner = inner.where(F.size("w") > 0).withColumn("k", F.least(F.lit(gram), F.size("w")))

    def runs(w: Column, k: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))

    named = inner.select("qid", "item", "k", F.array_min(runs(F.col("w"), F.col("k"))).alias("h"))
    cut = docs.select("doc_id", words.alias("w"))
    hits = None
    # At most `gram` lengths, whatever the items; most often one, so documents are read once.
    for k in [r.k for r in named.select("k").distinct().collect()] or [gram]:
        mine = named.where(F.col("k") == k).select("qid", "h")
        found = cut.where(F.size("w") >= k).select("doc_id", F.explode(F.array_distinct(runs(F.col("w"), F.lit(k)))).alias("h")).join(mine, "h").select("qid", "doc_id")
        hits = found if hits is None else hits.union(found)
    # Documents are cut to characters only where some item is that short.
    chars = F.split("text", "")
    short = items.where(F.size(words) < 3).where("text <> ''").select("qid", F.col("text").alias("item"), chars.alias("w")).withColumn("k", F.least(F.lit(gram), F.size("w")))
    short = short.select("qid", "item", "k", F.array_min(runs(F.col("w"), F.col("k"))).alias("h"))
    for k in [r.k for r in short.select("k").distinct().collect()]:
        mine = short.where(F.col("k") == k).select("qid", "h")
        spelt = docs.select("doc_id", chars.alias("w")).where(F.size("w") >= k)
        hits = hits.union(spelt.select("doc_id", F.explode(F.array_distinct(runs(F.col("w"), F.lit(k)))).alias("h")).join(mine, "h").select("qid", "doc_id"))
    named = named.select("qid", "item").union(short.select("qid", "item"))
    held = hits.distinct().join(docs.select("doc_id", "text"), "doc_id").join(named.select("qid", "item"), "qid")
    return held.where(F.contains("text", F.col("item"))).select("qid", "doc_id").distinct()
