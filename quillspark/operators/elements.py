"""Pages as a relational table of elements, and what stands under their headings, by windows over document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as t

from . import html

#: Elements whose text the table holds; others are places only.
TEXT_TAGS = {"h1", "h2", "h3", "h4", "p", "li", "main", "body"}
ELEMENT = "n int, tag string, name string, stop int, text string"


class PageElements:
    """A table function of a page's markup: its elements in document order, 0 for the page itself."""

    def eval(self, markup: str):
        page = html.Page(markup)
        for n, (tag, attrs) in enumerate(zip(page.tags, page.attrs, strict=True)):
            name = attrs.get("id")
            yield n, tag, name, page.stop[n], page.text(n) if n == 0 or tag in TEXT_TAGS or name in html.SECTIONS else None


def elements(pages: DataFrame) -> DataFrame:
    """page_id, n, tag, name (its id), stop (the number after its last descendant) and text of each element of each page.

    Each page (page_id, html) is parsed where it lies, by a lateral join with a table function; a null page has element 0.
    """
    of_page = F.udtf(PageElements, returnType=ELEMENT)
    return pages.select("page_id", "html").lateralJoin(of_page(F.col("html").outer())).drop("html")


def inside(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """The elements of each scope (page_id, scope, start, end): those after its start and before its end."""
    return rows.join(scopes, "page_id").where((F.col("n") > F.col("start")) & (F.col("n") < F.col("end")))


def heading_groups(rows: DataFrame, headings: list[str], tags: list[str], by: list[str], titled: bool = True, among: Column | None = None) -> DataFrame:
    """by, heading (its number), k (0 for the first in its group), title and body: each heading with the distinct texts of
    the given tags up to the next one.

    rows: n, tag, text and the columns by. Groups are islands between headings: the number of the last heading is carried
    on over the document order, and what comes before the first belongs to none. Texts of boilerplate are left out.
    titled: headings without text open no group. among: nor do those for which this does not hold.
    """
    order = Window.partitionBy(*by).orderBy("n")
    opens = F.col("tag").isin(headings) & ((F.col("text") != "") if titled else F.lit(True)) & (F.lit(True) if among is None else among)
    named = rows.withColumns({
        "heading": F.last(F.when(opens, F.col("n")), ignorenulls=True).over(order),
        "title": F.last(F.when(opens, F.col("text")), ignorenulls=True).over(order),
        "k": F.count(F.when(opens, 1)).over(order) - 1,
    }).where(F.col("heading").isNotNull())
    said = F.col("tag").isin(tags) & (F.col("n") > F.col("heading")) & (F.col("text") != "") & ~t.boilerplate(F.col("text"))
    first = named.groupBy(*by, "heading", "k", "title", F.when(said, F.col("text")).alias("line")).agg(F.min("n").alias("at"))
    lines = F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("at", "line"))))
    return first.groupBy(*by, "heading", "k", "title").agg(lines.alias("lines")).withColumn("body", F.array_join("lines.line", "\n")).drop("lines")


def _documents(groups: DataFrame, prefix, section, kind) -> DataFrame:
    text = F.concat("title", F.lit("\n"), "body")
    return groups.select("page_id", F.format_string("%s-%02d", prefix, F.col("k").cast("int")).alias("doc_id"), section.alias("section"), "title", text.alias("text"), kind.alias("kind"), F.lit(False).alias("volatile"), F.create_map().cast("map<string,string>").alias("meta"))


def terms(rows: DataFrame) -> DataFrame:
    """A document for each h2 or h3 of a page's main part with enough below it; the part as one, where there is none.

    rows: elements() of the pages.
    """
    first = lambda tag: F.min(F.when(F.col("tag") == tag, F.struct("n", "stop", "text")))
    part = rows.groupBy("page_id").agg(F.coalesce(first("main"), first("body"), F.min(F.when(F.col("n") == 0, F.struct("n", "stop", "text")))).alias("m"))
    scopes = part.select("page_id", F.col("m.n").alias("start"), F.col("m.stop").alias("end"))
    # What follows the last heading of the part belongs to it to the end of the page.
    groups = heading_groups(rows.join(scopes, "page_id"), ["h2", "h3"], ["p", "li"], ["page_id"], among=F.col("n").between(F.col("start") + 1, F.col("end") - 1))
    found = _documents(groups.where(F.length("body") >= html.MIN_TERM), F.lit("terms"), F.lit(html.TERMS_LABEL), F.lit("terms"))
    rest = part.join(found.select("page_id").distinct(), "page_id", "left_anti").where("m.text <> ''")
    label = F.lit(html.TERMS_LABEL)
    whole = rest.select("page_id", F.lit("terms-00").alias("doc_id"), label.alias("section"), label.alias("title"), F.col("m.text").alias("text"), F.lit("terms").alias("kind"), F.lit(False).alias("volatile"), F.create_map(F.lit("extraction"), F.lit(html.PAGE_FALLBACK)).alias("meta"))
    return found.unionByName(whole)


def sections(rows: DataFrame) -> DataFrame:
    """For each section that is known by its id, a document for each h3 in it, or the whole as one.

    rows: elements() of the pages.
    """
    kinds = F.create_map(*[F.lit(x) for pair in html.SECTIONS.items() for x in pair])
    scopes = rows.where(F.col("name").isin(list(html.SECTIONS))).groupBy("page_id", F.col("name").alias("scope")).agg(F.min(F.struct("n", "stop", "text")).alias("s"))
    scopes = scopes.select("page_id", "scope", F.col("s.n").alias("start"), F.col("s.stop").alias("end"), F.col("s.text").alias("whole"))
    within = inside(rows, scopes)
    by = ["page_id", "scope"]
    labels = within.where(F.col("tag").isin("h1", "h2")).groupBy(*by).agg(F.min(F.struct("n", "text")).alias("h"))
    named = scopes.join(labels, by, "left").select(*by, "whole", F.coalesce("h.text", "scope").alias("label"))
    groups = heading_groups(within, ["h3"], ["p", "li", "h4"], by, titled=False).where("body <> ''").join(named, by)
    found = _documents(groups, F.col("scope"), F.col("label"), kinds[F.col("scope")])
    rest = named.join(groups.select(*by).distinct(), by, "left_anti").where((F.col("whole") != "") & ~t.like_counter(F.col("whole")))
    whole = rest.select("page_id", F.concat("scope", F.lit("-00")).alias("doc_id"), F.col("label").alias("section"), F.col("label").alias("title"), F.col("whole").alias("text"), kinds[F.col("scope")].alias("kind"), F.lit(False).alias("volatile"), F.create_map().cast("map<string,string>").alias("meta"))
    return found.unionByName(whole)
