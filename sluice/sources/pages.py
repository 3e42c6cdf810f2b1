"""Docket pages: their title and document links, parsed where the cheap test says there is something to parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.names import absolute_url, in_years, is_brief_label


def mentions_filer(html: Column) -> Column:
    return F.coalesce(html.rlike("(?i)amicus|amici"), F.lit(False))


#: The character references that are resolved, the ampersand last.
REFERENCES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def plain_text(html: Column) -> Column:
    """Text of a piece of HTML: no tags, references resolved, no blanks at either end."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def table_of(html: Column, table_id: str) -> Column:
    """What stands in the table of that id; empty where there is none."""
    return F.regexp_extract(html, rf"""(?is)<table\b[^>]*\bid\s*=\s*["']?{table_id}["']?(?=[\s>])[^>]*>(.*?)</table>""", 1)


def page_links(pages: DataFrame, url: str = "url", html: str = "html", every: bool = False) -> DataFrame:
    """(docket_url, case_title, date, label, doc_title, url): the main documents listed on docket pages.

    Rows of the proceedings table are read in pairs, a label row and a link row; an odd last row and pages
    without the table give nothing.  every: all main documents of a pair, not the first alone.  Built-in functions
    only; a table ends at its first end tag.
    """
    worth = pages.where(mentions_filer(F.col(html))).select(F.col(url).alias("docket_url"), table_of(F.col(html), "docketinfo").alias("info"), table_of(F.col(html), "proceedings").alias("body"))
    title = F.array_join(F.filter(F.transform(F.split("info", "<[^>]*>"), plain_text), lambda x: x != ""), " ")
    rows = worth.where("body != ''").select("docket_url", title.alias("case_title"), F.regexp_extract_all("body", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|$)"), F.lit(1)).alias("rows"))
    # the head row is the first, so pair n holds rows 2n and 2n + 1 counted from one
    pairs = rows.where(F.size("rows") >= 3).select("docket_url", "case_title", "rows", F.explode(F.sequence(F.lit(1), F.floor((F.size("rows") - 1) / 2).cast("int"))).alias("n"))
    pairs = pairs.select("docket_url", "case_title", F.col("rows")[2 * F.col("n") - 1].alias("label"), F.col("rows")[2 * F.col("n")].alias("link"))
    anchor = lambda part: F.regexp_extract_all("link", F.lit(r"(?is)<a\b([^>]*)>(.*?)(?=</a>|<a\b|$)"), F.lit(part))
    pairs = pairs.withColumns({"cells": F.transform(F.regexp_extract_all("label", F.lit(r"(?is)<td\b[^>]*>(.*?)(?=</td>|<td\b|$)"), F.lit(1)), plain_text), "at": anchor(1), "of": F.transform(anchor(2), plain_text)})
    main = F.filter(F.arrays_zip("at", "of"), lambda x: x["of"] == "Main Document")
    href = plain_text(F.concat_ws("", F.regexp_extract("x.at", r"""(?i)\bhref\s*=\s*"([^"]*)\"""", 1), F.regexp_extract("x.at", r"(?i)\bhref\s*=\s*'([^']*)'", 1)))
    found = pairs.select("docket_url", "case_title", "cells", F.explode(main if every else F.slice(main, 1, 1)).alias("x")).withColumn("href", href).where(F.endswith("href", F.lit(".pdf")))
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    return found.select("docket_url", "case_title", cell(0).alias("date"), cell(1).alias("label"), F.lit("Main Document").alias("doc_title"), absolute_url(F.col("docket_url"), F.col("href")).alias("url"))


def filed_briefs(links: DataFrame) -> DataFrame:
    """Links of filer briefs of the wanted years, with the blob name."""
    from sluice.functions.names import blob_name, docket_url_key

    found = links.withColumns({"docket_url": docket_url_key(F.col("docket_url")), "blob": blob_name(F.col("url"))})
    return found.where(is_brief_label(F.col("label")) & in_years(F.col("blob")))


#: The labels of a case page's rows, by field; the first four have one value, the others a list.
CASE_FIELDS = {
    "case_number": "Supreme Court case number",
    "date_filed": "Date filed",
    "case_title": "Case",
    "position": "Position",
    "filer_organizations": "Amicus curiae",
    "petitioners": "Petitioner",
    "respondents": "Respondent",
}
_ROW = r'(?s)<div[^>]*class="[^"]*segColL[^"]*"[^>]*>(.*?)</div>\s*<div[^>]*>(.*?)</div>'


def case_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One record for each landed case page: rows of label and value, a row without a label continuing the one before.

    A field without a row is null, a list without one empty; `Show all ...` is no value.  Built-in functions only.
    """
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"(?U)\s+", " "))
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(url, F.transform(F.regexp_extract_all(text, F.lit(_ROW), F.lit(1)), plain).alias("_l"), F.transform(F.regexp_extract_all(text, F.lit(_ROW), F.lit(2)), plain).alias("_v"))
    named = F.transform("_v", lambda v, i: F.struct(F.try_element_at(F.filter(F.slice("_l", 1, i + 1), lambda x: x != ""), F.lit(-1)).alias("label"), v.alias("value")))
    filled = rows.withColumn("_rows", F.filter(named, lambda r: (r["value"] != "") & ~r["value"].startswith("Show all")))
    values = lambda label: F.transform(F.filter("_rows", lambda r: r["label"] == label), lambda r: r["value"])
    fields = [(values(label) if i >= 4 else F.get(values(label), F.lit(0))).alias(name) for i, (name, label) in enumerate(CASE_FIELDS.items())]
    return filled.select(*fields, F.col(url).alias("url"))


def link_targets(html: Column) -> Column:
    """href values of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def page_title(html: Column) -> Column:
    return F.trim(F.nullif(F.regexp_extract(html, r"<title>([^<]*)</title>", 1), F.lit("")))
