"""Name, docket, path and date expressions: Column in, Column out, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Abbreviations of common terms, in the order in which misspellings are tried.
TERMS = {
    "association": "assn",
    "committee": "comm",
    "foundation": "fdn",
    "institute": "inst",
    "organization": "org",
    "society": "soc",
    "federation": "fed",
    "international": "intl",
    "national": "natl",
    "division": "div",
    "group": "grp",
    "center": "ctr",
}
#: Legal forms that are dropped as words.
LEGAL_FORMS = ["inc", "llc", "corp", "ltd", "plc", "gmbh", "ag", "sa"]
#: File extensions by content type.
EXTENSIONS = {"application/pdf": "pdf", "text/html": "html", "application/json": "json", "text/plain": "txt"}


def shorten_terms(name: Column) -> Column:
    """Common terms, also when misspelt by one edit, become abbreviations; runs of blanks become one."""
    for term, short in TERMS.items():
        name = F.regexp_replace(name, rf"(?iU)\b{term}\b", short)
    tokens = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")

    def respelled(word: Column) -> Column:
        out = F.when(word.isin(*TERMS.values()), word)
        for term, short in TERMS.items():
            out = out.when((word != term) & (F.levenshtein(word, F.lit(term), 1) >= 0), F.lit(short))
        return out.otherwise(word)

    return F.array_join(F.transform(tokens, respelled), " ")


def normalize_name(name: Column) -> Column:
    """One spelling for the many of an organisation's name; the order of the steps matters.  Null stays null."""
    name = F.regexp_replace(name, r"(?iU)^(?:the|a|an)\s+", "")
    name = F.regexp_replace(name, rf"(?iU)\s+(?:{'|'.join(LEGAL_FORMS)})(?:\.|\b)", "")
    name = F.regexp_replace(name, r"(?U)\s*\([A-Z]{2,}\)\s*$", "")
    name = F.lower(F.replace(name, F.lit("&"), F.lit("and")))
    name = shorten_terms(F.translate(name, "',", ""))
    name = F.regexp_replace(name, r"(?U)\s*[-–—]+\s*", "-")
    return F.trim(F.regexp_replace(name, r"(?U)\s+", " "))


def normalized(rows: DataFrame, name: str = "name", norm: str = "norm", known: DataFrame | None = None) -> DataFrame:
    """rows with normalize_name(name) as norm; each different name is normalised once and joined back, or found in known (name, norm)."""
    if known is not None:
        return rows.join(known.select(F.col("name").alias("_name"), F.col("norm").alias(norm)), F.col(name) == F.col("_name"), "left").drop("_name")
    known = rows.select(name).distinct().select(F.col(name).alias("_name"), normalize_name(F.col(name)).alias(norm))
    return rows.join(known, F.col(name) == F.col("_name"), "left").drop("_name")


def docket_number(text: Column) -> Column:
    """The first NN-NNNN in a text, else null."""
    return F.nullif(F.regexp_extract(text, r"(\d{1,2}-\d{1,4})", 1), F.lit(""))


def docket_from_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"/(\d{1,2}-\d{1,4})/", 1), F.lit(""))


def checked_dockets(dockets: Column, path: Column, oldest: str = "17") -> Column:
    """Dockets of a record; if any of them is not in the path or too old, the path's docket alone; null if there is none either.

    A docket that has no number counts as one that is not in the path; no dockets at all fall back to the path too.
    """
    known = F.transform(F.coalesce(dockets, F.array().cast("array<string>")), docket_number)
    bad = F.exists(known, lambda d: d.isNull() | ~F.contains(path, d) | (F.substring(d, 1, 2) < oldest))
    fallback = docket_from_path(path)
    return F.when((F.size(known) > 0) & ~F.coalesce(bad, F.lit(True)), known).when(fallback.isNotNull(), F.array(fallback))


def docket_label(year: Column, number: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), number.cast("string"))


def docket_url_key(url: Column) -> Column:
    """What stands after SUPREMECOURT/, else the whole; null becomes empty."""
    return F.coalesce(F.element_at(F.split(url, "SUPREMECOURT/", 2), -1), F.lit(""))


def blob_name(url: Column) -> Column:
    """The storage name of a document url, whichever scheme it has."""
    return F.regexp_replace(url, "^https?://", "SUPREMECOURT/")


def page_blob(url: Column, extension: Column, folder: str = "") -> Column:
    """url without scheme and trailing slash; the extension is added unless the name ends in one."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "/$", "")
    named = F.when(bare.rlike(r"\.[a-z]+$"), bare).otherwise(F.concat(bare, F.lit("."), extension))
    return F.concat(F.lit(folder), named)


def text_name(blob: Column) -> Column:
    """The name with .txt in place of its suffix, or added where it has none."""
    return F.when(blob.rlike(r"\.[^./]*$"), F.regexp_replace(blob, r"\.[^./]*$", ".txt")).otherwise(F.concat(blob, F.lit(".txt")))


def extension_of(content_type: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.element_at(kinds, F.trim(F.substring_index(content_type, ";", 1)))


def page_year_number(blob: Column) -> Column:
    """struct(year, number) of a page blob .../YY-N.html; nulls where the name is another."""
    part = lambda i: F.nullif(F.regexp_extract(blob, r"(\d+)-(\d+)\.html$", i), F.lit("")).cast("int")
    return F.struct(part(1).alias("year"), part(2).alias("number"))


def absolute_url(page: Column, href: Column) -> Column:
    """href seen from the page: absolute, from the host's root, or beside the page."""
    root = F.regexp_extract(page, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(?<!/)/[^/]*$", "/")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page, r"^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.regexp_replace(folder, r"^([a-z]+://[^/]+)$", "$1/"), href))
    )


def parse_date(text: Column) -> Column:
    """`Jul 27 2018` to a date; anything else to null."""
    return F.try_to_date(text, "MMM d yyyy")


def is_brief_label(label: Column) -> Column:
    return F.coalesce(label.rlike("(?i)^Brief (amicus|amici)"), F.lit(False))


def in_years(blob: Column, first: int = 18, last: int = 24) -> Column:
    return F.coalesce(blob.rlike(f"DocketPDF/({'|'.join(str(y) for y in range(first, last + 1))})"), F.lit(False))


def is_docket(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{2}-\d+$"), F.lit(False))


def metadata_header(metadata: Column) -> Column:
    """A line `key: value` for each entry of a map that has a value."""
    filled = F.map_filter(metadata, lambda k, v: v.isNotNull() & (v != ""))
    return F.array_join(F.transform(F.array_sort(F.map_entries(filled)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def page_text(pages: Column, which: str = "all", mark: str = "\n--Page Break--\n") -> Column:
    """Pages joined by a mark: all, the `first` five, or the first and last four (`ends`; no page twice)."""
    if which == "first":
        pages = F.slice(pages, 1, 5)
    elif which == "ends":
        pages = F.when(F.size(pages) <= 8, pages).otherwise(F.concat(F.slice(pages, 1, 4), F.slice(pages, -4, 4)))
    elif which != "all":
        raise ValueError(f"which must be all, first or ends, not {which}")
    return F.array_join(pages, mark)


def has_embedded_text(pages: Column, least: int = 100) -> Column:
    """Whether the first three pages hold more than `least` characters."""
    return F.length(F.array_join(F.slice(pages, 1, 3), "")) > least
