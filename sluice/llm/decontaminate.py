"""Benchmark decontamination by winnowing, DataFrame functions only.

A window is `span` consecutive words.  Each window is represented by the smallest hash among its
`span - gram + 1` word grams, so two equal windows always carry the same fingerprint and every shared
passage of at least `span` words meets in the fingerprint join.  Neighbouring windows mostly share
their fingerprint, which is what keeps the joined side small.  Hits are then extended: each window of a
document with a met fingerprint is compared, as text, with the benchmark's windows.

Defined cases: a null or wordless text has no words, hits nothing and is hit by nothing; an item shorter
than `span` (but not wordless) is a single window of its own length; repeated rows get equal results;
null item ids never name an item; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ascii_lower, row_key, sized, written

CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
GRAM = 5


def spaced(text: Column) -> Column:
    """Lower-cased words of a text, one space between two."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def words_of(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def grams_of(line: Column, n: int) -> Column:
    """Every run of n words of a spaced line, overlapping, in order."""
    more = f"(?: [^ ]+){{{n - 1}}}" if n > 1 else ""
    return F.regexp_extract_all(line, F.lit(f"(?<![^ ])(?=([^ ]+{more}(?![^ ])))"), F.lit(1))


def fingerprints(line: Column, span: int, gram: int) -> Column:
    """The fingerprint of each window, in order of the windows' starts."""
    hashes = F.transform(grams_of(line, gram), lambda g: F.xxhash64(g))
    width = span - gram + 1
    # the one-element array binds the hashes, which would else be made anew for every window
    return F.flatten(
        F.transform(
            F.array(hashes),
            lambda h: F.transform(
                F.when(F.size(h) >= width, F.sequence(F.lit(1), F.size(h) - width + 1)).otherwise(F.array().cast("array<int>")),
                lambda i: F.array_min(F.slice(h, i, width)),
            ),
        )
    )


def match_windows(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(row_key, places, item_ids) of the documents hit, places being (pos in words from 0, length); and (row_key, doc_id, n_words) of all."""
    if not 1 <= gram <= span:
        raise ValueError("gram must lie between 1 and span")
    lines = items.select("item_id", spaced(F.col("text")).alias("line")).where("item_id is not null and line != ''")
    lines = lines.withColumn("n", F.size(F.split("line", " ")))
    windows = written(
        lines.select("item_id", F.least("n", F.lit(span)).alias("length"), F.explode(F.when(F.col("n") >= span, grams_of(F.col("line"), span)).otherwise(F.array("line"))).alias("window")).distinct(),
        "windows",
    )
    long = windows.where(F.col("length") == span)
    prints = written(long.select("window", F.element_at(fingerprints(F.col("window"), span, gram), 1).alias("print")).distinct(), "prints")
    facts = windows.agg(F.sum(F.length("window") + 48).alias("bytes"), F.collect_set(F.when(F.col("length") < span, F.col("length"))).alias("short")).first()
    small = facts["bytes"] or 0

    texts = docs.select("doc_id", "text").withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    line = texts.select("row_key", "doc_id", spaced(F.col("text")).alias("line"))
    n_words = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "))) + 1).cast("long")
    # the one pass over all texts; later passes read this table, or the texts of documents that were met
    read = written(line.select("row_key", "doc_id", n_words.alias("n_words"), F.array_distinct(fingerprints(F.col("line"), span, gram)).alias("prints")), "read")
    met = read.select("row_key", F.explode("prints").alias("print")).join(sized(prints.select("print").distinct(), small), "print", "left_semi").select("row_key")
    for n in sorted(facts["short"]):
        brief = windows.where(F.col("length") == n).select("window").distinct()
        met = met.unionByName(
            line.where("line != ''").select("row_key", F.explode(F.array_distinct(grams_of(F.col("line"), n))).alias("window"))
            .join(sized(brief, small), "window", "left_semi").select("row_key")
        )
    met = written(met.distinct(), "met")
    found = texts.join(sized(met, 16 * met.count()), "row_key", "left_semi").dropDuplicates(["row_key"]).select("row_key", spaced(F.col("text")).alias("line"))
    places = found.select("row_key", F.posexplode(F.arrays_zip(grams_of(F.col("line"), span).alias("window"), fingerprints(F.col("line"), span, gram).alias("print"))).alias("pos", "w"))
    hits = places.select("row_key", "pos", F.lit(span).alias("length"), "w.window", "w.print").join(sized(prints, small), ["print", "window"], "left_semi").select("row_key", "pos", "length", "window")
    for n in sorted(facts["short"]):
        brief = windows.where(F.col("length") == n).select("window").distinct()
        hits = hits.unionByName(found.select("row_key", F.posexplode(grams_of(F.col("line"), n)).alias("pos", "window")).join(sized(brief, small), "window", "left_semi").select("row_key", "pos", F.lit(n).alias("length"), "window"))
    hits = written(hits, "hits")
    named = hits.select("row_key", "window", "length").distinct().join(sized(windows, small), ["window", "length"]).groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    covered = hits.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("pos", "length"))).alias("places"))
    marks = written(covered.join(named, "row_key"), "marks")
    size = marks.agg(F.sum(32 + 16 * F.size("places") + 8 * F.size("item_ids")).cast("long")).first()[0] or 0
    return sized(marks, size), read.select("row_key", "doc_id", "n_words")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, places (pos, length of matched windows), n_hit words, item_ids (sorted)."""
    marks, read = match_windows(docs, items, span, gram)
    # places come in order of their starts; (end reached so far, words covered)
    reach = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct(
            F.greatest(a["end"], p["pos"] + p["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), p["pos"] + p["length"] - F.greatest(a["end"], p["pos"]))).alias("n"),
        ),
    )
    return read.join(marks.withColumn("n_hit", reach["n"].cast("long")), "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "places", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids")
    )


def strip_passages(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """documents with the matched words cut out of their texts; rows and columns stay, untouched texts stay as they are.

    What remains keeps its own separators; a text that is all passages becomes empty.
    """
    marks = match_windows(docs, items, span, gram)[0].select("row_key", "places")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "text", row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    text = F.coalesce(F.col("text"), F.lit(""))
    words, gaps = F.regexp_extract_all(text, F.lit(CASED_WORD), F.lit(0)), F.split(text, CASED_WORD, -1)
    hit = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["pos"], p["pos"] + p["length"] - 1))))
    keep = F.map_from_arrays(hit, hit)
    rest = F.concat(
        F.element_at("gaps", 1),
        F.array_join(F.transform("words", lambda w, i: F.when(F.col("hits")[i].isNotNull(), F.lit("")).otherwise(F.concat(w, F.element_at("gaps", i + 2)))), ""),
    )
    met = F.col("places").isNotNull()
    marked = keyed.join(marks, "row_key", "left").withColumns({"hits": F.when(met, keep), "words": F.when(met, words), "gaps": F.when(met, gaps)})
    new = F.when(F.col("places").isNull(), F.col("text")).otherwise(rest)
    return marked.select(*(new.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
