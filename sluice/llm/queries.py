"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import ann, decontaminate, hmm, jaccard, langid, licenses, packing, pii, quality, substrings
from sluice.llm.common import bucket, table, written


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(bucket(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs, weights)
    return scored.select(
        "doc_id",
        (bucket(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = langid.fit(docs.where(bucket(F.col("doc_id"), 5) != 0))
    return langid.predict(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.deduplicate(table(spark, sf_dir, "documents")))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return marks.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bg as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from bw where len(w) > 0)),
sizes as (select distinct n from bg),
dg as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
hit as (select doc_id, item_id, dg.n, i from dg join bg on dg.n = bg.n and dg.g = bg.g),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos using (doc_id) left join its using (doc_id)
"""


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.where(bucket(F.col("doc_id"), 7) != 2)
    counts = written(hmm.count_tokens(training), "counts")
    lex = hmm.lexicon(counts)
    scored = hmm.score(docs, counts, lex, hmm.train(training, lex))
    return scored.select(
        "doc_id", (bucket(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def tokenizer_path() -> str:
    """Where the public vocabulary file lies, unless SLUICE_TOKENIZER names another."""
    if path := os.environ.get("SLUICE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = written(pii.scan(table(spark, sf_dir, "documents")), "pii")
    found = pii.accepted(scanned, pii.fit(scanned))
    names = F.array(*map(F.lit, pii.ALL_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
ex as (select doc_id, unnest(s) as g from sh),
pr as (select a.doc_id as x, b.doc_id as y, count(*) as c from ex a join ex b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e1 as (select x, y from pr join sh p on p.doc_id = x join sh q on q.doc_id = y where 100 * c >= 85 * (len(p.s) + len(q.s) - c)),
e as (select x, y from e1 union all select y, x from e1),
walk as (select doc_id, doc_id as c from documents union select e.y, walk.c from walk join e on e.x = walk.doc_id)
select sh.doc_id, cast(len(s) as bigint) as n_shingles, component_id from sh join (select doc_id, min(c) as component_id from walk group by 1) using (doc_id)
"""


def _op8_sql() -> str:
    lower = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = lambda x: rf"regexp_extract_all({lower.format(x)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    notices = [(label, sorted(set(licenses.words(naming))), sorted(set(licenses.words(t))), *licenses.SIZES[licenses.size_of(t)]) for label, naming, t in licenses.TEMPLATES]
    held = ", ".join(f"({i}, '{label}', {naming!r}, {tw!r}, {block}, {block - longest + 1})" for i, (label, naming, tw, longest, block) in enumerate(notices))
    places = " union all ".join(f"select doc_id, '{label}' as label, unnest(list_filter(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ') = '{phrase}')) - 1 as k from w" for phrase, label in licenses.PHRASES.items() for n in [len(phrase.split())])
    return f"""
with w as (select doc_id, {split("text")} as w from documents), t(number, label, naming, tw, size, step) as (values {held}), pl as ({places}),
b as (select doc_id, size, step, list_distinct(w[k * step + 1:k * step + size]) as bw, k from (select doc_id, w, size, step, unnest(range(0, (greatest(len(w), 1) - 1) // step + 1)) as k from w, (select distinct size, step from t))),
m0 as (select doc_id, k, b.size, number, label, tw, len(list_intersect(bw, tw)) / len(tw) as share from b join t using (size, step) where len(list_intersect(bw, tw)) >= {licenses.THRESHOLD} * len(tw) - 1e-9 and len(list_intersect(bw, naming)) = len(naming)),
m as (select doc_id, label, share from m0 where not exists (select 1 from m0 o where o.doc_id = m0.doc_id and o.k = m0.k and o.size = m0.size and len(o.tw) > len(m0.tw) and len(list_intersect(o.tw, m0.tw)) = len(m0.tw))),
base as (select doc_id, count(*) as n, min(k) as lo, max(k) as hi, string_agg(distinct label, ',' order by label) as labels from pl group by 1),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from pl union all select doc_id, label from m) group by 1), best as (select doc_id, max(share) as share from m group by 1)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(base.n, 0) as bigint) as n_base, cast(lo as bigint) as first_word, cast(hi as bigint) as last_word, coalesce(base.labels, '') as base_labels,
 coalesce(every.labels, '') as labels, case when base.n > 0 then 1.0 else coalesce(best.share, 0.0) end::double as score from w left join base using (doc_id) left join every using (doc_id) left join best using (doc_id)
"""


OP8_SQL = _op8_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: globals()[sql] for name in queries() if (sql := name.split("_")[0].upper() + "_SQL") in globals()}
