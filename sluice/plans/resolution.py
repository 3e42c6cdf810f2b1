"""Queries that chain operators: block, compare, decide and map; service results with their sources; state kept in files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import similarity as S
from sluice.operators import blocking, graph, relational, review
from sluice.plans import catalogue as C
from sluice.plans.catalogue import query
from sluice.plans.fixtures import fixture
from sluice.sources import extraction, files
from sluice.storage import load_state, save_state, written

# Pairs that blocking finds -------------------------------------------------------------------------------------

#: Pairs at or over this cosine of character terms are decided to match.
SAME = 0.8

_COSINES = """cs as (select p.left_norm, p.right_norm, sum(a.weight * b.weight) as s from pairs p join wt a on a.name = p.left_norm join wt b on b.name = p.right_norm and b.term = a.term group by 1, 2),
ws as (select p.left_norm, p.right_norm, sum(a.weight * b.weight) as s from pairs p join wtw a on a.name = p.left_norm join wtw b on b.name = p.right_norm and b.term = a.term group by 1, 2),
cosines as (select p.left_norm, p.right_norm, round(coalesce(cs.s, 0), 6) as charsim, round(coalesce(ws.s, 0), 6) as wordsim from pairs p
 left join cs on cs.left_norm = p.left_norm and cs.right_norm = p.right_norm left join ws on ws.left_norm = p.left_norm and ws.right_norm = p.right_norm)"""
_JUDGED = "case when length(left_norm) % 3 = 0 then 0.0 when length(left_norm) % 3 = 1 then 0.9 else 1 - 0.9 end"


@query(f"""with {C._PAIRS}, {_COSINES} select left_norm, right_norm, charsim, wordsim, {_JUDGED} as openai_pred,
 1 - levenshtein(left_norm, right_norm) / greatest(length(left_norm), length(right_norm)) as levenstein, jaro_winkler_similarity(left_norm, right_norm) as jaro_winkler,
 len(list_intersect({C._LETTERS.format('left_norm')}, {C._LETTERS.format('right_norm')})) / len(list_distinct({C._LETTERS.format('left_norm')} || {C._LETTERS.format('right_norm')})) as first_letter_jaccard,
 ln(length(left_norm) + length(right_norm)) as combined_len, least(length(left_norm), length(right_norm)) / greatest(length(left_norm), length(right_norm)) as len_ratio from cosines""")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every pair that blocking finds, but for the ratios that SQL lacks (similarity_ratios)."""
    cosines = C._QUERIES["pair_cosines"](spark, sf_dir)
    names = ["levenstein", "jaro_winkler", "first_letter_jaccard", "combined_len", "len_ratio"]
    judged = cosines.where(F.length("left_norm") % 3 > 0).select("left_norm", "right_norm", (F.length("left_norm") % 3 == 1).alias("are_same_entity"), F.lit(0.9).alias("confidence"))
    return extraction.with_predictions(S.featurize(cosines, {n: S.FEATURES[n] for n in names}), judged)


@query(f"""with recursive {C._PAIRS}, {_COSINES}, dec as (select left_norm as l, right_norm as r, charsim >= {SAME} as m from cosines), e as (select l as u, r as v from dec where m union select r, l from dec where m),
nd as (select l as node from dec union select r from dec), walk as (select node, node as c from nd union select e.v, walk.c from walk join e on e.u = walk.node), comp as (select node, min(c) as component from walk group by node),
big as (select component from comp group by 1 having count(*) > 1), raw as (select comp.component, nodes.raw_name as name, count(*) as times from comp join big on big.component = comp.component join nodes on nodes.norm = comp.node group by 1, 2),
far as (select a.component, a.name, sum(b.times * levenshtein(a.name, b.name)) as d from raw a join raw b on a.component = b.component group by 1, 2), med as (select component, arg_min(name, struct_pack(d := d, n := name)) as medoid from far group by 1)
select comp.node as original_name, med.medoid as mapped_name from comp join med on med.component = comp.component""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From names to their mapping: block, compare, decide by a threshold, take components, map each name to its medoid."""
    known = C._known(spark, sf_dir)
    norms = C._norms(spark, sf_dir, known)
    pairs = C._pairs(spark, sf_dir, known, norms)
    weights = blocking.tfidf(norms, blocking.char_grams(F.col("name")))
    decided = blocking.cosine(pairs, weights, "charsim").select(F.col("left_norm").alias("left"), F.col("right_norm").alias("right"), (F.round("charsim", 6) >= SAME).alias("is_match"))
    return graph.name_mapping(graph.match_components(written(decided, "decided")), C._nodes(spark, sf_dir, known))


@query(f"with {C._PAIRS} select left_norm as norm from pairs union select right_norm from pairs")
def blocked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.names_in(C._pairs(spark, sf_dir))


@query(f"""with {C._PAIRS}, met as (select left_norm as norm from pairs union select right_norm from pairs)
select distinct cast(d.year as varchar) || '-' || cast(d.number as varchar) as docket from nodes n join fx_dockets d on d.document_id = n.doc_id where n.norm in (select norm from met)""")
def blocked_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    stands = graph.positions(C._nodes(spark, sf_dir), fixture(spark, sf_dir, "fx_dockets"))
    return graph.neighbouring_dockets(stands, blocking.names_in(C._pairs(spark, sf_dir)))


@query(f"with {C._PAIRS} select p.left_norm, p.right_norm, max(mg.char_similarity) as p from pairs p join mg on p.left_norm = least(mg.left_side, mg.right_side) and p.right_norm = greatest(mg.left_side, mg.right_side) group by 1, 2")
def probable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filers' names are known here, whatever their category; documents hold those of organisations."""
    known = C._known(spark, sf_dir)
    norms = C._norms(spark, sf_dir, known)
    merged = blocking.merge_blocks(C._char_pairs(norms), C._word_pairs(norms))
    return graph.probable_edges(merged, C._nodes(spark, sf_dir, known), "char_similarity", "left_side", "right_side", norms.withColumnRenamed("name", "norm"))


@query(f"with {C._PAIRS} select left_norm, right_norm from pairs order by left_norm, right_norm limit 50")
def limited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pairs that a run with a limit of 50 sends."""
    return C._pairs(spark, sf_dir).orderBy("left_norm", "right_norm").limit(50)


@query(f"""with {C._PAIRS}, b as (select left_norm, right_norm, (n - 1) // 10 as batch, (n - 1) % 10 + 1 as pair from (select *, row_number() over (order by left_norm, right_norm) as n from pairs)),
m as (select batch, count(*) as pairs, length('{extraction.ASK}' || string_agg('Pair ' || cast(pair as varchar) || ':' || chr(10) || 'Org 1: ' || left_norm || chr(10) || 'Org 2: ' || right_norm || chr(10) || chr(10), '') || '{extraction.ANSWER}') as n from b group by batch),
t as (select cast(sum(n // 4 + 25) as bigint) as input_tokens, cast(sum(pairs) * 50 + count(*) * 50 as bigint) as output_tokens from m) select input_tokens, output_tokens, input_tokens / 1e6 * 0.075 + output_tokens / 1e6 * 0.30 as cost from t""")
def pair_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.pair_cost(extraction.pair_batches(C._pairs(spark, sf_dir)), "p" * 100)


@query(f"""{C._EQUIVALENCE}, ask as (select left_id as left_norm, right_id as right_norm from fx_decisions union select left_id, left_id from fx_decisions union select left_id, right_id + 1000000 from fx_decisions)
select left_norm, right_norm, case when left_norm = right_norm then 1.0 else coalesce(sigma, 0.0) end as dc_reg_eq from ask left join sg on sg.u = left_norm and sg.v = right_norm""")
def pair_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their regular equivalence, among them names beside themselves and names outside the graph."""
    d = fixture(spark, sf_dir, "fx_decisions").select("left_id", "right_id")
    ask = d.union(d.select("left_id", "left_id")).union(d.select("left_id", F.col("right_id") + 1_000_000)).distinct().toDF("left_norm", "right_norm")
    sigma = graph.regular_equivalence(d.toDF("u", "v"), pairs=ask.toDF("u", "v")).withColumn("sigma", F.round("sigma", 6))
    return graph.with_equivalence(ask, sigma)


@query("with one as (select least(left_id, right_id) as u, greatest(left_id, right_id) as v, avg(score) as p from fx_decisions group by 1, 2) select u, v, round(p, 10) as p from one union all select v, u, round(p, 10) from one where u <> v")
def pair_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pair_means(fixture(spark, sf_dir, "fx_decisions"), "score", "left_id", "right_id").withColumn("p", F.round("p", 10))


@query(f"with {C._NODES} select doc_id, array_to_string(list_sort(list(distinct norm)), '|') as names from nodes group by doc_id")
def names_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.names_by_document(C._nodes(spark, sf_dir)).select("doc_id", F.array_join("names", "|").alias("names"))


# Decisions and state -------------------------------------------------------------------------------------------


@query("select decision_id, n as number, n % 5 as since_save, n % 10 = 0 as trains from (select decision_id, row_number() over (order by ts, decision_id) as n from fx_decisions)")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_log(fixture(spark, sf_dir, "fx_decisions"), "ts", "decision_id").select("decision_id", "number", "since_save", "trains")


@query("select decision_id, left_id, right_id, is_match, component as left_component from fx_decisions join comp on node = left_id".join([C._COMPONENTS + " ", ""]))
def saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and components saved, first a part of them and then all, and the last state loaded."""
    at, d = C._folder(spark, "state"), C._decided(spark, sf_dir)
    for some in (d.where("decision_id % 2 = 0"), d):
        save_state({"decisions": some, "components": graph.match_components(some)}, at)
    state = load_state(spark, at)
    held = state["decisions"].select("decision_id", F.col("left").alias("left_id"), F.col("right").alias("right_id"), "is_match")
    return held.join(state["components"].select(F.col("node").alias("left_id"), F.col("component").alias("left_component")), "left_id")


@query("select doc_id as blob, 36 as id_length, true as stamped from documents")
def tracking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.tracking_rows(C._table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("blob", F.length("id").alias("id_length"), F.col("at").isNotNull().alias("stamped"))


@query("select doc_id as blob, quality = 1 as has_text, cast(null as varchar) as error from labels union all select doc_id, null, 'new' from documents")
def appended_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = C._table(spark, sf_dir, "labels").select(F.col("doc_id").alias("blob"), (F.col("quality") == 1).alias("has_text"))
    return relational.appended(old, C._table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob"), F.lit("new").alias("error")))


# Results of the service ----------------------------------------------------------------------------------------

_LEGACY = "lg as (select event_id, case event_id % 5 when 1 then 'error' when 2 then 'empty' else case when event_id % 7 = 0 then 'undecodable' end end as error from events)"


def _legacy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Legacy responses, and the table from request to source file as it was stored: one file in eleven is not in it."""
    filer = F.struct(F.lit("A").alias("name"), F.lit("organization").alias("type"))
    brief = F.struct(F.lit("P").alias("position"), F.array(F.lit("No. 18-5")).alias("dockets"))
    lines = C._responses(spark, sf_dir, F.to_json(F.struct(F.array_repeat(filer, (F.col("event_id") % 3).cast("int")).alias("filers"), brief.alias("brief"), F.lit("high").alias("confidence"))))
    at, known = C._folder(spark, "sources"), C._table(spark, sf_dir, "events").where("event_id % 11 <> 0")
    files.write_csv(known.select(F.concat(F.lit("batch_"), F.col("event_id").cast("string")).alias("custom_id"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("source_file")), at)
    return extraction.legacy_records(lines, files.table_csv(spark, at, "custom_id string, source_file string"))


@query(f"with {_LEGACY} select 'f' || cast(event_id as varchar) as source_file, case when error is null then 'high' else 'error' end as confidence, error, case when error is null then cast(event_id % 3 as int) else 0 end as n_filers from lg where event_id % 11 <> 0")
def legacy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(spark, sf_dir)[0].select("source_file", "confidence", "error", F.when(F.col("filers").isNull(), 0).otherwise(F.size("filers")).alias("n_filers"))


@query("select 'batch_' || cast(event_id as varchar) as custom_id from events where event_id % 11 = 0")
def unknown_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(spark, sf_dir)[1]


@query(f"with {_LEGACY} select count(*) as files, count(error) as errors, cast(coalesce(sum(event_id % 3) filter (where error is null), 0) as bigint) as filers, count(*) filter (where error is null) as dockets from lg where event_id % 11 <> 0")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.run_statistics(_legacy(spark, sf_dir)[0])


@query("select event_id as batch, 1 as pair, true as are_same_entity, round(value / 1000.0, 3) as confidence from events where event_id % 5 not in (1, 2) and event_id % 7 <> 0 and event_id % 2 = 0 and round(value / 1000.0, 3) >= 0.2 order by confidence desc, batch limit 5")
def confident_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five surest matches."""
    return extraction.confident(extraction.verdicts(C._responses(spark, sf_dir)), 0.2).limit(5)


@query("select d.counsel_of_record as left_norm, l.name as right_norm from fx_documents d join fx_lawyers l on l.document_id = d.document_id where d.document_id % 3 <> 0 and d.document_id % 5 <> 0")
def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from two columns, of which some rows lack one name or have a blank one."""
    both = fixture(spark, sf_dir, "fx_documents").join(fixture(spark, sf_dir, "fx_lawyers"), "document_id")
    gaps = both.select(F.when(F.col("document_id") % 3 != 0, F.col("counsel_of_record")).alias("a"), F.when(F.col("document_id") % 5 != 0, F.col("name")).otherwise(" ").alias("b"))
    return extraction.name_pairs(gaps, "a", "b")


@query("select cast(d.doc_id as varchar) || '.pdf' as blob_name, l.quality, l.toxic from documents d left join labels l on l.doc_id = d.doc_id and l.doc_id % 3 <> 0")
def results_with_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results beside what is known of their briefs, found by the last part of the blob's name."""
    briefs = C._table(spark, sf_dir, "labels").where("doc_id % 3 <> 0").select(F.concat(F.lit("host/a/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("blob"), "quality", "toxic")
    return extraction.with_metadata(C._table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("blob_name")), briefs)


@query("select cast(doc_id as varchar) as custom_id, sha256(substr(coalesce(text, ''), 1, 30000)) as sha from documents")
def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as the service allows them, with 30,000 characters of a text at most, and what they send."""
    texts = C._table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    sent = F.get_json_object("line", "$.body.messages[1].content")
    return extraction.document_requests(texts, "p", limit=30_000).select("custom_id", F.sha2(sent.cast("binary"), 256).alias("sha"))


# Folders -------------------------------------------------------------------------------------------------------


@query("select page_id from pages")
def stored_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing kept from its first reading: what comes to the folder later is not in it."""
    at, cache = C._folder(spark, "blobs"), C._folder(spark, "listing")
    pages = C._table(spark, sf_dir, "pages").select("html", "page_id").repartition("page_id")
    pages.write.partitionBy("page_id").text(at)
    files.cached_listing(spark, at, cache, "*.txt")
    pages.withColumn("page_id", -F.col("page_id")).write.mode("append").partitionBy("page_id").text(at)
    return files.cached_listing(spark, at, cache, "*.txt").select(F.regexp_extract("path", "page_id=([0-9]+)/", 1).cast("long").alias("page_id"))


@query("select 'documents' as name, count(*) as n, 0 as numbers from pages union all select 'dockets', count(*), cast(sum(page_id % 500) as bigint) from pages union all select 'filers', cast(sum(page_id % 3) as bigint), 0 from pages union all select 'lawyers', count(*), 0 from pages")
def database_from_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of extraction records, a file each, loaded as a database of four tables."""
    at, database, n = C._folder(spark, "records"), f"sluice_{uuid.uuid4().hex}", F.col("page_id") % 500
    filer = F.struct(F.lit("A").alias("name"), F.lit("organization").alias("category"))
    lawyer = F.struct(F.lit("L").alias("name"), F.lit("").alias("role"), F.lit("").alias("employer"))
    docket = F.struct(F.lit(18).alias("year"), n.alias("number"), F.lit("P").alias("position"))
    filers = F.array_repeat(filer, (F.col("page_id") % 3).cast("int"))
    records = C._table(spark, sf_dir, "pages").select("page_id", F.array(docket).alias("dockets"), filers.alias("filers"), F.array(lawyer).alias("lawyers"), F.lit(True).alias("complete_list"))
    records.repartition("page_id").write.partitionBy("page_id").json(at)
    relational.load_folder(spark, at, database, recursive=True)
    out = None
    for name in relational.list_tables(spark, database):
        numbers = F.coalesce(F.sum("number"), F.lit(0)) if name == "dockets" else F.lit(0)
        one = written(spark.table(f"{database}.{name}").agg(F.count("*").alias("n"), numbers.cast("long").alias("numbers")), name).select(F.lit(name).alias("name"), "n", "numbers")
        out = one if out is None else out.unionByName(one)
    spark.sql(f"drop database {database} cascade")
    return out
