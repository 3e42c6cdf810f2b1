"""Blocking: TF-IDF weights as a long table, cosine as an equi-join on terms, the n best a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.storage import written

MAX_FEATURES, THRESHOLD, TOP = 20_000, 0.6, 10


def char_grams(name: Column, n: int = 3) -> Column:
    """Overlapping character n-grams; none of a shorter name."""
    places = F.when(F.length(name) >= n, F.sequence(F.lit(1), F.length(name) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(name, i, F.lit(n)))


def word_terms(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))


def tfidf(names: DataFrame, terms: Column, name: str = "name", max_features: int = MAX_FEATURES) -> DataFrame:
    """(name, term, weight): tf x (ln((1 + N) / (1 + df)) + 1), each name's weights of length 1; the most frequent terms only.

    Names are distinct first, so counts are per name; a name without a term does not appear.
    """
    names = names.select(name).where(F.col(name).isNotNull()).distinct()
    tf = names.select(name, F.explode(terms).alias("term")).withColumnRenamed(name, "name").groupBy("name", "term").agg(F.count("*").alias("tf"))
    tf = written(tf, "terms")
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    kept = stats.orderBy(F.desc("total"), "term").limit(max_features)  # max_features rows at any size of input
    n = names.agg(F.count("*").alias("n"))
    idf = kept.crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(idf), "term").select("name", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("name")))
    return raw.select("name", "term", (F.col("w") / length).alias("weight"))


def top_pairs(weights: DataFrame, threshold: float = THRESHOLD, top: int = TOP) -> DataFrame:
    """(left_side, right_side, similarity): for each name its `top` best at or over the threshold, itself counted but not given.

    Similarities are rounded to six places before they are compared, ties go to the smaller name.  Terms are ordered rare
    before frequent; of a pair at or over the threshold the first shared term lies so early in both names that what
    follows it could not reach the threshold alone, so only those first terms meet in the join and the frequent ones
    stay out of it.  The weights are written once.
    """
    rarity = weights.groupBy("term").agg(F.count("*").alias("df"))
    weights = written(weights.join(rarity, "term").select("name", "term", "weight", "df"), "weights")
    order = Window.partitionBy("name").orderBy("df", "term")
    before = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # what the terms from here on can still add to a cosine is at most the length of that rest
    prefix = written(weights.withColumn("before", before).where(F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("before"))) >= threshold - 1e-6).select("name", "term"), "prefix")
    met = prefix.withColumnRenamed("name", "left_side").join(prefix.withColumnRenamed("name", "right_side"), "term").select("left_side", "right_side").distinct()
    a = weights.select(F.col("name").alias("left_side"), "term", F.col("weight").alias("wl"))
    b = weights.select(F.col("name").alias("right_side"), "term", F.col("weight").alias("wr"))
    sims = met.join(a, "left_side").join(b, ["right_side", "term"]).groupBy("left_side", "right_side").agg(F.round(F.sum(F.col("wl") * F.col("wr")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("left_side").orderBy(F.desc("similarity"), "right_side"))
    return sims.where(F.col("similarity") >= threshold).withColumn("rank", rank).where((F.col("rank") <= top) & (F.col("left_side") != F.col("right_side"))).drop("rank")


def merge_blocks(chars: DataFrame, words: DataFrame) -> DataFrame:
    """Full outer join of both kinds of pairs, a missing similarity being 0."""
    a = chars.withColumnRenamed("similarity", "char_similarity")
    b = words.withColumnRenamed("similarity", "word_similarity")
    return a.join(b, ["left_side", "right_side"], "full").fillna(0.0, ["char_similarity", "word_similarity"])


def legal_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs as (left_norm, right_norm), the smaller first, once each, without those whose names share a document of docs (norm, doc_id)."""
    one = pairs.select(F.least("left_side", "right_side").alias("left_norm"), F.greatest("left_side", "right_side").alias("right_norm")).where("left_norm != right_norm").distinct()
    return apart_in_documents(one, docs)


def apart_in_documents(pairs: DataFrame, docs: DataFrame, most: int = 32) -> DataFrame:
    """pairs (left_norm < right_norm) without those whose names share a document of docs (norm, doc_id).

    A document of up to `most` names is spelt out as the pairs it holds, which no more than the documents decide the number of.  In
    larger ones only the names that are pairs meet.
    """
    pairs = written(pairs, "apart")
    one = pairs.select("left_norm", "right_norm")
    held = docs.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("norm").alias("names")).where(F.size("names") > 1)
    few = held.where(F.size("names") <= most).select("names", F.explode("names").alias("left_norm"))
    few = few.select("left_norm", F.explode(F.filter("names", lambda n: n > F.col("left_norm"))).alias("right_norm"))
    many = held.where(F.size("names") > most).select("doc_id", F.explode("names").alias("left_norm"))
    many = many.join(one, "left_norm").join(many.withColumnRenamed("left_norm", "right_norm"), ["right_norm", "doc_id"]).select("left_norm", "right_norm")
    shared = few.join(one, ["left_norm", "right_norm"], "left_semi").unionByName(many).distinct()
    return pairs.join(shared, ["left_norm", "right_norm"], "left_anti")


def names_in(pairs: DataFrame, left: str = "left_norm", right: str = "right_norm") -> DataFrame:
    """(norm): the different names of either side, in order."""
    return pairs.select(F.col(left).alias("norm")).union(pairs.select(right)).distinct().orderBy("norm")


def cosine(pairs: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """pairs (left_norm, right_norm) with the cosine of their weights as `name`, 0 where no term is shared."""
    a = weights.select(F.col("name").alias("left_norm"), "term", F.col("weight").alias("wl"))
    b = weights.select(F.col("name").alias("right_norm"), "term", F.col("weight").alias("wr"))
    both = pairs.select("left_norm", "right_norm").join(a, "left_norm").join(b, ["right_norm", "term"]).groupBy("left_norm", "right_norm").agg(F.sum(F.col("wl") * F.col("wr")).alias(name))
    return pairs.join(both, ["left_norm", "right_norm"], "left").fillna(0.0, [name])
