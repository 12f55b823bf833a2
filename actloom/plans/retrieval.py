"""Retrieval and sampling plans of the experiments: appendix cut, BM25, severity, effect windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .numbering import numbered


def before_appendix(segments: DataFrame, heading: str = r"(?i)^(appendix|supplementary|additional experiments)") -> DataFrame:
    """Segments before the first appendix heading of their context."""
    cut = segments.filter(F.rlike("text", F.lit(heading))).groupBy("ctx").agg(F.min("id").alias("__cut"))
    return segments.join(cut, "ctx", "left").filter("__cut is null or id < __cut").drop("__cut")


MARGIN = 1e-4  # below a threshold, as scores are rounded to 1e-5
SHARE = 0.5  # of the goal, that the words may add through which no document is met; any value gives the same result


def bm25(docs: DataFrame, queries: DataFrame, top: int = 3, terms: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best documents of each query (item_id, text) over its distinct words, or its first ``terms`` words.

    A posting is a word's part of a document's score. The documents of the ``top`` largest postings of each query's rarer
    words are scored first; the ``top``-th best of these scores, the goal, is reached by so many documents, so one that
    cannot reach it is out. A query's words of smallest bounds that together miss half the goal lead to no document: common
    words have small bounds, so most postings are never met. Of the documents met through the other words, those stay
    whose parts of these, with the bounds of the rest, reach the goal; they are scored on all words.
    """
    of = F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), "")
    asked = queries.select("item_id", F.explode(F.array_distinct(F.slice(of, 1, terms) if terms else of)).alias("word"))
    # the empty word stands for the document itself, so that one pass gives words, number and lengths
    itself = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(-1).cast("long").alias("t"))
    named = written(asked.select("word").distinct().withColumn("t", F.monotonically_increasing_id()).union(itself), "words")
    asked = written(asked.join(named, "word").select("item_id", "t"), "asked")
    split = docs.select("doc_id", of.alias("w")).select("doc_id", F.when(F.col("w").isNotNull(), F.size("w")).alias("len"), F.concat(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit(""))).alias("w"))
    tf = split.select("doc_id", "len", F.explode("w").alias("word")).join(named, "word").groupBy("doc_id", "t", "len").agg(F.count(F.lit(1)).alias("tf"))
    tf = written(tf, "tf")
    by_id = tf.filter("t = -1").groupBy("doc_id").agg(F.sum("tf").alias("n"), F.sum(F.when(F.col("len").isNotNull(), F.col("tf"))).alias("texts"), F.sum(F.col("tf") * F.col("len")).alias("words"), F.count(F.lit(1)).alias("rows"))
    size = by_id.agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("texts")).alias("avg_len"), F.max("rows").alias("rows"))
    tf = tf.filter("t >= 0")
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size))  # one row
    idf = written(df.select("t", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len", "rows"), "idf")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * ((1 - b) + b * F.col("len") / F.col("avg_len")))
    postings = written(tf.join(idf, "t").select("t", "doc_id", weight.alias("s")), "postings")
    scores = _scored(_candidates(asked, postings, idf, top), asked, postings)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= top)


def _scored(pairs: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of pairs, over all words of the query; postings of other documents are left first."""
    near = postings.select("t", F.col("doc_id").alias("__doc"), "s")
    near = near.join(pairs.select("doc_id").distinct(), F.col("__doc").eqNullSafe(F.col("doc_id")), "left_semi")
    wanted = pairs.join(asked, "item_id").withColumnRenamed("t", "__t")
    parts = wanted.join(near, (F.col("__t") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
    return parts.groupBy("item_id", "doc_id").agg(F.round(F.sum("s"), 5).alias("score"))


def _candidates(asked: DataFrame, postings: DataFrame, idf: DataFrame, top: int) -> DataFrame:
    """(item_id, doc_id) of the documents that may be among the best."""
    of_query = Window.partitionBy("item_id")
    place = F.row_number().over(of_query.orderBy(F.desc("idf"), "t"))
    rare = asked.join(idf, "t").withColumn("r", place).withColumn("all", F.count(F.lit(1)).over(of_query))
    rare = written(rare.filter((F.col("r") <= top) | (F.col("r") <= F.col("all") / 2)).select("item_id", "t"), "rare")
    nth = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "doc_id"))
    first = postings.join(rare.select("t").distinct(), "t", "left_semi").withColumn("r", nth).filter(F.col("r") <= top)
    seeds = _scored(written(rare.join(first, "t").select("item_id", "doc_id").distinct(), "seeds"), asked, postings)
    place = F.row_number().over(of_query.orderBy(F.desc("score")))
    goals = seeds.withColumn("r", place).filter(F.col("r") == top).select("item_id", (F.col("score") - MARGIN).alias("goal"))
    # an id with several documents of different lengths has a posting for each
    bounds = postings.groupBy("t").agg(F.max("s").alias("most")).join(idf, "t").select("t", (F.col("most") * F.col("rows")).alias("most"))
    # from the smallest bound up, words whose bounds together miss a share of the goal lead to no document
    small = F.sum("most").over(of_query.orderBy("most", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = asked.join(bounds, "t").join(goals, "item_id", "left").withColumn("goal", F.coalesce("goal", F.lit(0.0))).withColumn("small", small)
    minor = F.col("small") < F.col("goal") * SHARE
    rest = F.sum(F.when(minor, F.col("most")).otherwise(0.0)).over(of_query)
    essential = written(ranked.withColumn("rest", rest).filter(~minor).select("item_id", "t", "goal", "rest"), "essential")
    met = essential.join(postings, "t").groupBy("item_id", "doc_id").agg(F.sum("s").alias("part"), F.max("goal").alias("goal"), F.max("rest").alias("rest"))
    met = written(met.filter(F.col("part") + F.col("rest") >= F.col("goal") - MARGIN), "met")
    # the parts are lower bounds of scores, so their top-th largest is a goal too
    place = F.row_number().over(of_query.orderBy(F.desc("part")))
    higher = met.withColumn("r", place).filter(F.col("r") == top).select("item_id", (F.col("part") - MARGIN).alias("higher"))
    near = met.join(higher, "item_id", "left").filter(F.col("part") + F.col("rest") >= F.coalesce("higher", F.lit(0.0)) - MARGIN)
    return written(near.select("item_id", "doc_id"), "candidates")


def severity(forums: DataFrame, by: str = "score_change", key: str = "forum_id") -> DataFrame:
    """Terciles of a forum measure as low, medium, high; nulls come last. Numbers are dealt over range partitions of
    (measure, key), so neither a frequent value nor the whole table is one task."""
    rows = numbered(forums, [F.col(by).asc_nulls_last(), F.col(key)], "__at")
    total = forums.agg(F.count(F.lit(1)).alias("__t"))
    size, extra = F.floor(F.col("__t") / 3), F.col("__t") % 3
    one, two = size + (extra >= 1).cast("int"), 2 * size + F.least(extra, F.lit(2))
    name = F.when(F.col("__at") <= one, F.lit("low")).when(F.col("__at") <= two, F.lit("medium")).otherwise(F.lit("high"))
    return rows.crossJoin(F.broadcast(total)).withColumn("severity", name).drop("__at", "__t")  # one row


def change_after(moves: DataFrame, key: str, order: str, seeks: Column, changes: Column, within: int = 5) -> DataFrame:
    """Threads in which a change follows an evidence-seeking move within so many moves."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, within)
    hit = moves.withColumn("__h", seeks & (F.max(F.when(changes, 1).otherwise(0)).over(w) == 1))
    by_thread = hit.groupBy(key).agg(F.bool_or("__h").alias("__h"))
    return by_thread.agg(F.count_if("__h").alias("changed"), F.count(F.lit(1)).alias("threads"))


def split_forums(forums: DataFrame, by: str, most: int = 2000, key: str = "forum_id") -> DataFrame:
    """The ``most`` forums of the largest absolute measure."""
    return forums.filter(F.col(by).isNotNull() & (F.col(by) != 0)).orderBy(F.desc(F.abs(by)), key).limit(most)
