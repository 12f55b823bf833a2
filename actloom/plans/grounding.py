"""Re-grounding: each act's query, the operator it leads to, its observation, and thread seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import derive_query, observation_id, route
from ..sources.scratch import written


def routed(acts: DataFrame) -> DataFrame:
    """Acts with query and call struct<skill, argument, value>."""
    query = derive_query(F.col("grounding_ref"), F.col("action"), F.col("intent"), F.col("operation"), F.col("target_type"), (F.col("operation") != "") | (F.col("target_type") != ""))
    return acts.withColumn("query", query).withColumn("call", route("query"))


#: Whether a segment answers a call, by the operator; the identifiers are the digits the router took from a query. All numbers
#: behind a word are taken by a fixed pattern, which is compiled once, not once for each pair.
def _answers():
    value, text = F.col("value"), F.col("text")
    numbered = lambda words, a="", b="": F.array_contains(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{words})\s*{a}([0-9]+){b}\b"), 1), value)
    return (
        F.when(F.col("skill") == "Extract_Table", numbered(r"Table|Tab\.?"))
        .when(F.col("skill") == "Extract_Figure_Caption", numbered(r"Figure|Fig\.?"))
        .when(F.col("skill") == "Extract_Equation", numbered(r"Eq\.?,?|Equation", r"\(?", r"\)?"))
        .when(F.col("skill") == "Extract_Algorithm", numbered(r"Algorithm|Alg\.?"))
        .otherwise(F.contains(F.lower(text), F.lower(value)))
    )


def reground(acts: DataFrame, segments: DataFrame, max_matches: int = 5) -> DataFrame:
    """Acts with status, provenance (first matching segments) and observation id.

    The distinct questions of a context meet its segments by an equi-join; a context is one paper, so no pair
    across papers is formed, and only ids come out of the join. Acts are routed once; one dealing by context serves the
    distinct questions, the join and the grouping of its matches.
    """
    calls = written(routed(acts).select("act_id", "forum_id", "query", "call.*"), "calls")
    asked = calls.select("forum_id", "skill", "value").repartition("forum_id").distinct()
    hit = asked.join(segments.select(F.col("ctx").cast("string").alias("forum_id"), F.col("id").alias("seg"), "text"), "forum_id").filter(_answers())
    found = hit.groupBy("forum_id", "skill", "value").agg(F.slice(F.array_sort(F.collect_set("seg")), 1, max_matches).alias("prov"))
    out = calls.join(found, ["forum_id", "skill", "value"], "left").withColumn("prov", F.coalesce("prov", F.array().cast("array<int>")))
    out = out.withColumn("status", F.when(F.size("prov") > 0, F.lit("ok")).otherwise(F.lit("missing")))
    return out.withColumn("observation_id", observation_id(F.lit("text"), F.col("prov")))


def threads(acts: DataFrame) -> DataFrame:
    """A thread for each issue from its first act by (timestamp or 0, order): text, forum, seeded request."""
    when = F.struct(F.coalesce("timestamp", F.lit(0.0)), F.col("pos"))
    first = acts.filter(F.coalesce("issue_id", F.lit("")) != "").groupBy("issue_id").agg(F.min_by(F.struct("forum_id", "role", "action", "grounding_ref"), when).alias("f"))
    text = F.coalesce(F.nullif("f.action", F.lit("")), F.nullif("f.grounding_ref", F.lit("")), F.lit(""))
    asks = F.lower(F.coalesce("f.role", F.lit(""))).startswith("review")
    return first.select("issue_id", "f.forum_id", text.alias("issue_text"), F.lit("medium").alias("severity"), F.lit(6).alias("budget"), F.lit("Open").alias("phase"), F.when(asks, text).alias("request"))


def oracle_seeds(acts: DataFrame) -> DataFrame:
    """Threads with the intents and operators of all their acts, in order; an act without issue is its own."""
    key = F.coalesce(F.nullif("issue_id", F.lit("")), F.col("act_id"))
    moves = F.array_sort(F.collect_list(F.struct("pos", "intent", F.col("call.skill").alias("skill"))))
    out = routed(acts).groupBy(key.alias("issue_id")).agg(F.min_by("action", "pos").alias("issue_text"), moves.alias("m"))
    return out.select("issue_id", F.coalesce("issue_text", F.lit("")).alias("issue_text"), F.transform("m", lambda x: F.struct(x["intent"], x["skill"])).alias("oracle_moves"))
