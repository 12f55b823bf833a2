"""The evidence gate and normalisation of plans and actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Actions that need no evidence. Fixed values.
FREE_ACTIONS = ("clarification", "evidence_plan", "conditional_commitment", "request")
DEFAULT_INTENTS = ("Request_Evidence", "Clarify", "Respond", "Close_Issue")
CLAIM = "array<struct<text:string,cites:array<string>>>"


def gate_claims(claims, status, allowed) -> Column:
    """Claims that keep a citable id; none unless the observation is ok. Repeated cites are kept."""
    c = F.col(claims) if isinstance(claims, str) else claims
    kept = F.filter(
        F.transform(c, lambda x: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), F.filter(x["cites"], lambda i: F.array_contains(allowed, i)).alias("cites"))),
        lambda x: F.size(x["cites"]) > 0,
    )
    return F.when(status == "ok", F.coalesce(kept, F.array().cast(CLAIM))).otherwise(F.array().cast(CLAIM))


def gate_action(action_type, status) -> Column:
    """Without evidence only free actions remain; others become a clarification."""
    return F.when((status == "ok") | F.coalesce(action_type.isin(*FREE_ACTIONS), F.lit(False)), action_type).otherwise(F.lit("clarification"))


def gate_single(claims, status, observation_id) -> Column:
    """The gate of the demo: claims must cite the current observation."""
    return gate_claims(claims, status, F.array(observation_id))


def citable(ledger_ids, current_id, status) -> Column:
    """Distinct ids of the ledger, and the current one if ok, in order."""
    now = F.when((status == "ok") & current_id.isNotNull(), F.array(current_id)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(ledger_ids, now), lambda x: x.isNotNull() & (x != "")))


def normal_plan(intent, skill, intents=DEFAULT_INTENTS, skills=("Extract_Span",)) -> Column:
    """struct<intent, skill>, each replaced by the inventory's first if unknown."""
    pick = lambda c, known: F.when(c.isin(*known), c).otherwise(F.lit(known[0]))
    return F.struct(pick(intent, intents or ("Request_Evidence",)).alias("intent"), pick(skill, skills or ("Extract_Span",)).alias("skill"))


def normal_action(action_type, text) -> Column:
    blank = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    return F.struct(blank(action_type, "response").alias("action_type"), blank(text, "").alias("text"))
