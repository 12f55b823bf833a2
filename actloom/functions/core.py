"""Scalar expressions over acts, references, roles and observations; all are built-in Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c, default) -> Column:
    """``c`` unless it is null or empty (a blank string, zero, an empty array), else ``default``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if not isinstance(default, Column) else default)


def truthy_number(c, default) -> Column:
    return F.coalesce(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(0)), F.lit(default))


def first_text(*cs) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def observation_id(kind: Column, prov: Column) -> Column:
    """O and 12 hex digits over type and provenance; the payload takes no part, so ids may repeat."""
    body = F.concat(F.lit('{"prov": ['), F.array_join(prov.cast("array<string>"), ", "), F.lit('], "type": "'), kind, F.lit('"}'))
    return F.concat(F.lit("O"), F.substring(F.sha2(body, 256), 1, 12))


def valid_status(status: Column) -> Column:
    return F.when(status.isin("ok", "missing", "fail"), status).otherwise(F.lit("fail"))


def ordered_union(*arrays) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(F.concat(*arrays))


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


# --- references, queries and routing -------------------------------------------------------------------


#: A trimmed reference that says that there is none. Fixed value.
VOID = r"(?i)^(?:n/a|na )|^(?:na|none|not_required)\z|not[_ ]required"


def _trimmed(c) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def clean_ref(c) -> Column:
    """A reference, or '' where it says that there is none."""
    c = _trimmed(c)
    return F.when(F.rlike(c, F.lit(VOID)), F.lit("")).otherwise(c)


def _given(c) -> Column:
    """A reference, or null where it is blank or says that there is none; tested once."""
    c = _trimmed(c)
    return F.when((c != "") & ~F.rlike(c, F.lit(VOID)), c)


def derive_query(ref, action, intent, operation, target, has_calls) -> Column:
    """What to look for: reference, action or intent, else the first call's operation and target, else 'evidence'."""
    parts = F.trim(F.concat_ws(" ", _given(operation), _given(target)))
    return F.coalesce(*[_given(c) for c in (ref, action, intent)], F.when(has_calls, parts), F.lit("evidence"))


#: Tests in order: words, the operator they lead to, its argument and the pattern of its number. Fixed values.
ROUTES = (
    (("table", "tab"), "Extract_Table", "table_id", r"(?i)(?:table|tab)\s*([0-9]+)"),
    (("figure", "fig"), "Extract_Figure_Caption", "figure_id", r"(?i)(?:figure|fig\.?)[^0-9]*([0-9]+)"),
    (("equation", "eq"), "Extract_Equation", "eq_id", r"(?i)(?:eq\.?|equation)[^0-9]*([0-9]+)"),
    (("algorithm", "alg"), "Extract_Algorithm", "algo_id", r"(?i)(?:alg\.?|algorithm)[^0-9]*([0-9]+)"),
)


def route(query) -> Column:
    """struct<skill, argument, value>: the operator for a query. Word tests are on substrings, as documented."""
    q = F.col(query) if isinstance(query, str) else query
    low = F.lower(q)
    call = lambda name, arg, value: F.struct(F.lit(name).alias("skill"), F.lit(arg).alias("argument"), value.alias("value"))
    out = F
    for words, name, arg, pattern in ROUTES:
        number = F.regexp_extract(q, pattern, 1)
        out = out.when(contains_any(low, words) & (number != ""), call(name, arg, number))
    title = F.when(F.contains(low, F.lit("appendix")), F.lit("Appendix")).otherwise(q)
    out = out.when(contains_any(low, ["section", "sec", "appendix"]), call("Extract_Section", "title", title))
    return out.otherwise(call("Extract_Span", "query", q))


# --- roles ---------------------------------------------------------------------------------------------


def role_token(token: Column) -> Column:
    """One role's standard name; '' for a blank token."""
    low = F.regexp_replace(F.trim(F.regexp_replace(F.trim(token), "[_-]+", " ")), r"\s+", " ")
    low = F.lower(low)
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(F.trim(token) == "", F.lit(""))
        .when((low == "ac") | has("area chair"), F.lit("Area Chair"))
        .when(has("meta reviewer") | has("meta review") | (low == "metareviewer"), F.lit("Meta-Reviewer"))
        .when(has("reviewer") | (low == "review"), F.lit("Reviewer"))
        .when(has("author") | has("rebuttal"), F.lit("Author"))
        .when(has("editor"), F.lit("Editor"))
        .when(has("chair"), F.lit("Chair"))
        .otherwise(F.initcap(low))
    )


#: What stands between several roles in one text. Fixed value.
ROLE_SPLIT = r"(?i)\s*(?:,|/|;|\||&|\band\b)\s*"


def roles(c) -> Column:
    """All roles of a text, standard names, distinct, in order."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.array_distinct(F.filter(F.transform(F.split(c, ROLE_SPLIT), role_token), lambda x: x != ""))


def role_of_three(c) -> Column:
    """Reviewer, Author or Meta; null for others."""
    low = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(has("meta") | has("area chair") | (low == "ac"), F.lit("Meta"))
        .when(has("author") | has("rebuttal"), F.lit("Author"))
        .when(has("reviewer") | (low == "review"), F.lit("Reviewer"))
        .when(has("chair") | has("editor"), F.lit("Meta"))
    )


# --- texts ---------------------------------------------------------------------------------------------


def _joined(parts, *fallbacks) -> Column:
    text = F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (text, *fallbacks)], F.lit(""))


def issue_text(action, grounding, targets, mode: str = "action+grounding+target") -> Column:
    """action | grounding | sorted distinct target types, as the mode names them; the action if all are blank."""
    named = F.array_join(F.array_sort(F.array_distinct(F.filter(targets, lambda x: x.isNotNull() & (x != "")))), ", ")
    parts = [p for word, p in (("action", action), ("grounding", grounding), ("target", named)) if word in mode]
    return _joined(parts, action)


def intent_text(chain, role_raw, action, mode: str = "chain+role+action") -> Column:
    role = F.when(role_raw != "", F.concat(F.lit("role:"), role_raw))
    parts = [p for word, p in (("chain", chain), ("role", role), ("action", action)) if word in mode]
    return _joined(parts, action, chain)


def need_text(intent, action, hints, grounding, sources, mode: str = "intent+action+tools+grounding+source") -> Column:
    """Labelled parts joined by bars; tool hints sorted and distinct, the first eight sources."""
    tools = F.array_join(F.array_sort(F.array_distinct(F.filter(hints, lambda x: x.isNotNull() & (x != "")))), ", ")
    source = F.array_join(F.slice(sources, 1, 8), ", ")
    named = (("intent", "intent:", intent), ("action", "action:", action), ("tools", "tools:", tools), ("grounding", "grounding:", grounding), ("source", "source:", source))
    parts = [F.when(c != "", F.concat(F.lit(label), c)) for word, label, c in named if word in mode]
    return _joined(parts, action, intent)


def turn_id(seg) -> Column:
    """A segment's id without its trailing _number."""
    return F.regexp_replace(seg, "(?<=.)_[0-9]+$", "")


def year_of(ts) -> Column:
    """UTC year of an epoch in seconds, or in milliseconds above 1e12; null for what is not a number."""
    v = F.expr(f"try_cast({ts} AS double)")
    return F.year(F.timestamp_micros((F.when(v > 1e12, v / 1000).otherwise(v) * 1_000_000).cast("long")))


def shorten(c, most: int = 280, mark: str = "...") -> Column:
    """At most ``most`` characters, the mark included."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - len(mark)), F.lit(mark)))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_doi(c) -> Column:
    return F.regexp_replace(F.trim(c), "(?i)^https?://(dx[.])?doi[.]org/", "")


def mean_iqr(mean, p25, p75) -> Column:
    return F.concat(F.format_string("%.1f", mean), F.lit(" [p25 "), F.format_string("%.0f", p25), F.lit(", p75 "), F.format_string("%.0f", p75), F.lit("]"))


def thread_tag(c) -> Column:
    """Issue class of a demo utterance by keyword."""
    low = F.lower(c)
    return F.when(contains_any(low, ["metric"]), F.lit("T1")).when(contains_any(low, ["figure 1", "ablation"]), F.lit("T2")).otherwise(F.lit("T0"))


def turn_intent(role, text) -> Column:
    """Intent of a demo utterance by role and keyword."""
    gives = contains_any(F.lower(text), ["define", "figure", "evidence"])
    return F.when(role == "Author", F.when(gives, F.lit("ProvideEvidence")).otherwise(F.lit("CommitUpdate"))).when(role == "Meta", F.lit("ScheduleThreads")).otherwise(F.lit("RequestEvidence"))


def canonical_url(base: str, params: dict) -> Column:
    """base?k=v&..., keys sorted, null and blank values left out, values form-encoded."""
    pairs = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(k + "="), F.url_encode(v))) for k, v in sorted(params.items())]
    query = F.concat_ws("&", *pairs)
    return F.when(query == "", F.lit(base)).otherwise(F.concat(F.lit(base + "?"), query))


def json_object(c) -> Column:
    """The outermost {...} of a text that holds JSON among other words; null if there is none."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))


def code_block(c) -> Column:
    """What a fenced block holds, or the whole text."""
    inner = F.regexp_extract(c, r"(?s)```[a-zA-Z]*\n(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(c), r"^\s+|\s+$", "")
