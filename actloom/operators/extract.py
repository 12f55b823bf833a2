"""Extraction operators: segments in, one observation a context out.

Segments are rows (ctx, id, text), ordered by id inside a context. An operator is a predicate over the text
and, for some, an expression for the items it draws from a matching text. All run as one aggregation by
context, so every context has an observation (status ok or missing) after a single shuffle in which only
the matching segments' columns travel.

Observation: ctx, id, type, status, prov (distinct segment ids in order), match_texts, items, query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import contains_any, observation_id

MAX_MATCHES = 5


def _limit(value) -> int:
    """Matches kept: 0, null and blanks mean the default; a negative number keeps exactly one."""
    n = int(value or MAX_MATCHES)
    return n if n > 0 else 1


def _limit_positive(value) -> int:
    n = int(value or MAX_MATCHES)
    return n if n > 0 else MAX_MATCHES


def _number_or_text(value) -> str:
    """The first digits of an identifier, or the identifier itself."""
    text = "" if value is None else str(value)
    found = re.search(r"\d+", text)
    return found[0] if found else text.strip()


def _quoted(text: str) -> str:
    """``text`` as a literal in a Java pattern."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)


def _has(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


@dataclass(frozen=True)
class Operator:
    """``required`` names the parameter without which the result is missing; ``bounded`` applies max_matches."""

    name: str
    required: str | None
    matches: Callable[[Column, dict], Column]
    items: Callable[[Column, dict], Column] | None = None
    bounded: bool = True
    distinct: bool = False
    needs_items: bool = False
    positive_limit: bool = False
    needs_params: bool = False


def _numbered(words: str, key: str, open_: str = "", close: str = ""):
    def matches(text, p):
        number = _quoted(_number_or_text(p.get(key)))
        return F.rlike(text, F.lit(rf"(?i)\b(?:{words})\s*{open_}{number}{close}\b"))

    return matches


def _span(text, p):
    query = str(p["query"]).strip()
    if p.get("regex"):
        return F.rlike(text, F.lit(query if p.get("case_sensitive") else "(?iu)" + query))
    return F.contains(text, F.lit(query)) if p.get("case_sensitive") else _has(text, query)


def _citation(text, p):
    key = str(p["cite_key"]).strip()
    hit = _has(text, key)
    digits = re.findall(r"\d+", key)
    if digits:
        blocks = F.array_join(F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]"), 0), " ")
        hit = hit | F.arrays_overlap(F.regexp_extract_all(blocks, F.lit(r"\d+"), 0), F.array(*[F.lit(d) for d in digits]))
    return hit


def _definition(text, p):
    term = r"\b" + _quoted(str(p["term"]).strip().lower()) + r"\b"
    forms = [rf"define\s+(the\s+|a\s+|an\s+)?{term}", rf"{term}\s+is\s+defined\s+as", rf"{term}\s+refers\s+to", rf"{term}\s+denotes"]
    return F.rlike(F.lower(text), F.lit("|".join(forms)))


def _notation(text, p):
    return F.contains(text, F.lit(str(p["symbol"]).strip())) & contains_any(F.lower(text), ["denote", "represent", " is ", " are "])


def _list_items(text, p):
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    bullet = lambda x: x.startswith("-") | x.startswith("*") | x.startswith("+")
    number = lambda x: F.rlike(x, F.lit(r"^\d+\."))
    items = F.transform(
        F.filter(lines, lambda x: bullet(x) | number(x)),
        lambda x: F.when(bullet(x), F.regexp_replace(x, r"^[-*+ ]+", "")).otherwise(F.regexp_replace(x, r"^\d+\.\s*", "")),
    )
    query = str(p.get("query") or "").strip().lower()
    return F.filter(items, lambda x: F.contains(F.lower(x), F.lit(query))) if query else items


def _keywords(words, veto: str | None = None, least: int = 1):
    def matches(text, p):
        low = F.lower(text)
        if least > 1:
            hit = sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int")) >= least
        else:
            hit = contains_any(low, words)
        return hit & ~F.rlike(low, F.lit(veto)) if veto else hit

    return matches


def _dataset(text, p):
    name = str(p.get("dataset") or "").strip()
    return _has(text, name) if name else _keywords(("dataset", "benchmark", "corpus", "data set"))(text, p)


#: Capitalised words that name no baseline. Fixed values.
NO_BASELINE = ("We", "Our", "Table", "Figure", "Section", "Results", "Baseline", "Baselines")


def _baselines(text, p):
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z0-9\-+]{1,}\b"), 0)
    return F.filter(found, lambda x: ~x.isin(*NO_BASELINE))


#: Hyper-parameters and the patterns of their values in lower-cased text. Fixed values.
HYPERPARAMETERS = {
    "learning_rate": r"(?:learning rate|lr)\s*(?:=|:)?\s*([0-9\.eE-]+)",
    "batch_size": r"(?:batch size|batch)\s*(?:=|:)?\s*(\d+)",
    "epochs": r"(?:epochs?|training steps?)\s*(?:=|:)?\s*(\d+)",
    "weight_decay": r"weight decay\s*(?:=|:)?\s*([0-9\.eE-]+)",
    "dropout": r"dropout\s*(?:=|:)?\s*([0-9\.eE-]+)",
    "momentum": r"momentum\s*(?:=|:)?\s*([0-9\.eE-]+)",
}


def _hyperparameters(text, p):
    """key=value of each hyper-parameter found, in the table's order; the last segment's value wins later."""
    low = F.lower(text)
    each = [F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")) for pattern in HYPERPARAMETERS.values()]
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(k + "="), v)) for k, v in zip(HYPERPARAMETERS, each, strict=True)]))


def _resources(text, p):
    models = r"(?i)(\d+)\s*x?\s*(A100|V100|RTX\s*\d+|GPU|TPU)"
    times = r"(?i)(\d+)\s*(hours?|days?)"
    both = lambda pattern, mark: F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2), lambda a, b: F.concat(a, F.lit(mark), b))
    return F.concat(both(models, "x"), both(times, " "))


def _links(text, p):
    trimmed = lambda c: F.transform(c, lambda x: F.regexp_replace(x, "[.,]+$", ""))
    full = F.regexp_extract_all(text, F.lit(r"https?://[^\s\)\]]+"), 0)
    bare = F.regexp_extract_all(text, F.lit(r"github\.com/[^\s\)\]]+"), 0)
    return F.concat(trimmed(full), F.transform(trimmed(bare), lambda x: F.concat(F.lit("https://"), x)))


def _has_items(f):
    return lambda text, p: F.size(f(text, p)) > 0


_numbers = lambda text, p: F.regexp_extract_all(text, F.lit(r"(?i)[-+]?\d*\.?\d+(?:e[-+]?\d+)?%?"), 0)
_compared = _keywords(("baseline", "baselines", "compare", "compared", "comparison", "against"))

OPERATORS = {
    o.name: o
    for o in (
        Operator("Extract_Span", "query", _span, positive_limit=True),
        Operator("Extract_Section", "title", lambda t, p: _has(t, str(p["title"]).strip()), positive_limit=True),
        Operator("Extract_Subsection", "title", lambda t, p: _has(t, str(p["title"]).strip()), positive_limit=True),
        Operator("Extract_List_Items", None, _has_items(_list_items), _list_items, bounded=False),
        Operator("Extract_Table", "table_id", _numbered(r"Table|Tab\.?", "table_id")),
        Operator("Extract_Figure_Caption", "figure_id", _numbered(r"Figure|Fig\.?", "figure_id")),
        Operator("Extract_Equation", "eq_id", _numbered(r"Eq\.?,?|Equation", "eq_id", r"\(?", r"\)?")),
        Operator("Extract_Algorithm", "algo_id", _numbered(r"Algorithm|Alg\.?", "algo_id")),
        Operator("Resolve_Citation", "cite_key", _citation),
        Operator("Extract_Definition", "term", _definition),
        Operator("Extract_Notation_Definition", "symbol", _notation),
        Operator("Extract_Metric_Values", "metric", lambda t, p: _has(t, str(p["metric"]).strip()) & _has_items(_numbers)(t, p), _numbers, bounded=False),
        Operator("Extract_Dataset_Info", None, _dataset),
        Operator("Extract_Split_Info", None, _keywords(("train", "training", "validation", "dev", "test", "split"), least=2)),
        Operator("Extract_Baseline_List", None, lambda t, p: _compared(t, p) & _has_items(_baselines)(t, p), _baselines, bounded=False, distinct=True),
        Operator("Extract_Ablation_Info", None, _keywords(("ablation", "w/o", "without", "variant", "remove"), r"\bno\s+ablation(s)?\b")),
        Operator("Extract_Hyperparameters", None, _has_items(_hyperparameters), _hyperparameters, bounded=False),
        Operator("Extract_Training_Details", None, _keywords(("train", "optimizer", "epoch", "schedule", "early stopping", "loss"), r"\bno\s+train(ing)?\b")),
        Operator("Extract_Compute_Resources", None, _keywords(("gpu", "tpu", "cpu", "a100", "v100", "rtx", "hours", "days")), _resources, bounded=False),
        Operator("Extract_Limitations", None, _keywords(("limitation", "limitations", "future work", "weakness", "shortcoming"), r"\bno\s+limitations?\b"), needs_params=True),
        Operator("Extract_Code_Data_Links", None, _has_items(_links), _links, bounded=False),
    )
}


def clean_segments(segments: DataFrame) -> DataFrame:
    """Rows with an integer id and a text; others are dropped, their contexts being kept as empty rows."""
    number = F.expr("try_cast(id AS int)")
    usable = number.isNotNull() & F.col("text").isNotNull()
    return segments.select("ctx", F.when(usable, number).alias("id"), F.when(usable, F.col("text")).alias("text"))


def _parts(name: str, params: dict | None) -> tuple[Column, Callable[[Column], dict[str, Column]]]:
    """An operator as an aggregate over a context's segments, and its observation from the aggregate's result."""
    op, given = OPERATORS[name], params
    params = params if isinstance(params, dict) else {}
    empty = F.array().cast("array<string>")
    needed = str(params.get(op.required) or "").strip() if op.required else "-"
    fails = op.needs_params and given is None
    if fails or not needed:
        hit = F.lit(False)
    else:
        hit = F.coalesce(op.matches(F.col("text"), params) & F.col("id").isNotNull(), F.lit(False))
    row = F.struct(F.col("id"), F.col("text"), (op.items(F.col("text"), params) if op.items and needed else empty).alias("items"))
    found = F.array_sort(F.collect_list(F.when(hit, row)))
    if op.bounded:
        found = F.slice(found, 1, (_limit_positive if op.positive_limit else _limit)(params.get("max_matches")))

    def observation(m: Column) -> dict[str, Column]:
        items = F.flatten(F.transform(m, lambda x: x["items"]))
        if op.distinct:
            items = F.array_distinct(items)
        if name == "Extract_Hyperparameters":
            items = last_values(items)
        prov = F.transform(m, lambda x: x["id"])
        return {
            "type": F.lit("text" if needed else "evidence"),
            "status": F.lit("fail") if fails else F.when(F.size(m) > 0, F.lit("ok")).otherwise(F.lit("missing")),
            "prov": prov if name == "Extract_List_Items" else F.array_distinct(prov),
            "match_texts": F.transform(m, lambda x: x["text"]),
            "items": items,
            "query": F.lit(needed if op.required else ""),
        }

    return found, observation


def extract(segments: DataFrame, name: str, params: dict | None = None) -> DataFrame:
    """Observations of one operator, one row a context.

    Rows with a null text or id are ignored but keep their context alive. Without its required parameter an
    operator gives status missing and type evidence for each context.
    """
    found, observation = _parts(name, params)
    out = segments.groupBy("ctx").agg(found.alias("m")).select("ctx", *[c.alias(k) for k, c in observation(F.col("m")).items()])
    return out.withColumn("id", observation_id(F.col("type"), F.col("prov")))


def extract_many(segments: DataFrame, calls: list[tuple[str, str, dict | None]]) -> DataFrame:
    """Several operators (label, name, parameters) in one scan and one aggregation: columns label_status and so on."""
    parts = [(label, *_parts(name, params)) for label, name, params in calls]
    out = segments.groupBy("ctx").agg(*[found.alias(f"__{label}") for label, found, _ in parts])
    return out.select("ctx", *[c.alias(f"{label}_{k}") for label, _, see in parts for k, c in see(F.col(f"__{label}")).items() if k not in ("type", "query")])


def last_values(pairs: Column) -> Column:
    """Of key=value items in order, each key's last, keys in order of first appearance."""
    key = lambda x: F.substring_index(x, "=", 1)
    return F.transform(F.array_distinct(F.transform(pairs, key)), lambda k: F.element_at(F.filter(pairs, lambda x: key(x) == k), -1))


def intervals(text: Column) -> Column:
    """array<struct<lower, upper, pattern>>: bracketed pairs, then centre and half-width."""
    number = r"([-+]?\d*\.?\d+)"
    bracket, about = F.lit(rf"\[\s*{number}\s*,\s*{number}\s*\]"), F.lit(rf"{number}\s*±\s*{number}")
    a = F.zip_with(F.regexp_extract_all(text, bracket, 1), F.regexp_extract_all(text, bracket, 2), lambda x, y: F.struct(x.cast("double").alias("lower"), y.cast("double").alias("upper"), F.lit("bracket").alias("pattern")))
    b = F.zip_with(
        F.regexp_extract_all(text, about, 1), F.regexp_extract_all(text, about, 2),
        lambda x, y: F.struct((x.cast("double") - y.cast("double")).alias("lower"), (x.cast("double") + y.cast("double")).alias("upper"), F.lit("plus_minus").alias("pattern")),
    )
    return F.concat(a, b)


def keyword_filter(segments: DataFrame, keywords: list[str], shown: int = 220) -> DataFrame:
    """Segments that hold any keyword, by context: the first match's opening and all matches' ids."""
    hit = contains_any(F.lower("text"), [k.lower() for k in keywords])
    row = F.struct("id", F.substring("text", 1, shown).alias("text"))
    out = segments.groupBy("ctx").agg(F.array_sort(F.collect_list(F.when(hit, row))).alias("m"))
    return out.select("ctx", F.when(F.size("m") > 0, F.lit("ok")).otherwise(F.lit("missing")).alias("status"), F.transform("m", lambda x: x["id"]).alias("prov"), F.get("m", F.lit(0))["text"].alias("text"))
