"""Composite checks: small graphs of extraction operators over the same segments, joined by context.

Every skill gives one row a context: ctx, type, status, supported, prov and what it found or missed. All the
operators of a skill run in one scan and one aggregation; a failing step decides the status instead of
stopping a run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import ordered_union
from .extract import OPERATORS, extract, extract_many

VERDICT = "verification_result"


def _as_list(value) -> list[str]:
    if value is None:
        return []
    return [str(v) for v in value if v is not None] if isinstance(value, (list, tuple)) else [str(value)]


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def budget_texts(texts: Column, most: int) -> Column:
    """Texts until ``most`` characters are used up; the one that crosses the limit is cut. 0 or less: all."""
    if most <= 0:
        return texts
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    step = lambda s, t: F.when(s["used"] >= most, s).otherwise(
        F.struct((s["used"] + F.length(F.substring(t, F.lit(1), F.lit(most) - s["used"]))).alias("used"), F.concat(s["kept"], F.array(F.substring(t, F.lit(1), F.lit(most) - s["used"]))).alias("kept"))
    )
    return F.aggregate(texts, start, step, lambda s: s["kept"])


def _verdict(df: DataFrame, ok: Column, supported: Column, prov: Column, kind: str = VERDICT, **more: Column) -> DataFrame:
    return df.select("ctx", F.lit(kind).alias("type"), F.when(ok, F.lit("ok")).otherwise(F.lit("missing")).alias("status"), supported.alias("supported"), prov.alias("prov"), *[v.alias(k) for k, v in more.items()])


def _unasked(segments: DataFrame, kind: str = VERDICT) -> DataFrame:
    """The result when a required parameter is absent."""
    return _verdict(segments.select("ctx").distinct(), F.lit(False), F.lit(None).cast("boolean"), F.array().cast("array<int>"), kind)


def verify_definition(segments, term: str, max_chars: int = 1000, max_matches=None):
    if not str(term or "").strip():
        return _unasked(segments)
    o = extract(segments, "Extract_Definition", {"term": term, "max_matches": max_matches})
    ok = F.col("status") == "ok"
    return _verdict(o, ok, F.when(ok, F.lit(True)), F.col("prov"), evidence_texts=budget_texts(F.col("match_texts"), max_chars))


def verify_claim(segments, queries, regex: bool = False, case_sensitive: bool = False):
    queries = _as_list(queries)
    if not queries:
        return _unasked(segments)
    wide = extract_many(segments, [(f"q{i}", "Extract_Span", {"query": q, "regex": regex, "case_sensitive": case_sensitive}) for i, q in enumerate(queries)])
    hits = F.array_compact(F.array(*[F.when(F.col(f"q{i}_status") == "ok", F.lit(q)) for i, q in enumerate(queries)]))
    prov = ordered_union(*[F.col(f"q{i}_prov") for i in range(len(queries))])
    texts = F.concat(*[F.col(f"q{i}_match_texts") for i in range(len(queries))])
    return _verdict(wide, F.size(hits) > 0, F.size(hits) > 0, prov, matched_queries=hits, match_texts=texts)


def check_citation(segments, cite_key: str, max_matches=None):
    if not str(cite_key or "").strip():
        return _unasked(segments)
    o = extract(segments, "Resolve_Citation", {"cite_key": cite_key, "max_matches": max_matches})
    ok = F.col("status") == "ok"
    return _verdict(o, ok, ok, F.col("prov"))


def check_baselines(segments, expected=()):
    expected = _as_list(expected)
    o = extract(segments, "Extract_Baseline_List", {})
    low = F.transform("items", lambda x: F.lower(x))
    missing = F.filter(_texts(expected), lambda x: ~F.array_contains(low, F.lower(x)))
    ok = F.col("status") == "ok"
    return _verdict(o, ok, F.when(ok, F.size(missing) == 0), F.col("prov"), found=F.col("items"), missing=F.when(ok, missing))


def check_ablation(segments, components=()):
    o = extract(segments, "Extract_Ablation_Info", {})
    low = F.lower(F.array_join("match_texts", " "))
    missing = F.filter(_texts(_as_list(components)), lambda x: ~F.contains(low, F.lower(x)))
    ok = F.col("status") == "ok"
    return _verdict(o, ok, F.when(ok, F.size(missing) == 0), F.col("prov"), missing=F.when(ok, missing))


def _required(found: dict[str, Column], requirements) -> Column:
    return reduce(lambda a, b: a & b, [found.get(r, F.lit(False)) for r in sorted(set(_as_list(requirements)))], F.lit(True))


def check_setup(segments, requirements=(), metrics=()):
    metrics = _as_list(metrics)
    calls = [("dataset", "Extract_Dataset_Info", {}), ("splits", "Extract_Split_Info", {}), ("hyperparameters", "Extract_Hyperparameters", {}), ("training", "Extract_Training_Details", {})]
    wide = extract_many(segments, calls + [(f"m{i}", "Extract_Metric_Values", {"metric": m}) for i, m in enumerate(metrics)])
    found = {label: F.col(f"{label}_status") == "ok" for label, _, _ in calls}
    if metrics:
        found["metrics"] = reduce(lambda a, b: a | b, [F.col(f"m{i}_status") == "ok" for i in range(len(metrics))])
    else:
        found["metrics"] = F.lit("metrics" not in _as_list(requirements))
    prov = ordered_union(*[F.col(f"{c[0]}_prov") for c in calls], *[F.col(f"m{i}_prov") for i in range(len(metrics))])
    return _verdict(wide, reduce(lambda a, b: a | b, found.values()), _required(found, requirements), prov, **{f"has_{k}": v for k, v in found.items()})


def check_results(segments, expected: dict | None, tolerance: float = 0.0):
    """A value such as 91% is no number, so it never confirms an expectation."""
    if not expected:
        return _unasked(segments)
    names = list(expected)
    wide = extract_many(segments, [(f"m{i}", "Extract_Metric_Values", {"metric": m}) for i, m in enumerate(names)])
    near = lambda i, e: F.exists(f"m{i}_items", lambda v: F.coalesce(F.abs(v.try_cast("double") - F.lit(float(e))) <= tolerance, F.lit(False)))
    found = [F.col(f"m{i}_status") == "ok" for i in range(len(names))]
    agree = [f & near(i, expected[m]) for i, (m, f) in enumerate(zip(names, found, strict=True))]
    both = lambda cs, op: reduce(op, cs)
    prov = ordered_union(*[F.col(f"m{i}_prov") for i in range(len(names))])
    return _verdict(wide, both(found, lambda a, b: a | b), both(agree, lambda a, b: a & b), prov)


def verify_equation(segments, eq_id, assumption_terms=()):
    if not eq_id:
        return _unasked(segments)
    terms = _as_list(assumption_terms)
    wide = extract_many(segments, [("e", "Extract_Equation", {"eq_id": eq_id})] + [(f"t{i}", "Extract_Span", {"query": t}) for i, t in enumerate(terms)])
    ok = F.col("e_status") == "ok"
    missing = F.array_compact(F.array(*[F.when(F.col(f"t{i}_status") != "ok", F.lit(t)) for i, t in enumerate(terms)])) if terms else _texts(())
    prov = F.when(ok, ordered_union(F.col("e_prov"), *[F.col(f"t{i}_prov") for i in range(len(terms))])).otherwise(F.col("e_prov"))
    return _verdict(wide, ok, F.when(ok, F.size(missing) == 0), prov, missing_terms=F.when(ok, missing))


def check_reproducibility(segments, requirements=(), code_urls=(), data_urls=(), available: dict | None = None):
    """``available`` holds code and data flags from a remote check; without it any link counts."""
    calls = [("links", "Extract_Code_Data_Links", {}), ("hyperparameters", "Extract_Hyperparameters", {}), ("compute", "Extract_Compute_Resources", {}), ("training", "Extract_Training_Details", {})]
    wide = extract_many(segments, calls)
    found = {kind: F.lit(bool(given)) | (F.size("links_items") > 0) for kind, given in (("code", code_urls), ("data", data_urls))}
    if available is not None:
        found = {kind: F.lit(bool(available.get(kind))) for kind in ("code", "data")}
    found |= {label: F.col(f"{label}_status") == "ok" for label in ("hyperparameters", "compute", "training")}
    prov = ordered_union(*[F.col(f"{c[0]}_prov") for c in calls])
    return _verdict(wide, reduce(lambda a, b: a | b, found.values()), _required(found, requirements), prov, **{f"has_{k}": v for k, v in found.items()})


def _summary(segments, calls, max_chars):
    wide = extract_many(segments, calls)
    texts = budget_texts(F.concat(*[F.col(f"{c[0]}_match_texts") for c in calls]), max_chars)
    return _verdict(wide, F.size(texts) > 0, F.size(texts) > 0, ordered_union(*[F.col(f"{c[0]}_prov") for c in calls]), "evidence_summary", evidence_texts=texts)


def summarize_method(segments, section_title: str = "Method", queries=(), max_chars: int = 1200):
    return _summary(segments, [("s", "Extract_Section", {"title": section_title})] + [(f"q{i}", "Extract_Span", {"query": q}) for i, q in enumerate(_as_list(queries))], max_chars)


def summarize_results(segments, section_titles=("Results", "Experiments"), max_chars: int = 1200):
    return _summary(segments, [(f"s{i}", "Extract_Section", {"title": t}) for i, t in enumerate(_as_list(section_titles))], max_chars)


#: Skills over segments by name, and the operators that each needs.
SKILLS = {
    "Verify_Definition": (verify_definition, ("Extract_Definition",)),
    "Verify_Claim_With_Evidence": (verify_claim, ("Extract_Span",)),
    "Check_Citation_Support": (check_citation, ("Resolve_Citation",)),
    "Check_Baseline_Coverage": (check_baselines, ("Extract_Baseline_List",)),
    "Check_Ablation_Coverage": (check_ablation, ("Extract_Ablation_Info",)),
    "Check_Experimental_Setup": (check_setup, ("Extract_Dataset_Info", "Extract_Split_Info", "Extract_Hyperparameters", "Extract_Training_Details", "Extract_Metric_Values")),
    "Check_Result_Consistency": (check_results, ("Extract_Metric_Values",)),
    "Verify_Equation_Assumption": (verify_equation, ("Extract_Equation", "Extract_Span")),
    "Check_Reproducibility_Checklist": (check_reproducibility, ("Extract_Code_Data_Links", "Extract_Hyperparameters", "Extract_Compute_Resources", "Extract_Training_Details")),
    "Summarize_Method_Evidence": (summarize_method, ("Extract_Section", "Extract_Span")),
    "Summarize_Results_Evidence": (summarize_results, ("Extract_Section",)),
}


def run_skill(segments: DataFrame, name: str, **params) -> DataFrame:
    """A skill by name; status fail if an operator it needs is not there."""
    fn, needs = SKILLS[name]
    if gone := [n for n in needs if n not in OPERATORS]:
        return _unasked(segments).withColumn("status", F.lit("fail")).withColumn("error", F.lit(f"primitive_missing:{gone[0]}"))
    return fn(segments, **params)
