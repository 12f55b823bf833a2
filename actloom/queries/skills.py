"""Composite checks over the paper-like view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.skills import run_skill
from ..views import view
from .extraction import CASES, NONE, _any, _i, _NUMBERS, distinct_in_order, observed


def shown(df, *more):
    """ctx, status, supported, prov and list columns as strings."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select("ctx", "status", "supported", text("prov").alias("prov"), *[(F.array_join(c, "|").alias(c) if kinds[c].startswith("array") else F.col(c)) for c in more])


def _case(name: str) -> str:
    _, _, hit, items, bounded = CASES[name]
    return observed(hit, items, bounded)


def _span(q: str) -> str:
    return observed(f"contains(lower(text), '{q.lower()}')")


def _metric(m: str) -> str:
    return observed(f"contains(lower(text), '{m.lower()}') AND len({_NUMBERS}) > 0", _NUMBERS, False)


def _budget(texts: str, most: int) -> str:
    """Running character budget: each text cut to what its predecessors leave."""
    used = f"coalesce(list_sum(list_transform({texts}[1:i - 1], lambda y: length(y))), 0)"
    return f"list_filter(list_transform({texts}, lambda x, i: CASE WHEN {used} < {most} THEN left(x, ({most} - {used})::BIGINT) END), lambda x: x IS NOT NULL)"


def _run(name, *more, **params):
    return lambda s, d: shown(run_skill(view(s, d, "papers"), name, **params), *more)


QUERIES, ORACLES = {}, {}

QUERIES["k01_verify_definition"] = _run("Verify_Definition", "evidence_texts", term="margin", max_chars=100)
ORACLES["k01_verify_definition"] = f"""
SELECT ctx, status, CASE WHEN status = 'ok' THEN true END AS supported, array_to_string(prov, ',') AS prov,
       array_to_string({_budget('texts', 100)}, '|') AS evidence_texts FROM {_case('e10_definition')}"""

QUERIES["k02_verify_claim"] = _run("Verify_Claim_With_Evidence", "matched_queries", queries=["BERT-base", "Trained on", "nowhere"])
ORACLES["k02_verify_claim"] = f"""
SELECT a.ctx, CASE WHEN a.status = 'ok' OR b.status = 'ok' THEN 'ok' ELSE 'missing' END AS status, a.status = 'ok' OR b.status = 'ok' AS supported,
       array_to_string({distinct_in_order('list_concat(a.prov, b.prov)')}, ',') AS prov,
       concat_ws('|', CASE WHEN a.status = 'ok' THEN 'BERT-base' END, CASE WHEN b.status = 'ok' THEN 'Trained on' END) AS matched_queries
FROM {_span('bert-base')} a JOIN {_span('trained on')} b USING (ctx)"""

QUERIES["k03_citation_support"] = _run("Check_Citation_Support", cite_key="[2, 15]")
ORACLES["k03_citation_support"] = f"SELECT ctx, status, status = 'ok' AS supported, array_to_string(prov, ',') AS prov FROM {_case('e09_citation')}"

_LOW = "list_transform(items, lambda x: lower(x))"
QUERIES["k04_baseline_coverage"] = _run("Check_Baseline_Coverage", "found", "missing", expected=["bert-base", "Net3"])
ORACLES["k04_baseline_coverage"] = f"""
SELECT ctx, status, CASE WHEN status = 'ok' THEN len(list_filter(['bert-base', 'Net3'], lambda x: NOT list_contains({_LOW}, lower(x)))) = 0 END AS supported,
       array_to_string(prov, ',') AS prov, array_to_string({distinct_in_order('items')}, '|') AS found,
       CASE WHEN status = 'ok' THEN array_to_string(list_filter(['bert-base', 'Net3'], lambda x: NOT list_contains({_LOW}, lower(x))), '|') END AS missing
FROM {_case('e15_baseline_list')}"""

_JOINED = "lower(array_to_string(texts, ' '))"
QUERIES["k05_ablation_coverage"] = _run("Check_Ablation_Coverage", "missing", components=["Variant", "dropout"])
ORACLES["k05_ablation_coverage"] = f"""
SELECT ctx, status, CASE WHEN status = 'ok' THEN contains({_JOINED}, 'variant') AND contains({_JOINED}, 'dropout') END AS supported, array_to_string(prov, ',') AS prov,
       CASE WHEN status = 'ok' THEN concat_ws('|', CASE WHEN NOT contains({_JOINED}, 'variant') THEN 'Variant' END, CASE WHEN NOT contains({_JOINED}, 'dropout') THEN 'dropout' END) END AS missing
FROM {_case('e16_ablation_info')}"""

_HAS = ["has_dataset", "has_splits", "has_hyperparameters", "has_training", "has_metrics"]
QUERIES["k06_experimental_setup"] = _run("Check_Experimental_Setup", *_HAS, requirements=["dataset", "training", "metrics"], metrics=["accuracy", "F1"])
ORACLES["k06_experimental_setup"] = f"""
SELECT a.ctx, CASE WHEN 'ok' IN (a.status, b.status, c.status, d.status, e.status, f.status) THEN 'ok' ELSE 'missing' END AS status,
       a.status = 'ok' AND d.status = 'ok' AND 'ok' IN (e.status, f.status) AS supported,
       array_to_string({distinct_in_order('flatten([a.prov, b.prov, c.prov, d.prov, e.prov, f.prov])')}, ',') AS prov,
       a.status = 'ok' AS has_dataset, b.status = 'ok' AS has_splits, c.status = 'ok' AS has_hyperparameters, d.status = 'ok' AS has_training, 'ok' IN (e.status, f.status) AS has_metrics
FROM {_case('e13_dataset_info')} a JOIN {_case('e14_split_info')} b USING (ctx) JOIN {_case('e17_hyperparameters')} c USING (ctx)
JOIN {_case('e18_training_details')} d USING (ctx) JOIN {_metric('accuracy')} e USING (ctx) JOIN {_metric('f1')} f USING (ctx)"""

QUERIES["k07_result_consistency"] = _run("Check_Result_Consistency", expected={"accuracy": 0.5, "Figure": 2}, tolerance=0.25)
_NEAR = lambda t, e: f"len(list_filter({t}.items, lambda v: coalesce(abs(TRY_CAST(v AS DOUBLE) - {e}) <= 0.25, false))) > 0"
ORACLES["k07_result_consistency"] = f"""
SELECT a.ctx, CASE WHEN 'ok' IN (a.status, b.status) THEN 'ok' ELSE 'missing' END AS status, {_NEAR('a', 0.5)} AND {_NEAR('b', 2)} AS supported,
       array_to_string({distinct_in_order('list_concat(a.prov, b.prov)')}, ',') AS prov
FROM {_metric('accuracy')} a JOIN {_metric('figure')} b USING (ctx)"""

QUERIES["k08_equation_assumption"] = _run("Verify_Equation_Assumption", "missing_terms", eq_id="(1)", assumption_terms=["bound", "corpus"])
ORACLES["k08_equation_assumption"] = f"""
SELECT a.ctx, a.status, CASE WHEN a.status = 'ok' THEN b.status = 'ok' AND c.status = 'ok' END AS supported,
       CASE WHEN a.status = 'ok' THEN array_to_string({distinct_in_order('flatten([a.prov, b.prov, c.prov])')}, ',') ELSE '' END AS prov,
       CASE WHEN a.status = 'ok' THEN concat_ws('|', CASE WHEN b.status <> 'ok' THEN 'bound' END, CASE WHEN c.status <> 'ok' THEN 'corpus' END) END AS missing_terms
FROM {observed(_i(r'\b(?:Eq\.?,?|Equation)\s*\(?1\)?\b'))} a JOIN {_span('bound')} b USING (ctx) JOIN {_span('corpus')} c USING (ctx)"""

_REPRO = ["has_code", "has_data", "has_hyperparameters", "has_compute", "has_training"]
QUERIES["k10_reproducibility"] = _run("Check_Reproducibility_Checklist", *_REPRO, requirements=["code", "hyperparameters"])
ORACLES["k10_reproducibility"] = f"""
SELECT a.ctx, CASE WHEN len(a.items) > 0 OR 'ok' IN (b.status, c.status, d.status) THEN 'ok' ELSE 'missing' END AS status, len(a.items) > 0 AND b.status = 'ok' AS supported,
       array_to_string({distinct_in_order('flatten([a.prov, b.prov, c.prov, d.prov])')}, ',') AS prov,
       len(a.items) > 0 AS has_code, len(a.items) > 0 AS has_data, b.status = 'ok' AS has_hyperparameters, c.status = 'ok' AS has_compute, d.status = 'ok' AS has_training
FROM {_case('e21_code_data_links')} a JOIN {_case('e17_hyperparameters')} b USING (ctx) JOIN {_case('e19_compute_resources')} c USING (ctx) JOIN {_case('e18_training_details')} d USING (ctx)"""

QUERIES["k11_summarize_method"] = _run("Summarize_Method_Evidence", "evidence_texts", section_title="Method", queries=["optimizer"], max_chars=90)
ORACLES["k11_summarize_method"] = f"""
SELECT ctx, CASE WHEN len(t) > 0 THEN 'ok' ELSE 'missing' END AS status, len(t) > 0 AS supported, array_to_string(p, ',') AS prov, array_to_string({_budget('t', 90)}, '|') AS evidence_texts
FROM (SELECT a.ctx, list_concat(a.texts, b.texts) AS t, {distinct_in_order('list_concat(a.prov, b.prov)')} AS p FROM {_span('method')} a JOIN {_span('optimizer')} b USING (ctx))"""

QUERIES["k12_summarize_results"] = _run("Summarize_Results_Evidence", "evidence_texts", max_chars=120)
ORACLES["k12_summarize_results"] = f"""
SELECT ctx, CASE WHEN len(t) > 0 THEN 'ok' ELSE 'missing' END AS status, len(t) > 0 AS supported, array_to_string(p, ',') AS prov, array_to_string({_budget('t', 120)}, '|') AS evidence_texts
FROM (SELECT a.ctx, list_concat(a.texts, b.texts) AS t, {distinct_in_order('list_concat(a.prov, b.prov)')} AS p FROM {_span('results')} a JOIN {_span('experiments')} b USING (ctx))"""
