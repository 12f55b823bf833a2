"""Extraction operators over the paper-like view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.extract import HYPERPARAMETERS, NO_BASELINE, extract, intervals, keyword_filter
from ..views import view

NONE = "[]::VARCHAR[]"


def shown(o):
    return o.select("ctx", "status", F.array_join(F.col("prov").cast("array<string>"), ",").alias("prov"), F.array_join("items", "|").alias("items"), F.size("match_texts").cast("long").alias("n_matches"))


def _any(words, low: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


def _i(pattern: str) -> str:
    return f"regexp_matches(text, '{pattern}', 'i')"


_BULLETS = r"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x)), lambda x: regexp_matches(x, '^([-*+]|\d+\.)'))"
_ITEMS = rf"list_transform({_BULLETS}, lambda x: CASE WHEN regexp_matches(x, '^[-*+]') THEN regexp_replace(x, '^[-*+ ]+', '') ELSE regexp_replace(x, '^\d+\.\s*', '') END)"
_NUMBERS = r"regexp_extract_all(text, '(?i)[-+]?\d*\.?\d+(?:e[-+]?\d+)?%?')"
_NAMES = r"list_filter(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9\-+]{1,}\b'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in NO_BASELINE) + "))"
_HYPER = "list_filter([" + ", ".join(f"CASE WHEN regexp_extract(lower(text), '{p}', 1) <> '' THEN '{k}=' || regexp_extract(lower(text), '{p}', 1) END" for k, p in HYPERPARAMETERS.items()) + "], lambda x: x IS NOT NULL)"
_MODELS = r"(?i)(\d+)\s*x?\s*(A100|V100|RTX\s*\d+|GPU|TPU)"
_TIMES = r"(?i)(\d+)\s*(hours?|days?)"


def _two(p, mark):
    return f"list_transform(list_zip(regexp_extract_all(text, '{p}', 1), regexp_extract_all(text, '{p}', 2)), lambda x: x[1] || '{mark}' || x[2])"


_RESOURCES = f"list_concat({_two(_MODELS, 'x')}, {_two(_TIMES, ' ')})"
_LINKS = r"list_concat(list_transform(regexp_extract_all(text, 'https?://[^\s\)\]]+'), lambda x: regexp_replace(x, '[.,]+$', '')), list_transform(regexp_extract_all(text, 'github\.com/[^\s\)\]]+'), lambda x: 'https://' || regexp_replace(x, '[.,]+$', '')))"
_CITED = r"list_has_any(regexp_extract_all(array_to_string(regexp_extract_all(text, '\[[^\]]+\]'), ' '), '\d+'), ['2', '15'])"

#: query: (operator, parameters, matching SQL, item SQL, bounded)
CASES = {
    "e01_span": ("Extract_Span", {"query": "Net3 and"}, "contains(lower(text), 'net3 and')", NONE, True),
    "e01_span_regex": ("Extract_Span", {"query": r"A1\d+ for 2", "regex": True, "case_sensitive": True, "max_matches": 2}, r"regexp_matches(text, 'A1\d+ for 2')", NONE, 2),
    "e02_section": ("Extract_Section", {"title": "Method"}, "contains(lower(text), 'method')", NONE, True),
    "e03_subsection": ("Extract_Subsection", {"title": "method: see"}, "contains(lower(text), 'method: see')", NONE, True),
    "e04_list_items": ("Extract_List_Items", {"query": "item"}, f"len(list_filter({_ITEMS}, lambda x: contains(lower(x), 'item'))) > 0", f"list_filter({_ITEMS}, lambda x: contains(lower(x), 'item'))", False),
    "e05_table": ("Extract_Table", {"table_id": "Table 2"}, _i(r"\b(?:Table|Tab\.?)\s*2\b"), NONE, True),
    "e06_figure_caption": ("Extract_Figure_Caption", {"figure_id": "Fig 3"}, _i(r"\b(?:Figure|Fig\.?)\s*3\b"), NONE, True),
    "e07_equation": ("Extract_Equation", {"eq_id": "(1)"}, _i(r"\b(?:Eq\.?,?|Equation)\s*\(?1\)?\b"), NONE, True),
    "e08_algorithm": ("Extract_Algorithm", {"algo_id": 2}, _i(r"\b(?:Algorithm|Alg\.?)\s*2\b"), NONE, True),
    "e09_citation": ("Resolve_Citation", {"cite_key": "[2, 15]"}, f"({_CITED} OR contains(lower(text), '[2, 15]'))", NONE, True),
    "e10_definition": ("Extract_Definition", {"term": "margin"}, r"regexp_matches(lower(text), 'define\s+(the\s+|a\s+|an\s+)?\bmargin\b|\bmargin\b\s+is\s+defined\s+as|\bmargin\b\s+refers\s+to|\bmargin\b\s+denotes')", NONE, True),
    "e11_notation": ("Extract_Notation_Definition", {"symbol": "alpha"}, f"contains(text, 'alpha') AND {_any(['denote', 'represent', ' is ', ' are '])}", NONE, True),
    "e12_metric_values": ("Extract_Metric_Values", {"metric": "F1"}, f"contains(lower(text), 'f1') AND len({_NUMBERS}) > 0", _NUMBERS, False),
    "e13_dataset_info": ("Extract_Dataset_Info", {}, _any(["dataset", "benchmark", "corpus", "data set"]), NONE, True),
    "e14_split_info": ("Extract_Split_Info", {}, "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ("train", "training", "validation", "dev", "test", "split")) + ") >= 2", NONE, True),
    "e15_baseline_list": ("Extract_Baseline_List", {}, f"{_any(['baseline', 'compare', 'comparison', 'against'])} AND len({_NAMES}) > 0", _NAMES, False),
    "e16_ablation_info": ("Extract_Ablation_Info", {}, rf"{_any(['ablation', 'w/o', 'without', 'variant', 'remove'])} AND NOT regexp_matches(lower(text), '\bno\s+ablation(s)?\b')", NONE, True),
    "e17_hyperparameters": ("Extract_Hyperparameters", {}, f"len({_HYPER}) > 0", _HYPER, False),
    "e18_training_details": ("Extract_Training_Details", {}, rf"{_any(['train', 'optimizer', 'epoch', 'schedule', 'early stopping', 'loss'])} AND NOT regexp_matches(lower(text), '\bno\s+train(ing)?\b')", NONE, True),
    "e19_compute_resources": ("Extract_Compute_Resources", {}, _any(["gpu", "tpu", "cpu", "a100", "v100", "rtx", "hours", "days"]), _RESOURCES, False),
    "e20_limitations": ("Extract_Limitations", {}, rf"{_any(['limitation', 'future work', 'weakness', 'shortcoming'])} AND NOT regexp_matches(lower(text), '\bno\s+limitations?\b')", NONE, True),
    "e21_code_data_links": ("Extract_Code_Data_Links", {}, f"len({_LINKS}) > 0", _LINKS, False),
}

QUERIES = {name: (lambda s, d, o=op, p=params: shown(extract(view(s, d, "papers"), o, p))) for name, (op, params, *_) in CASES.items()}


def observed(hit: str, items: str = NONE, bounded=True) -> str:
    """(ctx, status, prov, items, texts) of one operator as a subquery."""
    most = 5 if bounded is True else bounded
    cut = (lambda x: f"list_slice({x}, 1, {most})") if most else (lambda x: x)
    return f"""(SELECT ctx, CASE WHEN count(*) FILTER (WHERE hit) > 0 THEN 'ok' ELSE 'missing' END AS status,
      coalesce({cut('list(id ORDER BY id) FILTER (WHERE hit)')}, []::INT[]) AS prov,
      coalesce(flatten(list(items ORDER BY id) FILTER (WHERE hit)), {NONE}) AS items,
      coalesce({cut('list(text ORDER BY id) FILTER (WHERE hit)')}, {NONE}) AS texts
    FROM (SELECT ctx, id, text, {hit} AS hit, {items} AS items FROM papers) GROUP BY ctx)"""


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _oracle(name: str) -> str:
    op, _, hit, items, bounded = CASES[name]
    drawn = "items"
    if op == "Extract_Baseline_List":
        drawn = distinct_in_order("items")
    if op == "Extract_Hyperparameters":
        keys = "list_transform(items, lambda x: split_part(x, '=', 1))"
        drawn = f"list_transform({distinct_in_order(keys)}, lambda k: list_filter(items, lambda x: split_part(x, '=', 1) = k)[-1])"
    return f"SELECT ctx, status, array_to_string(prov, ',') AS prov, array_to_string({drawn}, '|') AS items, len(texts)::BIGINT AS n_matches FROM {observed(hit, items, bounded)}"


ORACLES = {name: _oracle(name) for name in CASES}


def _intervals(s, d):
    rows = view(s, d, "papers").select("ctx", "id", F.explode(intervals(F.col("text"))).alias("x"))
    return rows.select("ctx", "id", F.round("x.lower", 6).alias("lower"), F.round("x.upper", 6).alias("upper"), "x.pattern")


QUERIES["e22_confidence_intervals"] = _intervals
_NUM = r"([-+]?\d*\.?\d+)"
_BRACKET, _ABOUT = rf"\[\s*{_NUM}\s*,\s*{_NUM}\s*\]", rf"{_NUM}\s*±\s*{_NUM}"
ORACLES["e22_confidence_intervals"] = f"""
SELECT ctx, id, round(x[1]::DOUBLE, 6) AS lower, round(x[2]::DOUBLE, 6) AS upper, 'bracket' AS pattern
FROM (SELECT ctx, id, unnest(list_zip(regexp_extract_all(text, '{_BRACKET}', 1), regexp_extract_all(text, '{_BRACKET}', 2))) AS x FROM papers)
UNION ALL
SELECT ctx, id, round(x[1]::DOUBLE - x[2]::DOUBLE, 6), round(x[1]::DOUBLE + x[2]::DOUBLE, 6), 'plus_minus'
FROM (SELECT ctx, id, unnest(list_zip(regexp_extract_all(text, '{_ABOUT}', 1), regexp_extract_all(text, '{_ABOUT}', 2))) AS x FROM papers)"""
QUERIES["e23_keyword_filter"] = lambda s, d: keyword_filter(view(s, d, "papers"), ["Baseline", "corpus"], 30).withColumn("prov", F.array_join(F.col("prov").cast("array<string>"), ","))
ORACLES["e23_keyword_filter"] = f"""
SELECT ctx, status, array_to_string(prov, ',') AS prov, left(texts[1], 30) AS text
FROM {observed(_any(['baseline', 'corpus']), NONE, False)}"""
