"""Checks of operator specifications before they enter the library, and the library's registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import contains_any

#: Words of goals that say nothing testable, and verbs that do. Fixed values.
VAGUE = ("robustness", "robust", "novelty", "significance", "important", "impact", "overall", "quality", "assess", "evaluate", "validate", "judge", "soundness")
ACTIONS = ("extract", "locate", "find", "match", "identify", "list", "count", "parse", "retrieve", "compare", "compute", "check", "verify", "detect")
STEP = "struct<type:string,name:string,primitive:string>"


def dag_primitives(dag) -> Column:
    """Sorted distinct primitives that a graph's steps name."""
    name = lambda s: F.coalesce(F.nullif(s["primitive"], F.lit("")), F.when(s["type"] == "primitive", F.nullif(s["name"], F.lit(""))))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(dag, name))))


#: Fields that a specification's checks read.
SPEC = f"""struct<action:string,kind:string,name:string,need_summary:string,goal:string,external:boolean,uses_controlled_llm:boolean,n_tests:int,
  test_statuses:array<string>,n_tests_without_segments:int,n_bad_segments:int,dag:array<{STEP}>,outputs:array<string>,spec_names:array<string>,stub_names:array<string>>"""


def spec_issues(existing: list[str], primitives: str | None = None) -> Column:
    """Issue codes of a specification row.

    Columns: action, kind, name, need_summary, goal, external, uses_controlled_llm, n_tests, test_statuses
    (array), n_tests_without_segments, n_bad_segments, dag (array<STEP>), outputs (array of names), spec_names
    (array), stub_names (array; null if a test has none). A skipped specification has no issues. ``primitives`` names
    a column of nested specifications (array<SPEC>): the first one with issues adds primitive_spec_invalid, its name and
    its issues.
    """
    found = _issues(F.col, existing)
    if primitives:
        nested = F.filter(F.transform(primitives, lambda p: F.struct(F.coalesce(F.nullif(p["name"], F.lit("")), F.lit("unknown")).alias("name"), _issues(lambda c: p[c], existing).alias("found"))), lambda x: F.size(x["found"]) > 0)
        first = F.get(nested, F.lit(0))
        invalid = F.concat(F.lit("primitive_spec_invalid:"), first["name"], F.lit(":"), F.array_join(first["found"], ","))
        found = F.when(F.col("action") == "skip", found).otherwise(F.array_compact(F.concat(found, F.array(F.when(first.isNotNull(), invalid)))))
    return found


def _issues(of: Callable[[str], Column], existing: list[str]) -> Column:
    prims = dag_primitives(of("dag"))
    known = F.array(*[F.lit(e) for e in existing]) if existing else F.array().cast("array<string>")
    absent = F.array_except(prims, known)
    unspecified = F.array_except(absent, of("spec_names"))
    has_prims = (of("kind") == "skill") & (F.size(prims) > 0)
    goal = F.lower(F.concat_ws(" ", of("need_summary"), of("goal"), of("name")))
    code = lambda when, text: F.when(F.coalesce(when, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    # the checks of tests stop at the first finding; missing tests count as one
    broken = F.when(of("n_tests") == 0, F.lit("no_tests")).when(~of("external") & (of("n_tests_without_segments") > 0), F.lit("test_missing_segments")).when(of("n_bad_segments") > 0, F.lit("segment_missing_id_or_text"))
    found = F.array_compact(F.array(
        broken,
        code(~F.array_contains(of("test_statuses"), "ok"), "no_ok_test"),
        code((of("kind") == "skill") & (F.size(of("dag")) == 0) & ~of("uses_controlled_llm"), "skill_without_dag_or_controlled_llm"),
        code(has_prims & (F.size(absent) > 0) & (F.size(of("spec_names")) == 0), "missing_primitive_specs"),
        code(has_prims & (F.size(of("spec_names")) > 0) & (F.size(unspecified) > 0), F.concat(F.lit("missing_primitive_specs_for:"), F.array_join(unspecified, ","))),
        code(has_prims & of("stub_names").isNull(), "missing_primitive_stubs"),
        code(has_prims & (F.size(F.array_except(prims, of("stub_names"))) > 0), "incomplete_primitive_stubs"),
        code(~F.array_contains(of("outputs"), "prov"), "outputs_missing_prov"),
        code(contains_any(goal, VAGUE) & ~contains_any(goal, ACTIONS), "vague_goal_or_summary"),
    ))
    return F.when(of("action") == "skip", F.array().cast("array<string>")).otherwise(found)


#: A payload as it is proposed; nested primitives have no primitives of their own.
_PRIMITIVE = f"action:string,skip_reason:string,kind:string,candidate_kind:string,name:string,label:string,need_summary:string,summary:string,spec:struct<goal:string,dag:array<{STEP}>>,tests:array<string>,dependencies:array<string>"
PAYLOAD = f"struct<{_PRIMITIVE},primitive_specs:array<struct<{_PRIMITIVE}>>>"


def _normal(p: Column, fallback: Column, kind: Column | None = None) -> list[Column]:
    text = lambda *names: F.coalesce(*[F.nullif(p[n], F.lit("")) for n in names])
    one_of = lambda c, names: F.when(c.isin(*names), c).otherwise(F.lit(names[0]))
    own = one_of(F.lower(F.trim(F.coalesce(text("kind", "candidate_kind"), F.lit("")))), ("primitive", "skill"))
    spec = p["spec"]
    # a skill without a graph has an empty one; other kinds may have none
    dag = F.coalesce(spec["dag"], F.when(own == "skill", F.array().cast(f"array<{STEP}>")))
    return [
        one_of(F.lower(F.trim(F.coalesce(p["action"], F.lit("")))), ("accept", "skip")).alias("action"),
        F.coalesce(p["skip_reason"], F.lit("")).alias("skip_reason"),
        (own if kind is None else kind).alias("kind"),
        F.coalesce(text("name", "label"), fallback).alias("name"),
        F.coalesce(text("need_summary", "summary"), F.lit("")).alias("need_summary"),
        F.struct(spec["goal"].alias("goal"), dag.alias("dag")).alias("spec"),
        F.coalesce(p["tests"], F.array().cast("array<string>")).alias("tests"),
        F.filter(F.coalesce(p["dependencies"], F.array().cast("array<string>")), lambda d: F.coalesce(d, F.lit("")) != "").alias("dependencies"),
    ]


def normalized_spec(payload: Column, fallback: Column) -> Column:
    """A proposed specification (struct PAYLOAD, or null) in its normal form.

    Unknown actions become accept and unknown kinds primitive; name and summary may stand under their other keys, and a
    missing name is the fallback, that of the nth nested specification being <name>_Primitive_<n>. Nested ones are
    always primitives. The payload is named often: what is costly to make ought to be a column of its own.
    """
    own = _normal(payload, fallback)
    name = F.coalesce(F.nullif(payload["name"], F.lit("")), F.nullif(payload["label"], F.lit("")), fallback)
    nested = F.coalesce(payload["primitive_specs"], F.array().cast(f"array<struct<{_PRIMITIVE}>>"))
    made = F.transform(nested, lambda p, i: F.struct(*_normal(p, F.concat(name, F.lit("_Primitive_"), (i + 1).cast("string")), F.lit("primitive"))))
    return F.struct(*own, made.alias("primitive_specs"))


def test_totals(results, status: str = "status"):
    """Passed, failed, timed out and all runs of a library's tests."""
    each = [F.count_if(F.col(status) == s).alias(n) for s, n in (("pass", "passed"), ("fail", "failed"), ("timeout", "timed_out"))]
    return results.agg(*each, F.count(F.lit(1)).alias("total"))


INDEX = "name string, kind string, code_path string, needs array<string>"


def library_index(rows: DataFrame, order: list[str], last_wins: bool = False) -> DataFrame:
    """The artifacts of index rows (name, kind, code_path, needs): one row a name, with the needs that the library lacks.

    Rows without a name, a kind or a code path are left out. A name that comes twice is an error that names it, found when the
    rows are read; with ``last_wins`` its last row by ``order`` counts. Needs are met by name in one join, so an
    artifact that everything needs is a frequent key of narrow rows.
    """
    filled = rows.filter(" AND ".join(f"coalesce({c}, '') <> ''" for c in ("name", "kind", "code_path")))
    row = F.struct("kind", "code_path", "needs")
    one = filled.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max_by(row, F.struct(*order)).alias("r"))
    twice = F.raise_error(F.concat(F.lit("duplicate artifact "), F.col("name")))
    kept = one.withColumn("name", F.col("name") if last_wins else F.when(F.col("n") > 1, twice.cast("string")).otherwise(F.col("name"))).select("name", "r.*")
    asked = kept.select("name", F.explode("needs").alias("need")).filter("coalesce(need, '') <> ''").distinct()
    lacking = asked.join(kept.select(F.col("name").alias("need")), "need", "left_anti").groupBy("name").agg(F.array_sort(F.collect_list("need")).alias("missing"))
    return kept.join(lacking, "name", "left").select("name", "kind", "code_path", "needs", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


@dataclass
class Registry:
    """Named operators with their dependencies. A name may be taken once unless ``last_wins``."""

    last_wins: bool = False
    entries: dict[str, tuple[str, Callable, tuple[str, ...]]] = field(default_factory=dict)

    def register(self, name: str, kind: str, fn: Callable, needs: tuple[str, ...] = ()) -> None:
        if not name or kind not in ("primitive", "skill"):
            return
        if name in self.entries and not self.last_wins:
            raise ValueError(f"duplicate operator {name}")
        self.entries[name] = (kind, fn, tuple(needs))

    def run(self, name: str, *args, **kwargs):
        kind, fn, needs = self.entries[name]
        if gone := [n for n in needs if n not in self.entries]:
            raise LookupError(f"primitive_missing:{gone[0]}")
        return fn(*args, **kwargs)

    def closure(self, names: list[str]) -> list[str]:
        """Names with what they need before them; the first mention wins."""
        out: list[str] = []
        for name in names:
            for n in (*self.entries[name][2], name) if name in self.entries else (name,):
                if n not in out:
                    out.append(n)
        return out


def library() -> Registry:
    """All operators and skills over segments: skills first, then primitives."""
    from functools import partial

    from ..operators.extract import OPERATORS, extract
    from ..operators.skills import SKILLS

    r = Registry()
    for name, (fn, needs) in SKILLS.items():
        r.register(name, "skill", fn, needs)
    for name in OPERATORS:
        r.register(name, "primitive", partial(extract, name=name))
    return r
