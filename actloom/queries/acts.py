"""Projections, predicates and text grouping over acts, turns and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core
from ..operators import cluster, gate, kmeans
from ..plans import specs
from ..sources import markdown, readers
from ..sources.scratch import written
from ..views import parts, view

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_ROLE_TOKEN = r"""CASE WHEN trim(x) = '' THEN '' WHEN l = 'ac' OR contains(l, 'area chair') THEN 'Area Chair' WHEN contains(l, 'meta review') OR l = 'metareviewer' THEN 'Meta-Reviewer'
  WHEN contains(l, 'reviewer') OR l = 'review' THEN 'Reviewer' WHEN contains(l, 'author') OR contains(l, 'rebuttal') THEN 'Author' WHEN contains(l, 'editor') THEN 'Editor' WHEN contains(l, 'chair') THEN 'Chair'
  ELSE array_to_string(list_transform(string_split(l, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END"""


@query("p02_roles", rf"""
WITH parts AS (SELECT act_id, unnest(string_split_regex(role, '(?i)\s*(?:,|/|;|\||&|\band\b)\s*')) AS x, unnest(range(len(string_split_regex(role, '(?i)\s*(?:,|/|;|\||&|\band\b)\s*')))) AS i FROM acts),
n AS (SELECT act_id, i, {_ROLE_TOKEN} AS r FROM (SELECT *, lower(regexp_replace(trim(regexp_replace(trim(x), '[_-]+', ' ', 'g')), '\s+', ' ', 'g')) AS l FROM parts)),
f AS (SELECT act_id, r, min(i) AS i FROM n WHERE r <> '' GROUP BY act_id, r)
SELECT acts.act_id, coalesce(array_to_string(list(r ORDER BY i), ','), '') AS roles, first(r ORDER BY i) AS role FROM acts LEFT JOIN f ON acts.act_id = f.act_id GROUP BY acts.act_id""")
def _roles(s, d):
    r = core.roles("role")
    return view(s, d, "acts").select("act_id", F.array_join(r, ",").alias("roles"), F.get(r, F.lit(0)).alias("role"))


@query("p03_role_of_three", """
SELECT role, count(*) AS n, CASE WHEN contains(l, 'meta') OR contains(l, 'area chair') OR l = 'ac' THEN 'Meta' WHEN contains(l, 'author') OR contains(l, 'rebuttal') THEN 'Author'
  WHEN contains(l, 'reviewer') OR l = 'review' THEN 'Reviewer' WHEN contains(l, 'chair') OR contains(l, 'editor') THEN 'Meta' END AS class
FROM (SELECT role, lower(trim(role)) AS l FROM acts) GROUP BY role, l""")
def _role3(s, d):
    return view(s, d, "acts").groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("class", core.role_of_three("role"))


@query("p04_issue_text", "SELECT act_id, concat_ws(' | ', nullif(action, ''), nullif(grounding_ref, ''), nullif(target_type, '')) AS issue_text FROM acts")
def _issue(s, d):
    return view(s, d, "acts").select("act_id", core.issue_text(F.col("action"), F.col("grounding_ref"), F.array("target_type")).alias("issue_text"))


@query("p05_intent_text", "SELECT act_id, concat_ws(' | ', nullif(cognitive_chain, ''), CASE WHEN role <> '' THEN 'role:' || role END, nullif(action, '')) AS intent_text FROM acts")
def _intent(s, d):
    return view(s, d, "acts").select("act_id", core.intent_text(F.col("cognitive_chain"), F.col("role"), F.col("action")).alias("intent_text"))


@query("p06_need_text", """
SELECT act_id, concat_ws(' | ', CASE WHEN intent <> '' THEN 'intent:' || intent END, CASE WHEN action <> '' THEN 'action:' || action END,
  CASE WHEN operation <> '' OR target_type <> '' THEN 'tools:' || array_to_string(list_sort(list_distinct(list_filter([operation, target_type], lambda x: x <> ''))), ', ') END,
  CASE WHEN grounding_ref <> '' THEN 'grounding:' || grounding_ref END, 'source:' || seg_id) AS need_text FROM acts""")
def _need(s, d):
    a = view(s, d, "acts")
    return a.select("act_id", core.need_text(F.col("intent"), F.col("action"), F.array("operation", "target_type"), F.col("grounding_ref"), F.array("seg_id")).alias("need_text"))


def _clean(c):
    t = f"trim({c})"
    return f"CASE WHEN lower({t}) IN ('n/a', 'na', 'none', 'not_required') OR lower({t}) LIKE 'n/a%' OR lower({t}) LIKE 'na %' OR contains(lower({t}), 'not_required') OR contains(lower({t}), 'not required') THEN '' ELSE {t} END"


_DERIVED = f"""SELECT *, coalesce(nullif({_clean('grounding_ref')}, ''), nullif({_clean('action')}, ''), nullif({_clean('intent')}, ''),
  CASE WHEN operation <> '' OR target_type <> '' THEN concat_ws(' ', nullif({_clean('operation')}, ''), nullif({_clean('target_type')}, '')) END, 'evidence') AS query FROM acts"""


@query("p07_clean_ref", f"SELECT act_id, {_clean('grounding_ref')} AS ref FROM acts")
def _clean_ref(s, d):
    return view(s, d, "acts").select("act_id", core.clean_ref("grounding_ref").alias("ref"))


def _routed(s, d):
    from ..plans.grounding import routed

    return routed(view(s, d, "acts")).select("act_id", "query", "call.skill", "call.argument", "call.value")


@query("p08_derive_query", f"SELECT act_id, query FROM ({_DERIVED})")
def _derive(s, d):
    return _routed(s, d).select("act_id", "query")


def _arm(words, pattern, skill, arg):
    return f"WHEN ({' OR '.join(f"contains(lower(query), '{w}')" for w in words)}) AND regexp_extract(query, '{pattern}', 1) <> '' THEN {{'skill': '{skill}', 'argument': '{arg}', 'value': regexp_extract(query, '{pattern}', 1)}}"


ROUTED = f"""SELECT *, CASE {' '.join(_arm(w, p, n, a) for w, n, a, p in core.ROUTES)}
  WHEN contains(lower(query), 'section') OR contains(lower(query), 'sec') OR contains(lower(query), 'appendix')
  THEN {{'skill': 'Extract_Section', 'argument': 'title', 'value': CASE WHEN contains(lower(query), 'appendix') THEN 'Appendix' ELSE query END}}
  ELSE {{'skill': 'Extract_Span', 'argument': 'query', 'value': query}} END AS call FROM ({_DERIVED})"""


@query("p09_route", f"SELECT act_id, query, call.skill AS skill, call.argument AS argument, call.value AS value FROM ({ROUTED})")
def _route(s, d):
    return _routed(s, d)


@query("p11_spec_issues", """
WITH t AS (SELECT p_partkey, p_partkey % 3 AS n_tests, p_partkey % 2 = 0 AS skill, p_partkey % 5 = 0 AS external, p_partkey % 7 AS bare, p_partkey % 4 AS dag, p_partkey % 11 = 0 AS skip FROM part),
u AS (SELECT *, CASE dag WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Extract_Span'] WHEN 2 THEN ['Extract_Span', 'New_Op'] ELSE ['New_Op'] END AS prims FROM t)
SELECT p_partkey, CASE WHEN skip THEN '' ELSE concat_ws(';',
  CASE WHEN n_tests = 0 THEN 'no_tests' WHEN NOT external AND bare = 1 THEN 'test_missing_segments' WHEN bare = 2 THEN 'segment_missing_id_or_text' END,
  CASE WHEN n_tests <> 2 THEN 'no_ok_test' END, CASE WHEN skill AND dag = 0 THEN 'skill_without_dag_or_controlled_llm' END,
  CASE WHEN skill AND dag >= 2 AND bare <> 3 THEN 'missing_primitive_specs' END, CASE WHEN skill AND dag >= 2 AND bare = 3 THEN 'missing_primitive_specs_for:New_Op' END,
  CASE WHEN skill AND dag > 0 AND bare = 4 THEN 'missing_primitive_stubs' END, CASE WHEN skill AND dag >= 2 AND bare <> 4 THEN 'incomplete_primitive_stubs' END,
  CASE WHEN bare = 5 THEN 'outputs_missing_prov' END, CASE WHEN bare = 6 THEN 'vague_goal_or_summary' END) END AS issues FROM u""")
def _spec(s, d):
    k = F.col("p_partkey")
    step = lambda *names: F.array(*[F.struct(F.lit("primitive").alias("type"), F.lit(n).alias("name"), F.lit("").alias("primitive")) for n in names]).cast(f"array<{specs.STEP}>")
    names = lambda *n: F.array(*[F.lit(x) for x in n]).cast("array<string>")
    dag = F.when(k % 4 == 0, step()).when(k % 4 == 1, step("Extract_Span")).when(k % 4 == 2, step("New_Op", "Extract_Span")).otherwise(step("New_Op"))
    t = view(s, d, "part").select(
        "p_partkey", F.when(k % 11 == 0, "skip").otherwise("accept").alias("action"), F.when(k % 2 == 0, "skill").otherwise("primitive").alias("kind"), F.lit("x").alias("name"), F.lit("").alias("need_summary"),
        F.when(k % 7 == 6, "overall quality").otherwise("find it").alias("goal"), (k % 5 == 0).alias("external"), F.lit(False).alias("uses_controlled_llm"), (k % 3).alias("n_tests"),
        F.when(k % 3 == 2, names("ok")).otherwise(names("missing")).alias("test_statuses"), (k % 7 == 1).cast("int").alias("n_tests_without_segments"), (k % 7 == 2).cast("int").alias("n_bad_segments"), dag.alias("dag"),
        F.when(k % 7 == 5, names()).otherwise(names("prov")).alias("outputs"), F.when(k % 7 == 3, names("Other")).otherwise(names()).alias("spec_names"), F.when(k % 7 != 4, names("Extract_Span")).alias("stub_names"),
    )
    return t.select("p_partkey", F.array_join(specs.spec_issues(["Extract_Span"]), ";").alias("issues"))


@query("p11_nested_specs", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'primitive_spec_invalid:' || CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE 'P' END || ':no_tests,no_ok_test,outputs_missing_prov' ELSE '' END AS issues FROM part""")
def _nested(s, d):
    k = F.col("p_partkey")

    def spec(name, tests, statuses, outputs):
        none = F.array().cast("array<string>")
        return F.struct(
            F.lit("accept").alias("action"), F.lit("primitive").alias("kind"), name.alias("name"), F.lit("").alias("need_summary"), F.lit("find it").alias("goal"), F.lit(True).alias("external"), F.lit(False).alias("uses_controlled_llm"),
            tests.cast("int").alias("n_tests"), statuses.alias("test_statuses"), F.lit(0).alias("n_tests_without_segments"), F.lit(0).alias("n_bad_segments"), F.array().cast(f"array<{specs.STEP}>").alias("dag"), outputs.alias("outputs"), none.alias("spec_names"), none.alias("stub_names"),
        ).cast(specs.SPEC)

    ok, prov, none = F.array(F.lit("ok")), F.array(F.lit("prov")), F.array().cast("array<string>")
    good, odd = spec(F.lit("G"), F.lit(1), ok, prov), k % 2 == 1
    other = spec(F.when(k % 3 == 0, "").otherwise("P"), F.when(odd, 0).otherwise(1), F.when(odd, none).otherwise(ok), F.when(odd, none).otherwise(prov))
    t = view(s, d, "part").select("p_partkey", good.alias("g"), F.array(good, other).alias("primitives")).select("p_partkey", "g.*", "primitives")
    return t.select("p_partkey", F.array_join(specs.spec_issues([], "primitives"), ";").alias("issues"))


@query("p10_spec_normalise", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'skip' ELSE 'accept' END AS action, CASE p_partkey % 3 WHEN 0 THEN 'skill' ELSE 'primitive' END AS kind,
  CASE WHEN p_partkey % 5 > 0 THEN 'N' || p_partkey WHEN p_partkey % 2 = 0 THEN 'L' || p_partkey ELSE 'F' || p_partkey END AS name,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS need_summary, CASE WHEN p_partkey % 3 = 0 THEN 0 END::INTEGER AS n_steps, 1::INTEGER AS n_dependencies,
  CASE WHEN p_partkey % 5 > 0 THEN 'N' || p_partkey WHEN p_partkey % 2 = 0 THEN 'L' || p_partkey ELSE 'F' || p_partkey END || '_Primitive_1' AS first_nested, 'primitive' AS nested_kind, 2::INTEGER AS n_nested FROM part""")
def _normalise(s, d):
    payload = s.sql(
        """SELECT p_partkey, to_json(named_struct(
          'action', CASE p_partkey % 4 WHEN 0 THEN 'accept' WHEN 1 THEN ' SKIP ' WHEN 2 THEN 'maybe' END, 'kind', CASE p_partkey % 3 WHEN 1 THEN 'Primitive' WHEN 2 THEN 'other' END,
          'candidate_kind', CASE p_partkey % 3 WHEN 0 THEN ' Skill' END, 'name', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('N', p_partkey) END, 'label', CASE WHEN p_partkey % 10 = 0 THEN concat('L', p_partkey) END,
          'need_summary', CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN p_brand END, 'summary', CASE WHEN p_partkey % 7 > 0 THEN p_brand END, 'dependencies', array('numpy', '', NULL),
          'primitive_specs', array(named_struct('kind', 'skill', 'name', ''), named_struct('kind', 'skill', 'name', 'own')))) AS payload FROM {part}""",
        part=view(s, d, "part").repartition(parts(s, d, "part", 1 << 18), "p_partkey"),  # a row costs far more than its bytes
    )
    read = payload.select("p_partkey", F.from_json("payload", specs.PAYLOAD).alias("p"))  # parsed once, named often
    out = read.select("p_partkey", specs.normalized_spec(F.col("p"), F.concat(F.lit("F"), F.col("p_partkey").cast("string"))).alias("x")).select("p_partkey", "x.*")
    first = F.get("primitive_specs", F.lit(0))
    return out.select("p_partkey", "action", "kind", "name", "need_summary", F.when(F.col("spec.dag").isNotNull(), F.size("spec.dag")).alias("n_steps"), F.size("dependencies").alias("n_dependencies"), first["name"].alias("first_nested"), first["kind"].alias("nested_kind"), F.size("primitive_specs").alias("n_nested"))


@query("p12_dag_primitives", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'A,' || p_brand ELSE p_brand END AS primitives FROM part")
def _dag(s, d):
    step = lambda t, n, p: F.struct(F.lit(t).alias("type"), n.alias("name"), p.alias("primitive"))
    none, brand = F.lit(""), F.col("p_brand")
    dag = F.array(step("primitive", brand, none), step("", none, brand), step("llm", F.lit("zz"), none), step("primitive", F.when(F.col("p_size") % 2 == 0, "A").otherwise(""), none))
    return view(s, d, "part").select("p_partkey", F.array_join(specs.dag_primitives(dag.cast(f"array<{specs.STEP}>")), ",").alias("primitives"))


@query("p13_normal_plan", "SELECT event_id, CASE WHEN intent IN ('I1', 'I2') THEN intent ELSE 'I1' END AS intent, CASE WHEN skill IN ('S4', 'S0') THEN skill ELSE 'S4' END AS skill, action_type FROM moves")
def _plan(s, d):
    m = view(s, d, "moves").withColumn("p", gate.normal_plan(F.col("intent"), F.col("skill"), ("I1", "I2"), ("S4", "S0")))
    return m.select("event_id", "p.intent", "p.skill", gate.normal_action(F.col("action_type"), F.lit(""))["action_type"].alias("action_type"))


def _claims(s, d):
    ids = lambda *c: F.array(*[F.concat(F.lit("O"), x.cast("string")) for x in c])
    e = F.col("event_id")
    claim = lambda t, c: F.struct(F.lit(t).alias("text"), c.alias("cites"))
    claims = F.array(claim("a", ids(e % 5, e % 5)), claim("b", ids(e % 7)), claim("c", F.array().cast("array<string>")))
    return view(s, d, "moves").withColumns({"claims": claims.cast(gate.CLAIM), "allowed": ids(e % 3, e % 4), "own": F.concat(F.lit("O"), (e % 2).cast("string"))})


def _gated(kind):
    allowed = "[event_id % 3, event_id % 4]" if kind == "set" else "[event_id % 2]"
    return f"""
SELECT event_id, CASE WHEN status = 'ok' THEN concat_ws(';', CASE WHEN list_contains({allowed}, event_id % 5) THEN 'a:O' || (event_id % 5) || ',O' || (event_id % 5) END, CASE WHEN list_contains({allowed}, event_id % 7) THEN 'b:O' || (event_id % 7) END) ELSE '' END AS claims,
  CASE WHEN status = 'ok' OR action_type IN ('clarification', 'evidence_plan', 'conditional_commitment', 'request') THEN action_type ELSE 'clarification' END AS action_type FROM moves"""


def _written(c):
    return F.array_join(F.transform(c, lambda x: F.concat(x["text"], F.lit(":"), F.array_join(x["cites"], ","))), ";")


@query("p14_gate", _gated("set"))
def _gate(s, d):
    return _claims(s, d).select("event_id", _written(gate.gate_claims("claims", F.col("status"), F.col("allowed"))).alias("claims"), gate.gate_action(F.col("action_type"), F.col("status")).alias("action_type"))


@query("p15_gate_single", _gated("one"))
def _gate1(s, d):
    return _claims(s, d).select("event_id", _written(gate.gate_single("claims", F.col("status"), F.col("own"))).alias("claims"), gate.gate_action(F.col("action_type"), F.col("status")).alias("action_type"))


@query("p18_turn_id", "SELECT act_id, regexp_replace(seg_id, '^(.+)_[0-9]+$', '\\1') AS turn_id FROM acts")
def _turn(s, d):
    return view(s, d, "acts").select("act_id", core.turn_id(F.col("seg_id")).alias("turn_id"))


@query("p19_year", "SELECT act_id, year(make_timestamp(((CASE WHEN timestamp > 1e12 THEN timestamp / 1000 ELSE timestamp END) * 1000000)::BIGINT))::INTEGER AS year FROM acts")
def _year(s, d):
    return view(s, d, "acts").select("act_id", core.year_of("timestamp").alias("year"))


@query("p23_demo_classes", """
SELECT act_id, CASE WHEN contains(lower(action), 'metric') THEN 'T1' WHEN contains(lower(action), 'figure 1') OR contains(lower(action), 'ablation') THEN 'T2' ELSE 'T0' END AS tag,
  CASE role WHEN 'Author' THEN CASE WHEN contains(lower(action), 'define') OR contains(lower(action), 'figure') OR contains(lower(action), 'evidence') THEN 'ProvideEvidence' ELSE 'CommitUpdate' END WHEN 'Meta' THEN 'ScheduleThreads' ELSE 'RequestEvidence' END AS intent FROM turns""")
def _demo(s, d):
    return view(s, d, "turns").select("act_id", core.thread_tag(F.col("action")).alias("tag"), core.turn_intent(F.col("role"), F.col("action")).alias("intent"))


@query("p_observation_id", """SELECT ctx, 'O' || left(sha256('{"prov": [' || array_to_string(list(id ORDER BY id), ', ') || '], "type": "text"}'), 12) AS id FROM papers GROUP BY ctx""")
def _oid(s, d):
    return view(s, d, "papers").groupBy("ctx").agg(core.observation_id(F.lit("text"), F.array_sort(F.collect_list("id"))).alias("id"))


@query("p_shorten", "SELECT doc_id, CASE WHEN length(text) <= 96 THEN text ELSE left(text, 93) || '...' END AS text FROM documents")
def _shorten(s, d):
    return view(s, d, "documents").select("doc_id", core.shorten(F.col("text"), 96).alias("text"))


@query("p_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def _slug(s, d):
    return view(s, d, "part").select("p_partkey", core.slug(F.col("p_name")).alias("slug"))


# --- segmentation ----------------------------------------------------------------------------------------

_MD = "concat('# Title ', cast(doc_id AS string), chr(10), text, chr(10), chr(10), '## Part', chr(10), left(text, 120), chr(10), ' ', chr(10), '### ', chr(10), 'end')"


@query("s04_markdown_segments", f"""
WITH l AS (SELECT doc_id AS ctx, unnest(string_split({_MD}, chr(10))) AS line, unnest(range(len(string_split({_MD}, chr(10))))) AS n FROM documents),
h AS (SELECT *, nullif(regexp_extract(trim(line), '^#{{1,6}}\\s+(.*)$', 1), '') AS heading, trim(line) = '' AS blank FROM l),
c AS (SELECT *, last_value(heading IGNORE NULLS) OVER w AS section, sum((blank OR heading IS NOT NULL)::INT) OVER w * 2 + (heading IS NULL)::INT AS chunk FROM h WINDOW w AS (PARTITION BY ctx ORDER BY n)),
b AS (SELECT ctx, chunk, any_value(section) AS section, any_value(heading) AS heading, trim(coalesce(any_value(heading), string_agg(line, chr(10) ORDER BY n)), ' ' || chr(10)) AS body FROM c WHERE NOT blank GROUP BY ctx, chunk),
p AS (SELECT ctx, chunk, section, unnest(range(0, CASE WHEN heading IS NOT NULL THEN 1 ELSE ((length(body) + 899) // 900) END)) AS i, body, heading FROM b)
SELECT ctx, row_number() OVER (PARTITION BY ctx ORDER BY chunk, i)::INTEGER AS id, CASE WHEN heading IS NOT NULL THEN body ELSE substring(body, i * 900 + 1, 900) END AS text, section FROM p""")
def _markdown(s, d):
    return markdown.segment(view(s, d, "documents").selectExpr("doc_id AS ctx", f"{_MD} AS text"))


@query("s05_markdown_blocks", f"""
WITH b AS (SELECT doc_id AS ctx, list_filter(list_transform(string_split_regex({_MD}, '\\n\\s*\\n'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS bs FROM documents),
r AS (SELECT ctx, unnest(bs) AS b, unnest(range(1, len(bs) + 1)) AS n FROM b)
SELECT ctx, 'C' || n AS id, CASE WHEN b LIKE '![%' THEN 'figure' WHEN b LIKE '#%' THEN 'heading' ELSE 'paragraph' END AS type, regexp_replace(b, '\\s+', ' ', 'g') AS text FROM r""")
def _blocks(s, d):
    return markdown.blocks(view(s, d, "documents").selectExpr("doc_id AS ctx", f"{_MD} AS text"))


@query("s11_segment_counts", "SELECT ctx, count(*) FILTER (WHERE id <> 2) AS n_segments FROM papers GROUP BY ctx")
def _counts(s, d):
    return readers.segment_counts(view(s, d, "papers").withColumn("id", F.when(F.col("id") != 2, F.col("id"))))


@query("s19_last_wins", "SELECT issue_id, arg_max(act_id, pos) AS act_id, arg_max(role, pos) AS role FROM acts GROUP BY issue_id")
def _last(s, d):
    return readers.last_wins(view(s, d, "acts").select("issue_id", "act_id", "role", "pos"), "issue_id")


@query("a09_first_wins", "SELECT issue_id, arg_min(act_id, pos) AS act_id, arg_min(role, pos) AS role FROM acts GROUP BY issue_id")
def _first(s, d):
    return readers.first_wins(view(s, d, "acts").select("issue_id", "act_id", "role", "pos"), "issue_id")


@query("p01_flatten", "SELECT printf('%d#%04d', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS act_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER - 1 AS act_index, conv_id::VARCHAR AS forum_id, role AS role_raw, text AS action FROM conversations")
def _flatten(s, d):
    item = F.struct("turn", "role", "text")
    rows = view(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    none = F.lit(None).cast("string")
    entry = lambda x: F.struct(x["role"].alias("role"), none.alias("strategic_intent"), x["text"].alias("action"), none.alias("grounding_ref"), F.lit(None).cast("array<string>").alias("source_seg_ids"), F.lit(None).cast(f"array<{readers.CALL}>").alias("latent_tool_calls"), none.alias("cognitive_chain"))
    records = rows.select(F.col("conv_id").cast("string").alias("forum_id"), none.alias("forum"), none.alias("title"), F.lit(None).cast("double").alias("timestamp"), F.struct(F.transform("m", entry).alias("mining_results")).alias("analysis"))
    return readers.flatten_mining(records).select("act_id", "act_index", "forum_id", "role_raw", "action")


# --- grouping and clustering -----------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in cluster.STOPWORDS)
KEYED = f"""
SELECT doc_id, text, CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(range(12), lambda b: CASE WHEN list_sum(list_transform(w, lambda h: CASE WHEN (h >> (11 - b)) & 1 = 1 THEN 1 ELSE -1 END)) >= 0 THEN 1 << (11 - b) ELSE 0 END)) END::BIGINT AS group_key
FROM (SELECT doc_id, text, list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP})), lambda x: ('0x' || left(md5(x), 3))::INTEGER) AS w FROM documents)"""


@query("g03_group_key", f"SELECT doc_id, group_key FROM ({KEYED})")
def _key(s, d):
    return cluster.with_group_key(view(s, d, "documents")).select("doc_id", "group_key")


@query("g05_representatives", f"SELECT group_key, count(*) AS size, arg_min(doc_id, (-length(text), doc_id)) AS doc_id, arg_min(text, (-length(text), doc_id)) AS text, 1 AS rank FROM ({KEYED}) GROUP BY group_key")
def _reps(s, d):
    return cluster.representatives(cluster.with_group_key(view(s, d, "documents").select("doc_id", "text")), ["group_key"], "text", "doc_id")


@query("g05_more_representatives", f"""
WITH k AS ({KEYED}), t AS (SELECT group_key, count(*) AS size, arg_min(doc_id, (-length(text), doc_id)) AS top FROM k GROUP BY group_key)
SELECT group_key, size, doc_id, text, rank FROM (SELECT k.group_key, size, doc_id, text, row_number() OVER (PARTITION BY k.group_key ORDER BY doc_id <> top, md5(doc_id || ':42'), doc_id)::INTEGER AS rank FROM k JOIN t USING (group_key)) WHERE rank <= 3""")
def _reps3(s, d):
    keyed = written(cluster.with_group_key(view(s, d, "documents").select("doc_id", "text")), "keyed")  # read twice, keyed once
    return cluster.representatives(keyed, ["group_key"], "text", "doc_id", 3)


@query("g06_l2_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def _norm(s, d):
    e = view(s, d, "embeddings")
    return e.select("vec_id", F.round(cluster.l2_norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(cluster.normalized("embedding"), F.lit(0)), 6).alias("first"))


@query("g07_centroids", """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT label, i::INTEGER AS i, round(m / n, 5) AS x FROM m JOIN n USING (label)""")
def _centroids(s, d):
    return cluster.centroids(view(s, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 5))


@query("g11_assign", """
WITH c AS (SELECT vec_id AS cid, embedding AS v FROM embeddings WHERE vec_id < 8),
p AS (SELECT e.vec_id, cid, list_sum(list_transform(list_zip(e.embedding, v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS dist FROM embeddings e CROSS JOIN c)
SELECT vec_id, arg_min(cid, (dist, cid)) AS cid, round(min(dist), 5) AS distance FROM p GROUP BY vec_id""")
def _assign(s, d):
    e = view(s, d, "embeddings")
    centers = e.filter("vec_id < 8").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("centroid"))
    return cluster.assign(e, centers, "vec_id", "embedding").withColumn("distance", F.round("distance", 5))


@query("g09_kmeans")
def _kmeans(s, d):
    e = view(s, d, "embeddings")
    return cluster.kmeans(e, "embedding", cluster_count(e.count())).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


@query("g09_kmeans_scoped", "SELECT label, count(*) AS size FROM embeddings GROUP BY label")
def _kmeans_scoped(s, d):
    """Sizes of the scopes, summed over their clusters."""
    out = cluster.kmeans_scoped(view(s, d, "embeddings"), "label", "embedding", "vec_id", 3, max_iter=4)
    return out.groupBy("label", "cluster_id").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.sum("n").alias("size"))


def _draw(i):
    return f"(('0x' || substr(md5(vec_id || ':42:{i}'), 1, 13))::BIGINT + 1) / 4503599627370496.0"


def _starts_sql(k):
    """D^2 starts, unrolled: one step a start."""
    steps = ["v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)", f"s0 AS MATERIALIZED (SELECT 0 AS cluster_id, vec_id, x FROM v ORDER BY {_draw(0)}, vec_id LIMIT 1)", "d0 AS MATERIALIZED (SELECT v.*, list_distance(v.x, s0.x) ** 2 AS d FROM v, s0)"]
    for i in range(1, k):
        steps.append(f"s{i} AS MATERIALIZED (SELECT {i} AS cluster_id, vec_id, x FROM d{i - 1} ORDER BY CASE WHEN d > 0 THEN -ln({_draw(i)}) / d ELSE 'Infinity'::DOUBLE END, {_draw(i)}, vec_id LIMIT 1)")
        steps.append(f"d{i} AS MATERIALIZED (SELECT r.vec_id, r.x, least(r.d, list_distance(r.x, s{i}.x) ** 2) AS d FROM d{i - 1} r, s{i})")
    return ", ".join([*steps, "c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(k)) + ")"])


def _rounds_sql(rounds, scope=""):
    """Lloyd's rounds, unrolled: labels by the centers, then means; nothing changes once labels are stable."""
    with_scope, using = (f", {scope}", f"USING ({scope})") if scope else ("", "ON true")
    steps = []
    for i in range(rounds):
        steps.append(f"l{i} AS MATERIALIZED (SELECT v.vec_id, any_value(v.x) AS x{with_scope}, arg_min(cluster_id, (list_distance(v.x, c.x), cluster_id)) AS cluster_id FROM v JOIN c{i} c {using} GROUP BY v.vec_id{with_scope})")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster_id{with_scope}, list(m ORDER BY i) AS x FROM (SELECT cluster_id{with_scope}, i, avg(x[i]) AS m FROM l{i}, range(1, 65) r(i) GROUP BY ALL) GROUP BY cluster_id{with_scope})")
    return ", ".join(steps)


@query("g08_dsquared_starts", f"WITH {_starts_sql(6)} SELECT cluster_id, vec_id FROM c0")
def _dsquared(s, d):
    e = view(s, d, "embeddings")
    starts = kmeans.dsquared_starts(e, "vec_id", "embedding", 6)
    return s.createDataFrame([(i, row) for i, (row, _) in enumerate(starts)], "cluster_id int, vec_id long").join(e.select("vec_id"), "vec_id").select("cluster_id", "vec_id")


@query("g09_kmeans_stable", f"WITH {_starts_sql(5)}, {_rounds_sql(8)} SELECT vec_id, cluster_id FROM l7")
def _stable(s, d):
    return kmeans.kmeans_stable(view(s, d, "embeddings"), "vec_id", "embedding", 5, max_iter=8).select("vec_id", "cluster_id")


@query(
    "g09_kmeans_scoped_labels",
    f"""WITH v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
c0 AS MATERIALIZED (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) - 1 AS cluster_id FROM v QUALIFY cluster_id < 3),
{_rounds_sql(5, "label")} SELECT vec_id, label, cluster_id::INTEGER AS cluster_id FROM l4""",
)
def _scoped_labels(s, d):
    return cluster.kmeans_scoped(view(s, d, "embeddings"), "label", "embedding", "vec_id", 3, max_iter=5).select("vec_id", "label", "cluster_id")


@query("g10_kmeans_minibatch")
def _kmeans_minibatch(s, d):
    e = view(s, d, "embeddings")
    return cluster.kmeans_minibatch(e, "embedding", "vec_id", cluster_count(e.count()), max_iter=10).groupBy("cid").agg(F.count(F.lit(1)).alias("size"))


def cluster_count(n):
    from ..functions.stats import auto_k

    return auto_k(n)


_SIZES = f"(SELECT group_key, count(*) AS size FROM ({KEYED}) GROUP BY group_key)"


@query("g12_propagate", f"SELECT k.doc_id, s.size FROM ({KEYED}) k JOIN {_SIZES} s USING (group_key)")
def _propagate(s, d):
    k = written(cluster.with_group_key(view(s, d, "documents").select("doc_id", "text")).select("doc_id", "group_key"), "keyed")  # read twice, keyed once
    return k.join(cluster.cluster_sizes(k, ["group_key"]), "group_key").select("doc_id", "size")


@query("g13_scoped_groups", f"SELECT source, group_key, count(*) AS size FROM ({KEYED}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source, group_key")
def _scoped(s, d):
    return cluster.cluster_sizes(cluster.with_group_key(view(s, d, "documents")), ["source", "group_key"])


@query("g14_samples", "SELECT * FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id)::INTEGER AS rank FROM embeddings) WHERE rank <= 6")
def _samples(s, d):
    return cluster.samples(view(s, d, "embeddings").select("vec_id", "label"), ["label"], "vec_id")


@query("g15_size_summary", f"SELECT min(size) AS size_min, quantile_cont(size, 0.5) AS size_median, avg(size) AS size_mean, max(size) AS size_max FROM {_SIZES}")
def _summary(s, d):
    return cluster.size_summary(cluster.cluster_sizes(cluster.with_group_key(view(s, d, "documents")), ["group_key"]))


@query("g16_top_clusters", f"SELECT group_key, size FROM {_SIZES} ORDER BY size DESC, group_key LIMIT 10")
def _top(s, d):
    return cluster.largest(cluster.cluster_sizes(cluster.with_group_key(view(s, d, "documents")), ["group_key"]), ["group_key"])


@query("g17_row_sample", "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 50")
def _sample(s, d):
    return cluster.row_sample(view(s, d, "documents").select("doc_id", "lang"), "doc_id", 50)


@query("s15_embeddings")
def _embed(s, d):
    from ..sources.providers import HashingEmbedder, embed

    out = embed(view(s, d, "documents").select("doc_id", "text"), "text", HashingEmbedder())
    return out.select("doc_id", F.round(cluster.l2_norm(F.col("embedding")), 4).alias("norm"), "embedding_error")


@query("g08_grouped_embeddings")
def _grouped(s, d):
    from ..sources.providers import HashingEmbedder, grouped_embeddings

    keyed = cluster.with_group_key(view(s, d, "documents").select("doc_id", "text"), bits=8)
    return grouped_embeddings(keyed, ["group_key"], "text", "doc_id", HashingEmbedder())
