"""Policy replies, containment in a table of queries, and intervals of run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import salvage
from ..operators.containment import claims_supported, contained
from ..plans import intervals
from ..views import view

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CASES = f"""t AS (SELECT doc_id, {_TRIM.format('reply')} AS t FROM replies),
c AS (SELECT doc_id, t, {_TRIM.format("regexp_extract(t, '(?is)```(?:json)?\\s*(.*?)```', 1)")} AS fence,
    CASE WHEN t[1] IN ('{{', '[') THEN t END AS bare, regexp_extract(t, '(?s)\\[.*\\]') AS arr, regexp_extract(t, '(?s)\\{{.*\\}}') AS obj,
    regexp_extract(CASE WHEN starts_with(t, '```') THEN {_TRIM.format("trim(t, '`')")} ELSE t END, '(?s)\\{{.*\\}}') AS open,
    CASE WHEN starts_with(t, '```') AND regexp_matches(t, '(?s)```.*```') THEN {_TRIM.format("regexp_extract(t, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1)")} ELSE t END AS js FROM t),
f AS (SELECT doc_id, CASE WHEN json_valid(fence) THEN fence WHEN json_valid(bare) THEN bare WHEN json_valid(arr) THEN arr WHEN json_valid(obj) THEN obj END AS reply,
    CASE WHEN json_valid(open) THEN open END AS widest,
    CASE WHEN json_valid(js) THEN js WHEN json_valid(regexp_extract(js, '(?s)\\{{.*\\}}')) THEN regexp_extract(js, '(?s)\\{{.*\\}}') END AS loose FROM c)"""


def _salvaged(s, d):
    replies = view(s, d, "replies")
    return replies.select("doc_id", salvage.reply_json(F.col("reply")).alias("reply"), salvage.object_json(F.col("reply")).alias("widest"), salvage.any_json(F.col("reply")).alias("loose"))


@query("p_json_salvage", f"WITH {_CASES} SELECT doc_id, md5(reply) AS reply, md5(widest) AS widest, md5(loose) AS loose, length(reply) AS n_reply FROM f")
def _salvage(s, d):
    return _salvaged(s, d).select("doc_id", *[F.md5(c).alias(c) for c in ("reply", "widest", "loose")], F.length("reply").cast("long").alias("n_reply"))


@query(
    "p_json_label_pick",
    f"""WITH {_CASES},
items AS (SELECT doc_id, unnest(from_json(CASE WHEN json_type(reply) = 'ARRAY' THEN reply ELSE '[' || reply || ']' END, '["JSON"]')) AS x,
  unnest(range(json_array_length(CASE WHEN json_type(reply) = 'ARRAY' THEN reply ELSE '[' || reply || ']' END)::BIGINT)) AS i, json_type(reply) AS kind FROM f WHERE reply IS NOT NULL),
picked AS (SELECT doc_id, arg_min(x, i) AS x FROM items WHERE json_type(x) = 'OBJECT' AND (kind = 'OBJECT' OR json_exists(x, '$.label') OR json_exists(x, '$.action')) GROUP BY doc_id)
SELECT doc_id, json_extract_string(x, '$.action') AS action, json_extract_string(x, '$.label') AS label, md5(json_extract_string(x, '$.note')) AS note FROM f LEFT JOIN picked USING (doc_id)""",
)
def _label(s, d):
    picked = salvage.label_payload(salvage.variant(F.col("reply")))
    of = lambda key: F.try_variant_get("x", f"$.{key}", "string")
    return _salvaged(s, d).select("doc_id", picked.alias("x")).select("doc_id", of("action").alias("action"), of("label").alias("label"), F.md5(of("note")).alias("note"))


@query(
    "p_json_first_value",
    """WITH s AS (SELECT doc_id, reply, string_split(reply, '') AS l FROM replies WHERE reply IS NOT NULL),
b AS (SELECT doc_id, unnest(list_filter(range(1, len(l) + 1), lambda i: l[i] IN ('[', '{'))) AS b FROM s),
e AS (SELECT doc_id, unnest(list_filter(range(1, len(l) + 1), lambda i: l[i] IN (']', '}'))) AS e FROM s),
v AS (SELECT doc_id, min(b) AS b, arg_min(e, b) AS e FROM b JOIN e USING (doc_id) JOIN s USING (doc_id)
  WHERE e > b AND json_valid(substring(reply, b, e - b + 1)) GROUP BY doc_id)
SELECT r.doc_id, md5(substring(reply, b, e - b + 1)) AS found, json_extract_string(substring(reply, b, e - b + 1), '$.label') AS label
FROM replies r LEFT JOIN v USING (doc_id)""",
)
def _first(s, d):
    found = view(s, d, "replies").select("doc_id", salvage.first_json(F.col("reply")).alias("found"))
    return found.select("doc_id", F.md5("found").alias("found"), F.try_variant_get(salvage.variant(F.col("found")), "$.label", "string").alias("label"))


def _sentences(s, d):
    """Sentences of benchmark items: a table of queries."""
    parts = F.explode(F.split("text", r"[.\n]"))
    return view(s, d, "benchmark").select("item_id", parts.alias("part")).select("item_id", F.btrim("part").alias("query")).filter("length(query) >= 12")


_SENTENCES = "q AS (SELECT item_id, lower(trim(part)) AS query FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.\\n]')) AS part FROM benchmark) WHERE length(trim(part)) >= 12)"


@query("j09_phrases_in_documents", f"WITH {_SENTENCES} SELECT doc_id, query FROM documents JOIN (SELECT DISTINCT query FROM q) ON contains(lower(text), query)")
def _phrases(s, d):
    return contained(view(s, d, "documents").select("doc_id", "text"), _sentences(s, d), ["doc_id"])


@query("j09_refs_in_segments", "SELECT query, count(*) AS n, count(DISTINCT ctx) AS n_ctx FROM papers JOIN (SELECT DISTINCT lower(grounding_ref) AS query FROM acts WHERE grounding_ref <> '') ON contains(lower(text), query) GROUP BY query")
def _refs(s, d):
    refs = view(s, d, "acts").select(F.col("grounding_ref").alias("query"))
    return contained(view(s, d, "papers"), refs, ["ctx", "id"]).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ctx").alias("n_ctx"))


@query("k02_claims_by_table", f"WITH {_SENTENCES} SELECT doc_id, item_id AS claim, string_agg(query, '|' ORDER BY query) AS matched FROM documents JOIN (SELECT DISTINCT * FROM q) ON contains(lower(text), query) GROUP BY ALL")
def _claims(s, d):
    claims = _sentences(s, d).withColumnRenamed("item_id", "claim")
    found = claims_supported(view(s, d, "documents").select("doc_id", "text"), claims, ["doc_id"])
    return found.select("doc_id", "claim", F.array_join("matched", "|").alias("matched"))


_POISSON = "[" + ", ".join(repr(p) for p in intervals.poisson_steps()) + "]"


@query(
    "a06_metric_intervals",
    f"""WITH m AS (SELECT split_part(thread_id, '#', 1) AS forum, CASE WHEN status = 'ok' THEN 1 ELSE 0 END AS ok, CASE WHEN n_claims > 0 AND status <> 'ok' THEN 1 ELSE 0 END AS h,
    least(n_cited, n_claims) AS cited, n_claims, CASE WHEN intent = gold_intent AND skill = gold_skill THEN 1 ELSE 0 END AS hit, CASE WHEN gold_intent IS NOT NULL THEN 1 ELSE 0 END AS gold FROM moves),
g AS (SELECT forum, unnest(['ok_rate', 'missing_or_fail_rate', 'halluc_missing_rate', 'claim_support_proxy', 'plan_acc']) AS metric,
    unnest([sum(ok), sum(1 - ok), sum(h), sum(cited), sum(hit)]) AS a, unnest([count(*), count(*), count(*), sum(n_claims), sum(gold)]) AS b FROM m GROUP BY forum),
w AS (SELECT forum, r, len(list_filter({_POISSON}, lambda p: p <= ('0x' || substr(md5(forum || ':42:' || (r // 4)), 1 + 8 * (r % 4)::BIGINT, 8))::BIGINT / 4294967296.0)) AS w
    FROM (SELECT DISTINCT forum FROM m), range(1000) t(r)),
d AS (SELECT metric, r, sum(w * a) / nullif(sum(w * b), 0) AS ratio FROM g JOIN w USING (forum) GROUP BY ALL),
i AS (SELECT metric, round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high FROM d GROUP BY metric)
SELECT metric, round(sum(a) / sum(b), 6) AS value, low, high, count(*) AS groups FROM g JOIN i USING (metric) GROUP BY metric, low, high""",
)
def _intervals(s, d):
    moves = view(s, d, "moves").withColumn("n_cited", F.least("n_cited", "n_claims"))
    return intervals.ratio_intervals(moves, F.substring_index("thread_id", "#", 1), intervals.metric_terms())
