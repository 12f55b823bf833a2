"""Corpus statistics, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cluster
from ..plans import corpus_stats, grounding, retrieval, specs
from ..sources import readers
from ..views import parts, view

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_CLASS = "CASE WHEN contains(l, 'meta') OR contains(l, 'area chair') OR l = 'ac' THEN 'Meta' WHEN contains(l, 'author') OR contains(l, 'rebuttal') THEN 'Author' WHEN contains(l, 'reviewer') OR l = 'review' THEN 'Reviewer' WHEN contains(l, 'chair') OR contains(l, 'editor') THEN 'Meta' END"
STATS = f"""(SELECT forum_id, count(*) AS n_acts, count(*) FILTER (WHERE c = 'Reviewer') AS n_reviewer, count(*) FILTER (WHERE c = 'Author') AS n_author, count(*) FILTER (WHERE c = 'Meta') AS n_meta,
  count(DISTINCT regexp_replace(seg_id, '^(.+)_[0-9]+$', '\\1')) AS n_turns, count(DISTINCT issue_id) AS n_threads, arg_min(timestamp, pos) AS timestamp, min(pos) AS first
  FROM (SELECT *, {_CLASS} AS c FROM (SELECT *, lower(trim(role)) AS l FROM acts)) GROUP BY forum_id)"""
_YEAR = "year(make_timestamp(((CASE WHEN timestamp > 1e12 THEN timestamp / 1000 ELSE timestamp END) * 1000000)::BIGINT))::INTEGER"
YEARS = f"(SELECT s.*, coalesce(m.year::INTEGER, {_YEAR}) AS year, m.score_change FROM {STATS} s LEFT JOIN meta m USING (forum_id))"
_RANKED = f"(SELECT *, row_number() OVER (ORDER BY first, forum_id) AS rank FROM {YEARS})"
DEFAULT = f"(SELECT forum_id, CASE WHEN rank <= 160 THEN 'train' WHEN rank <= 180 THEN 'dev' ELSE 'test' END AS split FROM {_RANKED} WHERE rank <= 200)"


def _stats(s, d):
    return corpus_stats.forum_stats(view(s, d, "acts"), (), parts(s, d, "lineitem", 1 << 20))  # acts are wider than lines


def _years(s, d):
    return corpus_stats.forum_years(_stats(s, d), view(s, d, "meta"))


def _splits(s, d):
    return corpus_stats.default_splits(_years(s, d), 160, 20, 20, 200)


@query("a01_forum_stats", f"SELECT forum_id, n_acts, n_reviewer, n_author, n_meta, n_turns, n_threads, timestamp FROM {STATS}")
def _a01(s, d):
    return _stats(s, d).drop("first")


@query("j02_forum_years", f"SELECT forum_id, year, score_change FROM {YEARS}")
def _j02(s, d):
    return _years(s, d).select("forum_id", "year", "score_change")


def _spread(n, c):
    return f"round(avg({c}), 6) AS {n}_mean, round(quantile_cont({c}, 0.25), 6) AS {n}_p25, round(quantile_cont({c}, 0.75), 6) AS {n}_p75, count({c}) AS {n}_count"


REPORT = f"""
SELECT split, count(*) AS forums, sum(n_acts)::BIGINT AS instances, {_spread('threads', 'CASE WHEN n_threads > 0 THEN n_threads END')}, {_spread('turns', 'CASE WHEN n_turns > 0 THEN n_turns END')},
  min(year) AS year_min, max(year) AS year_max, {_spread('score', 'score_change::DOUBLE')}, {_spread('segments', 'n_segments')},
  round(sum(n_reviewer) / greatest(sum(n_reviewer + n_author + n_meta), 1), 6) AS reviewer_share, round(sum(n_author) / greatest(sum(n_reviewer + n_author + n_meta), 1), 6) AS author_share, round(sum(n_meta) / greatest(sum(n_reviewer + n_author + n_meta), 1), 6) AS meta_share
FROM {{splits}} x JOIN {YEARS} USING (forum_id) LEFT JOIN (SELECT ctx::VARCHAR AS forum_id, count(*) AS n_segments FROM papers WHERE id <> 2 GROUP BY 1) USING (forum_id) GROUP BY split"""


def _report(s, d, splits):
    segments = view(s, d, "papers").filter("id <> 2").groupBy(F.col("ctx").cast("string").alias("forum_id")).agg(F.count(F.lit(1)).alias("n_segments"))
    return corpus_stats.split_report(_years(s, d), splits, segments)


@query("a03_split_report", REPORT.format(splits=DEFAULT))
def split_report(s, d):
    return _report(s, d, _splits(s, d))


TEMPORAL = f"""(SELECT forum_id, CASE WHEN pool = 'test' THEN 'test' WHEN n <= 100 THEN 'train' ELSE 'dev' END AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY rank) AS n FROM (SELECT *, CASE WHEN year BETWEEN 2020 AND 2024 THEN 'test' WHEN year BETWEEN 2014 AND 2019 OR year = 1995 THEN 'train' END AS pool FROM {_RANKED} WHERE rank <= 300) WHERE pool IS NOT NULL)
  WHERE (pool = 'test' AND n <= 50) OR (pool = 'train' AND n <= 130))"""


@query("a03_temporal_report", REPORT.format(splits=TEMPORAL))
def _temporal(s, d):
    splits = corpus_stats.temporal_splits(_years(s, d), corpus_stats.year_range("2014-2019,1995"), corpus_stats.year_range("2020-2024"), 100, 30, 50, 300)
    return _report(s, d, splits)


@query("j04_default_splits", f"SELECT * FROM {DEFAULT}")
def _j04(s, d):
    return _splits(s, d)


@query("a05_status_counts", "SELECT split_part(thread_id, '#', 1) AS forum_id, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) FILTER (WHERE status = 'fail') AS n_fail FROM moves GROUP BY 1")
def _a05(s, d):
    return corpus_stats.status_counts(view(s, d, "moves"))


@query("j01_issue_assignment", """
WITH g AS (SELECT act_id, arg_max(issue_id, n) AS issue_id FROM (SELECT act_id, 'first' AS issue_id, 0 AS n FROM acts WHERE act_index % 2 = 1 UNION ALL SELECT act_id, 'given_' || act_index, 1 FROM acts WHERE act_index % 4 = 1) GROUP BY act_id)
SELECT a.act_id, coalesce(a.issue_id, g.issue_id) AS issue_id FROM acts a LEFT JOIN g USING (act_id)""")
def _j01(s, d):
    """An act without an issue takes that of its own assignment, the last one given."""
    a = view(s, d, "acts")
    given = a.filter("act_index % 2 = 1").select("act_id", F.lit("first").alias("issue_id"), F.lit(0).alias("pos")).unionAll(a.filter("act_index % 4 = 1").select("act_id", F.concat(F.lit("given_"), F.col("act_index").cast("string")), F.lit(1)))
    return readers.assigned_issues(a.select("act_id", "issue_id"), given)


@query("j07_missing_expected", "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _j07(s, d):
    sold = view(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return view(s, d, "part").select("p_partkey", "p_brand").join(sold, "p_partkey", "left_anti")


@query("j09_queries_in_segments", """SELECT q, count(*) AS n, count(DISTINCT ctx) AS n_ctx FROM papers JOIN (SELECT unnest(['net3', 'corpus', 'alpha']) AS q) ON contains(lower(text), q) GROUP BY q""")
def _j09(s, d):
    wanted = ["net3", "corpus", "alpha"]
    hits = F.filter(F.array(*[F.lit(q) for q in wanted]), lambda q: F.contains(F.lower("text"), q))
    return view(s, d, "papers").select("ctx", F.explode(hits).alias("q")).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ctx").alias("n_ctx"))


@query("w05_running_budget", "SELECT ctx, id, left(text, (100 - used)::BIGINT) AS text FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY ctx ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM papers) WHERE used < 100")
def _w05(s, d):
    used = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("ctx").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = view(s, d, "papers").withColumn("used", used).filter("used < 100")
    return rows.select("ctx", "id", F.expr("left(text, cast(100 - used AS int))").alias("text"))


@query("w06_last_labels", "SELECT act_id, count(*) OVER (PARTITION BY forum_id ORDER BY act_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n_recent FROM acts")
def _w06(s, d):
    w = Window.partitionBy("forum_id").orderBy("act_index").rowsBetween(-3, -1)
    return view(s, d, "acts").select("act_id", F.count(F.lit(1)).over(w).alias("n_recent"))


@query("w06_label_memory", "SELECT forum_id, act_id, arg_min(act_id, act_index) OVER (PARTITION BY forum_id, issue_id) AS taken, act_index > min(act_index) OVER (PARTITION BY forum_id, issue_id) AS reused FROM acts WHERE issue_id IS NOT NULL")
def _w06_memory(s, d):
    """A forum has fewer issues than the memory of 50, so a label takes its first act."""
    return cluster.label_memory(view(s, d, "acts").filter("issue_id is not null"), "forum_id", "act_index", "act_id", "issue_id")


@query("a08_test_totals", "SELECT count(*) FILTER (WHERE status = 'ok') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'missing') AS timed_out, count(*) AS total FROM moves")
def _a08(s, d):
    named = F.when(F.col("status") == "ok", "pass").when(F.col("status") == "missing", "timeout").otherwise(F.col("status"))
    return specs.test_totals(view(s, d, "moves").select(named.alias("status")))


@query("p22_intents", "SELECT intent, min(event_id) AS first FROM moves GROUP BY intent")
def _p22(s, d):
    return readers.intents(view(s, d, "moves").select("intent", F.col("event_id").alias("pos")))


@query("set_union_prov", "SELECT ctx, array_to_string(list_sort(list_distinct(list(id))), ',') AS prov FROM (SELECT ctx, id FROM papers WHERE contains(text, 'Net') UNION ALL SELECT ctx, id FROM papers WHERE contains(text, 'Baseline')) GROUP BY ctx")
def _union(s, d):
    """The union of two sets of a table's rows is the rows that are in either, in one pass."""
    either = F.contains("text", F.lit("Net")) | F.contains("text", F.lit("Baseline"))
    return view(s, d, "papers").filter(either).groupBy("ctx").agg(F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("prov"))


@query("r01_reground", None)
def _reground(s, d):
    return grounding.reground(view(s, d, "acts"), view(s, d, "papers")).select("act_id", "skill", "status", F.array_join(F.col("prov").cast("array<string>"), ",").alias("prov"), "observation_id")


from .acts import ROUTED  # noqa: E402

_NUMBERED = " ".join(f"WHEN skill = '{n}' THEN regexp_matches(text, '\\b(?:{w})\\s*{a}' || value || '{b}\\b', 'i')" for n, w, a, b in (("Extract_Table", r"Table|Tab\.?", "", ""), ("Extract_Figure_Caption", r"Figure|Fig\.?", "", ""), ("Extract_Equation", r"Eq\.?,?|Equation", r"\(?", r"\)?"), ("Extract_Algorithm", r"Algorithm|Alg\.?", "", "")))
ORACLES["r01_reground"] = f"""
WITH c AS (SELECT act_id, forum_id, call.skill AS skill, call.value AS value FROM ({ROUTED})),
h AS (SELECT DISTINCT act_id, id FROM c JOIN (SELECT ctx::VARCHAR AS forum_id, id, text FROM papers) USING (forum_id) WHERE CASE {_NUMBERED} ELSE contains(lower(text), lower(value)) END),
g AS (SELECT act_id, list_slice(list(id ORDER BY id), 1, 5) AS prov FROM h GROUP BY act_id)
SELECT c.act_id, skill, CASE WHEN prov IS NULL THEN 'missing' ELSE 'ok' END AS status, coalesce(array_to_string(prov, ','), '') AS prov,
  'O' || left(sha256('{{"prov": [' || coalesce(array_to_string(prov, ', '), '') || '], "type": "text"}}'), 12) AS observation_id FROM c LEFT JOIN g USING (act_id)"""


@query("d01_appendix_cutoff", "SELECT ctx, id FROM (SELECT *, min(CASE WHEN regexp_matches(text, '^(Appendix|Supplementary|Limitations)') THEN id END) OVER (PARTITION BY ctx) AS cut FROM papers) WHERE cut IS NULL OR id < cut")
def _appendix(s, d):
    return retrieval.before_appendix(view(s, d, "papers"), r"^(Appendix|Supplementary|Limitations)").select("ctx", "id")


@query("d02_bm25", """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM docs),
q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), qt AS (SELECT item_id, unnest(w) AS t FROM q),
tf AS (SELECT doc_id, t, len, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t, len(w) AS len FROM docs) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 5) AS score FROM qt JOIN tf USING (t) JOIN df USING (t) CROSS JOIN n GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 3""")
def _bm25(s, d):
    return retrieval.bm25(view(s, d, "documents").select("doc_id", "text"), view(s, d, "benchmark"), top=3)


@query("d03_severity", "SELECT forum_id, CASE ntile(3) OVER (ORDER BY score_change, forum_id) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity FROM meta")
def _severity(s, d):
    return retrieval.severity(view(s, d, "meta")).select("forum_id", "severity")


@query("d04_change_after_evidence", "SELECT count(DISTINCT thread_id) FILTER (WHERE hit) AS changed, count(DISTINCT thread_id) AS threads FROM (SELECT thread_id, action_type = 'request' AND max(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 1 AS hit FROM moves)")
def _after(s, d):
    return retrieval.change_after(view(s, d, "moves"), "thread_id", "event_id", F.col("action_type") == "request", F.col("status") == "ok")


#: The library's operators: name, kind, number of operators it needs. Fixed values.
LIBRARY = (
    ("Check_Ablation_Coverage", "skill", 1), ("Check_Baseline_Coverage", "skill", 1), ("Check_Citation_Support", "skill", 1),
    ("Check_Experimental_Setup", "skill", 5), ("Check_Reproducibility_Checklist", "skill", 4), ("Check_Result_Consistency", "skill", 1),
    ("Extract_Ablation_Info", "primitive", 0), ("Extract_Algorithm", "primitive", 0), ("Extract_Baseline_List", "primitive", 0),
    ("Extract_Code_Data_Links", "primitive", 0), ("Extract_Compute_Resources", "primitive", 0), ("Extract_Dataset_Info", "primitive", 0),
    ("Extract_Definition", "primitive", 0), ("Extract_Equation", "primitive", 0), ("Extract_Figure_Caption", "primitive", 0),
    ("Extract_Hyperparameters", "primitive", 0), ("Extract_Limitations", "primitive", 0), ("Extract_List_Items", "primitive", 0),
    ("Extract_Metric_Values", "primitive", 0), ("Extract_Notation_Definition", "primitive", 0), ("Extract_Section", "primitive", 0),
    ("Extract_Span", "primitive", 0), ("Extract_Split_Info", "primitive", 0), ("Extract_Subsection", "primitive", 0),
    ("Extract_Table", "primitive", 0), ("Extract_Training_Details", "primitive", 0), ("Resolve_Citation", "primitive", 0),
    ("Summarize_Method_Evidence", "skill", 2), ("Summarize_Results_Evidence", "skill", 1), ("Verify_Claim_With_Evidence", "skill", 1),
    ("Verify_Definition", "skill", 1), ("Verify_Equation_Assumption", "skill", 2),
)


@query("s08_library", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', {x})" for n, k, x in LIBRARY) + ") AS t(name, kind, n_needs)")
def _library(s, d):
    """The registry as a table; each needed operator is one of its rows."""
    entries = specs.library().entries
    rows = [(name, kind, list(needs)) for name, (kind, _, needs) in entries.items()]
    table = s.createDataFrame(rows, "name string, kind string, needs array<string>")
    known = F.array(*[F.lit(n) for n in entries])
    return table.select("name", "kind", F.size(F.array_intersect("needs", known)).alias("n_needs"))
