"""Snapshot lookups, citation neighbours and availability checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import canonical_url
from ..operators import external
from ..views import view

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _url(k):
    return F.concat(F.lit("works/W"), k.cast("string"))


def _snapshots(s, d):
    """A payload for each part whose key is no multiple of 3; multiples of 15 are stored as not found."""
    k = F.col("p_partkey")
    doc = F.to_json(F.struct(
        F.struct(_url(k).alias("id")).getField("id").alias("id"), F.col("p_name").alias("display_name"), F.concat(F.lit("https://doi.org/10.1/"), k.cast("string")).alias("doi"), F.col("p_size").alias("publication_year"),
        F.struct(F.col("p_brand").alias("display_name")).alias("host_venue"), F.array(F.struct(F.struct(F.col("p_type").alias("display_name")).alias("author"))).alias("authorships"),
        F.when(k % 2 == 0, F.concat(F.lit("on "), F.col("p_name"))).alias("abstract"), F.create_map(F.lit("deep"), F.array(F.lit(0), F.lit(2)), F.lit("learning"), F.array(F.lit(1))).alias("abstract_inverted_index"),
        F.transform(F.sequence(F.lit(1), F.greatest(F.col("p_size") % 4, F.lit(1))), lambda i: F.concat(F.lit("W"), i)).alias("referenced_works"),
        F.array(F.struct(F.lit("W1").alias("id"), F.col("p_name").alias("display_name"), F.lit(1).alias("cited_by_count")), F.struct(F.lit("W2").alias("id"), F.col("p_name").alias("display_name"), F.lit(2).alias("cited_by_count"))).alias("results"),
    ))
    rows = view(s, d, "part").filter("p_partkey % 3 <> 0 OR p_partkey % 15 = 0")
    return rows.select(external.url_key(_url(k)).alias("url_sha256"), F.when(k % 15 != 0, doc).alias("payload"))


def _found(s, d, *more):
    return external.lookup(view(s, d, "part").select("p_partkey", _url(F.col("p_partkey")).alias("url"), *more), _snapshots(s, d))


_REASON = "CASE WHEN p_partkey % 15 = 0 THEN 'not_found' WHEN p_partkey % 3 = 0 THEN 'cache_miss' END"
_OK = "CASE WHEN p_partkey % 3 <> 0 THEN 'ok' ELSE 'missing' END"


@query("s12_snapshot_lookup", f"SELECT p_partkey, {_REASON} AS reason FROM part")
def _lookup(s, d):
    return _found(s, d).select("p_partkey", "reason")


@query("s13_canonical_url", "SELECT p_partkey, 'works?' || concat_ws('&', CASE WHEN p_size % 2 = 0 THEN 'mailto=me%40x.org' END, 'per_page=5', 'search=' || replace(p_name, ' ', '+')) AS url FROM part")
def _canonical(s, d):
    return view(s, d, "part").select("p_partkey", canonical_url("works", {"search": F.col("p_name"), "per_page": F.lit("5"), "mailto": F.when(F.col("p_size") % 2 == 0, "me@x.org"), "cursor": F.lit("")}).alias("url"))


@query("x01_search", f"SELECT p_partkey, {_OK} AS status, CASE WHEN p_partkey % 3 <> 0 THEN 'W1:' || p_name ELSE '' END AS results FROM part")
def _search(s, d):
    r = external.search_works(_found(s, d), 1)
    return r.select("p_partkey", "status", F.array_join(F.transform("results", lambda w: F.concat(w["id"], F.lit(":"), w["title"])), "|").alias("results"))


@query("x02_metadata", f"SELECT p_partkey, {_OK} AS status, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS year, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS venue, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS authors FROM part")
def _metadata(s, d):
    return external.metadata(_found(s, d)).select("p_partkey", "status", "title", "year", "venue", F.array_join("authors", ",").alias("authors"))


@query("x03_abstract", f"SELECT p_partkey, {_OK} AS status, CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'on ' || p_name ELSE 'deep learning deep' END END AS abstract FROM part")
def _abstract(s, d):
    return external.abstract(_found(s, d)).select("p_partkey", "status", "abstract")


@query("x04_references", f"SELECT p_partkey, {_OK} AS status, CASE WHEN p_partkey % 3 <> 0 THEN array_to_string(list_transform(range(1, least(greatest(p_size % 4, 1), 2) + 1), lambda i: 'W' || i), ',') ELSE '' END AS refs FROM part")
def _references(s, d):
    return external.reference_list(_found(s, d), 2).select("p_partkey", "status", F.array_join("references", ",").alias("refs"))


def _edges(s, d):
    return view(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


_EDGES = "(SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


@query("x05_neighbors", f"SELECT p_partkey AS work, count(src) AS count, CASE WHEN count(src) > 0 THEN 'ok' ELSE 'missing' END AS status, sum(src)::BIGINT AS total FROM part LEFT JOIN {_EDGES} ON dst = p_partkey GROUP BY p_partkey")
def _neighbors(s, d):
    n = external.neighbors(_edges(s, d), view(s, d, "part").select(F.col("p_partkey").alias("work")))
    return n.select("work", F.col("count").cast("long").alias("count"), "status", F.aggregate("neighbors", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("x06_existence", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 15 <> 0 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN p_partkey % 15 = 0 THEN false WHEN p_partkey % 3 <> 0 THEN true END AS \"exists\" FROM part")
def _exists(s, d):
    return external.exists(_found(s, d)).select("p_partkey", "status", "exists")


def _checks(s, d):
    return view(s, d, "pages").select("url", (F.lit(200) + F.col("page_id") % 3 * 150).cast("int").alias("http_status"))


def _requests(s, d):
    return view(s, d, "pages").select((F.col("page_id") % 20).alias("key"), "url")


_AVAILABLE = "SELECT page_id % 20 AS key, '{kind}' AS type, 'ok' AS status, bool_or(u.ok) AS available FROM pages JOIN (SELECT url, bool_or(200 + page_id % 3 * 150 BETWEEN 200 AND 399) AS ok FROM pages GROUP BY url) u USING (url) GROUP BY 1"


@query("x07_code_availability", _AVAILABLE.format(kind="code_availability"))
def _code(s, d):
    return external.availability(_requests(s, d), _checks(s, d))


@query("x08_data_availability", _AVAILABLE.format(kind="data_availability"))
def _data(s, d):
    return external.availability(_requests(s, d), _checks(s, d), "data_availability")


@query("s14_offline_availability", "SELECT page_id % 20 AS key, 'code_availability' AS type, 'ok' AS status, true AS available FROM pages GROUP BY 1")
def _offline(s, d):
    return external.availability(_requests(s, d))


@query("x09_sandbox", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN p_size % 5 <> 0 THEN (p_size * 2 + 1)::VARCHAR END AS stdout FROM part")
def _sandbox(s, d):
    rows = view(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "open(1)").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("*2+1"))).alias("code"))
    return external.run_expressions(rows, "p_partkey", "code").withColumn("stdout", F.when(F.col("status") == "ok", F.col("stdout")))


@query("k13_literature_support", "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 <> 0 THEN 2 ELSE 0 END::BIGINT AS n_works, CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_abstracts, p_partkey % 3 <> 0 AS supported FROM part")
def _support(s, d):
    found = external.search_works(_found(s, d)).withColumnRenamed("p_partkey", "key")
    known = s.createDataFrame([("W1", "text")], "work_id string, abstract string")
    return external.literature_support(found, known).select("key", "n_works", "n_abstracts", "supported")


@query("k14_citation_backbone", f"""SELECT k AS work, count(DISTINCT a.dst) AS reference_count, count(DISTINCT b.src) AS cited_by_count, count(a.dst) + count(b.src) > 0 AS supported
FROM (SELECT p_partkey AS k FROM part) LEFT JOIN {_EDGES} a ON a.src = k LEFT JOIN {_EDGES} b ON b.dst = k GROUP BY k""")
def _backbone(s, d):
    out = external.citation_backbone(_edges(s, d), view(s, d, "part").select(F.col("p_partkey").alias("work")))
    return out.select("work", F.col("reference_count").cast("long").alias("reference_count"), F.col("cited_by_count").cast("long").alias("cited_by_count"), "supported")


@query("k15_existence_batch", "SELECT p_brand AS key, bool_and(p_partkey % 3 <> 0) AS exists_all, count(*) AS n FROM part GROUP BY p_brand")
def _batch(s, d):
    return external.exists_batch(_found(s, d, F.col("p_brand").alias("key")))


@query("k18_smoke_run", "SELECT page_id % 20 AS key, bool_or(u.ok) AS supported FROM pages JOIN (SELECT url, bool_or(200 + page_id % 3 * 150 BETWEEN 200 AND 399) AS ok FROM pages GROUP BY url) u USING (url) GROUP BY 1")
def _smoke(s, d):
    code, data = external.availability(_requests(s, d), _checks(s, d)), external.availability(_requests(s, d), _checks(s, d), "data_availability")
    runs = external.run_expressions(code.select("key", F.lit("1+1").alias("code")), "key", "code")
    return external.smoke_run(code, data, runs).select("key", "supported")
