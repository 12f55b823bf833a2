"""Lookups against snapshot tables instead of live calls.

A snapshot is a row (url_sha256, url, payload JSON). A request's URL is built canonically, hashed and joined;
a request without a snapshot is a cache miss. Payloads are read by JSON path, so no schema is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import canonical_url


def url_key(url) -> Column:
    return F.sha2(url, 256)


def lookup(requests: DataFrame, snapshots: DataFrame, url: str = "url") -> DataFrame:
    """Requests with their payload and reason: null where found, cache_miss, or not_found for a stored 404.

    Snapshots grow with the requests, so they are sorted and merged, not held in a task's memory. Whether there is a payload is
    told before the join: who asks for the reason alone moves no payloads.
    """
    held = snapshots.select(F.col("url_sha256").alias("__k"), F.col("payload"), F.col("payload").isNull().alias("__none"))
    out = requests.join(held.hint("merge"), url_key(F.col(url)) == F.col("__k"), "left")
    reason = F.when(F.col("__k").isNull(), F.lit("cache_miss")).when(F.col("__none"), F.lit("not_found"))
    return out.withColumn("reason", reason).drop("__k", "__none")


def works_url(key, mailto=None) -> Column:
    return F.concat(F.lit("works/"), key) if mailto is None else canonical_url("works/", {"mailto": mailto})


def compact_work(w) -> Column:
    """The few fields of a work that are passed on."""
    return F.struct(*[w[k].alias(name) for k, name in (("id", "id"), ("display_name", "title"), ("doi", "doi"), ("publication_year", "publication_year"), ("cited_by_count", "cited_by_count"), ("type", "type"))])


WORK = "struct<id:string,display_name:string,doi:string,publication_year:int,cited_by_count:int,type:string>"


def search_works(found: DataFrame, per_page: int = 5) -> DataFrame:
    """Search results of each request: at most ``per_page`` compact works."""
    parsed = F.from_json("payload", f"struct<results:array<{WORK}>>")["results"]
    works = F.transform(F.slice(F.coalesce(parsed, F.array().cast(f"array<{WORK}>")), 1, per_page if per_page > 0 else 5), compact_work)
    out = found.withColumn("results", works).withColumn("count", F.size("results"))
    return out.withColumn("status", F.when(F.col("reason").isNull() & (F.col("count") > 0), F.lit("ok")).otherwise(F.lit("missing")))


def metadata(found: DataFrame) -> DataFrame:
    """Title, year, venue and authors of a resolved work."""
    shape = "struct<display_name:string,publication_year:int,host_venue:struct<display_name:string>,authorships:array<struct<author:struct<display_name:string>>>>"
    w = F.from_json("payload", shape)
    out = found.withColumns({"title": w["display_name"], "year": w["publication_year"], "venue": w["host_venue"]["display_name"], "authors": F.transform(w["authorships"], lambda a: a["author"]["display_name"])})
    return out.withColumn("status", F.when(F.col("reason").isNull(), F.lit("ok")).otherwise(F.lit("missing")))


def abstract(found: DataFrame) -> DataFrame:
    """A work's abstract, or the text rebuilt from its inverted index (word to positions)."""
    w = F.from_json("payload", "struct<abstract:string,abstract_inverted_index:map<string,array<int>>>")
    spots = F.flatten(F.transform(F.map_entries(w["abstract_inverted_index"]), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    text = F.coalesce(F.nullif(w["abstract"], F.lit("")), F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " "))
    out = found.withColumn("abstract", text)
    return out.withColumn("status", F.when(F.col("reason").isNull() & (F.coalesce("abstract", F.lit("")) != ""), F.lit("ok")).otherwise(F.lit("missing")))


def reference_list(found: DataFrame, max_refs: int = 200) -> DataFrame:
    refs = F.slice(F.coalesce(F.from_json("payload", "struct<referenced_works:array<string>>")["referenced_works"], F.array().cast("array<string>")), 1, max_refs)
    out = found.withColumn("references", refs).withColumn("reference_count", F.size("references"))
    return out.withColumn("status", F.when(F.col("reason").isNull() & (F.col("reference_count") > 0), F.lit("ok")).otherwise(F.lit("missing")))


def neighbors(edges: DataFrame, keys: DataFrame, direction: str = "cited_by") -> DataFrame:
    """One hop over (src cites dst) edges: what a work cites, or what cites it; works without any are missing."""
    here, there = ("src", "dst") if direction == "references" else ("dst", "src")
    near = edges.groupBy(F.col(here).alias("work")).agg(F.array_sort(F.collect_set(there)).alias("neighbors"))
    out = keys.join(near, "work", "left").withColumn("count", F.greatest(F.size(F.coalesce("neighbors", F.array())), F.lit(0)))
    return out.withColumn("status", F.when(F.col("count") > 0, F.lit("ok")).otherwise(F.lit("missing")))


def exists(found: DataFrame) -> DataFrame:
    """Whether a reference is known: a stored 404 is an answer (ok, false), a cache miss is not."""
    return found.withColumns({
        "status": F.when(F.col("reason") == "cache_miss", F.lit("missing")).otherwise(F.lit("ok")),
        "exists": F.when(F.coalesce(F.col("reason"), F.lit("")) != "cache_miss", F.col("reason").isNull()),
    })


def availability(requests: DataFrame, checks: DataFrame | None = None, kind: str = "code_availability") -> DataFrame:
    """Rows (key, url) to one row a key: available if a url answered (status 200 to 399 in ``checks``), or, without
    checks, if there is any url."""
    if checks is None:
        out = requests.groupBy("key").agg(F.bool_or(F.coalesce("url", F.lit("")) != "").alias("available"))
    else:
        good = checks.select("url", (F.col("http_status").between(200, 399)).alias("ok"))
        out = requests.join(good, "url", "left").groupBy("key").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("available"))
    return out.select("key", F.lit(kind).alias("type"), F.lit("ok").alias("status"), "available")


def literature_support(searches: DataFrame, abstracts: DataFrame, details: DataFrame | None = None, max_results: int | None = None) -> DataFrame:
    """Search results with their abstracts, and metadata if given, by two left joins on the work's id and DOI."""
    results = F.slice("results", 1, max_results) if max_results else F.col("results")
    rows = searches.select("key", "count", F.posexplode_outer(results).alias("rank", "work"))
    rows = rows.join(abstracts.select(F.col("work_id").alias("__w"), "abstract"), F.col("work.id") == F.col("__w"), "left").drop("__w")
    if details is not None:
        rows = rows.join(details.select(F.col("doi").alias("__d"), "title", "year"), F.col("work.doi") == F.col("__d"), "left").drop("__d")
    out = rows.groupBy("key").agg(F.count("work").alias("n_works"), F.count("abstract").alias("n_abstracts"), F.max("count").alias("count"))
    return out.withColumns({"supported": F.col("n_works") > 0, "status": F.when(F.col("n_works") > 0, F.lit("ok")).otherwise(F.lit("missing"))})


def citation_backbone(edges: DataFrame, keys: DataFrame) -> DataFrame:
    refs = neighbors(edges, keys, "references").select("work", F.col("neighbors").alias("references"), F.col("count").alias("reference_count"))
    cited = neighbors(edges, keys, "cited_by").select("work", F.col("neighbors").alias("cited_by"), F.col("count").alias("cited_by_count"))
    out = refs.join(cited, "work")
    some = (F.col("reference_count") > 0) | (F.col("cited_by_count") > 0)
    return out.withColumns({"supported": some, "status": F.when(some, F.lit("ok")).otherwise(F.lit("missing"))})


def exists_batch(found: DataFrame, key: str = "key") -> DataFrame:
    return exists(found).groupBy(key).agg(F.bool_and(F.coalesce("exists", F.lit(False))).alias("exists_all"), F.count(F.lit(1)).alias("n"))


def smoke_run(code: DataFrame, data: DataFrame, runs: DataFrame) -> DataFrame:
    """Availability of code and data with a run's outcome: supported if it ran and either is there."""
    out = code.select("key", F.col("available").alias("code")).join(data.select("key", F.col("available").alias("data")), "key").join(runs.select("key", (F.col("status") == "ok").alias("run_ok")), "key")
    return out.withColumn("supported", F.col("run_ok") & (F.col("code") | F.col("data")))


def run_expressions(df: DataFrame, key: str, code: str) -> DataFrame:
    """Evaluates arithmetic only, by the equation parser: arbitrary commands are not run on a cluster."""
    import ast

    from ..functions.stats import _BINARY, EquationError, parse_equation

    def value(node):
        if isinstance(node, ast.BinOp):
            return _BINARY[type(node.op)][1](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp):
            return -value(node.operand) if isinstance(node.op, ast.USub) else value(node.operand)
        if isinstance(node, ast.Constant):
            return node.value
        raise EquationError("unsupported_expression")

    @F.pandas_udf("status string, stdout string")
    def run(text):
        import pandas as pd

        rows = []
        for t in text:
            try:
                rows.append(("ok", str(value(parse_equation(t, "python")))))
            except (EquationError, ArithmeticError) as e:
                rows.append(("missing", str(e)[:200]))
        return pd.DataFrame(rows, columns=["status", "stdout"])

    return df.select(key, run(code).alias("r")).select(key, "r.status", "r.stdout")
