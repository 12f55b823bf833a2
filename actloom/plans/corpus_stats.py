"""Corpus statistics: per-forum aggregates, splits and the per-split report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered
from .quantiles import quantiles

from ..functions.core import role_of_three, turn_id, year_of
from ..sources.scratch import written


def forum_stats(acts: DataFrame, thread_keys: tuple[str, ...] = ("issue_type",), parts: int | None = None) -> DataFrame:
    """Acts, roles, distinct turns and threads, first timestamp of each forum: an aggregate by turn and by thread, then one by forum.

    Needs forum_id, role, seg_id, issue_id, timestamp, pos; a thread is the issue, else forum::value of the
    first key that is filled. With ``parts`` the acts are dealt by forum over so many partitions first, so that the distinct
    counts need no shuffle of their own and a task's memory is that of its share.
    """
    if parts:
        acts = acts.select("forum_id", "role", "seg_id", "issue_id", "timestamp", "pos", *[k for k in thread_keys if k in acts.columns]).repartition(parts, "forum_id")
    role = role_of_three("role")
    other = [F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.concat_ws("::", "forum_id", k)) for k in thread_keys if k in acts.columns]
    thread = F.coalesce(F.nullif("issue_id", F.lit("")), *other)
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), turn_id(F.col("seg_id")).alias("v")), F.struct(F.lit(1).alias("kind"), thread.alias("v"))))
    rows = acts.filter(F.coalesce("forum_id", F.lit("")) != "").select("forum_id", role.alias("role"), "timestamp", "pos", kinds.alias("k"))
    count = lambda r: F.count_if(F.coalesce(F.col("role") == r, F.lit(False)))
    at = F.when(F.col("timestamp").isNotNull(), F.col("pos"))
    each = rows.groupBy("forum_id", F.col("k.kind").alias("kind"), F.col("k.v").alias("v")).agg(
        F.count(F.lit(1)).alias("n_acts"), count("Reviewer").alias("n_reviewer"), count("Author").alias("n_author"), count("Meta").alias("n_meta"),
        F.min_by("timestamp", at).alias("timestamp"), F.min(at).alias("at"), F.min("pos").alias("first"),
    )
    of_turns = lambda c: F.sum(F.when(F.col("kind") == 0, F.col(c))).alias(c)
    known = lambda kind: F.count_if((F.col("kind") == kind) & F.col("v").isNotNull())
    return each.groupBy("forum_id").agg(
        *[of_turns(c) for c in ("n_acts", "n_reviewer", "n_author", "n_meta")], known(0).alias("n_turns"), known(1).alias("n_threads"),
        F.min_by("timestamp", "at").alias("timestamp"), F.min("first").alias("first"),
    )


def forum_years(stats: DataFrame, meta: DataFrame) -> DataFrame:
    """Stats with year and score change: the metadata's year, else that of the first timestamp."""
    return stats.join(meta, "forum_id", "left").withColumn("year", F.coalesce("year", year_of("timestamp")))


def _ranked(stats: DataFrame, most: int | None) -> DataFrame:
    """The first forums in order; the limit comes before the numbering, so one task numbers ``most`` rows.

    Without a limit they are numbered over range partitions.
    """
    chosen = stats.select("forum_id", "first", *([c for c in ("year",) if c in stats.columns])).orderBy("first", "forum_id")
    if not most:
        return numbered(chosen, [F.col("first"), F.col("forum_id")], "rank")
    chosen = chosen.limit(most)
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy("first", "forum_id")))


def default_splits(stats: DataFrame, train: int = 1600, dev: int = 200, test: int = 200, most: int = 2000) -> DataFrame:
    """(forum_id, split): contiguous runs in order of first appearance."""
    r = F.col("rank")
    split = F.when(r <= train, F.lit("train")).when(r <= train + dev, F.lit("dev")).when(r <= train + dev + test, F.lit("test"))
    return _ranked(stats, most).select("forum_id", split.alias("split")).filter("split is not null")


def temporal_splits(stats: DataFrame, train_years, test_years, train: int = 1600, dev: int = 200, test: int = 200, most: int = 2000) -> DataFrame:
    """(forum_id, split): test by year; train and dev from the train years, or from all others if those are empty."""
    ranked = _ranked(stats, most)
    is_test = F.coalesce(F.col("year").isin(*test_years), F.lit(False))
    in_train = F.coalesce(F.col("year").isin(*train_years), F.lit(False)) & ~is_test
    some = F.max(in_train.cast("int")).over(Window.partitionBy())
    ranked = ranked.withColumn("pool", F.when(is_test, F.lit("test")).when((some == 0) | in_train, F.lit("train")))
    ranked = ranked.filter("pool is not null").withColumn("n", F.row_number().over(Window.partitionBy("pool").orderBy("rank")))
    n = F.col("n")
    split = F.when(F.col("pool") == "test", F.when(n <= test if test else F.lit(True), F.lit("test"))).when(n <= train, F.lit("train")).when(n <= train + dev, F.lit("dev"))
    return ranked.select("forum_id", split.alias("split")).filter("split is not null")


def status_counts(moves: DataFrame) -> DataFrame:
    """Observation statuses of each forum; a move's forum is what stands before # in its thread's id.

    Where rows have a ``type``, only moves count, as a run's log holds other events too.
    """
    if "type" in moves.columns:
        moves = moves.filter("type = 'move'")
    forum = F.when(F.contains("thread_id", F.lit("#")), F.substring_index("thread_id", "#", 1))
    each = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "missing", "fail")]
    return moves.filter("status is not null").groupBy(forum.alias("forum_id")).agg(*each).filter("coalesce(forum_id, '') <> ''")


def _spread(name: str, c: Column, places: int = 6) -> list[Column]:
    return [F.round(F.avg(c), places).alias(f"{name}_mean"), F.count(c).alias(f"{name}_count")]


def _quartiles(rows: DataFrame, by: str, measures: dict[str, Column], places: int = 6) -> DataFrame:
    """(by, <name>_p25, <name>_p75 of each measure): the measures of a group are groups of one rank selection."""
    long = rows.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in measures.items()])).alias("m")).select(by, "m.*")
    found = quantiles(long, [by, "name"], "v", {"p25": 0.25, "p75": 0.75})
    wide = [F.round(F.max(F.when(F.col("name") == n, F.col(p))), places).alias(f"{n}_{p}") for n in measures for p in ("p25", "p75")]
    return found.groupBy(by).agg(*wide)


def split_report(stats: DataFrame, splits: DataFrame, segments: DataFrame | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """One row a split: forums, years, instances, spreads, role shares and, if given, status rates.

    The joined forums are written once, as means and quartiles both read them."""
    rows = splits.join(stats, "forum_id")
    if segments is not None:
        rows = rows.join(segments, "forum_id", "left")
    if statuses is not None:
        rows = rows.join(statuses, "forum_id", "left")
    rows = written(rows, "forums")
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    roles = F.greatest(F.sum(F.col("n_reviewer") + F.col("n_author") + F.col("n_meta")), F.lit(1))
    measures = {"threads": some("n_threads"), "turns": some("n_turns")}
    out = [F.count(F.lit(1)).alias("forums"), F.sum("n_acts").alias("instances")]
    if "year" in rows.columns:
        out += [F.min("year").alias("year_min"), F.max("year").alias("year_max")]
    if "score_change" in rows.columns:
        measures["score"] = F.col("score_change").cast("double")
    if segments is not None:
        measures["segments"] = F.col("n_segments")
    out += [c for n, m in measures.items() for c in _spread(n, m)]
    out += [F.round(F.sum(c) / roles, 6).alias(n) for n, c in (("reviewer_share", "n_reviewer"), ("author_share", "n_author"), ("meta_share", "n_meta"))]
    if statuses is not None:
        total = F.nullif(F.sum(F.col("n_ok") + F.col("n_missing") + F.col("n_fail")), F.lit(0))
        out += [F.round(F.sum(f"n_{s}") / total, 6).alias(f"{s}_rate") for s in ("ok", "missing", "fail")]
    return rows.groupBy("split").agg(*out).join(_quartiles(rows, "split", measures), "split", "left")


def year_range(spec: str | None) -> list[int]:
    """Years of a text such as 2018-2023,2025; parts that are no years are left out."""
    years: list[int] = []
    for part in (p.strip() for p in str(spec or "").split(",")):
        ends = part.split("-", 1)
        if part and all(e.strip().lstrip("+").isdigit() for e in ends):
            years += range(int(ends[0]), int(ends[-1]) + 1)
    return years
