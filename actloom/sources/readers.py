"""Readers with explicit schemas for the record files of a dialogue corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.salvage import is_json, trimmed
from .pdf import page_count
from .scratch import files

CALL = "struct<operation:string,tool:string,name:string,target_type:string>"
MINING = f"""forum_id string, forum string, title string, timestamp double,
  analysis struct<mining_results:array<struct<role:string,strategic_intent:string,action:string,grounding_ref:string,
  source_seg_ids:array<string>,latent_tool_calls:array<{CALL}>,cognitive_chain:string>>>"""
ACTS = f"""act_id string, act_index int, issue_id string, forum_id string, title string, timestamp double, role string,
  roles array<string>, intent string, intent_id string, action string, act_text string, grounding_ref string,
  source_seg_ids array<string>, latent_skill_calls array<{CALL}>, meta struct<cognitive_chain:string,role_raw:string>"""
ASSIGNMENTS = "act_id string, issue_id string, intent_id string, forum_id string, cluster_id string, group_id string"
SEGMENTS = "id string, text string"
SPLITS = "forum_id string, forum string, split string, `set` string, partition string"
SNAPSHOTS = "url string, fetched_at long, payload string"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents (.json) or JSON lines (any other suffix); malformed input fails, a missing path raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", path.endswith(".json")).json(path)


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, whole): whether each file below a path is one JSON document, or JSON lines.

    A file is lines if its first line with text is a JSON value of its own; a single line that is an array is a document of
    rows. First lines are told by place, not by order of arrival, and one aggregation reads all files.
    """
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), trimmed(F.col("value")).alias("line")).filter("line <> ''")
    heads = lines.groupBy("file").agg(F.min_by("line", "at").alias("head"), F.count(F.lit(1)).alias("n"))
    return heads.select("file", (~is_json(F.col("head")) | ((F.col("n") == 1) & F.col("head").startswith("["))).alias("whole"))


def sniff_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As :func:`read_records`, each file's layout being told by its own content, so a folder may mix documents (an array
    of rows, or one row) with JSON lines. Files without text have no rows."""
    layouts = file_layouts(spark, path).collect()  # a row a file, as the listing itself
    out = spark.createDataFrame([], schema)
    for whole in (True, False):
        files_ = [r.file for r in layouts if r.whole == whole]
        if files_:
            out = out.unionByName(spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", whole).json(files_))
    return out


def in_file_order(df: DataFrame, name: str = "pos") -> DataFrame:
    """Adds a number that grows with the order of the input's lines inside each file split."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_markdown(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole markdown files: (ctx, text), ctx being the file's name without its suffix."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1)
    return spark.read.text(pattern, wholetext=True).select(F.url_decode(name).alias("ctx"), F.col("value").alias("text"))


def read_context_segments(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON-lines contexts, one file a forum: (ctx, id, text)."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)
    return spark.read.schema(SEGMENTS).json(pattern).select(F.url_decode(name).alias("ctx"), "id", "text")


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Contexts as the writer lays them out, one folder of JSON lines a forum: (ctx, id, text)."""
    rows = spark.read.schema(SEGMENTS + ", forum_id string").option("inferSchema", False).json(path)
    return rows.select(F.col("forum_id").alias("ctx"), "id", "text")


def acts_or_mining(spark: SparkSession, acts_path: str | None, mining_path: str) -> DataFrame:
    """Acts from their file if it is there, else flattened from the mining records; ``first`` grows with the file's order.

    Mined acts of a record without a forum have no id. Gives act_id, forum_id, title, timestamp, role, intent, action,
    source_seg_ids, pos.
    """
    fs, target = files(spark, acts_path or mining_path)
    if acts_path and (fs.exists(target) or fs.globStatus(target)):
        acts = in_file_order(read_records(spark, acts_path, ACTS + ", forum string"))
        forum = F.coalesce(F.nullif("forum_id", F.lit("")), F.nullif("forum", F.lit("")))
        return acts.select("act_id", forum.alias("forum_id"), "title", "timestamp", "role", "intent", "action", F.coalesce("source_seg_ids", F.array().cast("array<string>")).alias("source_seg_ids"), "pos")
    records = in_file_order(read_records(spark, mining_path, MINING))
    forum = F.coalesce(F.nullif("forum_id", F.lit("")), F.nullif("forum", F.lit("")))
    rows = records.select(forum.alias("forum_id"), "title", "timestamp", "pos", F.posexplode("analysis.mining_results").alias("i", "x"))
    return rows.select(
        F.when(F.col("forum_id").isNotNull(), F.format_string("%s#%04d", "forum_id", "i")).alias("act_id"), "forum_id", "title", "timestamp",
        F.col("x.role").alias("role"), F.col("x.strategic_intent").alias("intent"), F.col("x.action").alias("action"), F.coalesce("x.source_seg_ids", F.array().cast("array<string>")).alias("source_seg_ids"), "pos",
    )


#: Intents where no list is given. Fixed values.
INTENTS = ("Request_Evidence", "Clarify", "Respond", "Close_Issue")


def intents(records: DataFrame, pos: str = "pos") -> DataFrame:
    """(intent, first): distinct labels in the order in which they first appear; the fixed ones if there are none."""
    fixed = "(VALUES " + ", ".join(f"('{x}', {i}L)" for i, x in enumerate(INTENTS)) + ") AS t(intent, first)"
    label = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("label", "intent") if c in records.columns])
    found = records.select(label.alias("intent"), pos).filter("intent is not null").groupBy("intent").agg(F.min(pos).alias("first"))
    default = records.sparkSession.sql(f"SELECT * FROM {fixed}")
    none = found.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return found.unionAll(default.crossJoin(none).filter("n = 0").drop("n"))


def demo_folders(spark: SparkSession, root: str) -> DataFrame:
    """(ctx, text, images) of a folder of papers: each one's first markdown file and its number of images."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    folder = lambda depth: F.element_at(F.split("path", "/"), -depth)
    text = listed.option("pathGlobFilter", "*.[mM][dD]").load(root).select(folder(2).alias("ctx"), "path", F.decode("content", "UTF-8").alias("text"))
    first = text.groupBy("ctx").agg(F.min_by("text", "path").alias("text"))
    images = listed.option("pathGlobFilter", "*.{png,jpg,jpeg,svg,webp,PNG,JPG,JPEG}").load(root).filter(folder(2) == "images").select(folder(3).alias("ctx"))
    return first.join(images.groupBy("ctx").agg(F.count(F.lit(1)).alias("images")), "ctx", "left").select("ctx", "text", F.coalesce("images", F.lit(0)).alias("images"))


def resolve_contexts(threads: DataFrame, *candidates: DataFrame) -> DataFrame:
    """Each thread's segments from the first candidate (ctx, segments) that has them; an empty array otherwise."""
    out, names = threads, []
    for i, c in enumerate(candidates):
        names.append(f"__s{i}")
        out = out.join(c.select(F.col("ctx").alias("context_id"), F.col("segments").alias(names[-1])), "context_id", "left")
    empty = F.array().cast("array<struct<id:int,text:string>>")
    return out.withColumn("segments", F.coalesce(*names, empty)).drop(*names)


def segment_counts(segments: DataFrame) -> DataFrame:
    """Segments with an id and a text, by context."""
    return segments.groupBy("ctx").agg(F.count_if(F.col("id").isNotNull() & F.col("text").isNotNull()).alias("n_segments"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(forum_id, split) from rows, or from one object {train, dev, test}."""
    lists = sniff_records(spark, path, "train array<string>, dev array<string>, test array<string>")
    long = None
    for name in ("train", "dev", "test"):
        part = lists.select(F.explode(name).alias("forum_id"), F.lit(name).alias("split"))
        long = part if long is None else long.unionAll(part)
    rows = sniff_records(spark, path, SPLITS)
    split = F.lower(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("split", "`set`", "partition")]))
    named = rows.select(F.coalesce(F.nullif("forum_id", F.lit("")), "forum").alias("forum_id"), split.alias("split"))
    return long.unionAll(named.filter("forum_id is not null and split in ('train', 'dev', 'test')"))


def last_wins(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row a key: the last in order."""
    rest = [c for c in df.columns if c not in (key, pos)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("r")).select(key, "r.*")


def assigned_issues(acts: DataFrame, assignments: DataFrame, pos: str = "pos") -> DataFrame:
    """(act_id, issue_id): the act's own issue, else that of its last assignment (act_id, issue_id)."""
    given = last_wins(assignments.filter("coalesce(issue_id, '') <> ''").select("act_id", F.col("issue_id").alias("__given"), pos), "act_id", pos)
    return acts.join(given, "act_id", "left").select("act_id", F.coalesce(F.nullif("issue_id", F.lit("")), "__given").alias("issue_id"))


def first_wins(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    rest = [c for c in df.columns if c not in (key, pos)]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), pos).alias("r")).select(key, "r.*")


def flatten_mining(records: DataFrame) -> DataFrame:
    """One act for each mined item: id forum#0000, calls renamed, in order; a record without a forum is UNKNOWN."""
    forum = F.coalesce(F.nullif("forum_id", F.lit("")), F.nullif("forum", F.lit("")), F.lit("UNKNOWN"))
    rows = records.select(forum.alias("forum_id"), "title", "timestamp", F.posexplode("analysis.mining_results").alias("act_index", "x"))
    return rows.select(
        F.format_string("%s#%04d", "forum_id", "act_index").alias("act_id"), "act_index", "forum_id", "title", "timestamp",
        F.col("x.role").alias("role_raw"), F.col("x.strategic_intent").alias("intent"), F.col("x.action").alias("action"), F.col("x.grounding_ref").alias("grounding_ref"),
        F.coalesce("x.source_seg_ids", F.array().cast("array<string>")).alias("source_seg_ids"), F.col("x.latent_tool_calls").alias("latent_skill_calls"), F.col("x.cognitive_chain").alias("cognitive_chain"),
    )


def forum_order(acts: DataFrame, pos: str = "pos") -> DataFrame:
    """Forums with the position of their first act, by which they are ordered; numbering is left to whoever
    has cut them to a few, so that no task numbers all forums."""
    return acts.groupBy("forum_id").agg(F.min(pos).alias("first"))


def page_counts(spark: SparkSession, pattern: str) -> DataFrame:
    """(ctx, pages) of PDF files by walking their page trees; unreadable files give 0."""

    @F.pandas_udf("int")
    def pages(content):
        import pandas as pd

        return pd.Series([page_count(c) for c in content], dtype="int32")

    name = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    return spark.read.format("binaryFile").load(pattern).select(name.alias("ctx"), pages("content").alias("pages"))


def read_library(spark: SparkSession, path: str, last_wins: bool = False) -> DataFrame:
    """The artifacts that the index files below a folder list, in the order of file and line; see :func:`..plans.specs.library_index`."""
    from ..plans.specs import INDEX, library_index

    rows = spark.read.schema(INDEX).json(path)
    placed = rows.withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "line": F.monotonically_increasing_id()})
    return library_index(placed, ["file", "block", "line"], last_wins)


def event_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All events.jsonl below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "events.jsonl").json(root)
