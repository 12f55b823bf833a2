"""Markdown to segments, as window expressions over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def segment(docs: DataFrame, ctx: str = "ctx", text: str = "text", max_chars: int = 900) -> DataFrame:
    """(ctx, id, text, section): headings stand alone and name the section, blank lines end a chunk, long
    chunks are sliced; ids are dense from 1 in each document."""
    lines = docs.select(F.col(ctx).alias("ctx"), F.posexplode(F.split(text, LINE_BREAK)).alias("n", "line"))
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    heading = F.nullif(F.regexp_extract(trimmed, r"^#{1,6}\s+(.*)$", 1), F.lit(""))
    lines = lines.withColumns({"heading": heading, "blank": trimmed == ""})
    upto = Window.partitionBy("ctx").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.col("blank") | F.col("heading").isNotNull()
    lines = lines.withColumns({
        "section": F.last("heading", ignorenulls=True).over(upto),
        "chunk": F.sum(edge.cast("int")).over(upto) * 2 + F.col("heading").isNull().cast("int"),
    }).filter(~F.col("blank"))
    chunks = lines.groupBy("ctx", "chunk").agg(
        F.first("section").alias("section"), F.first("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    whole = F.coalesce("heading", F.regexp_replace("body", r"^\s+|\s+$", ""))
    pieces = F.when(F.col("heading").isNotNull() | (F.length(whole) <= max_chars) | F.lit(max_chars <= 0), F.array(whole)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / max(1, max_chars)).cast("int")), lambda i: F.substring(whole, i * max_chars + 1, F.lit(max_chars)))
    )
    rows = chunks.select("ctx", "chunk", "section", F.posexplode(pieces).alias("part", "text"))
    return rows.select("ctx", F.row_number().over(Window.partitionBy("ctx").orderBy("chunk", "part")).alias("id"), "text", "section")


def blocks(docs: DataFrame, ctx: str = "ctx", text: str = "text") -> DataFrame:
    """(ctx, id C1.., type, text): blocks between blank lines; headings, figures or paragraphs, blanks collapsed."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    rows = docs.select(F.col(ctx).alias("ctx"), F.posexplode(parts).alias("n", "b"))
    kind = F.when(F.col("b").startswith("!["), F.lit("figure")).when(F.col("b").startswith("#"), F.lit("heading")).otherwise(F.lit("paragraph"))
    return rows.select("ctx", F.concat(F.lit("C"), F.col("n") + 1).alias("id"), kind.alias("type"), F.regexp_replace("b", r"\s+", " ").alias("text"))
