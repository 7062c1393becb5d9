"""From positioned elements to lines and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_lines(elements: DataFrame, tolerance: float = 0.8) -> DataFrame:
    """(…, line_no): a line starts where y is further than tolerance * height from the line's first element.

    The fold keeps that element's y and where lines start; a page holds some hundreds of elements.
    """
    item = F.struct((-F.col("y")).alias("down"), "x", "elem_no", "y", "height", "text", "width")
    pages = elements.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(item)).alias("e"))
    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"))

    def step(s, e):
        new = s["anchor"].isNull() | (F.abs(e["y"] - s["anchor"]) > tolerance * e["height"])
        at = s["i"] + 1
        return F.struct(at.alias("i"), F.when(new, e["y"]).otherwise(s["anchor"]).alias("anchor"), F.when(new, F.concat(s["starts"], F.array(at))).otherwise(s["starts"]).alias("starts"))

    starts = pages.select("doc_id", "page_no", "e", F.aggregate("e", start, step)["starts"].alias("s"))
    following = F.concat(F.slice("s", 2, F.size("s")), F.array(F.size("e") + 1))
    lines = F.zip_with("s", following, lambda a, b: F.slice(F.col("e"), a, b - a))
    numbered = starts.select("doc_id", "page_no", F.posexplode(lines).alias("line_no", "line"))
    return numbered.select("doc_id", "page_no", (F.col("line_no") + 1).alias("line_no"), F.inline("line")).select("doc_id", "page_no", "line_no", "elem_no", "text", "x", "y", "width", "height")


def line_boxes(lines: DataFrame) -> DataFrame:
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "elem_no", "text"))), lambda s: s["text"]), " ")
    right, top = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return lines.groupBy("doc_id", "page_no", "line_no").agg(words.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (top - F.min("y")).alias("height"))


def page_text(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Whole text of each page of `pages` (doc_id, page_no); a placeholder where it has no lines."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n")
    texts = lines.groupBy("doc_id", "page_no").agg(joined.alias("text"))
    return pages.join(texts, ["doc_id", "page_no"], "left").withColumn("text", F.coalesce("text", F.format_string("[Page %d text]", "page_no")))
