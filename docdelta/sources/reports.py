"""Reports of comparisons as ordered lines: a header, a line for each difference, a footer.

No report is ever one value: its lines are rows (pair_id, section, page, place, line) that sort into the document,
and a pair of any number of differences is written as text parts of bounded size, in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections of a report in their order.
HEAD, METADATA, PAGES, BODY, FOOT = 0, 1, 2, 3, 9
ORDER = ["pair_id", "page", "section", "place"]


def _lines(d: DataFrame, section: int, line: Column, page: Column | None = None, place: Column | None = None) -> DataFrame:
    """Header sections sort before page 0, the footer after the last page."""
    at = page if page is not None else F.lit(2**31 - 1 if section == FOOT else section - 10)
    return d.select("pair_id", at.cast("int").alias("page"), F.lit(section).alias("section"), (place if place is not None else F.lit("")).alias("place"), line.alias("line"))


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _number(line: str) -> Column:
    """A place in text order."""
    return F.lpad(F.col(line).cast("string"), 10, "0")


def json_lines(summaries: DataFrame, differences: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON document for each pair: its summary, and an array of differences, one to a line. Nulls are written."""
    options = {"ignoreNullFields": "false"}
    head = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"differences":['))
    items = differences.select("pair_id", F.coalesce("base_page", "compare_page", F.lit(0)).alias("page"), F.concat_ws("|", _number("line_no"), "diff_id").alias("place"), F.to_json(F.struct(*fields), options).alias("item"))
    first = items.groupBy("pair_id").agg(F.min(F.struct("page", "place")).alias("first"))
    comma = F.when(F.struct("page", "place") == F.col("first"), "").otherwise(",")
    items = items.join(first, "pair_id")
    return _together([
        _lines(summaries.withColumn("head", F.to_json(F.struct(*summaries.columns), options)), HEAD, head),
        _lines(items, BODY, F.concat(comma, "item"), F.col("page"), F.col("place")),
        _lines(summaries, FOOT, F.lit("]}")),
    ])


def escaped(c: Column) -> Column:
    """Text for HTML; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_lines(summaries: DataFrame, page_pairs: DataFrame, differences: DataFrame) -> DataFrame:
    """One page of HTML for each pair: its summary, metadata differences, then page by page whether it is on one side alone, and its differences."""
    text = lambda n: escaped(F.col(n).cast("string"))
    tag = lambda name, *parts: F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))
    facts = [tag("p", F.lit(f"{c}: "), text(c)) for c in summaries.columns]
    meta = differences.where("type = 'metadata'")
    values = tag("p", F.lit("Key: "), text("name"), F.lit(" Base Value: "), text("base_value"), F.lit(" Comparison Value: "), text("compare_value"))
    alone = F.when(F.col("compare_page").isNull(), "Page exists only in base document").when(F.col("base_page").isNull(), "Page exists only in comparison document").otherwise("")
    number = F.coalesce("base_page", "compare_page")
    rows = differences.where("base_page is not null or compare_page is not null")
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", "type", "change", "severity", *(text(c) for c in ("name", "base_text", "compare_text"))), F.lit("</td></tr>"))
    return _together([
        _lines(summaries, HEAD, F.concat(F.lit("<!DOCTYPE html><html><body><h1>Comparison Summary</h1>"), *facts, F.lit("<h2>Detailed Differences</h2>"))),
        _lines(meta, METADATA, values, place=F.col("name")),
        _lines(page_pairs, PAGES, F.concat(tag("h3", F.lit("Page "), number.cast("string")), alone), number),
        _lines(rows, BODY, row, number, F.concat_ws("|", "type", _number("line_no"), "diff_id")),
        _lines(summaries, FOOT, F.lit("</body></html>")),
    ])


def write_reports(lines: DataFrame, path: str, parts: int | None = None, rows_a_file: int = 500_000) -> None:
    """A folder `pair_id=` for each report, whose text parts in order of their names make the document.

    Lines are dealt by ranges of their order, so a very long report is spread over tasks and files, and no task holds more than a sort's pages of it.
    """
    dealt = lines.repartitionByRange(parts, *ORDER) if parts else lines.repartitionByRange(*ORDER)
    dealt.sortWithinPartitions(*ORDER).select("pair_id", "line").write.option("maxRecordsPerFile", rows_a_file).partitionBy("pair_id").text(path)
