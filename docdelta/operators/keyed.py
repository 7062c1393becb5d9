"""Keyed snapshot differences: fonts, metadata, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.operators.catalog import readable_size

#: Names of a document's metadata, by column of its table; the last three are always there. Fixed values.
METADATA = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "created": "Creation Date", "changed": "Modification Date", "page_count": "Page Count", "size": "File Size", "encrypted": "Encrypted"}


def keyed_diff(base: DataFrame, compare: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer join on the key: added, deleted, or modified where any value differs (nulls are equal)."""
    rename = lambda d, s: d.select(*key, *(F.col(v).alias(f"{s}_{v}") for v in values), F.lit(True).alias(f"in_{s}"))
    both = rename(base, "base").join(rename(compare, "compare"), key, "full")
    same = F.struct(*(f"base_{v}" for v in values)).eqNullSafe(F.struct(*(f"compare_{v}" for v in values)))
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_compare").isNull(), "deleted").when(~same, "modified")
    return both.withColumn("change", change).where("change is not null").drop("in_base", "in_compare")


def by_pair(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows of documents (doc_id, ...) as those of the base and of the compare side of each pair (pair_id, ...)."""
    side = lambda s: pairs.select("pair_id", F.col(f"{s}_id").alias("doc_id")).join(rows, "doc_id").drop("doc_id")
    return side("base"), side("compare")


# ---- fonts

FONT = ["font_name", "family", "style", "size", "encoding", "embedded", "usage"]


def font_parts(name: str) -> dict[str, Column]:
    """Family and style, the halves of a name at its hyphen."""
    style = F.when(F.instr(name, "-") > 0, F.regexp_extract(name, "-(.*)$", 1)).otherwise("Regular")
    return {"family": F.regexp_extract(name, "^([^-]*)", 1), "style": style}


def font_usage(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id", "page_no", "font_name").agg(F.count("*").alias("usage"), F.max("font_size").alias("size")).withColumns(font_parts("font_name"))


def font_diff(page_pairs: DataFrame, pairs: DataFrame, fonts: DataFrame) -> DataFrame:
    """Fonts of matched pages, by the name (`font`) that both pages have for them; what is under it may differ in any attribute.

    fonts: doc_id, page_no, font, font_name, family, style, size, encoding, embedded, usage.
    """
    page = ["pair_id", "base_page", "compare_page"]
    matched = page_pairs.where("matched").select(page).join(pairs, "pair_id")
    side = lambda s: matched.join(fonts.withColumnsRenamed({"doc_id": f"{s}_id", "page_no": f"{s}_page"}), [f"{s}_id", f"{s}_page"]).select(*page, "font", *FONT)
    return keyed_diff(side("base"), side("compare"), [*page, "font"], FONT)


def font_severity(d: DataFrame) -> DataFrame:
    """Added and deleted fonts and another family are major, another style is minor, all else cosmetic."""
    other = lambda n: ~F.col(f"base_{n}").eqNullSafe(F.col(f"compare_{n}"))
    sev = F.when(F.col("change") != "modified", "major").when(other("family"), "major").when(other("style"), "minor").otherwise("cosmetic")
    added, deleted = F.concat(F.lit("Font added: "), "compare_font_name"), F.concat(F.lit("Font deleted: "), "base_font_name")
    changed = F.concat(F.lit("Font modified: "), "base_font_name", F.lit(" to "), "compare_font_name")
    return d.withColumn("severity", sev).withColumn("description", F.when(F.col("change") == "added", added).when(F.col("change") == "deleted", deleted).otherwise(changed))


def font_measures(d: DataFrame) -> list[Column]:
    """What changed, and by how much. A name or encoding changes only between two fonts; sizes and counts of a missing one are 0."""
    changed = lambda n: F.coalesce(F.col(f"base_{n}") != F.col(f"compare_{n}"), F.lit(False))
    number = lambda s, n: F.coalesce(F.col(f"{s}_{n}"), F.lit(0))
    gap = lambda n: number("compare", n) - number("base", n)
    percent = lambda n: F.coalesce(F.round(F.try_divide(gap(n) * 100.0, number("base", n)), 6), F.lit(0.0))
    embedded = F.coalesce("base_embedded", F.lit(False)) != F.coalesce("compare_embedded", F.lit(False))
    flags = [changed(n).alias(f"{n}_changed") for n in ("family", "style", "encoding")] + [(gap("size") != 0).alias("size_changed"), embedded.alias("embedding_changed")]
    return [*flags, gap("size").alias("size_change"), percent("size").alias("size_percent"), gap("usage").alias("usage_change"), percent("usage").alias("usage_percent")]


# ---- metadata and styles


def metadata_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, key, value) of up to eleven keys: nulls dropped, but page count, size and encryption are always there.

    docs: the id and the columns of METADATA.
    """
    always = {"page_count": F.coalesce(F.col("page_count"), F.lit(0)).cast("string"), "size": readable_size(F.coalesce(F.col("size"), F.lit(0))), "encrypted": F.coalesce(F.col("encrypted"), F.lit(False)).cast("string")}
    as_text = docs.select(id_col, *(always.get(c, F.col(c).cast("string")).alias(k) for c, k in METADATA.items()))
    return as_text.unpivot([id_col], list(METADATA.values()), "key", "value").where("value is not null")


def style_rows(styles: DataFrame, json: Column) -> DataFrame:
    return styles.select("doc_id", F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))
