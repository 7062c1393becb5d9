"""One lazy plan for a comparison of five kinds: options choose the branches, a strategy matches the pages.

Every kind gives rows of one table of differences. A kind that is switched off is never planned: its
function isn't called, so its tables aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.functions.lineage import stored
from docdelta.operators import keyed, layout, strategies, summaries, text, visual

if TYPE_CHECKING:
    from docdelta.sources.fixtures import Entities

PAGE = ["pair_id", "base_page", "compare_page"]
BOX = ("x", "y", "width", "height")
#: The table of differences; a column is null where a kind has nothing to say.
SCHEMA = {
    "pair_id": "bigint", "diff_id": "string", "type": "string", "change": "string", "severity": "string", "base_page": "int", "compare_page": "int", "line_no": "int", "name": "string",
    "base_text": "string", "compare_text": "string", "base_value": "string", "compare_value": "string", "description": "string", "synthetic": "boolean", **{f"{s}_{n}": "double" for s in ("base", "compare") for n in BOX},
}
#: Where a picture stands on its page, and how many points a pixel takes.
AT, POINTS = (72.0, 600.0), 6.0


@dataclass(frozen=True)
class Options:
    """What to compare and how.

    threshold: strict (every changed line), normal (lines less than 0.8 alike) or relaxed (major ones alone).
    smart: pages matched by content, with nearby and distant candidates; else by equal numbers. force: a synthetic row for
    pages and pairs that differ without a difference found. stride: of visual scores.
    """

    text: bool = True
    images: bool = True
    fonts: bool = True
    metadata: bool = True
    styles: bool = True
    threshold: str = "normal"
    smart: bool = False
    force: bool = False
    stride: int = 1


def _key(kind: str, ordinal: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.col(c) for c in PAGE), F.lit(kind), ordinal), 256)


def _rows(d: DataFrame, kind: str, ordinal: str | Column) -> DataFrame:
    """d as rows of SCHEMA."""
    d = d.withColumns({c: F.lit(None).cast("int") for c in PAGE if c not in d.columns})
    d = d.withColumn("type", F.lit(kind)).withColumn("diff_id", _key(kind, ordinal))
    return d.select(*((F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in SCHEMA.items()))


# ---- kinds


def text_kind(e: Entities, page_pairs: DataFrame, options: Options) -> DataFrame:
    lines = text.facing_lines(page_pairs) if "base_lines" in page_pairs.columns else text.pair_lines(page_pairs, e.pairs, e.page_lines, e.pages)
    found = text.text_differences(lines, 1.0 if text.THRESHOLDS[options.threshold] == "strict" else text.SIMILAR)
    return _rows(found.where("severity = 'major'") if text.THRESHOLDS[options.threshold] == "relaxed" else found, "text", "line_no")


def image_kind(e: Entities, page_pairs: DataFrame, options: Options) -> DataFrame:
    """Pictures of matched pages, each page's as the images of one pair. Two pictures are compared once, on however many pages they face each other."""
    both = ["base_image", "compare_image"]
    pages = page_pairs.where("matched").select(PAGE)
    shown = {s: e.side_px(s) for s in ("base", "compare")}
    for s in shown:
        pages = pages.join(shown[s].pages.withColumnsRenamed({"page_no": f"{s}_page", "image_id": f"{s}_image"}), ["pair_id", f"{s}_page"], "left")
    faced = stored(pages.select(both).distinct().where(F.coalesce(*both).isNotNull()).withColumn("key", F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in both))), "faced")

    def side(s: str) -> visual.Shown:
        here = faced.where(F.col(f"{s}_image").isNotNull())
        return visual.Shown(here.select(F.col("key").alias("pair_id"), F.lit(1).alias("page_no"), F.col(f"{s}_image").alias("image_id")), shown[s].pictures)

    found = stored(visual.image_differences(side("base"), side("compare"), stride=options.stride).select(F.col("pair_id").alias("key"), "change", "severity").join(faced, "key"), "facing")
    same = [pages[c].eqNullSafe(found[c]) for c in both]
    here = {f"{s}_{n}": F.when(F.col("change") != gone, v) for s, gone in (("base", "added"), ("compare", "deleted")) for n, v in zip(BOX, (*map(F.lit, AT), F.lit(16 * POINTS), F.lit(16 * POINTS)), strict=True)}
    return _rows(pages.join(found, same[0] & same[1]).drop(*both).withColumn("name", F.lit("image 1")).withColumns(here), "image", F.concat("change", F.lit(" 1")))


def font_kind(e: Entities, page_pairs: DataFrame, options: Options) -> DataFrame:
    found = keyed.font_severity(keyed.font_diff(page_pairs, e.pairs, e.doc_fonts))
    return _rows(found.withColumnsRenamed({"base_font_name": "base_value", "compare_font_name": "compare_value"}).withColumn("name", F.coalesce("compare_value", "base_value")), "font", "font")


def metadata_kind(e: Entities, page_pairs: DataFrame, options: Options) -> DataFrame:
    found = keyed.keyed_diff(*keyed.by_pair(e.pairs, keyed.metadata_rows(e.doc_info)), ["pair_id", "key"], ["value"])
    return _rows(found.withColumn("name", F.col("key")).withColumn("severity", F.lit("minor")), "metadata", "key")


def style_kind(e: Entities, page_pairs: DataFrame, options: Options) -> DataFrame:
    found = keyed.keyed_diff(*keyed.by_pair(e.pairs, e.doc_styles), ["pair_id", "key"], ["value"])
    return _rows(found.withColumn("name", F.col("key")).withColumn("severity", F.lit("cosmetic")), "style", "key")


KINDS = {"text": text_kind, "images": image_kind, "fonts": font_kind, "metadata": metadata_kind, "styles": style_kind}


# ---- the comparison


def page_pairs(e: Entities, options: Options) -> DataFrame:
    """Page pairs of every document pair; those of equal numbers come with their lines."""
    if not options.smart:
        return e.facing_pages
    return strategies.match_documents(e.side_pages("base"), e.side_pages("compare"), strategies.Lines(e.pairs, e.page_lines)).drop("strategy", "confidence")


def _kind(e: Entities, kind: str, matched: DataFrame, options: Options, kept: dict | None) -> DataFrame:
    """Rows of a kind, which stay in `kept` for options that ask the same of it."""
    if kept is None:
        return KINDS[kind](e, matched, options)
    if kind == "text" and text.THRESHOLDS[options.threshold] == "relaxed":
        return _kind(e, kind, matched, replace(options, threshold="normal"), kept).where("severity = 'major'")
    asked = (kind, options.smart, {"text": text.THRESHOLDS[options.threshold], "images": options.stride}.get(kind))
    if asked not in kept:
        kept[asked] = stored(KINDS[kind](e, matched, options), kind)
    return kept[asked]


def differences(e: Entities, options: Options = Options(), matched: DataFrame | None = None, kept: dict | None = None) -> DataFrame:
    """Differences of the kinds that are on, as rows of SCHEMA. kept: for several options over the same pages, what they share."""
    matched = page_pairs(e, options) if matched is None else matched
    found = None
    for kind in KINDS:
        if getattr(options, kind):
            d = _kind(e, kind, matched, options, kept)
            found = d if found is None else found.unionByName(d)
    if found is None:
        found = e.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in SCHEMA.items()))
    return found.unionByName(forced(e, matched, found)) if options.force else found


def forced(e: Entities, matched: DataFrame, found: DataFrame) -> DataFrame:
    """Synthetic rows: of matched pages that are unlike without a difference, and of pairs without any."""
    every = e.doc_pages.select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_no"))
    pages = text.forced_text(matched, found, layout.page_text(e.page_lines, every), e.pairs)
    silent = text.forced_pair(matched, found.select("pair_id").unionByName(pages.select("pair_id"))).withColumns({"change": F.lit("modified"), "severity": F.lit("minor")})
    return _rows(pages, "text", F.lit("page")).unionByName(_rows(silent, "text", F.lit("pair")))


def compare(e: Entities, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(differences, summaries) of every pair."""
    matched = page_pairs(e, options)
    found = differences(e, options, matched)
    return found, summaries.summary(e.pairs, matched, found)
