"""Operators on the table of differences: inference, display, filters, order, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.operators import text as text_ops
from docdelta.operators import visual

TYPES = ("text", "image", "font", "style")
SEVERITIES = ("cosmetic", "minor", "major")


def infer_type(d: DataFrame) -> Column:
    has = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    return F.coalesce("type", F.when(has("image_name"), "image").when(has("font_name"), "font").when(has("style_name"), "style").otherwise("text"))


def infer_change(d: DataFrame) -> Column:
    b, c = (F.coalesce(F.col(n), F.lit("")) != "" for n in ("base_text", "compare_text"))
    return F.coalesce("change", F.when(b & ~c, "deleted").when(~b & c, "added").when(b & c, "modified"))


def min_bound(side: Column) -> Column:
    return F.when(side.isNull() | (side < 2), F.lit(10.0)).otherwise(side)


def first_of_each(base: DataFrame, compare: DataFrame) -> DataFrame:
    """Union of the base and compare lists, one row for each id, the base's first."""
    both = base.withColumn("side", F.lit(0)).unionByName(compare.withColumn("side", F.lit(1)))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("diff_id").orderBy("side"))).where("rn = 1").drop("rn")


def page_of(d: DataFrame) -> Column:
    return F.coalesce("base_page", "compare_page", F.lit(1))


def ranked(d: DataFrame) -> DataFrame:
    """Place of each difference in its pair's list: by page, y, id."""
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id").orderBy(page_of(d), "y", "diff_id")))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def filtered(d: DataFrame, types: list[str] | None = None, severity: str = "all", search: str = "") -> DataFrame:
    if types:
        d = d.where(F.col("type").isin(types))
    if severity != "all":
        d = d.where(severity_rank(F.col("severity")) >= SEVERITIES.index(severity) + 1)
    if search:
        found = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(search.lower())), F.lit(False)) for c in ("base_text", "compare_text", "description") if c in d.columns]
        d = d.where(F.greatest(*found))
    return d


BUCKETS = (*TYPES, "structure")


def bucket(type_: Column) -> Column:
    return F.when(type_.isin(*TYPES), type_).otherwise("structure")


def group_by_type(pairs: DataFrame, d: DataFrame) -> DataFrame:
    """(pair_id, bucket, n): a row for each bucket of every pair, 0 where it has none."""
    counts = d.groupBy("pair_id").agg(*(F.count_if(bucket(F.col("type")) == b).alias(b) for b in BUCKETS))
    wide = pairs.select("pair_id").join(counts, "pair_id", "left").na.fill(0, list(BUCKETS))
    return wide.unpivot(["pair_id"], list(BUCKETS), "bucket", "n")


def cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def describe(d: DataFrame) -> Column:
    """One line on a difference: its own description, or one by type, change, texts and name (of the image, font or style)."""
    text_of = lambda n: F.coalesce(n, F.lit("")) if n in d.columns else F.lit("")
    b, c, t, name = (text_of(n) for n in ("base_text", "compare_text", "text", "name"))
    quoted = lambda head, what, n=None: F.concat(F.lit(head), cut(what, n) if n else what, F.lit('"'))
    both = F.concat(quoted('Text changed from "', b, 15), quoted(' to "', c, 15))
    text = F.when((b != "") & (c != ""), both).when(c != "", quoted('Text added: "', c, 30)).when(b != "", quoted('Text deleted: "', b, 30)).when(t != "", cut(t, 30)).otherwise("Text difference")
    known = F.col("change").isin("added", "deleted", "modified")
    image = F.when(known, F.concat(F.lit("Image "), F.when(F.col("change") == "modified", "changed").otherwise(F.col("change")))).when(name != "", F.concat(F.lit("Image: "), name)).otherwise("Image content differs")
    font = F.when(name != "", quoted('Font changed to "', name)).when(t != "", quoted('Font difference in "', t, 20)).otherwise("Font difference")
    style = F.when(name != "", F.concat(F.lit("Style element "), F.coalesce("change", F.lit("changed")), F.lit(': "'), name, F.lit('"'))).when(t != "", quoted('Style changed in "', t, 20)).otherwise("Style difference")
    kind = F.col("type")
    made = F.when(kind == "text", text).when(kind == "image", image).when(kind == "font", font).when(kind == "style", style).otherwise("Difference detected")
    return F.when(text_of("description") != "", F.col("description")).otherwise(made) if "description" in d.columns else made


def with_box(d: DataFrame) -> DataFrame:
    """d with the display box x, y, width, height of its type; 0 by 0 where it has no place."""
    box = ("x", "y", "width", "height")
    shown = text_ops.display_box(d.where("type is not null")).withColumnsRenamed({n: f"text_{n}" for n in box})
    own = lambda n: F.when(F.col("type") == "text", F.col(f"text_{n}")).when(F.col("type") == "image", F.col(n)).otherwise(F.lit(0.0))
    return visual.image_box(shown).withColumns({n: own(n) for n in box}).drop(*(f"text_{n}" for n in box))  # one pass over d


def page_differences(d: DataFrame) -> DataFrame:
    """What a page shows of differences of any kind that have a box."""
    return with_box(d).where("width > 0 and height > 0").select("pair_id", "diff_id", page_of(d).alias("page_no"), "type", "x", "y", "width", "height")


def flags(d: DataFrame) -> DataFrame:
    """(diff_id, is_...): each change, severity and type, and whether the box is valid."""
    is_ = lambda c, values: [(F.col(c) == v).alias(f"is_{v}") for v in values]
    box = (F.coalesce("width", F.lit(0.0)) > 0) & (F.coalesce("height", F.lit(0.0)) > 0)
    return with_box(d).select("diff_id", *is_("change", ("added", "deleted", "modified")), *is_("severity", SEVERITIES), *is_("type", (*TYPES, "metadata")), box.alias("box_valid"))


def hit_test(points: DataFrame, d: DataFrame, cell: int = 64) -> DataFrame:
    """First difference (by id) whose box holds each point (point_id, pair_id, page_no, px, py).

    Boxes go to the grid rows they touch, so a dense page isn't tested box by box.
    """
    boxes = d.select("pair_id", F.col("base_page").alias("page_no"), "diff_id", "x", "y", "width", "height").where("page_no is not null")
    boxes = boxes.withColumn("row", F.explode(F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("height")) / cell))))
    inside = (F.col("px") >= F.col("x")) & (F.col("px") <= F.col("x") + F.col("width")) & (F.col("py") >= F.col("y")) & (F.col("py") <= F.col("y") + F.col("height"))
    hits = points.withColumn("row", F.floor(F.col("py") / cell)).join(boxes, ["pair_id", "page_no", "row"]).where(inside)
    return hits.groupBy("point_id").agg(F.min("diff_id").alias("diff_id"))


def to_pixels(d: DataFrame, side: str, image_height: float = 1650.0, zoom: float = 1.0, dpi: float = 150.0) -> DataFrame:
    """Box of one side in pixels from its top left; the other side's box stands in for a base box at 0, 0."""
    f = dpi / 72
    own = lambda n, fixed: F.when(F.coalesce(F.col(f"{side}_{n}"), F.lit(0.0)) != 0, F.col(f"{side}_{n}")).otherwise(fixed)
    other = lambda n, fixed: F.when(F.coalesce(F.col(f"compare_{n}"), F.lit(0.0)) != 0, F.col(f"compare_{n}")).otherwise(fixed)
    gone = (F.coalesce(F.col("base_x"), F.lit(0.0)) == 0) & (F.coalesce(F.col("base_y"), F.lit(0.0)) == 0) & (F.lit(side) == "base")
    x, y, w, h = (F.when(gone, other(n, fixed)).otherwise(own(n, fixed)) for n, fixed in (("x", 0.0), ("y", 0.0), ("width", 50.0), ("height", 20.0)))
    least = lambda v: F.greatest(v * f * zoom, F.lit(5.0))
    return d.select("diff_id", F.round(x * f * zoom, 6).alias("px_x"), F.round((image_height - y * f - h * f) * zoom, 6).alias("px_y"), F.round(least(w), 6).alias("px_width"), F.round(least(h), 6).alias("px_height"))
