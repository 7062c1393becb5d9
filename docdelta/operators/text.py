"""Text differences of matched pages: lines paired by number, edit distance, severity, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.operators import edits

SIMILAR, LONG_LINE = 0.8, 50


def edit_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; null for two empty texts."""
    return F.try_divide(F.greatest(F.length(a), F.length(b)) - edit_distance(a, b), F.greatest(F.length(a), F.length(b)).cast("double"))


def severity(distance: Column, base_length: Column) -> Column:
    return F.when(distance > 0.5 * base_length, "major").when(distance > 0.2 * base_length, "minor").otherwise("cosmetic")


def pair_lines(page_pairs: DataFrame, pairs: DataFrame, lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Line i of the base page with line i of the compare page; either may be missing.

    pages: the same lines, numbered from 1 without gaps, as an array for each page (doc_id, page_no, lines), if there is one; then pages are joined and not lines.
    """
    matched = page_pairs.where("matched").join(pairs, "pair_id")
    if pages is not None:
        for s in ("base", "compare"):
            matched = matched.join(pages.withColumnsRenamed({"doc_id": f"{s}_id", "page_no": f"{s}_page", "lines": f"{s}_lines"}), [f"{s}_id", f"{s}_page"])
        return facing_lines(matched)
    side = lambda s: matched.join(lines.select(F.col("doc_id").alias(f"{s}_id"), F.col("page_no").alias(f"{s}_page"), "line_no", F.col("text").alias(f"{s}_text")), [f"{s}_id", f"{s}_page"]).select("pair_id", "base_page", "compare_page", "line_no", f"{s}_text")
    return side("base").join(side("compare"), ["pair_id", "base_page", "compare_page", "line_no"], "full")


def facing_lines(page_pairs: DataFrame) -> DataFrame:
    """pair_lines of matched pages that come with their lines (base_lines, compare_lines)."""
    both = F.arrays_zip(F.col("base_lines").alias("base_text"), F.col("compare_lines").alias("compare_text"))
    found = page_pairs.where("matched").select("pair_id", "base_page", "compare_page", F.posexplode(both).alias("line_no", "at"))
    return found.select("pair_id", "base_page", "compare_page", (F.col("line_no") + 1).alias("line_no"), "at.base_text", "at.compare_text")


def one_sided(line_pairs: DataFrame) -> DataFrame:
    b, c = F.col("base_text"), F.col("compare_text")
    change = F.when(b.isNull(), "added").when(c.isNull(), "deleted")
    return line_pairs.where(b.isNull() | c.isNull()).withColumn("change", change).withColumn("severity", F.when(F.length(F.coalesce(b, c)) > LONG_LINE, "major").otherwise("minor"))


def modified(line_pairs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    b, c = F.col("base_text"), F.col("compare_text")
    both = line_pairs.where(b.isNotNull() & c.isNotNull()).withColumn("distance", edit_distance(b, c))
    longer = F.greatest(F.length(b), F.length(c))
    close = F.try_divide(longer - F.col("distance"), longer.cast("double"))
    return both.where(close < threshold).withColumn("change", F.lit("modified")).withColumn("severity", severity(F.col("distance"), F.length(b))).drop("distance")


def text_differences(line_pairs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """All text differences in one pass, keyed by a hash of their place: retried tasks give the same ids."""
    b, c = F.col("base_text"), F.col("compare_text")
    one, longer = b.isNull() | c.isNull(), F.greatest(F.length(b), F.length(c))
    # A distance is no less than the lengths' gap: where that alone makes a major change, nothing more is asked.
    gap = F.abs(F.length(b) - F.length(c))
    clear = (severity(gap, F.length(b)) == "major") & (F.try_divide(longer - gap, longer.cast("double")) < threshold)
    short = longer <= edits.MOST
    near = lambda t: F.when(short & ~clear, t)  # noqa: E731  the distances of short lines, which most are, come from a batch at once
    distance = F.when(one, None).when(clear, gap).when(short, F.col("short_distance")).otherwise(F.levenshtein(b, c))
    line_pairs = line_pairs.where(one | (b != c))  # equal lines are no difference under any threshold up to 1
    measured = line_pairs.withColumn("short_distance", edits.distance(near(b), near(c))).withColumn("distance", distance).drop("short_distance")
    close = F.try_divide(longer - F.col("distance"), longer.cast("double"))
    change = F.when(b.isNull(), "added").when(c.isNull(), "deleted").when(close < threshold, "modified")
    grade = F.when(one, F.when(F.length(F.coalesce(b, c)) > LONG_LINE, "major").otherwise("minor")).otherwise(severity(F.col("distance"), F.length(b)))
    found = measured.withColumn("change", change).where("change is not null").withColumn("severity", grade).drop("distance")
    box = lambda s: [F.when(F.col(f"{s}_text").isNotNull(), v.cast("double")).alias(f"{s}_{n}") for n, v in (("x", F.lit(72)), ("y", 792 - 14 * F.col("line_no")), ("width", 6 * F.length(f"{s}_text")), ("height", F.lit(12)))]
    key = F.sha2(F.concat_ws("|", "pair_id", "base_page", "compare_page", F.lit("text"), "line_no"), 256)
    return found.select(key.alias("diff_id"), "*", F.lit("text").alias("type"), *box("base"), *box("compare"))


def display_box(d: DataFrame) -> DataFrame:
    """Mean place and largest extent of both sides; the other side where one is missing."""
    mean = lambda n: F.coalesce((F.col(f"base_{n}") + F.col(f"compare_{n}")) / 2, f"base_{n}", f"compare_{n}")
    most = lambda n: F.greatest(f"base_{n}", f"compare_{n}")
    return d.withColumns({"x": mean("x"), "y": mean("y"), "width": most("width"), "height": most("height")})


def box_or_default(d: DataFrame) -> DataFrame:
    """Display box by change type; 100, 100, 100, 14 where neither side has a place."""
    has = {s: F.coalesce(F.col(f"{s}_x") > 0, F.lit(False)) for s in ("base", "compare")}
    out = {}
    for n, fixed in (("x", 100.0), ("y", 100.0), ("width", 100.0), ("height", 14.0)):
        b, c = F.col(f"base_{n}"), F.col(f"compare_{n}")
        both = (b + c) / 2 if n in "xy" else F.greatest(b, c)
        v = F.when((F.col("change") == "added") & has["compare"], c).when((F.col("change") == "deleted") & has["base"], b)
        v = v.when((F.col("change") == "modified") & has["base"] & has["compare"], both).when((F.col("change") == "modified") & has["base"], b).when((F.col("change") == "modified") & has["compare"], c)
        out[n] = F.when(v > 0, v).otherwise(fixed) if n in ("width", "height") else F.coalesce(v, F.lit(fixed))
    return d.withColumns(out)


def estimated_box(d: DataFrame) -> DataFrame:
    """A box from the text's length alone, the length times 31 standing for the seed."""
    n = F.when(F.col("change") == "added", F.length("compare_text")).when(F.col("change") == "deleted", F.length("base_text")).otherwise(F.greatest(F.length("base_text"), F.length("compare_text")))
    page = F.when(F.col("change") == "added", F.col("compare_page")).otherwise(F.col("base_page"))
    seed = n * 31
    return d.withColumns({"x": (100 + seed % 300).cast("double"), "y": (100 + F.floor(seed / 10) % 500 + (page - 1) * 50).cast("double"), "width": F.least(F.lit(500), F.greatest(F.lit(50), 20 + 7 * n)).cast("double"), "height": F.lit(14.0)})


THRESHOLDS = {"strict": "strict", "low": "strict", "normal": "normal", "relaxed": "relaxed", "high": "relaxed"}


def _judged(line_pairs: DataFrame) -> DataFrame:
    """line_pairs with the edit distance of two lines, which all methods ask for, and the severity."""
    b, c = F.col("base_text"), F.col("compare_text")
    one, length = b.isNull() | c.isNull(), F.length(F.coalesce(b, c))
    measured = line_pairs.withColumn("distance", F.when(~one, edit_distance(b, c)))
    return measured.withColumn("severity", F.when(one, F.when(length > LONG_LINE, "major").otherwise("minor")).otherwise(severity(F.col("distance"), F.length(b))))


def _differs(method: str, threshold: str) -> Column:
    """Whether a line of _judged is a difference by method and threshold."""
    b, c = F.coalesce("base_text", F.lit("")), F.coalesce("compare_text", F.lit(""))
    one, longer = F.col("base_text").isNull() | F.col("compare_text").isNull(), F.greatest(F.length(b), F.length(c))
    bare = lambda t: F.regexp_replace(t, r"\s+", "")
    close = F.try_divide(longer - F.col("distance"), longer.cast("double"))
    differs = {"exact": b != c, "smart": (b != c) & (bare(b) != bare(c)), "fuzzy": one | (close < SIMILAR)}[method]
    if method == "fuzzy" and THRESHOLDS[threshold] == "strict":
        differs = b != c
    differs = F.coalesce(differs, F.lit(False))
    return differs & (F.col("severity") == "major") if THRESHOLDS[threshold] == "relaxed" else differs


def compare_by(line_pairs: DataFrame, method: str = "fuzzy", threshold: str = "normal") -> DataFrame:
    """Differences by method (exact, smart: without white space, fuzzy: similarity) and threshold.

    strict keeps every difference, normal those of the method, relaxed the major ones alone.
    """
    return _judged(line_pairs).where(_differs(method, threshold)).drop("distance")


def count_by_methods(line_pairs: DataFrame) -> DataFrame:
    """(method, threshold, pair_id, n): differences of each pair by every method and threshold that finds any, in one pass."""
    ways = [(m, t) for m in ("exact", "smart", "fuzzy") for t in ("strict", "normal", "relaxed")]
    counts = _judged(line_pairs).groupBy("pair_id").agg(*(F.count_if(_differs(m, t)).alias(f"{m} {t}") for m, t in ways))
    long = counts.unpivot(["pair_id"], [f"{m} {t}" for m, t in ways], "way", "n").where("n > 0")
    part = lambda i: F.element_at(F.split("way", " "), i)
    return long.select(part(1).alias("method"), part(2).alias("threshold"), "pair_id", "n")


def measures(d: DataFrame) -> list[Column]:
    """Lengths, and what changed between the sides: font, font size, colour, place, extent, and by how much.

    d has base_ and compare_ text, x, y, width, height, font, font_size, color. A font or colour changes only between
    two; numbers of a missing side are 0.
    """
    nb, nc = F.coalesce(F.length("base_text"), F.lit(0)), F.coalesce(F.length("compare_text"), F.lit(0))
    gap, number = F.abs(nb - nc), lambda s, n: F.coalesce(F.col(f"{s}_{n}"), F.lit(0.0))
    change = lambda n: number("compare", n) - number("base", n)
    other = lambda n: F.coalesce(F.col(f"base_{n}") != F.col(f"compare_{n}"), F.lit(False))
    return [
        nb.alias("base_length"), nc.alias("compare_length"), F.greatest(nb, nc).alias("max_length"), F.least(nb, nc).alias("min_length"), gap.alias("length_gap"),
        F.round(F.coalesce(F.try_divide(gap.cast("double"), F.greatest(nb, nc)), F.lit(0.0)), 6).alias("gap_ratio"),
        other("font").alias("font_changed"), (change("font_size") != 0).alias("font_size_changed"), other("color").alias("color_changed"),
        ((change("x") != 0) | (change("y") != 0)).alias("position_changed"), ((change("width") != 0) | (change("height") != 0)).alias("extent_changed"),
        change("font_size").alias("font_size_change"), F.round(font_size_change(number("base", "font_size"), number("compare", "font_size")), 6).alias("font_size_percent"),
        *(change(n).alias(f"{n}_change") for n in ("x", "y", "width", "height")),
    ]


def font_size_change(base: Column, compare: Column) -> Column:
    """In percent; 0 where the base is 0."""
    return F.coalesce(F.try_divide((compare - base) * 100, base), F.lit(0.0))


def forced_text(page_pairs: DataFrame, differences: DataFrame, texts: DataFrame, pairs: DataFrame, most: float = 0.98) -> DataFrame:
    """One synthetic row for a matched page pair under `most` without a difference."""
    key = ["pair_id", "base_page", "compare_page"]
    silent = page_pairs.where(F.col("matched") & (F.col("score") < most)).join(differences.select(key).distinct(), key, "left_anti").join(pairs, "pair_id")
    for s in ("base", "compare"):
        silent = silent.join(texts.select(F.col("doc_id").alias(f"{s}_id"), F.col("page_no").alias(f"{s}_page"), F.col("text").alias(f"{s}_text")), [f"{s}_id", f"{s}_page"], "left")
    return silent.select(*key, "base_text", "compare_text", F.lit("modified").alias("change"), F.lit("major").alias("severity"), F.lit(True).alias("synthetic"))


def forced_pair(page_pairs: DataFrame, differences: DataFrame) -> DataFrame:
    """One synthetic row, on the first matched page, for a document pair without any difference."""
    silent = page_pairs.where("matched").join(differences.select("pair_id").distinct(), "pair_id", "left_anti")
    return silent.groupBy("pair_id").agg(F.min("base_page").alias("base_page"), F.min_by("compare_page", "base_page").alias("compare_page")).withColumn("synthetic", F.lit(True))


def line_changes(lines: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Line pairs that differ in text, font, colour or place, with a flag for each. lines: line pairs with their attributes, as in measures."""
    b, c = F.col("base_text"), F.col("compare_text")
    worded = b.isNull() | c.isNull() | F.coalesce(similarity(b, c) < threshold, F.lit(False))
    other = lambda *ns: F.coalesce(~F.struct(*(f"base_{n}" for n in ns)).eqNullSafe(F.struct(*(f"compare_{n}" for n in ns))), F.lit(False))
    flags = {"text_changed": worded, "font_changed": other("font", "font_size"), "color_changed": other("color"), "moved": other("x", "y")}
    return lines.withColumns(flags).where(" or ".join(flags))


def worth_showing(ignore_colors: bool = False, ignore_moves: bool = False, near: float = 20.0) -> Column:
    """Whether a line change is more than what the switches ignore: colour, or a place at most `near` away."""
    hop = F.greatest(F.abs(F.col("base_x") - F.col("compare_x")), F.abs(F.col("base_y") - F.col("compare_y"))) <= near
    colour = F.col("color_changed") & F.lit(not ignore_colors)
    place = F.col("moved") & ~(F.coalesce(hop, F.lit(False)) & F.lit(ignore_moves))
    return F.col("text_changed") | F.col("font_changed") | colour | place


def suppress_cosmetic(d: DataFrame, ignore_colors: bool = False, ignore_moves: bool = False, near: float = 20.0) -> DataFrame:
    """Without changes that are only of what the switches ignore."""
    return d.where(worth_showing(ignore_colors, ignore_moves, near))
