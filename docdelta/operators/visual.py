"""Visual comparison of pixel tables (key columns, x, y, lum): sampled agreement, structural similarity, images."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.functions.lineage import stored

C1, C2, WINDOW = 6.5025, 58.5225, 8


@dataclass(frozen=True)
class Shown:
    """Pages that show pictures, in place of a table of their pixels: what two pictures are to each other is found once, on however many pages they stand.

    pages: pair_id, page_no, image_id; pictures: image_id, x, y, lum.
    """

    pages: DataFrame
    pictures: DataFrame


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(76 * r + 150 * g + 29 * b, 8)


def colour_distance(px: DataFrame) -> Column:
    """Sum of three channels' distances: of r1, g1, b1 and r2, g2, b2 where there are any, else of one grey channel."""
    if "r1" in px.columns:
        return sum((F.abs(F.col(f"{c}1") - F.col(f"{c}2")) for c in "rgb"), F.lit(0))
    return 3 * F.abs(F.col("l1") - F.col("l2"))


def sampled_agreement(px: DataFrame, key: list[str], step: int = 1, near: int = 50) -> DataFrame:
    """Share of sampled pixels whose colours are less than `near` apart. px: key, x, y and l1, l2 or the channels."""
    close = colour_distance(px) < near
    return px.where((F.col("x") % step == 0) & (F.col("y") % step == 0)).groupBy(*key).agg(F.round(F.avg(F.when(close, 1.0).otherwise(0.0)), 6).alias("quick"))


def _similarity(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """Clamped structural similarity of a window of n pixels by its sums; 1 where no pixel differs."""
    m1, m2 = a / n, b / n
    v1, v2, cov = aa / n - m1 * m1, bb / n - m2 * m2, ab / n - m1 * m2
    s = ((2 * m1 * m2 + C1) * (2 * cov + C2)) / ((m1 * m1 + m2 * m2 + C1) * (v1 + v2 + C2))
    return F.when(aa + bb - 2 * ab < 1e-9, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


SUMS = ("a", "b", "aa", "bb", "ab")


def ssim(px: DataFrame, key: list[str], stride: int = 1, window: int = WINDOW) -> DataFrame:
    """Mean structural similarity over windows of window x window pixels; an image smaller than that is one window.

    A summed-area table: sums run along rows, then along columns, and a window's sums are differences at
    its corners. So each pixel is one row at any window size; with a stride, only the columns and rows that end
    a window go on. px: key, x, y, l1, l2; each image a full rectangle from 0, 0. Whole numbers make exact sums.
    """
    a, b = F.col("l1"), F.col("l2")
    row, column = Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")
    so_far = lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = lambda c, w: F.coalesce(F.lag(c, window).over(w), F.lit(0))
    ends = lambda c: (F.col(c) >= window - 1) & ((F.col(c) - window + 1) % stride == 0)

    along = px.select(*key, "x", "y", *(so_far(v, row).alias(n) for n, v in zip(SUMS, (a, b, a * a, b * b, a * b), strict=True)), (F.max("x").over(Window.partitionBy(*key, "y")) + 1).alias("w"))
    strip = along.select(*key, "x", "y", "w", *SUMS, *((F.col(n) - before(n, row)).alias(f"s{n}") for n in SUMS))
    # Column -1 has the totals of rows, for images of one window.
    item = lambda x, p: F.struct(x.alias("x"), *(F.col(p + n).alias(n) for n in SUMS))
    kept = F.when(ends("x"), F.array(item(F.col("x"), "s"))).otherwise(F.array().cast(f"array<struct<x:int,{','.join(f'{n}:{strip.schema[n].dataType.simpleString()}' for n in SUMS)}>>"))
    strip = strip.withColumn("x", F.col("x").cast("int"))
    strip = strip.select(*key, "y", "w", F.inline(F.when(F.col("x") == F.col("w") - 1, F.concat(F.array(item(F.lit(-1), "")), kept)).otherwise(kept)))

    down = strip.select(*key, "x", "y", "w", *(so_far(F.col(n), column).alias(n) for n in SUMS), (F.max("y").over(Window.partitionBy(*key, "x")) + 1).alias("h"))
    boxes = down.select(*key, "x", "y", "w", "h", *SUMS, *((F.col(n) - before(n, column)).alias(f"s{n}") for n in SUMS))
    small = (F.col("w") < window) | (F.col("h") < window)
    whole = F.when((F.col("x") < 0) & small & (F.col("y") == F.col("h") - 1), _similarity(F.col("w") * F.col("h"), *(F.col(n) for n in SUMS)))
    part = F.when((F.col("x") >= 0) & ~small & ends("y"), _similarity(F.lit(window * window), *(F.col(f"s{n}") for n in SUMS)))
    return boxes.select(*key, F.coalesce(whole, part).alias("s")).where("s is not null").groupBy(*key).agg(F.round(F.avg("s"), 6).alias("ssim"))


def page_score(px: DataFrame, key: list[str], low: float = 0.1, high: float = 0.95, stride: int = 1) -> DataFrame:
    """Sampled agreement where it is under low or over high, structural similarity between; score_kind says which."""
    quick = sampled_agreement(px, key)
    clear = (F.col("quick") < low) | (F.col("quick") > high)
    slow = ssim(px.join(quick.where(~clear), key, "left_semi"), key, stride)
    return quick.where(clear).select(*key, F.col("quick").alias("score"), F.lit("quick").alias("score_kind")).unionByName(slow.select(*key, F.col("ssim").alias("score"), F.lit("ssim").alias("score_kind")))


def pixel_pairs(candidates: DataFrame, base_px: DataFrame, compare_px: DataFrame) -> DataFrame:
    b = base_px.select("pair_id", F.col("page_no").alias("base_page"), "x", "y", F.col("lum").alias("l1"))
    c = compare_px.select("pair_id", F.col("page_no").alias("compare_page"), "x", "y", F.col("lum").alias("l2"))
    return candidates.join(b, ["pair_id", "base_page"]).join(c, ["pair_id", "compare_page", "x", "y"])


def page_scorer(base_px: DataFrame | Shown, compare_px: DataFrame | Shown, stride: int = 1):
    """A scorer for matching: candidates to (pair_id, base_page, compare_page, score)."""
    if isinstance(base_px, Shown):
        return lambda candidates: _shown_scores(candidates, base_px, compare_px, stride)
    return lambda candidates: page_score(pixel_pairs(candidates, base_px, compare_px), ["pair_id", "base_page", "compare_page"], stride=stride).drop("score_kind")


def _shown_scores(candidates: DataFrame, base: Shown, compare: Shown, stride: int) -> DataFrame:
    both = ["base_image", "compare_image"]
    side = lambda d, s: d.pages.select("pair_id", F.col("page_no").alias(f"{s}_page"), F.col("image_id").alias(f"{s}_image"))
    shown = stored(candidates.select("pair_id", "base_page", "compare_page").join(side(base, "base"), ["pair_id", "base_page"]).join(side(compare, "compare"), ["pair_id", "compare_page"]), "shown")
    pixels = lambda d, s, n: d.pictures.select(F.col("image_id").alias(f"{s}_image"), "x", "y", F.col("lum").alias(n))
    px = shown.select(both).distinct().join(pixels(base, "base", "l1"), "base_image").join(pixels(compare, "compare", "l2"), ["compare_image", "x", "y"])
    return shown.join(stored(page_score(px, both, stride=stride).drop("score_kind"), "picture-scores"), both).drop(*both)


def coarse_scorer(base_px: DataFrame, compare_px: DataFrame, threshold: float = 0.7, margin: float = 0.25, by: int = 2, levels: int = 1, stride: int = 1):
    """A scorer that looks at small images first: candidates under threshold - margin there keep that score, the others get the full one.

    Level by level from the smallest, images `by` times smaller each, as long as they hold a whole window. Averaging hides noise, so unlike pages are about as unlike
    when small and like ones are more alike; yet it is a guess, which the margin makes safer, so it is for the caller to choose.
    """
    page = ["pair_id", "page_no"]

    def smaller(px: DataFrame) -> DataFrame:
        small = stored(downscale(px, page, by), "small")
        whole = small.groupBy(*page).agg(F.max("x").alias("w"), F.max("y").alias("h")).where(f"w >= {WINDOW - 1} and h >= {WINDOW - 1}")
        return small.join(whole, page, "left_semi")

    pages = [(base_px, compare_px)]
    for _ in range(levels):
        pages.append(tuple(smaller(px) for px in pages[-1]))
    key = ["pair_id", "base_page", "compare_page"]

    def score(candidates: DataFrame) -> DataFrame:
        left, ruled_out = candidates.select(key), None
        for small in reversed(pages[1:]):
            far = stored(page_scorer(*small)(left).where(F.col("score") < threshold - margin), "ruled-out")
            left = left.join(far, key, "left_anti")
            ruled_out = far if ruled_out is None else ruled_out.unionByName(far)
        full = page_scorer(base_px, compare_px, stride)(left)
        return full if ruled_out is None else full.unionByName(ruled_out)

    return score


def align(px: DataFrame, key: list[str], width: int, height: int, size: tuple[int, int] | None = None) -> DataFrame:
    """An image at another size, by the nearest cell. size: width and height of every image, some of whose cells may be missing; else an image's last column and row say it."""
    cell = lambda n, most, to, c: F.floor(F.col(n) * most / to).cast("int").alias(c)
    if size:
        grid = px.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("nx"), F.floor(F.col("id") / width).cast("int").alias("ny"))
        grid = F.broadcast(grid.select("nx", "ny", cell("nx", size[0], width, "x"), cell("ny", size[1], height, "y")))
        return px.join(grid, ["x", "y"]).select(*key, F.col("nx").alias("x"), F.col("ny").alias("y"), "lum")
    extent = px.groupBy(*key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    grid = extent.select(*key, "w", "h", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("nx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("ny"))
    grid = grid.select(*key, "nx", "ny", cell("nx", F.col("w"), width, "x"), cell("ny", F.col("h"), height, "y"))
    return grid.join(px, [*key, "x", "y"]).select(*key, F.col("nx").alias("x"), F.col("ny").alias("y"), "lum")


def downscale(px: DataFrame, key: list[str], by: int = 2) -> DataFrame:
    at = [F.floor(F.col(c) / by).cast("int").alias(c) for c in ("x", "y")]
    return px.select(*key, *at, "lum").groupBy(*key, "x", "y").agg(F.round(F.avg("lum"), 6).alias("lum"))


def signatures(px: DataFrame, key: list[str], size: tuple[int, int] | None = None) -> DataFrame:
    """WxH_ and the values of a grid of about five by five pixels. size: as for align."""
    whole = Window.partitionBy(*key)
    extent = dict(zip("xy", map(F.lit, size), strict=True)) if size else {c: F.max(c).over(whole) + 1 for c in "xy"}
    step = lambda c: F.greatest(F.lit(1), F.floor(extent[c] / 5))
    d = px.withColumns({"w": extent["x"], "h": extent["y"], "sx": step("x"), "sy": step("y")})
    values = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "lum"))), lambda s: s["lum"].cast("string")), ",")
    return d.where("x % sx = 0 and y % sy = 0").groupBy(*key, "w", "h").agg(values.alias("v")).select(*key, F.concat("w", F.lit("x"), "h", F.lit("_"), "v").alias("signature"))


def image_severity(change: Column, score: Column) -> Column:
    return F.when(change.isin("added", "deleted"), "major").when(score < 0.7, "major").when(score < 0.9, "minor").otherwise("cosmetic")


def exact_images(base: DataFrame, compare: DataFrame) -> DataFrame:
    """(pair_id, base_page, compare_page, score 1): images of one signature, lowest page with lowest page."""
    n = lambda d, s: d.select("pair_id", F.col("page_no").alias(f"{s}_page"), "signature", F.row_number().over(Window.partitionBy("pair_id", "signature").orderBy("page_no")).alias("n"))
    return n(base, "base").join(n(compare, "compare"), ["pair_id", "signature", "n"]).select("pair_id", "base_page", "compare_page", F.lit(1.0).alias("score"))


def image_differences(base_px: DataFrame | Shown, compare_px: DataFrame | Shown, threshold: float = 0.95, stride: int = 1, size: tuple[int, int] | None = None) -> DataFrame:
    """Added, deleted and modified images of each pair: equal ones first, then the best of what is left over `threshold`. size: as for align."""
    from docdelta.operators import matching

    key = ["pair_id", "page_no"]
    rest = lambda d, s: d.join(same.select("pair_id", F.col(f"{s}_page").alias("page_no")), key, "left_anti")
    if isinstance(base_px, Shown):
        signed = lambda d: d.pages.join(stored(signatures(d.pictures, ["image_id"], size).withColumn("signature", F.md5("signature")), "signatures"), "image_id")
        same = stored(exact_images(signed(base_px), signed(compare_px)), "equal-images")
        b, c = (Shown(stored(rest(d.pages, s), "open-images"), d.pictures) for d, s in ((base_px, "base"), (compare_px, "compare")))
    else:
        same = exact_images(signatures(base_px, key, size), signatures(compare_px, key, size))
        b, c = rest(base_px, "base"), rest(compare_px, "compare")
    pages = lambda d: (d.pages if isinstance(d, Shown) else d).select("pair_id", "page_no").distinct()
    scored = page_scorer(b, c, stride)(matching.full(pages(b), pages(c))).where(F.col("score") > threshold)
    near = stored(matching.assign(scored, 0.0), "matches")
    alone = matching.left_over(pages(b), pages(c), near)
    change = F.when(F.col("base_page").isNull(), "added").when(F.col("compare_page").isNull(), "deleted").otherwise("modified")
    every = near.where("score < 1").unionByName(alone.withColumn("score", F.lit(None).cast("double")))
    return every.withColumn("change", change).withColumn("severity", image_severity(F.col("change"), F.col("score")))


def image_box(d: DataFrame) -> DataFrame:
    """Display box of an image difference that has none of its own.

    That of the side by change; a modified one has the mean place and largest extent of sides with a width,
    or that of the one side. Without a width: 400 by 300, at 50, 50 if added or deleted, at 0, 0 if modified.
    """
    side = {(s, n): F.coalesce(F.col(f"{s}_{n}").cast("double"), F.lit(0.0)) for s in ("base", "compare") for n in ("x", "y", "width", "height")}
    wide = {s: side[s, "width"] > 0 for s in ("base", "compare")}
    out = {}
    for n, none in (("x", 50.0), ("y", 50.0), ("width", 400.0), ("height", 300.0)):
        b, c = side["base", n], side["compare", n]
        own = lambda v, least: F.when(v > 0, v).otherwise(least)  # noqa: E731, B023
        both = (b + c) / 2 if n in "xy" else F.greatest(b, c)
        one = 0.0 if n in "xy" else none
        changed = F.when(wide["base"] & wide["compare"], both).when(wide["base"], b).when(wide["compare"], c).otherwise(one)
        out[n] = F.when((F.col("change") == "added") & wide["compare"], own(c, one)).when((F.col("change") == "deleted") & wide["base"], own(b, one)).when(F.col("change") == "modified", changed).otherwise(none)
    return d.withColumns(out)


def image_box_or_hundred(d: DataFrame) -> DataFrame:
    """The stricter box: every missing part of an added or deleted image's side is 100, and so is all where a modified one has no width."""
    side = {(s, n): F.coalesce(F.col(f"{s}_{n}").cast("double"), F.lit(0.0)) for s in ("base", "compare") for n in ("x", "y", "width", "height")}
    wide = {s: side[s, "width"] > 0 for s in ("base", "compare")}
    out = {}
    for n in ("x", "y", "width", "height"):
        b, c = side["base", n], side["compare", n]
        own = lambda v: F.when(v > 0, v).otherwise(100.0)
        both = (b + c) / 2 if n in "xy" else F.greatest(b, c)
        changed = F.when(wide["base"] & wide["compare"], both).when(wide["base"], b).when(wide["compare"], c).otherwise(100.0)
        out[n] = F.when(F.col("change") == "added", own(c)).when(F.col("change") == "deleted", own(b)).otherwise(changed)
    return d.withColumns(out)


def image_shape(width: Column, height: Column) -> list[Column]:
    shape = F.when(width > height, "landscape").when(width < height, "portrait").otherwise("square")
    return [(width * height).alias("area"), F.coalesce(F.round(F.try_divide(width.cast("double"), height), 6), F.lit(0.0)).alias("aspect"), shape.alias("shape")]


def change_percent(base: Column, compare: Column) -> Column:
    return F.coalesce(F.round(F.try_divide((compare - base).cast("double") * 100, base), 6), F.lit(0.0))


def image_measures(d: DataFrame) -> list[Column]:
    """Areas, aspect ratios and differences of both sides (base_ and compare_ x, y, width, height); percents are 0 on a base of 0."""
    b, c = (lambda n: F.col(f"base_{n}")), (lambda n: F.col(f"compare_{n}"))
    aspect = lambda w, h: F.round(w / F.when(h > 0, h).otherwise(1), 6)
    area = lambda s: s("width") * s("height")
    ba, ca = aspect(b("width"), b("height")), aspect(c("width"), c("height"))
    out = [area(b).alias("base_area"), area(c).alias("compare_area"), (area(c) - area(b)).alias("area_change"), change_percent(area(b), area(c)).alias("area_percent")]
    out += [ba.alias("base_aspect"), ca.alias("compare_aspect"), F.round(ca - ba, 6).alias("aspect_change")]
    out += [(c(n) - b(n)).alias(f"{n}_change") for n in ("x", "y", "width", "height")]
    return out + [change_percent(b(n), c(n)).alias(f"{n}_percent") for n in ("width", "height")]
