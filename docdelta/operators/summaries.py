"""Aggregates over page pairs and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("text", "image", "font", "style", "metadata")
SEVERITIES = ("major", "minor", "cosmetic")
PAGE_KEY = ["pair_id", "base_page", "compare_page"]


def total_differences(pairs: DataFrame, d: DataFrame) -> DataFrame:
    return pairs.select("pair_id").join(d.groupBy("pair_id").agg(F.count("*").alias("n")), "pair_id", "left").select("pair_id", F.coalesce("n", F.lit(0)).alias("total"))


def count_by_dimension(d: DataFrame) -> DataFrame:
    """Counts by type, severity, change and page in one pass."""
    keys = ["type", "severity", "change", "base_page"]
    sets = d.groupingSets([[F.col("pair_id"), F.col(k)] for k in keys], "pair_id", *keys).agg(F.count("*").alias("n"), *(F.grouping(k).alias(f"g_{k}") for k in keys))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        name, value = F.when(F.col(f"g_{k}") == 0, F.lit(k)).otherwise(name), F.when(F.col(f"g_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    return sets.select("pair_id", name.alias("dimension"), value.alias("value"), "n")


def page_counts(page_pairs: DataFrame, d: DataFrame) -> DataFrame:
    differing = d.groupBy("pair_id").agg(F.count_distinct("base_page", "compare_page").alias("different"))
    counts = page_pairs.groupBy("pair_id").agg(F.count("*").alias("pages"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))
    return counts.join(differing, "pair_id", "left").withColumn("different", F.coalesce("different", F.lit(0)))


def pages_by(d: DataFrame, dimensions: tuple[str, ...] = ("type", "severity")) -> DataFrame:
    """(pair_id, dimension, value, pages): pages with a difference of each type and of each severity."""
    long = d.select("pair_id", "base_page", "compare_page", *dimensions).unpivot(["pair_id", "base_page", "compare_page"], list(dimensions), "dimension", "value")
    return long.groupBy("pair_id", "dimension", "value").agg(F.count_distinct("base_page", "compare_page").alias("pages"))


def count_maps(pairs: DataFrame, d: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES] + [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    names = [f"n_{x}" for x in (*TYPES, *SEVERITIES)]
    return pairs.select("pair_id").join(d.groupBy("pair_id").agg(*counts), "pair_id", "left").select("pair_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def overall_similarity(page_pairs: DataFrame) -> DataFrame:
    """Matched pages over the longer document's pages, times the mean score of the matched."""
    m = F.col("matched")
    pages = F.greatest(F.count("base_page"), F.count("compare_page"))
    value = F.try_divide(F.count_if(m).cast("double"), pages) * F.coalesce(F.avg(F.when(m, F.col("score"))), F.lit(0.0))
    return page_pairs.groupBy("pair_id").agg(F.round(F.coalesce(value, F.lit(0.0)), 6).alias("similarity"))


def identical_similar(totals: DataFrame, similarity: DataFrame, threshold: float = 0.5) -> DataFrame:
    return totals.join(similarity, "pair_id").select("pair_id", (F.col("total") == 0).alias("identical"), (F.col("similarity") >= threshold).alias("similar"))


def ui_summary(counts: DataFrame, totals: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts by category, all in structure where no type is known, and each bar's share of the chart."""
    known = F.col("n_text") + F.col("n_image") + F.col("n_font") + F.col("n_style")
    other = F.when(known == 0, F.col("total")).otherwise(F.col("total") - known)
    n = {"content": F.col("n_text"), "images": F.col("n_image"), "fonts": F.col("n_font"), "style": F.col("n_style"), "structure": other}
    bar = lambda c: F.round(F.when(c == 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(5.0), c * 100.0 / F.greatest(F.col("total"), F.lit(1))))), 6)
    d = counts.join(totals, "pair_id").join(pages, "pair_id")
    return d.select("pair_id", F.col("different").alias("different_pages"), *(c.alias(k) for k, c in n.items()), *(bar(c).alias(f"bar_{k}") for k, c in n.items()))


def match_label(score: Column) -> Column:
    return F.when(score >= 0.95, "Excellent Match").when(score >= 0.85, "Good Match").when(score >= 0.7, "Fair Match").when(score >= 0.5, "Possible Match").when(score > 0, "Poor Match").otherwise("No Match")


def document_pairs(pairs: DataFrame, doc_pages: DataFrame, totals: DataFrame, similarity: DataFrame) -> DataFrame:
    """A display row for each pair: both documents with their page counts and ranges, whether they exist, score, label, total. A range is null without pages."""
    d = pairs
    for s in ("base", "compare"):
        d = d.join(doc_pages.select(F.col("doc_id").alias(f"{s}_id"), F.col("page_count").alias(f"{s}_pages")), f"{s}_id", "left").withColumn(f"has_{s}", F.col(f"{s}_pages").isNotNull())
    span = lambda n: F.concat(F.lit("1-"), F.col(n).cast("string"))
    count = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return d.join(totals, "pair_id").join(similarity, "pair_id").select("pair_id", "base_id", "compare_id", "has_base", "has_compare", count("base_pages"), count("compare_pages"), span("base_pages").alias("base_range"), span("compare_pages").alias("compare_range"), "total", "similarity", match_label(F.col("similarity")).alias("label"))


def page_details(requests: DataFrame, page_pairs: DataFrame, texts: DataFrame, pairs: DataFrame, d: DataFrame) -> DataFrame:
    """What a viewer shows of requested (pair_id, page_no): the first page pair with that page on either side, whether
    both sides exist, both texts, differences by type, and the ids of those on either side. Requests without a page pair have nulls and zeros.
    """
    types = ("text", "image", "font", "style")
    either = [page_pairs.select("pair_id", F.col(f"{s}_page").alias("page_no"), "base_page", "compare_page") for s in ("base", "compare")]
    order = F.struct(F.coalesce("base_page", F.lit(2**31 - 1)), F.coalesce("compare_page", F.lit(2**31 - 1)))
    first = requests.join(either[0].unionByName(either[1]), ["pair_id", "page_no"]).groupBy("pair_id", "page_no").agg(F.min_by(F.struct("base_page", "compare_page"), order).alias("at")).select("pair_id", "page_no", "at.*")
    out = requests.join(first, ["pair_id", "page_no"], "left").join(pairs, "pair_id")
    for s in ("base", "compare"):
        out = out.join(texts.select(F.col("doc_id").alias(f"{s}_id"), F.col("page_no").alias(f"{s}_page"), F.col("text").alias(f"{s}_text")), [f"{s}_id", f"{s}_page"], "left")
    ids = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col(f"{s}_page").isNotNull(), F.col("diff_id")))), ",")
    listed = d.groupBy(PAGE_KEY).agg(*(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types), *(ids(s).alias(f"{s}_differences") for s in ("base", "compare")))
    out = out.join(listed, PAGE_KEY, "left")
    return out.select("pair_id", "page_no", *(F.col(f"{s}_page").isNotNull().alias(f"in_{s}") for s in ("base", "compare")), "base_text", "compare_text", *(F.coalesce(f"n_{t}", F.lit(0)).alias(f"n_{t}") for t in types), "base_differences", "compare_differences")


def pairs_with(page_pairs: DataFrame, d: DataFrame, **only: str) -> DataFrame:
    for k, v in only.items():
        d = d.where(F.col(k) == v)
    return page_pairs.join(d.select(PAGE_KEY).distinct(), PAGE_KEY, "left_semi")


def page_lookup(requests: DataFrame, page_pairs: DataFrame, side: str = "base") -> DataFrame:
    """The page pair of a page of one side; else the n-th pair of the document, else its first."""
    order = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.coalesce("base_page", "compare_page"), "compare_page"))
    numbered = page_pairs.withColumn("n", order)
    pick = lambda key, tag: numbered.select("pair_id", key.alias("page_no"), F.col("n").alias(tag))
    own = pick(F.col(f"{side}_page"), "own").where("page_no is not null")
    nth = pick(F.col("n"), "nth")
    first = numbered.groupBy("pair_id").agg(F.min("n").alias("first"))
    found = requests.join(own, ["pair_id", "page_no"], "left").join(nth, ["pair_id", "page_no"], "left").join(first, "pair_id", "left")
    return found.select("pair_id", "page_no", F.coalesce("own", "nth", "first").alias("pair_no"))


def summary(pairs: DataFrame, page_pairs: DataFrame, d: DataFrame) -> DataFrame:
    """Everything above in a row for each pair, from one aggregate of pages and one of differences."""
    m, pages = F.col("matched"), F.greatest(F.count("base_page"), F.count("compare_page"))
    mean, share = F.coalesce(F.avg(F.when(m, F.col("score"))), F.lit(0.0)), F.count_if(m).cast("double")
    p = page_pairs.groupBy("pair_id").agg(F.count("*").alias("pages"), F.count_if(m).alias("matched"), F.round(F.coalesce(F.try_divide(share, pages), F.lit(0.0)) * mean, 6).alias("similarity"), F.round(share / F.count("*") * mean, 6).alias("confidence"))
    n = d.groupBy("pair_id").agg(F.count("*").alias("total"), F.count_distinct("base_page", "compare_page").alias("different"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "different", *(f"n_{s}" for s in SEVERITIES))]
    return pairs.select("pair_id").join(p, "pair_id", "left").join(n, "pair_id", "left").select("pair_id", "pages", "matched", "similarity", "confidence", *zero)
