"""Strategies that score page pairs for matching: by lines, by pixels, by both, or by the caller's own function.

A strategy has a name and turns candidates (pair_id, base_page, compare_page) into scored edges with DataFrame
operations alone, so its plan is optimized with the rest; a pandas UDF may stand in `Own`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdelta.operators import matching, visual

KEY = matching.KEY


class Strategy(Protocol):
    name: str

    def score(self, candidates: DataFrame) -> DataFrame:
        """candidates and a score from 0 to 1."""


@dataclass(frozen=True)
class Lines:
    """Jaccard index of the pages' sets of lines."""

    pairs: DataFrame
    page_lines: DataFrame
    name: str = "content"

    def score(self, candidates: DataFrame) -> DataFrame:
        sets = self.page_lines.groupBy("doc_id", "page_no").agg(F.collect_set("text").alias("lines"))
        out = candidates.join(self.pairs, "pair_id")
        for s in ("base", "compare"):
            out = out.join(sets.withColumnsRenamed({"doc_id": f"{s}_id", "page_no": f"{s}_page", "lines": f"{s}_lines"}), [f"{s}_id", f"{s}_page"], "left")
        none = F.array().cast("array<string>")
        both = matching.content_similarity(F.coalesce("base_lines", none), F.coalesce("compare_lines", none))
        return out.select(*KEY, F.round(both, 6).alias("score"))


@dataclass(frozen=True)
class Pixels:
    """Visual score of the pages' pictures; 0 where one has none."""

    base_px: DataFrame
    compare_px: DataFrame
    stride: int = 1
    name: str = "visual"

    def score(self, candidates: DataFrame) -> DataFrame:
        seen = visual.page_scorer(self.base_px, self.compare_px, self.stride)(candidates)
        return candidates.join(seen, KEY, "left").select(*KEY, F.coalesce("score", F.lit(0.0)).alias("score"))


@dataclass(frozen=True)
class Weighted:
    """wv times the visual and wc times the content score."""

    visual: Strategy
    content: Strategy
    wv: float = 0.7
    wc: float = 0.3
    name: str = "weighted"

    def score(self, candidates: DataFrame) -> DataFrame:
        v, c = (s.score(candidates).withColumnRenamed("score", n) for s, n in ((self.visual, "v"), (self.content, "c")))
        mean = matching.weighted(F.col("v"), F.col("c"), self.wv, self.wc)
        return v.join(c, KEY).select(*KEY, F.round(mean + 1e-9, 6).alias("score"))  # halves go up, whatever the last bit of the sum


@dataclass(frozen=True)
class Own:
    """The caller's function of the candidates' DataFrame, which adds a score."""

    function: Callable[[DataFrame], DataFrame]
    name: str = "own"

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.transform(self.function).select(*KEY, F.round("score", 6).alias("score"))


def match_documents(base: DataFrame, compare: DataFrame, strategy: Strategy, mode: str = "smart", threshold: float = matching.THRESHOLD) -> DataFrame:
    """Page pairs of every document pair, unmatched pages too, with the strategy's name and its confidence in the pair (0 without a match)."""
    found = matching.match(base, compare, strategy.score, mode, threshold)
    trust = matching.confidence(found).select("pair_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return found.join(trust, "pair_id").withColumn("strategy", F.lit(strategy.name))
