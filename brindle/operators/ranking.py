"""Candidate sets of listings: drop rules, set scores and the best set of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least score of a strong record.
STRONG = 18


def dropped(score: Column, supported: Column, detail_like: Column, utility: Column, detail_merchandise: Column, fallback_merchandise: Column, job: Column) -> Column:
    """Whether a listing record goes. A record stays that isn't negative and whose kind of link vouches for it.

    A detail link vouches for utility rows of 10 or more, and for others with support, of a job or of merchandise by that link. Another link
    vouches for no utility row, and for others with support, or of a job or merchandise with 10 or more.
    """
    by_detail = (~utility | (score >= 10)) & (supported | job | detail_merchandise)
    by_other = ~utility & (supported | ((score >= 10) & (job | fallback_merchandise)))
    return (score < 0) | ~F.when(detail_like, by_detail).otherwise(by_other)


def set_scores(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank struct) of records with score, supported, detail_like, utility: strong, supported, detail-like and
    clean ones, mean score in hundredths, fewest utility ones, sum. One aggregate with map-side sums."""
    n, total, utility = F.count("*"), F.sum("score"), F.count_if("utility")
    rank = F.struct(
        F.count_if(F.col("score") >= STRONG).alias("strong"), F.count_if("supported").alias("supported"), F.count_if("detail_like").alias("detail_like"), (n - utility).alias("clean"),
        F.bround(total / n * 100).cast("long").alias("mean"), (-utility).alias("utility"), total.alias("total"),
    )
    return records.groupBy(*keys).agg(rank.alias("rank"))


def best_sets(scored: DataFrame, page: str, order: str) -> DataFrame:
    """The set of largest rank of each page; of equal ones the first by ``order``."""
    return scored.groupBy(page).agg(F.max_by(F.struct(*[c for c in scored.columns if c != page]), F.struct("rank", -F.col(order))).alias("best")).select(page, "best.*")


def best_per_link(clusters: DataFrame, link: str, score: str, origin: list[str]) -> DataFrame:
    """The cluster of largest score of each link, ties by place. No window: one aggregate."""
    least = F.min(F.struct((-F.col(score)).alias("_score"), *origin, F.struct(*clusters.columns).alias("_row")))
    return clusters.groupBy(link).agg(least.alias("_best")).select("_best._row.*")
