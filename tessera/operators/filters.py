"""The ordered rule cascade: a reason for each rejected listing, and the counts of reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.seen import Seen
from tessera.functions.text import text
from tessera.operators import fields
from tessera.operators import matching as M
from tessera.operators.profile import Profile


def with_reason(listings: DataFrame, p: Profile) -> DataFrame:
    """listings with reject_reason, null for those that stay. The first rule that fails counts; of rows with one content hash the
    first by seq is judged, the others are duplicates. The hash decides the exchange, and only that one is needed."""
    words = F.concat_ws(" ", text("title"), text("description"), text("requirements"))
    hay = F.lower(F.concat_ws(" ", words, F.array_join(F.coalesce("skills", F.array().cast("array<string>")), " ")))
    told = listings.withColumns({"_hay": hay, "_years": M.required_years(words), "_tier": M.job_tier("title", "description")})
    seen = Seen("_seen")  # one pass over each text answers all rules
    hits = M.skill_hits(seen, p)
    rules = [
        ("internship", F.lit(p.exclude_internships) & M.is_internship("title", "description")),
        ("experience_mismatch", F.lit(p.strict_experience) & ~(M.tier_fits(F.col("_tier"), p) & M.years_fit(F.col("_years"), p))),
        ("enterprise_stack", M.enterprise_mismatch(seen, p)),
        ("role_mismatch", ~fields.role_fits(F.lower(text("title")), seen, F.col("_hits"), p)),
        ("location_mismatch", ~M.place_fits("location", p)),
    ]
    told = told.withColumn("_seen", seen.column(F.col("_hay"))).withColumn("_hits", hits)
    # judged before the exchange, so that a query for reasons alone moves no texts
    told = told.withColumn("_reason", F.coalesce(*[F.when(fails, F.lit(name)) for name, fails in rules])).drop("_hay", "_seen", "_years", "_tier", "_hits")
    copy = F.row_number().over(Window.partitionBy("content_hash").orderBy("seq")) > 1
    return told.withColumn("reject_reason", F.when(copy, "duplicate").otherwise(F.col("_reason"))).drop("_reason")


def reason_counts(told: DataFrame) -> DataFrame:
    return told.where(F.col("reject_reason").isNotNull()).groupBy("reject_reason").agg(F.count("*").alias("n"))


def above(scored: DataFrame, least: int, score: str = "match_score") -> DataFrame:
    """(rows from a score on; how many fell is reporting.threshold_counts)."""
    return scored.where(F.col(score) >= max(0, min(100, least)))
