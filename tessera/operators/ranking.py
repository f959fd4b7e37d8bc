"""From fetched listings to ordered matches: recency, annotation, enrichment, pools, the final order, and the digest's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.operators import matching as M
from tessera.operators import people, state
from tessera.operators.profile import Profile

#: Rows kept after recall, reranked, and scored by a language model.
RECALL, RERANK, SCORED = 50, 20, 8


def recent(listings: DataFrame, as_of: Column, days: int = 0) -> DataFrame:
    """listings with dates that are missing recovered from phrases in title and description; with days, only those as young, and
    none without a date. hiring_order is added for recent_order."""
    said = T.relative_date(F.concat_ws(" ", X.text("title"), F.substring(X.text("description"), 1, 500)), as_of)
    rows = listings.withColumn("posted_at", F.coalesce("posted_at", said))
    if days > 0:
        rows = rows.where(F.col("posted_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return rows.withColumn("hiring_order", T.hiring_order(T.hiring_class(F.col("posted_at"), as_of)))


def recent_order(prefer_hiring: bool = True, seq: str = "seq") -> list[Column]:
    newest = [F.desc_nulls_last("posted_at"), F.col(seq)]
    return [F.col("hiring_order"), *newest] if prefer_hiring else newest


def annotated(listings: DataFrame, p: Profile) -> DataFrame:
    """What a source hands on: listings of a fitting level and place, with their experience in words."""
    years = M.required_years(F.concat_ws(" ", X.text("title"), X.text("description"), X.text("requirements")))
    rows = listings.withColumn("experience", people.experience_label("title", "description"))
    return rows.where(M.tier_fits(M.job_tier("title", "description"), p) & M.years_fit(years, p) & M.place_fits("location", p))


def enriched(listings: DataFrame) -> DataFrame:
    """listings with requirements, nice_to_have, required_years, tier, remote_policy and employment_type filled in where they are
    empty or missing; without a header, the first 3000 characters of the description are the requirements."""
    have = lambda c, kind: F.col(c) if c in listings.columns else F.lit(None).cast(kind)
    full = lambda c: F.nullif(X.strip(have(c, "string")), F.lit(""))
    rows = listings.withColumn("_s", X.listing_sections("description"))
    head = F.when(F.col("_s.requirements") != "", F.col("_s.requirements")).otherwise(F.substring("_s.body", 1, 3000))
    rows = rows.withColumns({"requirements": F.coalesce(full("requirements"), head), "nice_to_have": F.coalesce(full("nice_to_have"), F.col("_s.nice"))})
    years = M.required_years(F.concat_ws(" ", X.text("title"), X.text("description"), X.text("requirements")))
    return rows.withColumns({
        "required_years": F.coalesce(have("required_years", "int"), years),
        "tier": F.coalesce(have("tier", "int"), M.job_tier("title", "description")),
        "remote_policy": F.coalesce(full("remote_policy"), X.remote_policy("description", "location")),
        "employment_type": F.coalesce(full("employment_type"), X.employment_type("description", "title")),
    }).drop("_s")


def threshold(run: Column, profile: Column, default: int) -> Column:
    """The least score: a run's own, else the profile's, else the default; within 0 to 100."""
    return X.clamped(F.coalesce(run.cast("double"), profile.cast("double"), F.lit(float(default))))


def seen() -> Column:
    return F.coalesce("posted_at", "scraped_at")


def rerank_pool(scored: DataFrame, recall: int = RECALL, rerank: int = RERANK) -> DataFrame:
    """The rows to rerank: of the best by recall, newer ones first among equals."""
    return scored.orderBy(F.desc("recall"), seen().desc_nulls_last(), "seq").limit(min(recall, rerank))


def reranked(pool: DataFrame, top_n: int = 8, scored: int = SCORED, rerank: int = RERANK) -> DataFrame:
    """A pool of at most `rerank` rows in order of rerank and recall, cut to what is scored; used_llm marks the first of them."""
    place = F.row_number().over(Window.orderBy(F.desc("rerank"), F.desc("recall"), "seq"))
    return pool.withColumn("place", place).where(F.col("place") <= max(rerank, 3 * top_n, 30)).withColumn("used_llm", F.col("place") <= scored)


def final_order(matches: DataFrame, least: int, top_n: int = 8) -> DataFrame:
    """The best max(10 * top_n, 80) of the matches with a score, with their place: those from the threshold on come first. A small
    table, by its cap."""
    best = matches.where(F.col("match_score") >= 1).orderBy(F.desc("match_score"), seen().desc_nulls_last(), "seq").limit(max(10 * top_n, 80))
    strong = (F.col("match_score") >= least).cast("int")
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(strong), F.desc("match_score"), seen().desc_nulls_last(), "seq")))


def judged_for_digest(matches: DataFrame, notified: DataFrame, p: Profile, least: int, as_of: Column, delta: int = 10) -> DataFrame:
    """matches with `dropped`: below_threshold, location or already_notified, the first that holds, null for the others; and with
    notice, why one is sent, and hiring_order. A notice without a date leaves the date to the next one of the same listing."""
    told = state.prior_notice(matches, notified, known=("match_score", "posted_at", "listing_fingerprint"))
    why = state.notice_reason(F.col("match_score"), F.col("posted_at"), F.col("listing_fingerprint"), F.lit(True), F.col("prior"), delta)
    dropped = F.when(F.col("match_score") < least, "below_threshold").when(~M.place_fits("location", p), "location").when(why == "already_notified", "already_notified")
    return told.withColumns({"notice": why, "dropped": dropped, "hiring_order": T.hiring_order(T.hiring_class(F.col("posted_at"), as_of))}).drop("prior")


def digest_rows(judged: DataFrame, cap: int) -> DataFrame:
    """The rows of a digest: open listings first, then by score and date, at most cap."""
    return judged.where(F.col("dropped").isNull()).orderBy("hiring_order", F.desc("match_score"), F.desc_nulls_last("posted_at"), "seq").limit(max(0, cap))


def digest_stats(judged: DataFrame, cap: int) -> DataFrame:
    """One row: how many came in, were dropped for each reason, were cut off, and are sent."""
    why = lambda name: F.count_if(F.col("dropped") == name)
    left = F.count_if(F.col("dropped").isNull())
    return judged.agg(F.count("*").alias("input"), why("below_threshold").alias("dropped_below_threshold"), why("location").alias("dropped_location"), why("already_notified").alias("dropped_already_notified"), F.greatest(F.lit(0), left - max(0, cap)).alias("truncated"), F.least(left, F.lit(max(0, cap))).alias("sent"))


def digest_message(entries: DataFrame, name: str, least: int, cap: int, footer: str) -> DataFrame:
    """One row, the text of a digest from (place, entry) rows, of which there are at most cap: header, entries, footer."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), "\n")
    count = F.count("*")
    head = F.concat(count.cast("string"), F.when(count == 1, " match").otherwise(" matches"), F.lit(f" for {name}\nMin match score: {least}%\nDigest cap: {cap}\n\n"))
    return entries.agg(F.concat(head, F.when(count == 0, "No matches at or above the threshold this time").otherwise(lines), F.lit(f"\n\n{footer}")).alias("text"))
