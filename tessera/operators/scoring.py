"""Scores of listings: early relevance, the composite, the blend of a match, and its caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import temporal as T
from tessera.functions.seen import Seen
from tessera.functions.text import clamped, strip, text
from tessera.operators import fields
from tessera.operators import matching as M
from tessera.operators.profile import Profile

#: Parts of the composite, and of the blend of embedding, skills, reranker and language model.
COMPOSITE = {"title": 35, "skills": 25, "seniority": 20, "recency": 12, "location": 8}
BLEND = {"embed": 0.15, "skill": 0.25, "rerank": 0.45, "llm": 0.15}
CAPS = {"skill": 35, "level": 20, "sales": 25}


def early(title: Column, hay: Column, hits: Column, p: Profile) -> Column:
    """14 for each skill, 4 for each role with a word in the text, less 20 for internships from tier 2 on."""
    score = hits * 14
    for role in p.role_phrases():
        score = score + F.when(M.any_of([hay.contains(w) for w in role.lower().split() if len(w) > 2]), 4).otherwise(0)
    if p.tier >= 2:
        score = score - F.when(F.lower(title).contains("intern"), 20).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def title_relevance(title: Column | str, p: Profile) -> Column:
    """1 for a role's phrase, else what the profile's fields give, else 0.7 for a technical word."""
    low = F.lower(text(title))
    phrase = M.any_of([low.contains(r.lower()) for r in p.role_phrases()])
    family = M.any_of([low.contains(w) for w in ("engineer", "developer", "scientist", "analyst", "architect")])
    return M.once(fields.title_score(fields.fields_of(p), low), lambda score: F.when(phrase, 1.0).when(score > 0, score).when(family, 0.7).otherwise(0.0))


def seniority_proximity(tier: Column, p: Profile) -> Column:
    return M.once(F.abs(tier - p.tier), lambda away: F.when(away == 0, 1.0).when(away == 1, 0.7).when(away == 2, 0.35).otherwise(0.0))


def location_fit(c: Column | str, p: Profile) -> Column:
    known = F.lit(0.6) if not p.location.strip() else F.when(strip(c) == "", 0.4).when(M.place_matches(c, p.location), 1.0).otherwise(0.2)
    return F.when(M.is_remote(c), 1.0 if p.include_remote else 0.2).otherwise(known)


def composite(listings: DataFrame, p: Profile, as_of: Column) -> DataFrame:
    """listings with the five parts and relevance; sales titles have none."""
    hay = F.lower(F.concat_ws(" ", text("title"), text("description"), text("requirements"), F.array_join(F.coalesce("skills", F.array().cast("array<string>")), " ")))
    seen = Seen("_seen")  # one pass over each text finds all terms of the skills
    hits = M.skill_hits(seen, p)
    out = listings.withColumn("_seen", seen.column(hay)).withColumn("hits", hits).withColumns({
        "title_part": title_relevance("title", p),
        "skills_part": M.overlap_percent(F.col("hits"), p) / 100.0,
        "seniority_part": seniority_proximity(M.job_tier("title", "description"), p),
        "recency_part": T.recency_score(F.col("posted_at"), F.col("scraped_at"), as_of),
        "location_part": location_fit("location", p),
    })
    total = sum((F.lit(w) * F.col(f"{n}_part") for n, w in COMPOSITE.items()), F.lit(0.0))
    return out.withColumn("relevance", F.when(M.is_sales("title"), 0).otherwise(clamped(total))).drop("_seen")


def blended(parts: dict[str, Column], used_llm: bool) -> Column:
    """The weighted parts; without a language model the other weights are scaled up to 1."""
    used = {n: w for n, w in BLEND.items() if used_llm or n != "llm"}
    whole = 1.0 if used_llm else sum(used.values())
    return clamped(sum((F.lit(w / whole) * parts[n] for n, w in used.items()), F.lit(0.0)))


def capped(score: Column, skill: Column, matched: Column, level_ok: Column, tier: Column, title: Column, bonus: Column, recommended: Column, p: Profile) -> Column:
    """struct<match_score, recommendation, reasons>: the bonus, then the caps in order; each cap says Skip and adds its reason."""
    start = F.least(F.lit(100), score + bonus)
    no_skill = (skill < 15) & (F.size(matched) == 0)
    wrong_level = ~level_ok | (F.lit(p.tier <= 1) & ((tier >= 3) | M.is_leadership(title)))
    sales = F.lit(p.tier <= 2 and p.technical) & M.is_sales(title)
    caps = [(no_skill, CAPS["skill"], "Low skill overlap with your profile"), (wrong_level, CAPS["level"], "Experience mismatch"), (sales, CAPS["sales"], "Sales role for a technical profile")]
    for hit, most, _ in caps:
        start = F.when(hit, F.least(start, F.lit(most))).otherwise(start)
    reasons = F.array_compact(F.array(*[F.when(hit, F.lit(why)) for hit, _, why in caps]))
    return F.struct(start.cast("int").alias("match_score"), F.when(no_skill | wrong_level | sales, "Skip").otherwise(recommended).alias("recommendation"), reasons.alias("reasons"))


def browse_score(early_: Column, composite_: Column, threshold: int) -> Column:
    """For listings that aren't matched: below the threshold, at least 1."""
    return F.greatest(F.lit(1), F.least(F.lit(max(1, threshold - 1)), F.greatest(early_, composite_)))


TIER_LABELS = D.TIER_LABELS
