"""Profiles as rows: levels, years and tiers, places, contacts, and what of a tailored profile is true."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import taxonomy as T
from tessera.functions import text as X
from tessera.functions.temporal import total_months
from tessera.operators import matching as M


def _by(value: Column, steps: list[tuple[float, int]], last: int) -> Column:
    """The tier of the first bound that value is within."""
    return M.once(value, lambda v: _ladder(v, steps, last))


def _ladder(v: Column, steps: list[tuple[float, int]], last: int) -> Column:
    out = F.when(v.isNull(), F.lit(None).cast("int"))
    for bound, tier in steps:
        out = out.when(v <= bound, tier)
    return out.otherwise(last)


_MIDDLE = [(1, 0), (2.5, 1), (5, 2), (7, 3)]
_YEARS = [(1, 0), (2, 1), (4, 2), (7, 3)]


def level_tier(level: Column | str) -> Column:
    """0 to 5 from a level in words: fresh, a range of years, a number of years, then words; null if it says nothing."""
    low = F.lower(X.strip(level))
    has = lambda *words: M.any_of([low.contains(w) for w in words])
    number = lambda pattern, k: F.nullif(F.regexp_extract(low, pattern, k), F.lit("")).try_cast("int")
    middle = (number(T.LEVEL_RANGE, 1) + number(T.LEVEL_RANGE, 2)) / 2
    years = number(r"(\d+)", 1)
    in_words = F.when(has("entry", "junior"), 1).when(has("mid", "intermediate"), 2).when(has("senior") & ~has("lead"), 3).when(has("lead", "staff", "principal"), 4).when(has("executive", "director", "vp"), 5)
    return F.when(has(*T.FRESH_LEVELS) | has("intern"), 0).when(middle.isNotNull(), _by(middle, _MIDDLE, 4)).when(years.isNotNull(), _by(years, _YEARS, 4)).otherwise(in_words)


def target_years(level: Column | str, low: Column, high: Column) -> Column:
    """struct<low, high> of years: as told, else what the level usually means."""
    text = F.lower(X.strip(level))
    pair = lambda a, b: F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"))
    tier = level_tier(level)
    usual = (
        F.when(text.isin(*T.FRESH_LEVELS) | text.contains("intern"), pair(0, 0))
        .when(text.contains("0-1") | text.contains("0 - 1"), pair(0, 1))
        .when(text.contains("1-3"), pair(1, 3))
        .when(text.contains("3-5"), pair(3, 5))
        .when(text.contains("5+") | text.startswith("5"), pair(5, 15))
        .when(tier == 0, pair(0, 1))
        .when(tier == 1, pair(0, 2))
        .when(tier == 2, pair(2, 5))
        .when(tier == 3, pair(4, 8))
        .otherwise(pair(5, 15))
    )
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(low.alias("low"), high.alias("high"))).otherwise(usual)


def candidate_years(target: Column) -> Column:
    return (target["low"] + target["high"]) / 2.0


def history_months(jobs: Column, as_of: Column) -> Column:
    """Months over array<struct<start, end, current, duration>>: from dates if any job has a start, else from durations in words, a
    year for one that says nothing; null without jobs."""
    dated = F.filter(jobs, lambda j: F.trim(j["start"]).rlike(r"^20\d{2}(-\d{1,2})?$"))

    def told(j: Column) -> Column:
        low = F.lower(X.text(j["duration"]))
        years = F.regexp_extract_all(low, F.lit(r"(20\d{2})"), F.lit(1))
        span = (F.element_at(years, -1).cast("int") - years[0].cast("int")) * 12
        number = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).try_cast("int")
        return F.when(F.size(years) >= 2, span).otherwise(F.coalesce(number(r"(\d+)\s*months?"), number(r"(\d+)\s*years?") * 12, F.lit(12)))

    words = F.aggregate(F.transform(jobs, told), F.lit(0), lambda t, m: t + m)
    return F.when(F.size(jobs) == 0, F.lit(None)).when(F.size(dated) > 0, total_months(dated, as_of)).otherwise(words)


def history_tier(jobs: Column, schooled: Column, as_of: Column) -> Column:
    """From months of work; 0 for a profile with schooling and no work, null without either."""
    tier = _by(history_months(jobs, as_of) / 12, _YEARS, 4)
    return F.when(F.size(jobs) > 0, tier).when(schooled, 0)


def candidate_tier(level: Column | str, low: Column, high: Column, jobs: Column, schooled: Column, as_of: Column) -> Column:
    """The smaller of what the target years, or else the level, and the history say; 0 if nothing does."""
    told = F.when(low.isNotNull() & high.isNotNull(), _by((low + high) / 2, _MIDDLE, 4)).otherwise(level_tier(level))
    return F.coalesce(F.least(told, history_tier(jobs, schooled, as_of)), F.lit(0)).cast("int")


def level_label(low: Column, high: Column) -> Column:
    a, b = F.least(low, high), F.greatest(low, high)
    return F.when(b <= 0, "Fresher").when((a == 0) & (b <= 1), "0-1 years").when((b >= 15) & (a >= 5), "5+ years").otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string"), F.lit(" years")))


def experience_label(title: Column | str, description: Column | str) -> Column:
    """The tier's name, with the years that the text asks for."""
    hay = F.concat_ws(" ", X.text(title), X.text(description))
    label = M.tier_label(M.job_tier(title, description))
    found = [F.nullif(F.regexp_extract(hay, p, 1), F.lit("")) for p in (D.YEARS_EXPERIENCE, D.YEARS_REQUIRED)]
    return F.coalesce(F.concat(label, F.lit(" ("), F.coalesce(*found), F.lit("+ yrs)")), label)


def effective_place(run: Column, preferred: Column, own: Column) -> Column:
    """A run's place, else the preferred one, else the profile's own."""
    return F.coalesce(*[F.nullif(X.strip(c.cast("string")), F.lit("")) for c in (run, preferred, own)], F.lit(""))


def search_place(preference: Column | str) -> Column:
    """The first known city of a preference as `City, Region, Country`; an unknown place as it is."""
    parts = F.filter(F.transform(F.split(X.text(preference), r"[,;/|]+"), X.strip), lambda s: s != "")
    known = F.flatten(F.transform(parts, M.cities))
    spelt = {name: ", ".join(x for x in (T.CITY_SPELLINGS.get(name, name.title()), region.title(), country.title()) if x) for name, _, region, _, country, _ in D.CITIES}
    named = F.create_map(*[F.lit(x) for pair in spelt.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.try_element_at(known, F.lit(1))), X.strip(preference))


CONTACTS = ("email", "phone", "linkedin_url", "github_url", "portfolio_url")


def merged_contacts(own: dict[str, Column], source: Column | str) -> Column:
    """struct of the contacts: the profile's own, filled from a text where they are empty or not told."""
    return M.once(X.contacts(source), lambda found: F.struct(*[F.coalesce(F.nullif(X.strip(own[c]), F.lit("")), found[c]).alias(c) if c in own else found[c].alias(c) for c in CONTACTS]))


def truthful(claimed: Column, source: Column | str, fallback: Column) -> Column:
    """Claimed skills that share a word with the source; the fallback if none does."""
    split = lambda c: F.regexp_extract_all(F.lower(X.text(c)), F.lit(X.TOKEN), F.lit(0))
    own = F.filter(claimed, lambda s: F.arrays_overlap(split(s), split(source)))
    return F.when(F.size(own) > 0, own).otherwise(fallback)


def employed_at(jobs: Column, employers: Column) -> Column:
    """Jobs array<struct<company, ...>> at known employers or without one; all jobs if no employer is known."""
    known = F.transform(employers, F.lower)
    kept = F.filter(jobs, lambda j: (X.text(j["company"]) == "") | F.array_contains(known, F.lower(j["company"])))
    return F.when(F.size(employers) == 0, jobs).otherwise(kept)
