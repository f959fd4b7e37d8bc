"""Predicates and inferences of one listing against one profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions.text import escaped, has_word, once, strip, text
from tessera.operators.profile import Profile, city_aliases, expand_skill, normal_place, place_tokens, preferred_cities


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _most_years(c: Column, upper: bool = False) -> Column:
    """The largest number of years that the patterns find in a text, of a range the lower or the upper end. All need digits before
    the word, and each some letters of its own, which are looked for first."""

    def search(low: Column) -> Column:
        each = [(D.YEARS_REQUIRED, 1, ["min", "at least", "require", "must have"]), (D.YEARS_EXPERIENCE, 1, ["experience"]), (D.YEARS_PLUS, 1, ["+"]), (D.YEARS_RANGE, 2 if upper else 1, ["-", "–"])]
        none = F.array().cast("array<string>")
        found = F.concat(*[F.when(any_of([low.contains(x) for x in parts]), F.regexp_extract_all(low, F.lit(p.removeprefix("(?i)")), F.lit(group))).otherwise(none) for p, group, parts in each])
        most = F.array_max(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))
        return F.when(low.contains("year") & low.rlike(r"\d\s*\+?\s*year"), most)

    return once(F.lower(c), search)


def required_years(c: Column) -> Column:
    """The largest of the least years that a text asks for; null without any."""
    return _most_years(c)


_ENTRY_PARTS = ["intern", "trainee", "junior", "jr", "entry", "associate", "grad", "fresher"]


def job_tier(title: Column | str, description: Column | str) -> Column:
    """0 to 5, the larger of what words and years say."""
    hay = F.concat_ws(" ", text(title), text(description))
    by_years = once(_most_years(hay, True), lambda y: F.when(y >= 10, 4).when(y >= 5, 3).when(y >= 3, 2).when(y >= 1, 1))

    def by_words(low: Column) -> Column:
        # a plain search first: whole words are looked for only where the letters stand
        part = lambda parts, pattern: any_of([low.contains(w) for w in parts]) & low.rlike(pattern)
        has = lambda words: part(words, r"\b(" + "|".join(words) + r")\b")
        entry = F.when(low.contains("intern"), 0).otherwise(1)
        return F.when(has(D.EXECUTIVE_WORDS), 5).when(has(D.LEAD_WORDS), 4).when(has(D.SENIOR_WORDS), 3).when(part(_ENTRY_PARTS, D.ENTRY_PATTERN), entry).otherwise(1)

    return F.greatest(once(F.lower(hay), by_words), F.coalesce(by_years, F.lit(0)))


def tier_fits(tier: Column, p: Profile) -> Column:
    extra = int(p.allow_stretch)
    low = 0 if p.tier <= 1 else max(0, p.tier - D.TIERS_BELOW.get(p.tier, 1) - extra)
    return once(tier, lambda t: t.between(low, p.tier + D.TIERS_ABOVE.get(p.tier, 1) + extra))


def years_fit(years: Column, p: Profile) -> Column:
    flex = max(0, p.flex_years) + int(p.allow_stretch)
    return years.isNull() | years.between(max(0, p.years_min - flex), p.years_max + flex)


def tier_label(tier: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, D.TIER_LABELS)), tier + 1), F.lit("Unknown"))


def skill_hits(c: Column, p: Profile) -> Column:
    """Skills with a term in a lower-case text. A term counts for the first skill that takes it."""
    lists = [[t for t in expand_skill(s) if len(t) > 2] for s in p.all_skills()]
    names = sorted({t for terms in lists for t in terms})
    if not names:
        return F.lit(0)
    found = F.array(*[c.contains(t) & has_word(c, t) for t in names])
    skills = F.array(*[F.array(*[F.lit(names.index(t)) for t in terms]).cast("array<int>") for terms in lists])
    kind = "struct<n:int,used:array<int>>"
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("used")).cast(kind)

    def count(hit: Column) -> Column:
        def take(acc: Column, terms: Column) -> Column:
            first = F.try_element_at(F.filter(terms, lambda k: hit[k] & ~F.array_contains(acc["used"], k)), F.lit(1))
            return F.when(first.isNull(), acc).otherwise(F.struct((acc["n"] + 1).alias("n"), F.concat(acc["used"], F.array(first)).alias("used")).cast(kind))

        return F.aggregate(skills, start, take, lambda acc: acc["n"])

    return once(found, count)  # not for each term of each skill


def overlap_percent(hits: Column, p: Profile) -> Column:
    n = len(p.all_skills())
    return F.least(F.lit(100), F.floor(hits * 100 / n).cast("int")) if n else F.lit(0)


def verified_skills(claimed: Column, p: Profile) -> Column:
    """Of claimed skills, those that share a term with the profile."""
    own = F.array(*[F.lit(t) for t in sorted(p.terms())] or [F.lit("")])
    aliases = {k: sorted({t for t in expand_skill(k)}) for k in {*D.SKILL_ALIASES, *D.SKILL_RELATED}}
    near = F.create_map(*[x for k, v in sorted(aliases.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def terms(s: Column) -> Column:
        low = F.lower(strip(s))
        each = F.array_distinct(F.concat(F.array(low), F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9+#.]+"), F.lit(0)), lambda t: F.length(t) > 1)))
        return F.concat(each, F.flatten(F.transform(each, lambda t: F.coalesce(F.try_element_at(near, t), F.array().cast("array<string>")))))

    return F.filter(claimed, lambda s: F.arrays_overlap(terms(s), own))


def enterprise_mismatch(c: Column, p: Profile) -> Column:
    """A stack in a lower-case text that no term of the profile holds."""
    own = p.terms()
    return any_of([c.contains(s) for s in D.ENTERPRISE_STACKS if not any(s in t for t in own)])


def role_fits(c: Column, title: Column, hits: Column, p: Profile) -> Column:
    """Any skill, a role's phrase, or a word of a role beside a word of technical work; texts in lower case."""
    phrases = any_of([c.contains(r.lower()) for r in p.role_phrases()])
    tokens = sorted({t for r in p.role_phrases() for t in r.lower().split() if len(t) > 2 and t not in ("level", "mid")})
    beside = any_of([c.contains(t) & has_word(c, t) for t in tokens]) & any_of([c.contains(w) for w in D.TECH_ROLE_WORDS])
    return (hits >= 1) | phrases | beside


def normal(c: Column | str) -> Column:
    """A place in lower case, runs of other characters as a space."""
    return strip(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]+", " "))


def cities(c: Column | str) -> Column:
    """Known cities that a place names, longer names first."""
    norm = F.concat(F.lit(" "), F.regexp_replace(normal(c), r"\s+", " "), F.lit(" "))
    hits = [F.when(norm.contains(f" {alias} "), F.lit(city)) for alias, city in city_aliases()]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def is_remote(c: Column | str) -> Column:
    return any_of([normal(c).contains(t) for t in D.REMOTE_TERMS])


def place_matches(c: Column | str, preference: str) -> Column:
    norm, wanted = normal(c), normal_place(preference)
    if not wanted:
        return F.lit(False)
    whole = lambda t: norm.rlike(rf"(^|\s){escaped(t)}(\s|$)")
    either = norm.contains(wanted) | F.lit(wanted).contains(norm)
    known = preferred_cities(preference)
    same = F.arrays_overlap(cities(c), F.array(*map(F.lit, known))) if known else F.lit(False)
    tokens = [whole(t) | (norm.contains(t) if len(t) >= 4 else F.lit(False)) for t in sorted(place_tokens(preference)) if len(t) > 2]
    regions = [whole(r) for name, _, region, more, _, country in D.CITIES if name in known for r in sorted({region, *more} - {""}) if r not in country]
    return (norm != "") & (either | same | any_of(tokens) | any_of(regions))


def place_fits(c: Column | str, p: Profile) -> Column:
    if not p.location.strip():
        return F.lit(True)
    return F.when(is_remote(c), F.lit(p.include_remote)).when(strip(c) == "", F.lit(p.include_remote)).otherwise(place_matches(c, p.location))


def is_internship(title: Column | str, description: Column | str) -> Column:
    blob = F.lower(F.concat_ws(" ", text(title), F.substring(text(description), 1, 200)))
    return blob.contains("intern") | blob.contains("trainee")


def is_sales(title: Column | str) -> Column:
    return text(title).rlike(D.SALES_PATTERN)


def is_leadership(title: Column | str) -> Column:
    return F.lower(text(title)).rlike(D.LEADERSHIP_PATTERN)
