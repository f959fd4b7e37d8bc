"""Career fields: which fields a listing or a profile belongs to, and what a profile searches for.

Listing rules take one Profile and are column expressions over listings. Profile rules are column expressions over rows of
profiles (skills, roles, focus ... as columns), so that any number of profiles is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import taxonomy as T
from tessera.functions.text import dedup_words, has_word, strip
from tessera.operators import matching as M
from tessera.operators.profile import Profile, expand_skill, words

FIELDS = T.FIELDS


def has_term(c: Column, term: str) -> Column:
    """The term as a whole word in a lower-case text; of short words only the listed ones count."""
    if len(term) < 2 or (len(term) == 2 and term not in T.SHORT_TERMS):
        return F.lit(False)
    return c.contains(term) & has_word(c, term)


def keyword_hits(c: Column, keywords: list[str]) -> Column:
    """How many keywords a lower-case text holds: phrases anywhere, words as whole words."""
    return sum(((c.contains(k) if " " in k else has_term(c, k)).cast("int") for k in keywords), F.lit(0))


def is_tech_title(title: Column) -> Column:
    return M.any_of([has_term(title, w) for w in T.TITLE_WORDS])


def _all_terms(c: Column, terms: list[str]) -> Column:
    out = F.lit(bool(terms))
    for t in terms:
        out = out & has_term(c, t)
    return out


def in_field(name: str, title: Column, hay: Column, p: Profile) -> Column:
    """Whether a listing belongs to a field; title and hay (title, description and skills) in lower case."""
    f = FIELDS[name]
    in_title, in_hay = keyword_hits(title, f.keywords), keyword_hits(hay, f.keywords)
    roles = [r for r in (*p.preferred, *p.roles) if r.strip()]
    if name == "software":
        return is_tech_title(title) | (in_hay >= 1)
    if name == "aiml":
        other = M.any_of([title.rlike(x) for x in T.NOT_AIML_TITLES])
        phrases = M.any_of([title.contains(r.lower().strip()) for r in roles if len(r.strip()) > 5])
        tokens = M.any_of([_all_terms(title, words(r)[:3]) for r in roles if len(words(r)) >= 2])
        named = has_term(title, "ml") | title.contains("machine learning")
        rest = F.when(((in_title >= 1) & is_tech_title(title)) | phrases | tokens, True).when(named, is_tech_title(title)).otherwise(in_hay >= 2)
        return F.when((in_title == 0) & other, False).otherwise(rest)
    label = [t for t in words(f.label) if len(t) >= 3]
    role = M.any_of([_all_terms(hay, words(r)[:3]) for r in roles]) & M.any_of([has_term(hay, t) for t in label])
    return (in_title >= 1) | (in_hay >= 2) | role


def in_any_field(names: list[str], title: Column, hay: Column, p: Profile) -> Column:
    return M.any_of([in_field(n, title, hay, p) for n in names if n in FIELDS])


def title_score(names: list[str], title: Column) -> Column:
    """0 to 1, the best of the fields: a phrase of it 1, two keywords 0.95, one 0.8, a technical title 0.7 for general software."""
    best = [F.lit(0.0)]
    for n in names:
        hits = keyword_hits(title, FIELDS[n].keywords)
        tech = is_tech_title(title) if n == "software" else F.lit(False)
        phrase = M.any_of([title.contains(k) for k in FIELDS[n].keywords if " " in k])
        best.append(F.when(phrase, 1.0).when(hits >= 2, 0.95).when(hits == 1, 0.8).when(tech, 0.7).otherwise(0.0))
    return F.greatest(*best, F.lit(0.0))


def looks(blob: Column) -> Column:
    """The family of roles of a profile's text in lower case: aiml, data or software."""
    has = lambda marks: M.any_of([blob.contains(m) for m in marks])
    return F.when(has(T.AIML_MARKERS), "aiml").when(has(T.DATA_MARKERS), "data").otherwise("software")


def profile_family(p: Profile) -> str:
    blob = " ".join([*p.skills, *p.preferred, *p.roles]).lower()
    return "aiml" if any(m in blob for m in T.AIML_MARKERS) else "data" if any(m in blob for m in T.DATA_MARKERS) else "software"


def fields_of(p: Profile) -> list[str]:
    """The focus, else the chosen fields that are known, else those with a signal in the profile, else general software."""
    if p.focus in FIELDS:
        return [p.focus]
    blob = " ".join([*p.roles, *p.preferred, *p.skills]).lower()
    return [f for f in p.fields if f in FIELDS] or [n for n, f in FIELDS.items() if any(s in blob for s in f.signals)] or ["software"]


def near_roles(p: Profile) -> list[str]:
    """The profile's roles, then those of its focus or family."""
    more = FIELDS[p.focus].search if p.focus in FIELDS else T.ROLE_FAMILIES[profile_family(p)]
    out: dict[str, str] = {}
    for r in (*p.role_phrases(), *more):
        out.setdefault(" ".join(r.split()).lower(), " ".join(r.split()))
    return list(out.values())


def role_fits(title: Column, hay: Column, hits: Column, p: Profile) -> Column:
    """With a focus, whether the listing is in that field; else any skill, a near role's phrase, a title of the family of data or
    machine learning, or a word of a role beside one of technical work. Texts in lower case."""
    if p.focus in FIELDS:
        return in_field(p.focus, title, hay, p)
    phrases = M.any_of([hay.contains(r.lower()) for r in near_roles(p)[:12]])
    hinted = M.any_of([title.contains(h) for h in T.TITLE_HINTS]) if profile_family(p) != "software" else F.lit(False)
    return phrases | hinted | M.role_fits(hay, title, hits, p)


def is_kept(hay: Column, hits: Column, p: Profile) -> Column:
    """What a source keeps: a skill or a near role; with a focus, a hint of the field or a skill of the profile that is one."""
    if p.focus not in FIELDS:
        return (strip(hay) != "") & ((hits >= 1) | M.any_of([hay.contains(r.lower()) for r in near_roles(p)[:8]]))
    hints = [k.lower() for k in FIELDS[p.focus].keywords]
    mine = [s for s in p.all_skills() if any(h in s.lower() or s.lower() in h for h in hints)]
    terms = sorted({t for s in mine for t in (s.lower(), *expand_skill(s)) if len(t) > 2})
    return M.any_of([hay.contains(h) for h in hints]) | M.any_of([hay.contains(t) & has_word(hay, t) for t in terms])


# ---------------------------------------------------------------- rows of profiles


def _texts(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda s: s != "")


def _lits(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def roles_of(preferred: Column, role: Column) -> Column:
    """Preferred roles, else the role, else a software engineer's."""
    own = lambda r: F.when(r != "", F.array(r)).otherwise(_lits(["software engineer"]))
    return M.once(_texts(preferred), lambda p: F.when(F.size(p) > 0, p).otherwise(M.once(strip(role), own)))


def inferred_fields(blob: Column) -> Column:
    """Fields with a signal in the profile's text in lower case, in order; general software without any."""
    found = F.array_compact(F.array(*[F.when(M.any_of([blob.contains(s) for s in f.signals]), F.lit(n)) for n, f in FIELDS.items() if f.signals]))
    return F.when(F.size(found) > 0, found).otherwise(_lits(["software"]))


def effective_fields(focus: Column, chosen: Column, blob: Column) -> Column:
    """The focus, else the chosen fields that are known, else the inferred ones."""
    known = F.filter(F.coalesce(chosen, F.array().cast("array<string>")), lambda f: f.isin(*FIELDS))
    one = F.lower(strip(focus))
    return F.when(one.isin(*FIELDS), F.array(one)).when(F.size(known) > 0, known).otherwise(inferred_fields(blob))


def field_labels(names: Column) -> Column:
    return F.array_compact(F.transform(names, lambda n: F.element_at(F.create_map(*[F.lit(x) for k, f in FIELDS.items() for x in (k, f.label)]), n)))


def _of_focus(focus: Column, pick: str) -> Column:
    """The list that a field has under that name; empty without a focus."""
    lists = F.create_map(*[x for n, f in FIELDS.items() for x in (F.lit(n), _lits(getattr(f, pick)))])
    return F.coalesce(F.try_element_at(lists, F.lower(strip(focus))), F.array().cast("array<string>"))


def adjacent_roles(preferred: Column, role: Column, focus: Column, blob: Column) -> Column:
    """The roles, then those of the focus, else of the family."""
    family = looks(blob)
    near = F.when(family == "aiml", _lits(T.ROLE_FAMILIES["aiml"])).when(family == "data", _lits(T.ROLE_FAMILIES["data"])).otherwise(_lits(T.ROLE_FAMILIES["software"]))
    of_focus = _of_focus(focus, "search")
    return dedup_words(F.concat(roles_of(preferred, role), F.when(F.size(of_focus) > 0, of_focus).otherwise(near)))


def searched_skills(skills: Column, focus: Column, limit: int = 10) -> Column:
    """Skills to search for: those of the focus first, then the others, then what the catalog has in common with them."""

    def told(of: Column) -> Column:
        own, low, hints = of["own"], of["low"], of["hints"]
        near = F.filter(own, lambda s, k: M.once(F.get(low, k), lambda x: F.exists(hints, lambda h: x.contains(h) | h.contains(x))))
        catalog = F.when(F.size(hints) > 0, hints).otherwise(_lits(T.CATALOG))
        known = F.filter(catalog, lambda k: F.exists(low, lambda s: s.contains(k)))
        clean = F.transform(F.concat(near, own, known), lambda s: F.regexp_replace(s, r"\s+", " "))
        usable = F.filter(clean, lambda s: (F.length(s) >= 2) & ~F.lower(s).isin(*T.NOT_SEARCHED))
        return F.slice(dedup_words(usable), 1, limit)

    hints = F.transform(_of_focus(focus, "keywords"), F.lower)
    return M.once(_texts(skills), lambda own: M.once(F.struct(own.alias("own"), F.transform(own, F.lower).alias("low"), hints.alias("hints")), told))


def search_queries(skills: Column, preferred: Column, role: Column, focus: Column, tier: Column, most: int = 6) -> Column:
    """At most `most` (1 to 8) searches: the focus' roles and terms, the roles (as a junior up to tier 1), skills, skills with a
    role, and the first skills together. Each part is told once."""
    most = max(1, min(8, most))
    step, none = "struct<out:array<string>,full:boolean>", F.array().cast("array<string>")

    def add(acc: Column, s: Column) -> Column:
        met = F.exists(acc["out"], lambda q: F.lower(q) == F.lower(s))
        grow = lambda grown: F.struct(grown.alias("out"), (F.size(grown) >= most - 1).alias("full")).cast(step)
        return F.when(acc["full"], acc).otherwise(M.once(F.when(met, acc["out"]).otherwise(F.concat(acc["out"], F.array(s))), grow))

    def first(of: Column) -> Column:
        as_junior = F.flatten(F.transform(F.slice(of["roles"], 1, 3), lambda r: F.when(of["tier"] <= 1, F.array(F.concat(F.lit("junior "), r), r)).otherwise(F.array(r))))
        return dedup_words(F.concat(of["focus"], as_junior))

    def rest(of: Column, begun: Column) -> Column:
        roles, terms = of["roles"], of["terms"]
        with_skills = F.aggregate(terms, F.struct(begun.alias("out"), F.lit(False).alias("full")).cast(step), add, lambda acc: acc["out"])
        pair = lambda k: F.when(F.size(terms) >= k, F.array(F.concat_ws(" ", F.try_element_at(terms, F.lit(k)), roles[0]))).otherwise(none)
        blend = F.when(F.size(terms) >= 2, F.array(F.array_join(F.slice(terms, 1, 3), " "))).otherwise(none)
        return dedup_words(F.concat(with_skills, pair(1), pair(2), blend))

    parts = F.struct(roles_of(preferred, role).alias("roles"), searched_skills(skills, focus).alias("terms"), F.slice(_of_focus(focus, "search"), 1, 2).alias("focus"), tier.alias("tier"))
    return M.once(parts, lambda of: M.once(first(of), lambda begun: F.slice(F.when(F.size(begun) >= most, begun).otherwise(rest(of, begun)), 1, most)))


def field_queries(fields: Column, preferred: Column, role: Column, tier: Column) -> Column:
    """Roles, then the search terms of all fields, and for newcomers to machine learning three more."""
    terms = F.flatten(F.transform(fields, lambda n: F.coalesce(F.try_element_at(F.create_map(*[x for k, f in FIELDS.items() for x in (F.lit(k), _lits(f.search))]), n), F.array().cast("array<string>"))))
    more = F.when(F.array_contains(fields, "aiml") & (tier <= 1), _lits(["junior machine learning engineer", "graduate AI engineer", "entry level ML engineer"])).otherwise(F.array().cast("array<string>"))
    return dedup_words(F.concat(roles_of(preferred, role), terms, more))


# ---------------------------------------------------------------- phrases


def has_tech_token(c: Column) -> Column:
    return c.rlike(T.TECH_TOKEN)


def is_sales_phrase(c: Column | str) -> Column:
    """A phrase of sales work; one that names a product counts only if it is of selling itself."""
    low = F.lower(strip(c))
    any_in = lambda marks: M.any_of([low.contains(m) for m in marks])
    return any_in(T.SALES_PHRASES) & (~has_tech_token(low) | any_in(T.SALES_ALWAYS))


def is_soft_phrase(c: Column | str) -> Column:
    """A blank, a soft skill, a phrase of sales, or long prose without a product or years."""
    low = F.lower(strip(c))
    prose = (F.length(low) > 60) & ~has_tech_token(low) & ~low.rlike(T.YEARS_GAP)
    return (low == "") | M.any_of([low.contains(m) for m in T.SOFT_PHRASES]) | is_sales_phrase(c) | prose


def is_missing_skill(c: Column | str, p: Profile, blob: str = "") -> Column:
    """Whether a phrase names a skill that a profile may be said to lack: it is technical, isn't covered by the profile, and isn't long
    prose. Case doesn't matter. blob is the profile's text."""
    english = "english" in blob.lower()

    def judged(s: Column) -> Column:
        told = ~is_soft_phrase(s) & ~((F.length(s) > 60) & ~s.rlike(T.YEARS_GAP))
        told = told & ~F.lower(s).contains("english") if english else told
        return told & (F.size(M.verified_skills(F.array(s), p)) == 0)

    return M.once(strip(c), judged)


def missing_skills(claimed: Column, p: Profile, blob: str = "") -> Column:
    """Of skills that a profile is said to lack, those that it may be said to; the first of those that differ only in case."""
    return F.filter(dedup_words(claimed), lambda s: is_missing_skill(s, p, blob))


def is_technical(blob: Column) -> Column:
    """A profile of machine-learning work without marks of sales."""
    sales = blob.rlike(D.SALES_PATTERN) | M.any_of([F.lower(blob).contains(w) for w in T.SALES_WORDS])
    return blob.rlike(T.AIML_WORK) & ~sales
