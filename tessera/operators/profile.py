"""The query object: one profile, kept on the driver, from which operators build literal expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.functions import dictionaries as D

_TOKEN = re.compile(r"[a-z0-9+#.]+")


def words(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text.lower()) if len(t) > 1]


@dataclass(frozen=True)
class Profile:
    skills: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    location: str = ""
    include_remote: bool = True
    tier: int = 1
    years_min: int = 0
    years_max: int = 2
    flex_years: int = 1
    allow_stretch: bool = False
    exclude_internships: bool = True
    strict_experience: bool = True
    technical: bool = True
    preferred: tuple[str, ...] = field(default=())
    focus: str = ""
    fields: tuple[str, ...] = ()

    def all_skills(self) -> list[str]:
        """Stripped, the first of those that differ only in case."""
        out: dict[str, str] = {}
        for s in self.skills:
            if s.strip():
                out.setdefault(s.strip().lower(), s.strip())
        return list(out.values())

    def terms(self) -> set[str]:
        found = {t for s in self.all_skills() for t in expand_skill(s)}
        return found | {t for r in (*self.roles, *self.preferred) for t in words(r)}

    def role_phrases(self) -> list[str]:
        return [r.strip() for r in (self.preferred or self.roles) if r.strip()] or ["software engineer"]


def expand_skill(skill: str) -> list[str]:
    """The skill, its words, and one step of aliases and related skills with theirs. The order is fixed: the skill itself, then
    longer terms first, then by letter; so a greedy count over it always gives the same."""
    base = skill.strip().lower()
    if not base:
        return []
    out = {base, *words(base)}
    for token in [*out]:
        for near in (*D.SKILL_ALIASES.get(token, ()), *D.SKILL_RELATED.get(token, ())):
            out |= {near, *words(near)}
    return [base, *sorted(out - {base}, key=lambda t: (-len(t), t))]


def canonical_skill(skill: str) -> str:
    key = skill.strip().lower()
    return next((name for name, near in D.SKILL_ALIASES.items() if key == name or key in near), key)


def canonical_skills(c: Column) -> Column:
    """canonical_skill of a column."""
    pairs = {near: name for name, others in reversed(D.SKILL_ALIASES.items()) for near in (name, *others)}
    key = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key), key)


def normal_place(text: str) -> str:
    return re.sub(r"[^a-z0-9\s]+", " ", text.lower()).strip()


def city_aliases() -> list[tuple[str, str]]:
    """(alias, city), longer aliases first."""
    owner: dict[str, str] = {}
    for name, aliases, *_ in D.CITIES:
        owner |= dict.fromkeys([name, *aliases], name)
    return sorted(owner.items(), key=lambda x: (-len(x[0]), x[0]))


def cities_in(text: str) -> list[str]:
    norm = f" {' '.join(normal_place(text).split())} "
    return list(dict.fromkeys(city for alias, city in city_aliases() if f" {alias} " in norm))


def place_parts(preference: str) -> list[str]:
    return [p.strip() for p in re.split(r"[,;/|]+", preference) if p.strip()]


def preferred_cities(preference: str) -> list[str]:
    return list(dict.fromkeys(c for part in place_parts(preference) for c in cities_in(part)))


def place_tokens(preference: str) -> set[str]:
    """Words and phrases in a place that count as a hit for the preference."""
    cities = set(preferred_cities(preference))
    if cities:
        return {t for name, aliases, region, regions, *_ in D.CITIES if name in cities for t in (name, *aliases, region, *regions) if t}
    parts = [normal_place(p) for p in place_parts(preference)]
    return {t for p in parts if p for t in (p, *[w for w in p.split() if len(w) > 2])}


def even_budget(total: int, ids: list[str]) -> dict[str, int]:
    """total over ids as even as can be, the remainder to the first; fewer than ids: one each for the first."""
    if not ids or total <= 0:
        return dict.fromkeys(ids, 0)
    return {s: total // len(ids) + (k < total % len(ids)) for k, s in enumerate(ids)}


def weighted_budget(total: int, weights: dict[str, float], least: int = 8) -> dict[str, int]:
    """total in proportion to weights, at least `least` each while that fits; the rest is evened out by weight."""
    if not weights or total <= 0:
        return dict.fromkeys(weights, 0)
    if total < least * len(weights):
        return even_budget(total, list(weights))
    share = {s: max(least, int(total * w / sum(weights.values()))) for s, w in weights.items()}
    low, high = sorted(weights, key=lambda s: weights[s]), sorted(weights, key=lambda s: -weights[s])
    while (gap := sum(share.values()) - total) != 0:
        for s in low if gap > 0 else high:
            if gap > 0 and share[s] > least:
                share[s] -= 1
                gap -= 1
            elif gap < 0:
                share[s] += 1
                gap += 1
            if not gap:
                break
    return share


def split_limit(limit: int, queries: int) -> list[int]:
    """A limit over queries, one each at least while the limit lasts."""
    return list(even_budget(limit, [str(k) for k in range(queries)]).values())


def split_limits(limit: Column, queries: Column) -> Column:
    """array<int>, split_limit of columns."""
    n, left = F.greatest(queries, F.lit(0)).cast("int"), F.greatest(limit, F.lit(0)).cast("int")
    share = lambda k: (F.floor(left / n) + (k <= left % n).cast("int")).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), share)).otherwise(F.array().cast("array<int>"))


class WeightedBudget:
    """A table function over the rows of one group (name, weight), of which there are as many as sources: (name, budget)."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, total: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or rows.dataType is None or {"name", "weight"} - set(rows.dataType.fieldNames()):
            raise ValueError("rows must be a table of name and weight")
        return AnalyzeResult(StructType([StructField("name", StringType()), StructField("budget", IntegerType())]))

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.total = self.least = 0

    def eval(self, rows: Row, total: int, least: int) -> None:
        self.weights[rows["name"]], self.total, self.least = rows["weight"], total, least

    def terminate(self) -> Iterator[tuple[str, int]]:
        yield from weighted_budget(self.total, dict(sorted(self.weights.items())), self.least).items()


def register_budget(spark: SparkSession) -> None:
    """weighted_budget(TABLE(...) PARTITION BY ..., total, least) in SQL."""
    spark.udtf.register("weighted_budget", udtf(WeightedBudget))
