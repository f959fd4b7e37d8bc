"""The registered queries: operators on the given tables, and SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import taxonomy
from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.operators import filters, matching, reporting, retrieval, scoring, state
from tessera.operators.profile import city_aliases, expand_skill, place_tokens, preferred_cities
from tessera.plans import listings as L
from tessera.session import shared_folder, spread
from tessera.sources import readers
from tessera.streaming import notices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _strip(c: str) -> str:
    return _STRIP.format(c)


def _word(t: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_]){X.escaped(t)}([^\p{{L}}\p{{N}}_]|$)"


def _any(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions or ["FALSE"]) + ")"


# ---------------------------------------------------------------- text


@query(f"SELECT page_id, sha256({_strip("replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ')")}) AS text_sha256, CAST(length({_strip("replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ')")}) AS INTEGER) AS n_chars FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01."""
    pages = table(spark, sf_dir, "pages").select("page_id", X.strip_html("html").alias("t"))
    return pages.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").alias("n_chars"))


@query(f"WITH {L.SQL} SELECT content_hash, min(seq) AS seq, count(*) AS copies FROM l GROUP BY content_hash")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P02, D01."""
    rows = L.listings(spark, sf_dir).select("content_hash", "seq")
    kept = state.first_of(rows, "content_hash")
    return kept.join(rows.groupBy("content_hash").agg(F.count("*").alias("copies")), "content_hash").select("content_hash", "seq", "copies")


@query(r"""SELECT page_id, CASE WHEN starts_with(lower(trim(url)), 'http') THEN 'url:' || regexp_replace(split_part(lower(trim(url)), '?', 1), '/+$', '') ELSE 'ct:|' END AS identity,
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) ||
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)', 1), '/+$', '') AS bare FROM pages""")
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P03, P06."""
    return table(spark, sf_dir, "pages").select("page_id", X.identity_key("url", F.lit(""), F.lit("")).alias("identity"), X.bare_url("url").alias("bare"))


@query(rf"""SELECT doc_id, coalesce(regexp_extract(text, '{D.EMAIL}', 0), '') AS email, coalesce(regexp_extract(text, '{D.PHONE}', 0), '') AS phone FROM documents""")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    return table(spark, sf_dir, "documents").select("doc_id", X.contacts("text").alias("c")).select("doc_id", "c.email", "c.phone")


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#.]+'), lambda x: length(x) > 1))) AS term FROM documents)
SELECT term, count(*) AS df FROM t GROUP BY term""")
def tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18, G09."""
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(X.tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"""WITH s AS (SELECT page_id, html, {' + '.join(f"CAST(regexp_matches(substring(html, 1, 8000), '(?i){p}') AS INTEGER)" for p in D.CHALLENGE_PATTERNS)} AS hits FROM pages)
SELECT page_id, hits, CASE WHEN length(html) < 2500 THEN hits >= 1 ELSE hits >= 2 END AS challenge FROM s""")
def challenge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26."""
    return table(spark, sf_dir, "pages").select("page_id", X.challenge_hits("html").alias("hits"), X.is_challenge("html").alias("challenge"))


@query(rf"""WITH {L.SQL}, h AS (SELECT seq, lower(description || ' ' || location) AS a, lower(title || ' ' || description) AS b FROM l)
SELECT seq, CASE WHEN regexp_extract(a, '{D.REMOTE_POLICY}', 1) <> '' THEN regexp_extract(a, '{D.REMOTE_POLICY}', 1) WHEN contains(a, 'remote') THEN 'remote' ELSE '' END AS remote_policy,
  regexp_extract(b, '{D.EMPLOYMENT}', 1) AS employment_type FROM h""")
def inferred_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P09, P10."""
    return L.listings(spark, sf_dir).select("seq", X.remote_policy("description", "location").alias("remote_policy"), X.employment_type("description", "title").alias("employment_type"))


@query(rf"""WITH {L.SQL} SELECT seq, substring(sha256(regexp_replace(regexp_replace(lower(title || '|' || company || '|' || substring(description, 1, 800) || '|' || coalesce(strftime(posted_at, '%Y-%m-%d %H:%M:%S'), '')), '\s+', ' ', 'g'), '^ | $', '', 'g')), 1, 24) AS fingerprint FROM l""")
def listing_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P07."""
    return L.listings(spark, sf_dir).select("seq", X.fingerprint("title", "company", "description", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss")).alias("fingerprint"))


_SECTIONED = "'Intro' || chr(10) || 'Requirements:' || chr(10) || text || chr(10) || 'Nice to have' || chr(10) || 'Patience'"


def _section(mode: str) -> str:
    return f"""coalesce({_strip(f"string_agg(line, chr(10) ORDER BY k) FILTER (WHERE head IS NULL AND mode = '{mode}')")}, '')"""


@query(rf"""WITH t AS (SELECT doc_id, regexp_split_to_array({_SECTIONED}, '\r\n|\r|\n') AS x FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS k FROM t),
h AS (SELECT *, CASE WHEN regexp_matches({_strip('line')}, '{D.REQUIREMENTS_HEADER}') THEN 'requirements' WHEN regexp_matches({_strip('line')}, '{D.NICE_HEADER}') THEN 'nice' END AS head FROM u),
m AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), 'body') AS mode FROM h)
SELECT doc_id, {_section('body')} AS body, sha256({_section('requirements')}) AS requirements_sha256, {_section('nice')} AS nice FROM m GROUP BY doc_id""")
def listing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a text with headers put around its lines."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    text = F.concat(F.lit("Intro\nRequirements:\n"), "text", F.lit("\nNice to have\nPatience"))
    return docs.select("doc_id", X.listing_sections(text).alias("s")).select("doc_id", "s.body", F.sha2("s.requirements", 256).alias("requirements_sha256"), "s.nice")


# ---------------------------------------------------------------- time

_AGE = f"(epoch_us(TIMESTAMP '{L.AS_OF_TEXT}') - epoch_us({{}})) / 86400000000.0"
_CLASS = f"CASE WHEN posted_at IS NULL THEN 'unknown' WHEN {_AGE.format('posted_at')} <= 7 THEN 'likely' ELSE 'stale' END"
_RECENCY = f"coalesce(greatest(0.0, least(1.0, 1 - ({_AGE.format('posted_at')} - 2) / 28)), 0.0)"


@query(f"""WITH {L.SQL} SELECT seq, {_CLASS} AS hiring_class, round({_RECENCY}, 6) AS recency,
  CASE WHEN {_AGE.format('coalesce(posted_at, scraped_at)')} * 24 <= 48 THEN 5 ELSE 0 END AS bonus FROM l""")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T06, T08, T09."""
    at = L.as_of()
    posted, scraped = F.col("posted_at"), F.col("scraped_at")
    return L.listings(spark, sf_dir).select("seq", T.hiring_class(posted, at).alias("hiring_class"), F.round(T.recency_score(posted, scraped, at), 6).alias("recency"), T.recency_bonus(posted, scraped, at).alias("bonus"))


@query(f"""WITH {L.SQL}, c AS (SELECT seq, title, posted_at, CAST(seq * 37 % 101 AS INTEGER) AS match_score, {_CLASS} AS hiring_class FROM l)
SELECT seq, match_score, hiring_class FROM c ORDER BY CASE hiring_class WHEN 'likely' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, match_score DESC, posted_at DESC NULLS LAST, seq LIMIT 10 OFFSET 10""")
def hiring_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page."""
    rows = L.listings(spark, sf_dir).select("seq", "posted_at", (F.col("seq") * 37 % 101).cast("int").alias("match_score"))
    rows = reporting.by_hiring(rows, L.as_of())
    order = [F.col("hiring_order"), F.desc("match_score"), F.desc_nulls_last("posted_at"), F.col("seq")]
    return reporting.page(order, rows, 2).select("seq", "match_score", "hiring_class")


@query(r"""WITH p AS (SELECT event_id, CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN 'Posted today' WHEN 1 THEN 'yesterday' WHEN 2 THEN (event_id % 28 + 1) || ' days ago' WHEN 3 THEN (event_id % 9 + 1) || ' weeks ago' ELSE 'no date' END AS said FROM events)
SELECT event_id, CASE WHEN said = 'Posted today' THEN 0 WHEN said = 'yesterday' THEN 1 WHEN said LIKE '%days ago' THEN CAST(regexp_extract(said, '\d+') AS INTEGER) WHEN said LIKE '%weeks ago' THEN 7 * CAST(regexp_extract(said, '\d+') AS INTEGER) END AS days FROM p""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T03."""
    n = F.col("event_id")
    said = F.when(n % 5 == 0, "Posted today").when(n % 5 == 1, "yesterday").when(n % 5 == 2, F.concat((n % 28 + 1).cast("string"), F.lit(" days ago"))).when(n % 5 == 3, F.concat((n % 9 + 1).cast("string"), F.lit(" weeks ago"))).otherwise("no date")
    return table(spark, sf_dir, "events").select("event_id", T.age_days(T.relative_date(said, L.as_of()), L.as_of()).cast("int").alias("days"))


@query("SELECT event_type, count(*) FILTER (WHERE NOT (hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 420)) AS loud, count(*) FILTER (WHERE hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 420) AS quiet FROM events GROUP BY event_type")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """22:00 to 07:00."""
    quiet = T.in_quiet_hours(F.hour("ts") * 60 + F.minute("ts"), 22 * 60, 7 * 60)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(~quiet).alias("loud"), F.count_if(quiet).alias("quiet"))


# ---------------------------------------------------------------- matching

P = L.PROFILE
_HAY = "lower(title || ' ' || description || ' ' || '' || ' ' || array_to_string(skills, ' '))"
_HITS = " + ".join(f"CAST({_any([f"CASE WHEN contains(hay, '{t}') THEN regexp_matches(hay, '{_word(t)}') ELSE FALSE END" for t in expand_skill(s) if len(t) > 2])} AS INTEGER)" for s in P.all_skills())


@query(f"""WITH {L.SQL}, h AS (SELECT seq, {_HAY} AS hay FROM l), n AS (SELECT seq, {_HITS} AS hits FROM h)
SELECT seq, hits, CAST(least(100, floor(hits * 100 / {len(P.all_skills())})) AS INTEGER) AS overlap FROM n""")
def skill_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X01, X06, X07. The profile's skills share no term, so that SQL can count them apart."""
    hay = F.lower(F.concat_ws(" ", "title", "description", "requirements", F.array_join("skills", " ")))
    rows = L.listings(spark, sf_dir).select("seq", hay.alias("hay")).select("seq", matching.skill_hits(F.col("hay"), P).alias("hits"))
    return rows.select("seq", "hits", matching.overlap_percent(F.col("hits"), P).alias("overlap"))


def _years(hay: str, upper: bool) -> str:
    found = [(D.YEARS_REQUIRED, 1), (D.YEARS_EXPERIENCE, 1), (D.YEARS_PLUS, 1), (D.YEARS_RANGE, 2 if upper else 1)]
    lists = ", ".join(f"regexp_extract_all({hay}, '{p}', {g})" for p, g in found)
    return f"list_max(list_transform(flatten([{lists}]), lambda x: TRY_CAST(x AS INTEGER)))"


def _words(words: list[str]) -> str:
    return rf"regexp_matches(low, '\b({'|'.join(words)})\b')"


_TIERS = rf"""x AS (SELECT *, title || ' ' || description AS hay, lower(title || ' ' || description) AS low FROM l),
y AS (SELECT *, {_years("(hay || ' ')", False)} AS years, {_years("hay", True)} AS top_years FROM x),
t AS (SELECT *, greatest(
    CASE WHEN {_words(D.EXECUTIVE_WORDS)} THEN 5 WHEN {_words(D.LEAD_WORDS)} THEN 4 WHEN {_words(D.SENIOR_WORDS)} THEN 3
      WHEN regexp_matches(low, '{D.ENTRY_PATTERN}') THEN CASE WHEN contains(low, 'intern') THEN 0 ELSE 1 END ELSE 1 END,
    coalesce(CASE WHEN top_years >= 10 THEN 4 WHEN top_years >= 5 THEN 3 WHEN top_years >= 3 THEN 2 WHEN top_years >= 1 THEN 1 END, 0)) AS tier FROM y)"""


@query(f"WITH {L.SQL}, {_TIERS} SELECT seq, years, tier, ({L._list(D.TIER_LABELS)})[tier + 1] AS label FROM t")
def tier_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21, X22, X26."""
    rows = L.listings(spark, sf_dir)
    rows = rows.select("seq", matching.required_years(F.concat_ws(" ", "title", "description", "requirements")).alias("years"), matching.job_tier("title", "description").alias("tier"))
    return rows.withColumn("label", matching.tier_label(F.col("tier")))


_PLACE = "trim(regexp_replace(lower(location), '[^a-z0-9\\s]+', ' ', 'g'))"
_CITIES = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(' ' || regexp_replace(place, '\\s+', ' ', 'g') || ' ', ' {a} ') THEN '{c}' END" for a, c in city_aliases()) + "], lambda x: x IS NOT NULL))"
_REMOTE = _any([f"contains(place, '{t}')" for t in D.REMOTE_TERMS])
_TOKENS = _any([f"regexp_matches(place, '(^|\\s){X.escaped(t)}(\\s|$)')" + (f" OR contains(place, '{t}')" if len(t) >= 4 else "") for t in sorted(place_tokens(P.location)) if len(t) > 2])
_WANTED = "bangalore  mumbai"
_MATCH = f"(place <> '' AND (contains(place, '{_WANTED}') OR contains('{_WANTED}', place) OR len(list_intersect({_CITIES}, {L._list(preferred_cities(P.location))})) > 0 OR {_TOKENS}))"
_FITS = f"CASE WHEN {_REMOTE} THEN TRUE WHEN place = '' THEN TRUE ELSE {_MATCH} END"


@query(f"WITH {L.SQL}, p AS (SELECT seq, {_PLACE} AS place FROM l) SELECT seq, {_REMOTE} AS remote, array_to_string(list_sort({_CITIES}), ',') AS cities, {_FITS} AS fits FROM p")
def location_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F03, F04, F05, X18."""
    rows = L.listings(spark, sf_dir)
    return rows.select("seq", matching.is_remote("location").alias("remote"), F.array_join(F.array_sort(matching.cities("location")), ",").alias("cities"), matching.place_fits("location", P).alias("fits"))


_ROLE = _any([f"contains(hay2, '{r}')" for r in P.role_phrases()])
_ROLE_WORDS = _any([f"CASE WHEN contains(hay2, '{t}') THEN regexp_matches(hay2, '{_word(t)}') ELSE FALSE END" for t in sorted({w for r in P.role_phrases() for w in r.split() if len(w) > 2})])
_TECH = _any([f"contains(hay2, '{w}')" for w in D.TECH_ROLE_WORDS])
_NEAR = _any([f"contains(hay2, '{r.lower()}')" for r in [*P.role_phrases(), *taxonomy.ROLE_FAMILIES["aiml"]][:12]] + [f"contains(lower(title), '{h}')" for h in taxonomy.TITLE_HINTS])
_STACKS = _any([f"contains(hay2, '{s}')" for s in D.ENTERPRISE_STACKS if not any(s in t for t in P.terms())])
_REASONS = f"""{_TIERS}, u AS (SELECT *, {_HAY} AS hay2, {_PLACE} AS place, row_number() OVER (PARTITION BY content_hash ORDER BY seq) AS copy FROM t),
r AS (SELECT seq, CASE WHEN copy > 1 THEN 'duplicate'
  WHEN contains(lower(title || ' ' || substring(description, 1, 200)), 'intern') OR contains(lower(title || ' ' || substring(description, 1, 200)), 'trainee') THEN 'internship'
  WHEN NOT (tier BETWEEN 0 AND 2 AND (years IS NULL OR years BETWEEN 0 AND 4)) THEN 'experience_mismatch'
  WHEN {_STACKS} THEN 'enterprise_stack'
  WHEN NOT (({_HITS.replace("(hay, ", "(hay2, ")}) >= 1 OR {_ROLE} OR {_NEAR} OR ({_ROLE_WORDS} AND {_TECH})) THEN 'role_mismatch'
  WHEN NOT ({_FITS}) THEN 'location_mismatch' END AS reject_reason FROM u)"""


@query(f"WITH {L.SQL}, {_REASONS} SELECT seq, reject_reason FROM r")
def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01, F02, F03, F06, F07, F09, F10."""
    return filters.with_reason(L.listings(spark, sf_dir), P).select("seq", "reject_reason")


@query(f"WITH {L.SQL}, {_REASONS} SELECT reject_reason, count(*) AS n FROM r WHERE reject_reason IS NOT NULL GROUP BY reject_reason")
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01."""
    return filters.reason_counts(filters.with_reason(L.listings(spark, sf_dir), P))


def _holds(c: str, k: str) -> str:
    """A keyword: a phrase anywhere, a word as a whole."""
    if " " in k:
        return f"contains({c}, '{k}')"
    return f"(contains({c}, '{k}') AND regexp_matches({c}, '{_word(k)}'))" if len(k) > 2 or k in taxonomy.SHORT_TERMS else "FALSE"


def _n_keywords(c: str, field: str) -> str:
    return "(" + " + ".join(f"CAST({_holds(c, k)} AS INTEGER)" for k in taxonomy.FIELDS[field].keywords) + ")"


def _tech_title(c: str) -> str:
    return _any([_holds(c, w) for w in taxonomy.TITLE_WORDS])


def _field_title(field: str, c: str = "lower(title)") -> str:
    phrase = _any([f"contains({c}, '{k}')" for k in taxonomy.FIELDS[field].keywords if " " in k])
    tech = f" WHEN {_tech_title(c)} THEN 0.7" if field == "software" else ""
    return f"CASE WHEN {phrase} THEN 1.0 WHEN {_n_keywords(c, field)} >= 2 THEN 0.95 WHEN {_n_keywords(c, field)} = 1 THEN 0.8{tech} ELSE 0.0 END"


_TITLE_PHRASE = _any([f"contains(lower(title), '{r}')" for r in P.role_phrases()])
_TITLE_FAMILY = _any([f"contains(lower(title), '{w}')" for w in ("engineer", "developer", "scientist", "analyst", "architect")])
# the profile names machine learning and PyTorch, data science, and Kubernetes
_TITLE_FIELDS = f"greatest({', '.join(_field_title(f) for f in ('aiml', 'data_science', 'devops'))})"
_TITLE_PART = f"CASE WHEN {_TITLE_PHRASE} THEN 1.0 WHEN {_TITLE_FIELDS} > 0 THEN {_TITLE_FIELDS} WHEN {_TITLE_FAMILY} THEN 0.7 ELSE 0.0 END"
_SENIORITY = f"CASE abs(tier - {P.tier}) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.35 ELSE 0.0 END"
_LOCATION = f"CASE WHEN {_REMOTE} THEN 1.0 WHEN place = '' THEN 0.4 WHEN {_MATCH} THEN 1.0 ELSE 0.2 END"


@query(f"""WITH {L.SQL}, {_TIERS}, u AS (SELECT *, {_HAY} AS hay2, {_PLACE} AS place FROM t),
h AS (SELECT *, {_HITS.replace("(hay, ", "(hay2, ")} AS hits FROM u),
s AS (SELECT seq, title, CAST({_TITLE_PART} AS DOUBLE) AS title_part, least(100, floor(hits * 100 / {len(P.all_skills())})) / 100.0::DOUBLE AS skills_part, CAST({_SENIORITY} AS DOUBLE) AS seniority_part, CAST({_RECENCY} AS DOUBLE) AS recency_part, CAST({_LOCATION} AS DOUBLE) AS location_part FROM h)
SELECT seq, CASE WHEN regexp_matches(title, '{D.SALES_PATTERN}') THEN 0 ELSE CAST(greatest(0, least(100, round_even(35 * title_part + 25 * skills_part + 20 * seniority_part + 12 * recency_part + 8 * location_part, 0))) AS INTEGER) END AS relevance FROM s""")
def composite_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C02 to C05, F13."""
    return scoring.composite(L.listings(spark, sf_dir), P, L.as_of()).select("seq", "relevance")


_PARTS = "CAST(seq * 37 % 101 AS DOUBLE) AS embed, CAST(seq * 53 % 101 AS DOUBLE) AS skill, CAST(seq * 71 % 101 AS DOUBLE) AS rerank"
_NO_LLM = f"{0.15 / 0.85!r} * embed + {0.25 / 0.85!r} * skill + {0.45 / 0.85!r} * rerank"


@query(f"""WITH {L.SQL}, {_TIERS}, b AS (SELECT seq, title, tier, years, len(skills) AS n_skills, posted_at, scraped_at, {_PARTS} FROM t),
s AS (SELECT *, least(100, CAST(greatest(0, least(100, round_even({_NO_LLM}, 0))) AS INTEGER) + CASE WHEN {_AGE.format('coalesce(posted_at, scraped_at)')} * 24 <= 48 THEN 5 ELSE 0 END) AS s0,
  skill < 15 AND n_skills = 0 AS c1, NOT (tier BETWEEN 0 AND 2 AND (years IS NULL OR years BETWEEN 0 AND 4)) OR tier >= 3 OR regexp_matches(lower(title), '{D.LEADERSHIP_PATTERN}') AS c2, regexp_matches(title, '{D.SALES_PATTERN}') AS c3 FROM b)
SELECT seq, CAST(least(s0, CASE WHEN c1 THEN 35 ELSE 100 END, CASE WHEN c2 THEN 20 ELSE 100 END, CASE WHEN c3 THEN 25 ELSE 100 END) AS INTEGER) AS match_score,
  CASE WHEN c1 OR c2 OR c3 THEN 'Skip' ELSE 'Consider' END AS recommendation, CAST(CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) + CAST(c3 AS INTEGER) AS INTEGER) AS n_reasons FROM s""")
def final_blend_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12, C13, F08, F14, T09."""
    n = F.col("seq")
    part = lambda k: (n * k % 101).cast("double")
    rows = L.listings(spark, sf_dir).withColumns({"tier": matching.job_tier("title", "description"), "years": matching.required_years(F.concat_ws(" ", "title", "description", "requirements"))})
    ok = matching.tier_fits(F.col("tier"), P) & matching.years_fit(F.col("years"), P)
    score = scoring.blended({"embed": part(37), "skill": part(53), "rerank": part(71)}, used_llm=False)
    bonus = T.recency_bonus(F.col("posted_at"), F.col("scraped_at"), L.as_of())
    out = scoring.capped(score, part(53), F.col("skills"), ok, F.col("tier"), F.col("title"), bonus, F.lit("Consider"), P)
    return rows.select("seq", out.alias("o")).select("seq", "o.match_score", "o.recommendation", F.size("o.reasons").alias("n_reasons"))


# ---------------------------------------------------------------- retrieval

_TERMS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9+#.]+'), lambda x: length(x) > 1)"
_BM25 = f"""w AS (SELECT doc_id, len({_TERMS.format('text')}) AS length, unnest({_TERMS.format('text')}) AS term FROM documents),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM w GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len({_TERMS.format('text')})) AS mean FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, size),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT item_id AS query_id, doc_id AS id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term), size GROUP BY ALL)"""


@query(f"WITH {_BM25}, r AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    best = retrieval.bm25_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_ASKED = "a AS (SELECT label, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS q FROM embeddings GROUP BY label)"
_SIM = "greatest(0.0, least(1.0, list_dot_product(CAST(embedding AS DOUBLE[]), q)))"


def _asked(pool: DataFrame) -> DataFrame:
    """(label, q): each label's vector with the smallest id stands for its query."""
    return pool.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))


@query(f"""WITH {_ASKED}, s AS (SELECT label, vec_id, round({_SIM}, 6) AS sim FROM embeddings JOIN a USING (label))
SELECT label, vec_id, sim, CAST(row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 50""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of fifty of each label's query."""
    pool = table(spark, sf_dir, "embeddings")
    scored = retrieval.similarity(pool, _asked(pool), "label").select("label", "vec_id", F.round("sim", 6).alias("sim"))
    return retrieval.top(scored, 50, ["label"], "sim", "vec_id")


@query(f"""WITH {_BM25}, {_ASKED}, p AS (SELECT label AS query_id, vec_id AS id, {_SIM} AS sim FROM embeddings JOIN a USING (label) SEMI JOIN documents ON doc_id = vec_id),
wp AS (SELECT p.query_id, p.id, sim, coalesce(score, 0.0) AS bm25 FROM p LEFT JOIN s ON s.query_id = p.query_id AND s.id = p.id),
b AS (SELECT query_id, min(sim) AS sl, max(sim) AS sh, min(bm25) AS bl, max(bm25) AS bh FROM wp GROUP BY query_id)
SELECT query_id, id, round(0.65 * CASE WHEN sh - sl < 1e-9 THEN 0.5 ELSE (sim - sl) / (sh - sl) END + 0.35 * CASE WHEN bh - bl < 1e-9 THEN 0.5 ELSE (bm25 - bl) / (bh - bl) END, 5) AS score FROM wp JOIN b USING (query_id)""")
def hybrid_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents, blended with BM25 of the benchmark item that has the label's number."""
    pool = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents")
    mine = pool.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    vector = retrieval.similarity(mine, _asked(pool), "label").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), "sim")
    words = retrieval.bm25_of(vector, docs, table(spark, sf_dir, "benchmark")).select("query_id", "id", F.round("score", 6).alias("bm25"))
    return retrieval.hybrid(vector, words).select("query_id", "id", F.round("score", 5).alias("score"))


# ---------------------------------------------------------------- state


@query(f"""WITH {L.SQL}, b AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS new, CASE WHEN seq % 4 <> 0 THEN '' || seq ELSE '' END AS salary, CASE WHEN seq % 5 <> 0 THEN seq || ' years' ELSE '' END AS experience FROM l), o AS (SELECT *, new * 1000000000000 + seq AS o FROM b)
SELECT content_hash, arg_min(source, o) AS source, arg_min(company, o) AS company, arg_min(title, o) AS title, arg_min(salary, o) AS salary, arg_max(experience, o) FILTER (WHERE experience <> '') AS experience,
  arg_max(location, o) FILTER (WHERE location <> '') AS location, arg_max(apply_url, o) FILTER (WHERE apply_url <> '') AS apply_url, array_to_string(arg_max(skills, o) FILTER (WHERE len(skills) > 0), ',') AS skills,
  min(coalesce(posted_at, scraped_at)) AS posted_at, arg_max(scraped_at, o) AS scraped_at, sha256(arg_max(description, {{'n': length(description), 'o': -o}})) AS description_sha256 FROM o GROUP BY content_hash""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the listings are stored, the others come in a batch."""
    n = F.col("seq")
    rows = L.listings(spark, sf_dir).withColumns({"salary": F.when(n % 4 != 0, n.cast("string")).otherwise(""), "experience": F.when(n % 5 != 0, F.concat(n.cast("string"), F.lit(" years"))).otherwise("")})
    out = state.merge_listings(rows.where("seq % 3 = 0"), rows.where("seq % 3 <> 0"))
    return out.select("content_hash", "source", "company", "title", "salary", "experience", "location", "apply_url", F.array_join("skills", ",").alias("skills"), "posted_at", "scraped_at", F.sha2("description", 256).alias("description_sha256"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as matches: one hash in five is missing."""
    n = F.col("event_id")
    hash_ = F.when(F.col("user_id") % 5 != 0, F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"), 256)).otherwise("")
    return table(spark, sf_dir, "events").select(n.alias("seq"), hash_.alias("content_hash"), F.concat(F.lit("https://x.example/"), F.col("user_id").cast("string")).alias("apply_url"), F.col("event_type").alias("company"), F.lit("").alias("title"), F.floor(F.pmod("value", F.lit(100))).cast("int").alias("match_score"), F.col("ts").alias("posted_at"), F.substring(F.sha2(F.col("event_type"), 256), 1, 24).alias("listing_fingerprint"))


_M = """m AS (SELECT event_id AS seq, CASE WHEN user_id % 5 <> 0 THEN sha256(user_id || ':' || event_type) ELSE '' END AS content_hash, 'https://x.example/' || user_id AS apply_url, event_type AS company, '' AS title,
  CAST(floor(((value % 100) + 100) % 100) AS INTEGER) AS match_score, ts AS posted_at, substring(sha256(event_type), 1, 24) AS listing_fingerprint FROM events)"""


@query(f"""WITH {_M}, n AS (SELECT * FROM m WHERE posted_at < TIMESTAMP '2024-01-16'), h AS (SELECT * FROM n WHERE content_hash <> '' QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1),
u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY apply_url ORDER BY seq) = 1),
j AS (SELECT m.seq, m.match_score, m.posted_at, m.listing_fingerprint, h.seq AS hs, coalesce(h.seq, u.seq) AS ps, CASE WHEN h.seq IS NOT NULL THEN h.match_score ELSE u.match_score END AS pm, CASE WHEN h.seq IS NOT NULL THEN h.posted_at ELSE u.posted_at END AS pp, CASE WHEN h.seq IS NOT NULL THEN h.listing_fingerprint ELSE u.listing_fingerprint END AS pf
  FROM m LEFT JOIN h ON m.content_hash = h.content_hash LEFT JOIN u ON m.apply_url = u.apply_url WHERE m.posted_at >= TIMESTAMP '2024-01-16')
SELECT seq, CASE WHEN ps IS NULL THEN 'new' WHEN match_score - pm >= 10 THEN 'score_jump' WHEN posted_at > pp THEN 'listing_refreshed' WHEN listing_fingerprint <> pf THEN 'listing_changed' ELSE 'already_notified' END AS reason FROM j""")
def notify_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the month was notified."""
    m = _matches(spark, sf_dir)
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    told = state.prior_notice(m.where(F.col("posted_at") >= half), m.where(F.col("posted_at") < half).withColumnRenamed("seq", "notice_id"))
    reason = state.notice_reason(F.col("match_score"), F.col("posted_at"), F.col("listing_fingerprint"), F.lit(True), F.col("prior"))
    return told.select("seq", reason.alias("reason"))


@query(f"""WITH {_M}, k AS (SELECT *, CASE WHEN content_hash <> '' THEN content_hash ELSE apply_url END AS state_key, CASE WHEN posted_at < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END * 1000000000000 + seq AS o FROM m)
SELECT state_key, arg_max(match_score, o) AS match_score, arg_max(posted_at, o) AS posted_at, arg_max(listing_fingerprint, o) AS listing_fingerprint FROM k GROUP BY state_key""")
def record_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U02."""
    m = _matches(spark, sf_dir)
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    return state.record_notices(m.where(F.col("posted_at") < half), m.where(F.col("posted_at") >= half)).select("state_key", "match_score", "posted_at", "listing_fingerprint")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def anti_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04, J07."""
    return state.new_ids(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH RECURSIVE {L.SQL}, o AS (SELECT seq, content_hash AS h, 'url:' || regexp_replace(split_part(lower(trim(apply_url)), '?', 1), '/+$', '') AS i, row_number() OVER (ORDER BY seq) AS k FROM l),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS met, FALSE AS stays UNION ALL
  SELECT o.k, o.seq, CASE WHEN list_has_any(met, [h, i]) THEN met ELSE list_concat(met, [h, i]) END, NOT list_has_any(met, [h, i]) FROM f JOIN o ON o.k = f.k + 1)
SELECT seq FROM f WHERE stays""")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash or address, over all sources in order."""
    rows = L.listings(spark, sf_dir).select("seq", "content_hash", X.identity_key("apply_url", "company", "title").alias("identity"))
    return state.greedy_dedup(rows, ("content_hash", "identity")).select("seq")


@query(f"""WITH {L.SQL}, {_REASONS}, s AS (SELECT r.seq, reject_reason, CAST(seq * 37 % 101 AS INTEGER) AS match_score, CAST(seq * 53 % 101 AS INTEGER) AS other FROM r)
SELECT seq, CASE WHEN reject_reason IS NULL AND match_score >= 60 THEN match_score ELSE greatest(1, least(59, greatest(match_score, other))) END AS match_score, coalesce(reject_reason, '') AS reason FROM s WHERE reject_reason IS DISTINCT FROM 'duplicate'""")
def browse_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches, then what was rejected, below the threshold."""
    told = filters.with_reason(L.listings(spark, sf_dir), P).select("seq", "reject_reason", (F.col("seq") * 37 % 101).cast("int").alias("score"))
    strong = told.where(F.col("reject_reason").isNull() & (F.col("score") >= 60)).select("seq", F.col("score").alias("match_score"), F.lit("").alias("reason"))
    rest = told.where(~F.coalesce(F.col("reject_reason") == "duplicate", F.lit(False))).join(strong.select("seq"), "seq", "left_anti")
    return strong.unionByName(rest.select("seq", scoring.browse_score(F.col("score"), (F.col("seq") * 53 % 101).cast("int"), 60).alias("match_score"), X.text("reject_reason").alias("reason")))


# ---------------------------------------------------------------- reports


@query(f"""WITH {L.SQL}, o AS (SELECT source, count(*) AS returned, count(*) FILTER (WHERE posted_at >= TIMESTAMP '{L.AS_OF_TEXT}' - INTERVAL 30 DAY) AS kept FROM l GROUP BY source),
t AS (SELECT source, string_agg(title, '; ' ORDER BY seq) AS sample_titles FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= 5) GROUP BY source)
SELECT source, returned, kept, sample_titles FROM o JOIN t USING (source)""")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G02, G03, J10, T02."""
    kept = F.coalesce(F.col("posted_at") >= L.as_of() - F.make_dt_interval(F.lit(30)), F.lit(False))
    return reporting.source_report(L.listings(spark, sf_dir), kept)


@query(f"SELECT source, CAST(floor(100 / {len(D.SOURCES)}) + CASE WHEN row_number() OVER (ORDER BY source) - 1 < 100 % {len(D.SOURCES)} THEN 1 ELSE 0 END AS INTEGER) AS budget FROM (VALUES {', '.join(f"('{s[0]}')" for s in D.SOURCES)}) v(source)")
def even_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01, S16, S17."""
    return reporting.budgets(readers.registry(spark), 100)


@query("""WITH r AS (SELECT event_type AS source, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'ok' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'strange' ELSE 'error' END AS status, event_id FROM events)
SELECT source, CASE WHEN arg_max(status, event_id) = 'strange' THEN 'error' ELSE arg_max(status, event_id) END AS status, max(event_id) AS updated_at FROM r GROUP BY source""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last report of each."""
    n = F.col("event_id")
    status = F.when(n % 4 == 0, "ok").when(n % 4 == 1, "rate_limited").when(n % 4 == 2, "strange").otherwise("error")
    reports = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), status.alias("status"), F.lit("").alias("detail"), n.alias("updated_at"))
    return state.latest_health(reports).select("source", "status", "updated_at")


@query(f"WITH {L.SQL} SELECT count(*) AS scored, count(*) FILTER (WHERE seq * 37 % 101 >= 1) AS viewable, count(*) FILTER (WHERE seq * 37 % 101 >= 60) AS above, count(*) FILTER (WHERE seq * 37 % 101 < 60) AS low FROM l")
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G05, F17."""
    return reporting.match_stats(L.listings(spark, sf_dir).select((F.col("seq") * 37 % 101).alias("match_score")), 60)


@query(f"""WITH {L.SQL}, c AS (SELECT *, CAST(seq * 37 % 101 AS INTEGER) AS match_score, CASE {_CLASS.replace('CASE ', '', 1).replace("'likely'", '0').replace("'unknown'", '1').replace("'stale'", '2')} AS o FROM l),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY o, match_score DESC, posted_at DESC NULLS LAST, seq) AS INTEGER) AS place FROM c WHERE match_score >= 60)
SELECT place, place || '. ' || title || ' - ' || company || ' (' || match_score || '%)' AS entry FROM r WHERE place <= 5""")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U05, K09, O10."""
    rows = L.listings(spark, sf_dir).withColumn("match_score", (F.col("seq") * 37 % 101).cast("int"))
    return reporting.digest(reporting.by_hiring(rows, L.as_of()), 60, 5)


@query(f"WITH {L.SQL}, s AS (SELECT seq, list_distinct(list_transform(skills, lambda x: lower(trim(x)))) AS k FROM l) SELECT seq, CAST(len(list_intersect(k, ['python', 'sql'])) AS INTEGER) AS overlap, CAST(len(k) - len(list_intersect(k, ['python', 'sql'])) AS INTEGER) AS gap FROM s")
def skills_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07."""
    gap = reporting.skills_gap(F.col("skills"), F.array(F.lit("Python"), F.lit("SQL")))
    return L.listings(spark, sf_dir).select("seq", gap.alias("g")).select("seq", "g.overlap", "g.gap")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of each key in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"), F.sum(F.length("text")).alias("chars"))


# ---------------------------------------------------------------- streams


#: Events of a key in order; a fold that knows the score of the last notice.
_NOTICES_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id || ':' || event_type AS state_key, CAST(floor(((value % 100) + 100) % 100) AS INTEGER) AS match_score, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT state_key, k, event_id, match_score, match_score AS last, 'new' AS reason FROM e WHERE k = 1 UNION ALL
  SELECT e.state_key, e.k, e.event_id, e.match_score, CASE WHEN e.match_score - f.last >= 10 THEN e.match_score ELSE f.last END, CASE WHEN e.match_score - f.last >= 10 THEN 'score_jump' ELSE 'already_notified' END
  FROM f JOIN e ON e.state_key = f.state_key AND e.k = f.k + 1)
SELECT state_key, event_id, match_score, reason FROM f"""


@query(_NOTICES_SQL)
def notify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U02 to U04 on a stream of events that come in three micro-batches, the later half of the month before the earlier one; the
    last holds one row of a later month, by which the watermark passes all others."""
    events = table(spark, sf_dir, "events")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    end = events.agg(*[(F.max(c) + F.make_dt_interval(F.lit(200)) if c == "ts" else F.lit(-1).cast(events.schema[c].dataType) if c == "user_id" else F.max(c)).alias(c) for c in events.columns])
    root = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    first, *others = (lambda part=part: part.write.mode("append").parquet(root) for part in (spread(events.where(F.col("ts") >= half), "event_id"), spread(events.where(F.col("ts") < half), "event_id"), end))
    first()
    told = notices.run_once(notices.notices(notices.event_stream(spark, root), late="100 days"), "notices", arrivals=others)
    return told.where(~F.col("state_key").startswith("-1:"))


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS start, count(*) AS n, CAST(sum(CAST(floor(((value % 100) + 100) % 100) AS INTEGER)) AS BIGINT) AS total FROM events GROUP BY 1")
def window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: windows of event time on a stream."""
    return notices.run_once(notices.windowed(notices.event_stream(spark, f"{sf_dir}/events.parquet"), late="60 days"), "windows", "update")


# ---------------------------------------------------------------- extensions: relational queries on the other tables


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def ext_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def ext_local_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL""")
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("new", F.when(gap <= 1_800_000_000, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
