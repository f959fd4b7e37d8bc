"""Registered queries of career fields, profiles and their searches, each with the SQL that must give the same rows.

customer rows stand for profiles: skills, roles, focus and levels come from small fixed lists by c_custkey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import taxonomy as T
from tessera.functions import text as X
from tessera.operators import fields, matching, people, retrieval
from tessera.plans import listings as L
from tessera.plans.queries import _any, _field_title, _holds, _n_keywords, _tech_title, _word, query, table
from tessera.session import checkpointed, spread

P = L.PROFILE
_q = lambda s: "'" + s.replace("'", "''") + "'"

SKILLS = [["Python", "SQL", "python ", "Communication"], ["PyTorch", "Kubernetes", "LLM", "Docker"], ["Excel", " Tableau"], [], ["React", "TypeScript", "Teamwork", "Go"], ["spring boot", "Java", "AWS", "Kafka", "Airflow", "dbt", "Spark", "ETL", "Scala", "Flink", "Hive", "Presto"]]
PREFERRED = [["Data Scientist"], [], ["ML Engineer", "ml engineer", " "], ["Backend Engineer", "Platform  Engineer", "SRE", "DevOps Engineer"], []]
ROLES = ["", "Machine Learning Engineer", "Office Manager", "Sales Engineer"]
FOCUS = ["", "any", "aiml", "qa", " DevOps ", "data_analytics", "nonsense"]
CHOSEN = [[], ["backend", "nonsense"], ["nonsense"], ["qa", "cloud"]]
LEVELS = ["fresher", "0-1 years", "1-3 years", "3-5 years", "5+ years", "Internship", "Senior", "Team Lead", "mid level", "2 years", "4 - 8 years", "", "Director", "Junior developer", "9 years", "unknown"]
CLAIMED = ["Python", "python", "Strong communication", "Kubernetes", "pre-sales", "SASE and pipeline", "Solution selling with SASE", "", "5+ years of Rust", "English", "Terraform", "A long sentence about how the team likes to work together on many things", "A long sentence on how the team deploys its services with Terraform on many clouds", "a willingness to grow within a period of at least 3 years in this very position"]
HISTORY = [[], [("2019-01", "2021-06", False, "")], [("2023", "", True, ""), ("2020-05", "2020-03", False, "")], [("", "", False, "2018 - 2021"), ("", "", False, "6 months")], [("", "", False, "3 years"), ("", "", False, "some")], [("soon", "", False, "9 months")]]
PLACES = ["Bangalore", "delhi, mumbai", "Gurgaon", "Springfield", " ", "SF or London", "singapore"]


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    jobs = "array<struct<start:string,end:string,current:boolean,duration:string>>"
    told = lambda items: F.array(*[F.struct(*[F.lit(x).alias(k) for x, k in zip(i, ("start", "end", "current", "duration"), strict=True)]) for i in items]).cast(jobs)
    history = F.element_at(F.array(*map(told, HISTORY)), (n % len(HISTORY) + 1).cast("int"))
    return spread(table(spark, sf_dir, "customer").select(n), "c_custkey").select(n, L.pick(SKILLS, n).alias("skills"), L.pick(PREFERRED, n).alias("preferred"), L.pick(ROLES, n).alias("role"), L.pick(FOCUS, n).alias("focus"), L.pick(CHOSEN, n).alias("chosen"), L.pick(LEVELS, n).alias("level"), F.when(n % 3 == 0, n % 11).cast("int").alias("low"), F.when(n % 3 == 0, n % 11 + n % 4).cast("int").alias("high"), history.alias("history"), (n % 2 == 0).alias("schooled"), L.pick(PLACES, n).alias("place"))


def _sql_history(items: list) -> str:
    return "[" + ", ".join("{'start': %s, 'end': %s, 'current': %s, 'duration': %s}" % (_q(a), _q(b), c, _q(d)) for a, b, c, d in items) + "]" + "::STRUCT(\"start\" VARCHAR, \"end\" VARCHAR, \"current\" BOOLEAN, duration VARCHAR)[]"


_N = "c_custkey"
_PROFILES = f"""p AS (SELECT c_custkey, {L.sql_pick(SKILLS, _N)} AS skills, {L.sql_pick(PREFERRED, _N)} AS preferred, {L.sql_pick(ROLES, _N)} AS role, {L.sql_pick(FOCUS, _N)} AS focus, {L.sql_pick(CHOSEN, _N)} AS chosen,
  {L.sql_pick(LEVELS, _N)} AS level, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 11 AS INTEGER) END AS low, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 11 + c_custkey % 4 AS INTEGER) END AS high,
  ([{', '.join(map(_sql_history, HISTORY))}])[c_custkey % {len(HISTORY)} + 1] AS history, c_custkey % 2 = 0 AS schooled, {L.sql_pick(PLACES, _N)} AS place FROM customer),
b AS (SELECT *, lower(concat_ws(' ', role, array_to_string(preferred, ' '), array_to_string(skills, ' '))) AS blob, lower(trim(focus)) AS one FROM p)"""


def _blob() -> Column:
    return F.lower(F.concat_ws(" ", "role", F.array_join("preferred", " "), F.array_join("skills", " ")))


# ---------------------------------------------------------------- listings


def _role_tokens(c: str, roles: list[str]) -> str:
    return _any(["(" + " AND ".join(_holds(c, w) for w in r.lower().split()[:3]) + ")" for r in roles])


def _in_field(name: str) -> str:
    roles = list(P.roles)
    title, hay = _n_keywords("low", name), _n_keywords("hay", name)
    if name == "software":
        return f"({_tech_title('low')} OR {hay} >= 1)"
    if name == "aiml":
        other = _any([f"regexp_matches(low, '{x}')" for x in T.NOT_AIML_TITLES])
        first = f"({title} >= 1 AND {_tech_title('low')}) OR {_any([f"contains(low, '{r}')" for r in roles])} OR {_role_tokens('low', roles)}"
        return f"(CASE WHEN {title} = 0 AND {other} THEN FALSE WHEN {first} THEN TRUE WHEN {_holds('low', 'ml')} OR contains(low, 'machine learning') THEN {_tech_title('low')} ELSE {hay} >= 2 END)"
    label = _any([_holds("hay", w) for w in T.FIELDS[name].label.lower().replace("/", " ").split() if len(w) >= 3])
    return f"({title} >= 1 OR {hay} >= 2 OR ({_role_tokens('hay', roles)} AND {label}))"


@query(f"""WITH {L.SQL}, h AS (SELECT seq, lower(title) AS low, lower(title || ' ' || description || ' ' || array_to_string(skills, ' ')) AS hay FROM l)
SELECT seq, concat_ws(',', {', '.join(f"CASE WHEN {_in_field(f)} THEN '{f}' END" for f in T.FIELDS)}) AS fields FROM h""")
def field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that each listing belongs to."""
    rows = L.listings(spark, sf_dir).select("seq", F.lower("title").alias("low"), F.lower(F.concat_ws(" ", "title", "description", F.array_join("skills", " "))).alias("hay"))
    return rows.select("seq", F.concat_ws(",", *[F.when(fields.in_field(f, F.col("low"), F.col("hay"), P), f) for f in T.FIELDS]).alias("fields"))


@query(f"WITH {L.SQL} SELECT seq, {', '.join(f'CAST({_field_title(f)} AS DOUBLE) AS {f}' for f in T.FIELDS)} FROM l")
def title_field_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each field says of a title."""
    return L.listings(spark, sf_dir).select("seq", *[fields.title_score([f], F.lower("title")).alias(f) for f in T.FIELDS])


_QA = [s for s in P.all_skills() if any(h in s.lower() or s.lower() in h for h in T.FIELDS["data_analytics"].keywords)]


@query(f"""WITH {L.SQL}, h AS (SELECT seq, lower(title || ' ' || description) AS hay FROM l)
SELECT seq, {_any([_holds('hay', t) for s in P.all_skills() for t in fields.expand_skill(s) if len(t) > 2] + [f"contains(hay, '{r.lower()}')" for r in [*P.role_phrases(), *T.ROLE_FAMILIES['aiml']][:8]])} AS any_field,
  {_any([f"contains(hay, '{k}')" for k in T.FIELDS['data_analytics'].keywords] + [_holds('hay', t) for s in _QA for t in fields.expand_skill(s) if len(t) > 2])} AS analytics FROM h""")
def kept_at_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """without a focus, and with one."""
    from dataclasses import replace

    rows = L.listings(spark, sf_dir).select("seq", F.lower(F.concat_ws(" ", "title", "description")).alias("hay")).withColumn("hits", matching.skill_hits(F.col("hay"), P))
    focused = replace(P, focus="data_analytics")
    return rows.select("seq", fields.is_kept(F.col("hay"), F.col("hits"), P).alias("any_field"), fields.is_kept(F.col("hay"), F.col("hits"), focused).alias("analytics"))


# ---------------------------------------------------------------- phrases

_SALES = f"({_any([f'contains(c, {_q(m)})' for m in T.SALES_PHRASES])} AND (NOT regexp_matches(c, {_q(T.TECH_TOKEN)}) OR {_any([f'contains(c, {_q(m)})' for m in T.SALES_ALWAYS])}))"
_SOFT = f"(c = '' OR {_any([f'contains(c, {_q(m)})' for m in T.SOFT_PHRASES])} OR {_SALES} OR (length(c) > 60 AND NOT regexp_matches(c, {_q(T.TECH_TOKEN)}) AND NOT regexp_matches(c, {_q(T.YEARS_GAP)})))"


@query(f"WITH x AS (SELECT p_partkey, lower(trim({L.sql_pick(CLAIMED, 'p_partkey')})) AS c FROM part) SELECT p_partkey, regexp_matches(c, {_q(T.TECH_TOKEN)}) AS tech, {_SALES} AS sales, {_SOFT} AS soft FROM x")
def phrase_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    c = L.pick(CLAIMED, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.has_tech_token(F.lower(c)).alias("tech"), fields.is_sales_phrase(c).alias("sales"), fields.is_soft_phrase(c).alias("soft"))


_OWN = sorted(P.terms())


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, trim({L.sql_pick(CLAIMED, 'l_partkey')}) AS s FROM lineitem), f AS (SELECT l_orderkey, lower(s) AS c, arg_min(s, {{'a': l_linenumber, 'b': s}}) AS s, min(l_linenumber) AS k FROM x GROUP BY l_orderkey, lower(s))
SELECT l_orderkey, coalesce(array_to_string(list(s ORDER BY k, s) FILTER (WHERE NOT {_SOFT} AND NOT (length(c) > 60 AND NOT regexp_matches(c, {_q(T.YEARS_GAP)})) AND NOT list_has_any(list_concat([c], regexp_extract_all(c, '[a-z0-9+#.]+')), {L._list(_OWN)})), '; '), '') AS missing FROM f GROUP BY l_orderkey""")
def missing_skill_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of an order's lines as skills that the profile is said to lack. Each different phrase is judged once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.pick(CLAIMED, F.col("l_partkey")).alias("said"))
    s = X.strip("said")
    judged = checkpointed(lines.select("said").distinct().where("said IS NOT NULL").select("said", s.alias("s"), F.lower(s).alias("low"), fields.is_missing_skill("said", P).alias("lacks")))
    told = lines.join(retrieval.sent(judged, F.octet_length("said") * 3 + 32), "said", "left")
    named = F.array_sort(F.collect_list(F.when(F.col("lacks"), F.struct("l_linenumber", "s", "low"))))  # at most seven lines
    claimed = told.groupBy("l_orderkey").agg(named.alias("claimed"))
    first = F.filter("claimed", lambda x, k: F.array_position(F.col("claimed.low"), x["low"]) == k + 1)
    return claimed.select("l_orderkey", F.array_join(F.transform(first, lambda x: x["s"]), "; ").alias("missing"))


# ---------------------------------------------------------------- profiles

_INFERRED = "CASE WHEN len(found) > 0 THEN found ELSE ['software'] END"
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN {_any([f'contains(blob, {_q(s)})' for s in f.signals])} THEN '{n}' END" for n, f in T.FIELDS.items() if f.signals) + "], lambda x: x IS NOT NULL)"
_IDS = L._list(list(T.FIELDS))
_EFFECTIVE = f"CASE WHEN list_contains({_IDS}, one) THEN [one] WHEN len(list_filter(chosen, lambda x: list_contains({_IDS}, x))) > 0 THEN list_filter(chosen, lambda x: list_contains({_IDS}, x)) ELSE {_INFERRED} END"
_LABELS = "CASE x " + " ".join(f"WHEN '{n}' THEN {_q(f.label)}" for n, f in T.FIELDS.items()) + " END"


@query(f"""WITH {_PROFILES}, f AS (SELECT *, {_FOUND} AS found FROM b), e AS (SELECT *, {_EFFECTIVE} AS fields FROM f)
SELECT c_custkey, array_to_string({_INFERRED}, ',') AS inferred, array_to_string(fields, ',') AS fields, array_to_string(list_transform(fields, lambda x: {_LABELS}), ', ') AS labels FROM e""")
def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11, X12, X13."""
    own = _profiles(spark, sf_dir).withColumn("blob", _blob())
    told = own.select("c_custkey", fields.inferred_fields(F.col("blob")).alias("inferred"), fields.effective_fields(F.col("focus"), F.col("chosen"), F.col("blob")).alias("fields"))
    return told.select("c_custkey", F.array_join("inferred", ",").alias("inferred"), F.array_join("fields", ",").alias("fields"), F.array_join(fields.field_labels(F.col("fields")), ", ").alias("labels"))


def _dedup(items: str) -> str:
    """The first of texts that differ only in case, in order."""
    return f"list_transform(list_filter(list_zip({items}, range(len({items}))), lambda x: list_position(list_transform({items}, lambda y: lower(y)), lower(x[1])) = x[2] + 1), lambda x: x[1])"


_CLEAN = "list_filter(list_transform({}, lambda x: trim(x)), lambda x: x <> '')"
_ROLES_OF = f"CASE WHEN len({_CLEAN.format('preferred')}) > 0 THEN {_CLEAN.format('preferred')} WHEN trim(role) <> '' THEN [trim(role)] ELSE ['software engineer'] END"
_OF_FOCUS = "CASE one " + " ".join(f"WHEN '{n}' THEN {L._list(f.search)}" for n, f in T.FIELDS.items()) + " ELSE []::VARCHAR[] END"
_HINTS = "CASE one " + " ".join(f"WHEN '{n}' THEN {L._list(f.keywords)}" for n, f in T.FIELDS.items()) + " ELSE []::VARCHAR[] END"
_FAMILY = f"CASE WHEN {_any([f'contains(blob, {_q(m)})' for m in T.AIML_MARKERS])} THEN {L._list(T.ROLE_FAMILIES['aiml'])} WHEN {_any([f'contains(blob, {_q(m)})' for m in T.DATA_MARKERS])} THEN {L._list(T.ROLE_FAMILIES['data'])} ELSE {L._list(T.ROLE_FAMILIES['software'])} END"


@query(f"""WITH {_PROFILES}, r AS (SELECT *, list_concat({_ROLES_OF}, CASE WHEN len({_OF_FOCUS}) > 0 THEN {_OF_FOCUS} ELSE {_FAMILY} END) AS near, {_HINTS} AS hints, {_CLEAN.format('skills')} AS own FROM b),
s AS (SELECT *, list_concat(list_filter(own, lambda s: len(list_filter(hints, lambda h: contains(lower(s), h) OR contains(h, lower(s)))) > 0), own,
  list_filter(CASE WHEN len(hints) > 0 THEN hints ELSE {L._list(T.CATALOG)} END, lambda k: len(list_filter(own, lambda s: contains(lower(s), k))) > 0)) AS every FROM r),
t AS (SELECT *, list_filter(every, lambda s: length(s) >= 2 AND NOT list_contains({L._list(T.NOT_SEARCHED)}, lower(s))) AS usable FROM s)
SELECT c_custkey, array_to_string({_dedup('near')}, ',') AS roles, array_to_string(list_slice({_dedup('usable')}, 1, 10), ',') AS skills FROM t""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14, X15."""
    own = _profiles(spark, sf_dir).withColumn("blob", _blob())
    roles = fields.adjacent_roles(F.col("preferred"), F.col("role"), F.col("focus"), F.col("blob"))
    return own.select("c_custkey", F.array_join(roles, ",").alias("roles"), F.array_join(fields.searched_skills(F.col("skills"), F.col("focus")), ",").alias("skills"))


@query(f"""WITH {_PROFILES}, f AS (SELECT *, {_FOUND} AS found FROM b), e AS (SELECT *, {_EFFECTIVE} AS fields, {_ROLES_OF} AS roles FROM f),
u AS (SELECT *, list_concat(roles, flatten(list_transform(fields, lambda x: CASE x {' '.join(f"WHEN '{n}' THEN {L._list(f.search)}" for n, f in T.FIELDS.items())} END)), CASE WHEN list_contains(fields, 'aiml') AND c_custkey % 4 <= 1 THEN ['junior machine learning engineer', 'graduate AI engineer', 'entry level ML engineer'] ELSE [] END) AS every FROM e)
SELECT c_custkey, array_to_string({_dedup('every')}, ',') AS queries FROM u""")
def field_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers are c_custkey modulo 4."""
    own = _profiles(spark, sf_dir).withColumn("fields", fields.effective_fields(F.col("focus"), F.col("chosen"), _blob()))
    return own.select("c_custkey", F.array_join(fields.field_queries(F.col("fields"), F.col("preferred"), F.col("role"), F.col("c_custkey") % 4), ",").alias("queries"))


@query()
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that stops, which the tests hold against a loop."""
    own = _profiles(spark, sf_dir)
    return own.select("c_custkey", F.array_join(fields.search_queries(F.col("skills"), F.col("preferred"), F.col("role"), F.col("focus"), F.col("c_custkey") % 4), ",").alias("queries"))


@query(f"""WITH {_PROFILES} SELECT c_custkey, regexp_matches(blob, {_q(T.AIML_WORK)}) AND NOT regexp_matches(blob, {_q(D.SALES_PATTERN)}) AS technical FROM b""")
def technical_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15."""
    return _profiles(spark, sf_dir).select("c_custkey", fields.is_technical(_blob()).alias("technical"))


# ---------------------------------------------------------------- levels

_DEFAULTS = "CASE WHEN v IN ('fresher', 'internship') THEN [0, 0] WHEN v = '0-1 years' THEN [0, 1] WHEN v = '1-3 years' THEN [1, 3] WHEN v = '3-5 years' THEN [3, 5] WHEN v = '5+ years' THEN [5, 15] WHEN v = 'senior' THEN [4, 8] WHEN v IN ('mid level') THEN [2, 5] WHEN v IN ('2 years', 'junior developer') THEN [0, 2] WHEN v = '4 - 8 years' THEN [4, 8] ELSE [5, 15] END"
_LEVEL_TIER = "CASE WHEN v IN ('fresher', 'internship', '0-1 years') THEN 0 WHEN v IN ('1-3 years', 'junior developer', '2 years') THEN 1 WHEN v IN ('3-5 years', 'mid level') THEN 2 WHEN v IN ('senior', '4 - 8 years', '5+ years') THEN 3 WHEN v IN ('team lead', '9 years') THEN 4 WHEN v = 'director' THEN 5 END"
_BAND = "CASE WHEN mid <= 1 THEN 0 WHEN mid <= 2.5 THEN 1 WHEN mid <= 5 THEN 2 WHEN mid <= 7 THEN 3 ELSE 4 END"
#: Months of each HISTORY until 2024-01, by hand: none, 29, 12 + 0, 36 + 6, 36 + 12, 9.
_MONTHS = "([NULL, 29, 12, 42, 48, 9])[c_custkey % 6 + 1]"


@query(f"""WITH {_PROFILES}, v AS (SELECT *, lower(level) AS v, {_MONTHS} AS months, (low + high) / 2.0 AS mid FROM b),
t AS (SELECT *, {_DEFAULTS} AS usual, CASE WHEN low IS NOT NULL THEN {_BAND} ELSE {_LEVEL_TIER} END AS told, CASE WHEN months IS NULL THEN CASE WHEN schooled THEN 0 END WHEN months <= 12 THEN 0 WHEN months <= 24 THEN 1 WHEN months <= 48 THEN 2 WHEN months <= 84 THEN 3 ELSE 4 END AS done FROM v)
SELECT c_custkey, CAST(coalesce(low, usual[1]) AS INTEGER) AS years_min, CAST(coalesce(high, usual[2]) AS INTEGER) AS years_max, CAST(coalesce(least(told, done), 0) AS INTEGER) AS tier,
  (coalesce(low, usual[1]) + coalesce(high, usual[2])) / 2.0::DOUBLE AS years,
  CASE WHEN coalesce(high, usual[2]) <= 0 THEN 'Fresher' WHEN coalesce(low, usual[1]) = 0 AND coalesce(high, usual[2]) <= 1 THEN '0-1 years' WHEN coalesce(high, usual[2]) >= 15 AND coalesce(low, usual[1]) >= 5 THEN '5+ years' ELSE coalesce(low, usual[1]) || '-' || coalesce(high, usual[2]) || ' years' END AS label FROM t""")
def candidate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X23, X24, X26, P22, T10, T11."""
    own = _profiles(spark, sf_dir)
    target = people.target_years("level", F.col("low"), F.col("high"))
    own = own.withColumn("target", target).withColumn("tier", people.candidate_tier("level", F.col("low"), F.col("high"), F.col("history"), F.col("schooled"), L.as_of()))
    low, high = F.col("target.low"), F.col("target.high")
    return own.select("c_custkey", low.alias("years_min"), high.alias("years_max"), "tier", people.candidate_years(F.col("target")).alias("years"), people.level_label(low, high).alias("label"))


_SEARCH = "CASE trim(place) WHEN 'Bangalore' THEN 'Bengaluru, Karnataka, India' WHEN 'delhi, mumbai' THEN 'New Delhi, Delhi, India' WHEN 'Gurgaon' THEN 'Gurugram, Haryana, India' WHEN 'SF or London' THEN 'London, England, United Kingdom' WHEN 'singapore' THEN 'Singapore, Singapore' WHEN '' THEN 'Paris' ELSE trim(place) END"


@query(f"WITH {_PROFILES} SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Pune' WHEN trim(place) <> '' THEN trim(place) ELSE 'Paris' END AS place, {_SEARCH} AS search FROM b")
def place_of_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's own place for each fifth profile, else the preferred one, else that of the resume."""
    own = _profiles(spark, sf_dir)
    run = F.when(F.col("c_custkey") % 5 == 0, "Pune").otherwise(" ")
    usual = people.effective_place(F.lit(None), F.col("place"), F.lit("Paris"))
    return own.select("c_custkey", people.effective_place(run, F.col("place"), F.lit("Paris")).alias("place"), people.search_place(usual).alias("search"))


@query(f"""WITH {_PROFILES}, x AS (SELECT c_custkey, skills, CASE WHEN c_custkey % 2 = 0 THEN 'own@mail.example' ELSE '' END AS email, 'a b@c.de Python' AS source FROM b)
SELECT c_custkey, CASE WHEN email <> '' THEN email ELSE 'b@c.de' END AS email, array_to_string(CASE WHEN len(list_filter(skills, lambda s: list_has_any(regexp_extract_all(lower(s), '[a-z0-9+#.]+'), regexp_extract_all(lower(source), '[a-z0-9+#.]+')))) > 0
  THEN list_filter(skills, lambda s: list_has_any(regexp_extract_all(lower(s), '[a-z0-9+#.]+'), regexp_extract_all(lower(source), '[a-z0-9+#.]+'))) ELSE ['fallback'] END, ',') AS skills FROM x""")
def truthful_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts that are missing come from the text, and skills that it doesn't name go."""
    own = _profiles(spark, sf_dir).withColumn("source", F.lit("a b@c.de Python"))
    email = people.merged_contacts({"email": F.when(F.col("c_custkey") % 2 == 0, "own@mail.example").otherwise("")}, F.col("source"))
    return own.select("c_custkey", email["email"].alias("email"), F.array_join(people.truthful(F.col("skills"), F.col("source"), F.array(F.lit("fallback"))), ",").alias("skills"))
