"""Registered queries from recency to the digest, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import text as X
from tessera.operators import matching, ranking, reporting
from tessera.operators import state as S
from tessera.plans import listings as L
from tessera.plans.queries import _AGE, _FITS, _HITS, _PLACE, _TIERS, P, query, table
from tessera.plans.rules import BOARDS, _payloads
from tessera.session import shared_folder
from tessera.sources import payloads, readers, sinks

_SAID = r"""CASE WHEN regexp_matches(x, '(?i)\bjust\s+posted\b|\btoday\b|\bhours?\s+ago\b|\bminutes?\s+ago\b') THEN 0 WHEN regexp_matches(x, '(?i)\byesterday\b') THEN 1
  ELSE coalesce(TRY_CAST(regexp_extract(x, '(?i)\b(\d+)\s*days?\s*ago\b', 1) AS INTEGER), 7 * TRY_CAST(regexp_extract(x, '(?i)\b(\d+)\s*weeks?\s*ago\b', 1) AS INTEGER),
    CASE WHEN length(x) <= 28 THEN coalesce(30 * TRY_CAST(regexp_extract(x, '(?i)\b(\d+)\s*months?\s*ago\b', 1) AS INTEGER), 365 * TRY_CAST(regexp_extract(x, '(?i)\b(\d+)\s*years?\s*ago\b', 1) AS INTEGER)) END) END"""
_BLOB = "(title || ' ' || substring(description, 1, 500))"
_RECOVERED = f"""g AS (SELECT *, list_filter(list_transform(list_concat(list_filter(list_transform(regexp_split_to_array({_BLOB}, '\\r\\n|\\r|\\n'), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> '' AND length(x) <= 40),
  [substring(trim(regexp_replace({_BLOB}, '\\s+', ' ', 'g')), 1, 80)]), lambda x: {_SAID}), lambda d: d IS NOT NULL)[1] AS days FROM l),
rec AS (SELECT * REPLACE (coalesce(posted_at, TIMESTAMP '{L.AS_OF_TEXT}' - to_days(CAST(days AS INTEGER))) AS posted_at) FROM g)"""
_ORDER = f"CASE WHEN posted_at IS NULL THEN 1 WHEN {_AGE.format('posted_at')} <= 7 THEN 0 ELSE 2 END"


@query(f"""WITH {L.SQL}, {_RECOVERED} SELECT seq, posted_at, CAST(row_number() OVER (ORDER BY {_ORDER}, posted_at DESC, seq) AS INTEGER) AS place FROM rec WHERE posted_at >= TIMESTAMP '{L.AS_OF_TEXT}' - INTERVAL 30 DAY""")
def recent_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of thirty days, dates recovered, open listings first. The place of every row is the query's own report."""
    rows = ranking.recent(L.listings(spark, sf_dir), L.as_of(), 30)
    return reporting.placed(rows.select("seq", "posted_at", "hiring_order"), *ranking.recent_order()).select("seq", "posted_at", "place")


_LABEL = f"({L._list(D.TIER_LABELS)})[tier + 1]"
_ASKED = f"coalesce(nullif(regexp_extract(hay, '{D.YEARS_EXPERIENCE}', 1), ''), nullif(regexp_extract(hay, '{D.YEARS_REQUIRED}', 1), ''))"


@query(f"""WITH {L.SQL}, {_TIERS}, p AS (SELECT *, {_PLACE} AS place FROM t) SELECT seq, {_LABEL} || coalesce(' (' || {_ASKED} || '+ yrs)', '') AS experience FROM p
WHERE tier BETWEEN 0 AND 2 AND (years IS NULL OR years BETWEEN 0 AND 4) AND {_FITS}""")
def annotated_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19, X25."""
    return ranking.annotated(L.listings(spark, sf_dir), P).select("seq", "experience")


@query(rf"""WITH {L.SQL}, {_TIERS}, h AS (SELECT *, lower(description || ' ' || location) AS a, lower(title || ' ' || description) AS b FROM t)
SELECT seq, sha256(regexp_replace(substring(regexp_replace(description, '^\s+|\s+$', '', 'g'), 1, 3000), '\r\n|\r', chr(10), 'g')) AS requirements_sha256, tier,
  CASE WHEN regexp_extract(a, '{D.REMOTE_POLICY}', 1) <> '' THEN regexp_extract(a, '{D.REMOTE_POLICY}', 1) WHEN contains(a, 'remote') THEN 'remote' ELSE '' END AS remote_policy, regexp_extract(b, '{D.EMPLOYMENT}', 1) AS employment_type FROM h
WHERE len(list_filter(regexp_split_to_array(description, '\r\n|\r|\n'), lambda x: regexp_matches(trim(x), '{D.REQUIREMENTS_HEADER}') OR regexp_matches(trim(x), '{D.NICE_HEADER}'))) = 0""")
def enriched_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose description has no headers of sections; the others are the tests'."""
    rows = L.listings(spark, sf_dir)
    headed = F.exists(F.split("description", r"\r\n|\r|\n"), lambda x: F.trim(x).rlike(D.REQUIREMENTS_HEADER) | F.trim(x).rlike(D.NICE_HEADER))
    out = ranking.enriched(rows.where(~headed))
    return out.select("seq", F.sha2("requirements", 256).alias("requirements_sha256"), "tier", "remote_policy", "employment_type")


@query("SELECT o_orderkey, CAST(greatest(0, least(100, round_even(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 130 - 10.5 END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 90 END, 60), 0))) AS INTEGER) AS least FROM orders")
def score_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a run's own, the profile's, or 60."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n, ranking.threshold(F.when(n % 3 == 0, n % 130 - 10.5), F.when(n % 2 == 0, n % 90), 60).alias("least"))


_SCORES = "CAST(seq * 37 % 101 AS INTEGER) AS recall, CAST(seq * 71 % 101 AS INTEGER) AS rerank, CAST(seq * 53 % 101 AS INTEGER) AS match_score"


@query(f"""WITH {L.SQL}, s AS (SELECT *, {_SCORES} FROM l), r AS (SELECT * FROM s ORDER BY recall DESC, coalesce(posted_at, scraped_at) DESC NULLS LAST, seq LIMIT 20)
SELECT seq, CAST(row_number() OVER (ORDER BY rerank DESC, recall DESC, seq) AS INTEGER) AS place, row_number() OVER (ORDER BY rerank DESC, recall DESC, seq) <= 8 AS used_llm FROM r""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O02, O03, O04."""
    rows = L.listings(spark, sf_dir).withColumns({"recall": (F.col("seq") * 37 % 101).cast("int"), "rerank": (F.col("seq") * 71 % 101).cast("int")})
    return ranking.reranked(ranking.rerank_pool(rows)).select("seq", "place", "used_llm")


@query(f"""WITH {L.SQL}, s AS (SELECT *, {_SCORES} FROM l), b AS (SELECT * FROM s WHERE match_score >= 1 ORDER BY match_score DESC, coalesce(posted_at, scraped_at) DESC NULLS LAST, seq LIMIT 80)
SELECT seq, match_score, CAST(row_number() OVER (ORDER BY match_score >= 95 DESC, match_score DESC, coalesce(posted_at, scraped_at) DESC NULLS LAST, seq) AS INTEGER) AS place FROM b""")
def final_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O05, O06."""
    rows = L.listings(spark, sf_dir).withColumn("match_score", (F.col("seq") * 53 % 101).cast("int"))
    return ranking.final_order(rows, 95).select("seq", "match_score", "place")


_JUDGED = f"""m AS (SELECT *, CAST(seq * 37 % 101 AS INTEGER) AS match_score, {_PLACE} AS place, 'f' || seq % 3 AS print FROM l),
n AS (SELECT content_hash, arg_min(match_score - CAST(seq % 2 * 20 AS INTEGER), seq) AS was, arg_min(posted_at, seq) AS at, arg_min(print, seq) AS print FROM m WHERE seq % 4 = 0 GROUP BY content_hash),
u AS (SELECT apply_url, arg_min(match_score - CAST(seq % 2 * 20 AS INTEGER), seq) AS was, arg_min(posted_at, seq) AS at, arg_min(print, seq) AS print FROM m WHERE seq % 4 = 0 GROUP BY apply_url),
w AS (SELECT m.*, CASE WHEN n.was IS NULL AND u.was IS NULL THEN 'new' WHEN match_score - CASE WHEN n.was IS NOT NULL THEN n.was ELSE u.was END >= 10 THEN 'score_jump' WHEN posted_at > CASE WHEN n.was IS NOT NULL THEN n.at ELSE u.at END THEN 'listing_refreshed'
  WHEN m.print <> CASE WHEN n.was IS NOT NULL THEN n.print ELSE u.print END THEN 'listing_changed' ELSE 'already_notified' END AS notice FROM m LEFT JOIN n USING (content_hash) LEFT JOIN u USING (apply_url)),
j AS (SELECT *, CASE WHEN match_score < 60 THEN 'below_threshold' WHEN NOT ({_FITS}) THEN 'location' WHEN notice = 'already_notified' THEN 'already_notified' END AS dropped FROM w)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    rows = L.listings(spark, sf_dir).withColumns({"match_score": (n * 37 % 101).cast("int"), "listing_fingerprint": F.concat(F.lit("f"), (n % 3).cast("string"))})
    told = rows.where(n % 4 == 0).select(n.alias("notice_id"), "content_hash", "apply_url", (F.col("match_score") - n % 2 * 20).cast("int").alias("match_score"), "posted_at", "listing_fingerprint")
    return ranking.judged_for_digest(rows, told, P, 60, L.as_of())


@query(f"WITH {L.SQL}, {_JUDGED} SELECT seq, notice, coalesce(dropped, '') AS dropped FROM j")
def digest_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a match is sent or not."""
    return _judged(spark, sf_dir).select("seq", "notice", X.text("dropped").alias("dropped"))


@query(f"WITH {L.SQL}, {_JUDGED} SELECT seq, match_score FROM j WHERE dropped IS NULL ORDER BY {_ORDER}, match_score DESC, posted_at DESC NULLS LAST, seq LIMIT 5")
def digest_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U05, O10."""
    return ranking.digest_rows(_judged(spark, sf_dir), 5).select("seq", "match_score")


@query(f"""WITH {L.SQL}, {_JUDGED} SELECT count(*) AS input, count(*) FILTER (WHERE dropped = 'below_threshold') AS dropped_below_threshold, count(*) FILTER (WHERE dropped = 'location') AS dropped_location,
  count(*) FILTER (WHERE dropped = 'already_notified') AS dropped_already_notified, greatest(0, count(*) FILTER (WHERE dropped IS NULL) - 5) AS truncated, CAST(least(5, count(*) FILTER (WHERE dropped IS NULL)) AS BIGINT) AS sent FROM j""")
def digest_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G06."""
    return ranking.digest_stats(_judged(spark, sf_dir), 5).select("input", "dropped_below_threshold", "dropped_location", "dropped_already_notified", F.col("truncated").cast("long").alias("truncated"), F.col("sent").cast("long").alias("sent"))


#: Parts as jobs: a job comes back every 160 parts in the same source, and in the source beside it.
_JOB_SQL = f"""k AS (SELECT p_partkey, CAST((p_partkey % 160) // 2 AS BIGINT) AS job, {L.sql_pick(BOARDS, 'p_partkey')} AS source FROM part),
g AS (SELECT p_partkey, source, {L.sql_pick(L.TITLES, 'job')} AS title, 'Co ' || job AS company, {L.sql_pick(L.PHRASES, 'job')} || ' no. ' || job AS description, 'https://x.example/' || job AS apply_url FROM k
  WHERE source NOT IN ('jobicy', 'workingnomads') AND NOT (source = 'themuse' AND p_partkey % 3 = 0)),
one AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY source, company ORDER BY p_partkey) = 1),
f AS (SELECT *, list_position({L._list([s[0] for s in D.SOURCES])}, source) AS rk FROM one QUALIFY row_number() OVER (PARTITION BY source ORDER BY p_partkey) <= 40 / 8),
kept AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY apply_url ORDER BY rk, p_partkey) = 1)"""
_EARLY_SQL = f"CAST(greatest(0, least(100, 14 * hits {' '.join(f"+ CASE WHEN {' OR '.join(f"contains(hay, '{w}')" for w in role.lower().split() if len(w) > 2)} THEN 4 ELSE 0 END" for role in P.role_phrases())})) AS INTEGER)"


def _job_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of payload files of parts as jobs. One source is broken, one is empty, and one has bad payloads."""
    n = F.col("p_partkey")
    job = F.floor(n % 160 / 2).cast("long")
    parts = table(spark, sf_dir, "part").select("p_partkey", L.pick(L.TITLES, job).alias("p_name"), F.concat(F.lit("Co "), job.cast("string")).alias("p_brand"), L.pick(L.PHRASES, job).alias("p_type"), job.alias("job"))
    rows = _payloads(parts, F.col("job"), F.concat_ws(" ", "p_type", F.lit("no."), F.col("job").cast("string")))
    bad = (F.col("source") == "jobicy") | ((F.col("source") == "themuse") & (F.col("seq") % 3 == 0))
    payload = F.when(bad, "{oops").when(F.col("source") == "workingnomads", "[]").otherwise(F.col("payload"))
    path = f"{shared_folder(spark)}/payloads-{uuid.uuid4().hex}"
    payloads.write(rows.select("source", F.lit("20240131").alias("stamp"), "seq", payload.alias("payload")), path)
    return path


@query(f"""WITH {_JOB_SQL}, h AS (SELECT *, lower(title || ' ' || description || ' ' || CASE source WHEN 'weworkremotely' THEN '' WHEN 'themuse' THEN 'x' ELSE company END) AS hay FROM kept), n AS (SELECT *, {_HITS} AS hits FROM h)
SELECT source, company, title, apply_url, {_EARLY_SQL} AS early FROM n ORDER BY early DESC, rk, p_partkey LIMIT 20""")
def aggregate_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty rows over eight sources, with copies in and across them, ranked by a profile."""
    path = _job_files(spark, sf_dir)
    best = readers.aggregate(payloads.read(spark, path), L.as_of(), BOARDS, 40, P, lambda name: payloads.read(spark, path, name))
    return best.orderBy(F.desc("early"), "seq").limit(20).select("source", "company", "title", "apply_url", "early")


@query(f"""WITH {_JOB_SQL}, s AS (SELECT unnest({L._list([s[0] for s in D.SOURCES])}) AS source),
c AS (SELECT source, count(*) AS returned, string_agg(title, '; ' ORDER BY p_partkey) AS sample_titles FROM f GROUP BY source), t AS (SELECT source, count(*) AS kept FROM kept GROUP BY source)
SELECT source, CASE WHEN NOT list_contains({L._list(BOARDS)}, source) THEN 'skipped' WHEN source IN ('jobicy', 'themuse') THEN 'error' WHEN returned IS NULL THEN 'empty' ELSE 'ok' END AS status,
  CAST(CASE WHEN list_contains({L._list(BOARDS)}, source) THEN 5 ELSE 0 END AS INTEGER) AS requested, coalesce(returned, 0) AS returned, coalesce(kept, 0) AS kept, coalesce(sample_titles, '') AS sample_titles FROM s LEFT JOIN c USING (source) LEFT JOIN t USING (source)""")
def fetch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source was asked for, returned and kept, with its status; broken payloads fail no other source."""
    path = _job_files(spark, sf_dir)
    _, report = readers.aggregate_with_report(payloads.read(spark, path), L.as_of(), BOARDS, 40, P, lambda name: payloads.read(spark, path, name))
    return report.select("source", "status", "requested", "returned", "kept", "sample_titles")


@query("SELECT c_nationkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey")
def latest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the largest id of each key."""
    return S.latest_of(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey").select("c_nationkey", "c_name")


@query("""SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS run_id, c_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 = 3 AND o_totalprice >= 1000""")
def run_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of one run with their listings, from a score on."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("run_id"), F.col("o_custkey").alias("listing_id"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("listing_id"))
    return sinks.matches_of(orders, customers, 3, "listing_id", "o_totalprice", 1000).select("o_orderkey", "run_id", F.col("listing_id").alias("c_custkey"), "o_totalprice")


_SHORT = "CASE WHEN trim(text) = '' THEN 'Consider' WHEN length(trim(text)) <= 160 THEN trim(text) ELSE rtrim(substring(trim(text), 1, 159)) || '…' END"


@query(f"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations)
SELECT conv_id, turn, {_SHORT} AS reason, substring(trim(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 60) AS filename FROM c""")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20, P23."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return rows.select("conv_id", "turn", X.short_reason(F.array("text"), F.lit("Consider")).alias("reason"), X.safe_filename("text").alias("filename"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '{D.QUERY_PREFIX}' ELSE '' END || lang AS query, CASE WHEN doc_id % 3 < 2 THEN '{D.PASSAGE_PREFIX}' ELSE '' END || source AS passage FROM documents""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes by the family of the model."""
    model = L.pick(["BAAI/bge-base", "intfloat/e5-base", "other"], F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", X.model_query("lang", model).alias("query"), X.model_passage("source", model).alias("passage"))
