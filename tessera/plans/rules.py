"""More registered queries: payload readers, dates, addresses, labels, runs, and scores. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.operators import matching, reporting, retrieval, scoring, state
from tessera.operators.profile import expand_skill
from tessera.plans import listings as L
from tessera.plans.queries import _AGE, _HAY, _HITS, P, query, table
from tessera.session import spread
from tessera.sources import readers, sinks

BOARDS = ["remotive", "remoteok", "arbeitnow", "jobicy", "himalayas", "themuse", "weworkremotely", "workingnomads"]
_PLACE_OF = {"jobicy": "EMEA", "themuse": "A, B"}


def _payloads(parts: DataFrame, job_key: Column | None = None, body: Column | None = None) -> DataFrame:
    """(source, payload, seq): each part as the only job of a payload in the form of one of the boards."""
    title, company = F.col("p_name"), F.col("p_brand")
    key = (F.col("p_partkey") if job_key is None else job_key).cast("string")
    body = F.concat_ws(" ", "p_type", key) if body is None else body
    text, url, day = F.concat_ws(" ", F.lit("<p>"), body, F.lit("</p>")), F.concat(F.lit("https://x.example/"), key), F.lit("2024-01-05")
    job = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    names = lambda *items: F.array(*[F.struct(F.lit(x).alias("name")) for x in items])
    under = lambda name, item: F.to_json(F.struct(F.array(item).alias(name)))
    item = lambda tag, c: F.concat(F.lit(f"<{tag}>"), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(f"</{tag}>"))
    forms = {
        "remotive": under("jobs", job(title=title, company_name=company, description=text, tags=F.array(company, F.lit(" ")), url=url, publication_date=day)),
        "remoteok": F.to_json(F.array(job(position=title, company=company, description=text, tags=F.array(company), url=url, date=day))),
        "arbeitnow": under("data", job(title=title, company_name=company, description=text, tags=F.array(company), url=url, created_at=F.lit("1704412800"))),
        "jobicy": under("jobs", job(jobTitle=title, companyName=company, jobDescription=text, jobIndustry=company, jobGeo=F.lit("EMEA"), url=url, pubDate=day)),
        "himalayas": under("jobs", job(title=title, companyName=company, description=text, categories=F.array(company), applicationLink=url, pubDate=day)),
        "themuse": under("results", job(name=title, contents=text, company=F.struct(company.alias("name")), locations=names("A", "B"), categories=names("x"), refs=F.struct(url.alias("landing_page")), publication_date=day)),
        "weworkremotely": F.concat(F.lit("<rss><channel><item>"), item("title", F.concat(company, F.lit(": "), title)), item("link", url), item("description", text), item("pubDate", F.lit("Fri, 05 Jan 2024 00:00:00 +0000")), F.lit("</item></channel></rss>")),
        "workingnomads": F.to_json(F.array(job(title=title, company_name=company, description=text, tags=F.concat_ws(", ", company), url=url, pub_date=day))),
    }
    source = L.pick(BOARDS, F.col("p_partkey"))
    payload = F.coalesce(*[F.when(source == name, form) for name, form in forms.items()])
    return parts.select(source.alias("source"), payload.alias("payload"), F.col("p_partkey").alias("seq"))


@query(f"""WITH s AS (SELECT *, {L.sql_pick(BOARDS, 'p_partkey')} AS source FROM part)
SELECT source, p_brand AS company, trim(p_name) AS title, p_type || ' ' || p_partkey AS description, CAST(CASE WHEN source = 'weworkremotely' THEN 0 ELSE 1 END AS INTEGER) AS n_skills,
  CASE source {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _PLACE_OF.items())} ELSE 'Remote' END AS location, 'https://x.example/' || p_partkey AS apply_url, TIMESTAMP '2024-01-05' AS posted_at FROM s""")
def source_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S01 to S08, S14, D02, P01, P12, T01."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    rows = readers.aggregate(_payloads(parts), L.as_of(), BOARDS)
    return rows.select("source", "company", "title", "description", F.size("skills").alias("n_skills"), "location", "apply_url", "posted_at")


@query(f"""SELECT p_partkey, trim(p_name) AS title, p_brand AS company, p_type AS location, TIMESTAMP '{L.AS_OF_TEXT}' - to_days(CAST(p_partkey % 9 + 2 AS INTEGER)) AS posted_at FROM part""")
def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card texts of browsed boards."""
    lines = F.concat_ws("\n", "p_name", F.lit(""), "p_brand", "p_type", F.concat(F.lit("Posted "), (F.col("p_partkey") % 9 + 2).cast("string"), F.lit(" days ago")))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    cards = parts.select(lines.alias("payload"), F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("href"))
    return readers.cards(cards, "indeed", L.as_of()).select(F.regexp_extract("apply_url", "([0-9]+)$", 1).cast("long").alias("p_partkey"), "title", "company", "location", "posted_at")


_IDS = [s[0] for s in D.SOURCES]


@query(f"""WITH r AS (SELECT {L.sql_pick(_IDS[:10], 'event_id')} AS source, CASE WHEN event_id % 7 = 0 THEN 'rate_limited' ELSE 'ok' END AS status, event_id FROM events),
h AS (SELECT source, arg_max(status, event_id) AS status FROM r GROUP BY source)
SELECT source, coalesce(status, 'ok') AS status FROM (VALUES {', '.join(f"('{s}')" for s in _IDS)}) v(source) LEFT JOIN h USING (source)""")
def registry_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15, S16, J09, U08."""
    n = F.col("event_id")
    reports = table(spark, sf_dir, "events").select(L.pick(_IDS[:10], n).alias("source"), F.when(n % 7 == 0, "rate_limited").otherwise("ok").alias("status"), F.lit("").alias("detail"), n.alias("updated_at"))
    return readers.with_health(readers.registry(spark), state.latest_health(reports)).select("source", "status")


@query(f"""WITH l AS (SELECT source, count(*) AS returned FROM (SELECT {L.sql_pick(_IDS[:5], 'event_id')} AS source FROM events) GROUP BY source),
t AS (SELECT source, CASE WHEN returned IS NULL THEN 'skipped' ELSE 'ok' END AS status FROM (VALUES {', '.join(f"('{s}')" for s in _IDS)}) v(source) LEFT JOIN l USING (source))
SELECT status, string_agg(source, ',' ORDER BY source) AS sources FROM t GROUP BY status""")
def sources_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G04."""
    report = table(spark, sf_dir, "events").groupBy(L.pick(_IDS[:5], F.col("event_id")).alias("source")).agg(F.count("*").alias("returned"))
    return reporting.sources_by_status(report, readers.registry(spark).select("source"))


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (2, 5) THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS posted_at FROM events""")
def posted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ways to write a date."""
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    seconds = F.floor(F.unix_micros(ts) / 1_000_000)
    said = F.when(n == 0, seconds.cast("string")).when(n == 1, (seconds * 1000).cast("string")).when(n == 2, F.date_format(ts, "yyyy-MM-dd")).when(n == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    said = said.when(n == 4, F.concat(F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(2)), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))).otherwise(F.date_format(ts, "MMM dd, yyyy"))
    events = spread(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id").select("event_id", said.alias("said"))
    return events.select("event_id", T.posted_at("said", L.as_of()).alias("posted_at"))


@query("""WITH m AS (SELECT event_id, (2000 + event_id % 25) * 12 + event_id % 12 + 1 AS a, CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN 24289 WHEN 1 THEN 2023 * 12 + 6 ELSE 2022 * 12 + 1 END AS b FROM events)
SELECT event_id, CAST(greatest(0, b - a) + 12 AS INTEGER) AS months FROM m""")
def experience_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs each, the second of one year."""
    n = F.col("event_id")
    job = lambda a, b, now: F.struct(a.alias("start"), b.alias("end"), now.alias("current"))
    start = F.format_string("%d-%02d", n % 25 + 2000, n % 12 + 1)
    end = F.when(n % 3 == 1, "2023-06").when(n % 3 == 2, "2022").otherwise("")
    jobs = F.array(job(start, end, n % 3 == 0), job(F.lit("2010-01"), F.lit("2011"), F.lit(False)))
    return table(spark, sf_dir, "events").select("event_id", T.total_months(jobs, L.as_of()).alias("months"))


@query(f"""WITH {L.SQL}, a AS (SELECT seq, posted_at, CAST(floor({_AGE.format('posted_at')}) AS INTEGER) AS days FROM l)
SELECT seq, CASE WHEN posted_at IS NULL THEN 'Date unknown' WHEN days <= 0 THEN 'Posted today' WHEN days = 1 THEN 'Posted 1 day ago' ELSE 'Posted ' || days || ' days ago' END AS label FROM a""")
def posted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21."""
    return L.listings(spark, sf_dir).select("seq", T.posted_label(F.col("posted_at"), L.as_of()).alias("label"))


@query("""SELECT event_id, event_id % 4 = 1 AND ts > TIMESTAMP '2024-01-31' - INTERVAL 30 MINUTE AND ts <= ts AS cooling FROM events""")
def cool_downs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15."""
    status = F.when(F.col("event_id") % 4 == 1, "rate_limited").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", T.in_cool_down(status, F.col("ts"), L.as_of()).alias("cooling"))


@query("""SELECT page_id, 'https://base.example/jobs/' || CAST(page_id AS VARCHAR) AS slug, url AS whole, '' AS bare, 'https://***@h.example/' || page_id AS redacted FROM pages""")
def address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P04, P24."""
    key = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", X.absolute_url(F.concat(F.lit("/"), key), "https://base.example/jobs/").alias("slug"), X.absolute_url("url", "https://base.example").alias("whole"), X.absolute_url(key).alias("bare"), X.redacted_url(F.concat(F.lit("https://user:pass@h.example/"), key)).alias("redacted"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'highly') THEN 'Highly Recommended' WHEN contains(lower(text), 'skip') THEN 'Skip' ELSE 'Consider' END AS recommendation,
  CAST(greatest(0, least(100, round_even(length(text) / 2.0, 0))) AS INTEGER) AS clamped FROM conversations""")
def reply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P27, P30."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.recommendation("text").alias("recommendation"), X.clamped(F.length("text") / 2.0).alias("clamped"))


_SPLIT = "list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT conv_id, turn, {_SPLIT} AS w FROM conversations)
SELECT conv_id, turn, sha256(array_to_string(list_transform(list_filter(list_zip(w, range(len(w))), lambda x: list_position(list_transform(w, lambda y: lower(y)), lower(x[1])) = x[2] + 1), lambda x: x[1]), ' ')) AS words_sha256 FROM w""")
def ordered_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive, the first spelling stays."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.array_join(X.dedup_words(F.split("text", " ")), " "), 256).alias("words_sha256"))


@query("SELECT o_orderkey, c_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_totalprice >= 1000")
def matches_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner join after a filter on one run."""
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") >= 1000))
    return orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "o_totalprice")


@query("SELECT user_id AS run_id, arg_max(event_type, event_id) AS status, max(event_id) AS at FROM events GROUP BY user_id ORDER BY user_id DESC LIMIT 20")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log of runs."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("at"))
    return sinks.latest_runs(log)


@query("SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 15.0)) AS BIGINT) AS total_pages FROM orders")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages hold 15 rows at most."""
    return reporting.page_count(table(spark, sf_dir, "orders"), 40)


@query(f"""WITH {L.SQL}, h AS (SELECT seq, posted_at, scraped_at, {_HAY} AS hay FROM l), n AS (SELECT *, {_HITS} AS hits FROM h)
SELECT seq, CAST(greatest(0, least(100, 14 * hits {' '.join(f"+ CASE WHEN {' OR '.join(f"contains(hay, '{w}')" for w in role.lower().split() if len(w) > 2)} THEN 4 ELSE 0 END" for role in P.role_phrases())})) AS INTEGER) AS early
FROM n ORDER BY early DESC, coalesce(posted_at, scraped_at) DESC, seq LIMIT 100""")
def early_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best of an aggregate fetch."""
    hay = F.lower(F.concat_ws(" ", "title", "description", "requirements", F.array_join("skills", " ")))
    rows = L.listings(spark, sf_dir).withColumn("hay", hay).withColumn("hits", matching.skill_hits(F.col("hay"), P))
    rows = rows.withColumn("early", scoring.early(F.col("title"), F.col("hay"), F.col("hits"), P).cast("int"))
    return rows.orderBy(F.desc("early"), F.coalesce("posted_at", "scraped_at").desc(), "seq").limit(100).select("seq", "early")


_OWN = P.terms()
_CLAIMED_HITS = [sum(bool({*expand_skill(s)} & _OWN) for s in claimed) for claimed in L.CLAIMED]


@query(f"SELECT doc_id AS seq, CAST([{', '.join(map(str, _CLAIMED_HITS))}][CAST(doc_id % {len(L.CLAIMED)} + 1 AS INTEGER)] AS INTEGER) AS n_verified FROM documents")
def verified_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X08."""
    return L.listings(spark, sf_dir).select("seq", F.size(matching.verified_skills(F.col("skills"), P)).alias("n_verified"))


@query("""WITH w AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, min(CAST(embedding[1] AS DOUBLE)) OVER (PARTITION BY label) AS lo, max(CAST(embedding[1] AS DOUBLE)) OVER (PARTITION BY label) AS hi FROM embeddings)
SELECT vec_id, round(CASE WHEN hi - lo < 1e-6 THEN 0.5 ELSE (x - lo) / (hi - lo) END, 6) AS scaled FROM w""")
def pool_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled within each pool."""
    pool = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    return pool.select("vec_id", F.round(retrieval.min_max(F.col("x"), ["label"], 1e-6), 6).alias("scaled"))
