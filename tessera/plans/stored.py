"""Registered queries on tables that batches change, and on texts made of the given tables, each with the SQL that must give the same
rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.operators import profile, state
from tessera.plans import listings as L
from tessera.plans.queries import query, table
from tessera.session import shared_folder, spread
from tessera.sources import sinks, tables
from tessera.streaming import firsts, notices


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- tables that batches change

_BATCHES = f"""WITH {L.SQL}, b AS (SELECT *, CASE WHEN seq % 4 <> 0 THEN '' || seq ELSE '' END AS salary, CASE WHEN seq % 5 <> 0 THEN seq || ' years' ELSE '' END AS experience FROM l), o AS (SELECT *, (seq % 3) * 1000000000000 + seq AS o FROM b)"""


@query(f"""{_BATCHES}
SELECT content_hash, arg_min(source, o) AS source, arg_min(salary, o) AS salary, arg_max(experience, o) FILTER (WHERE experience <> '') AS experience, arg_max(location, o) FILTER (WHERE location <> '') AS location,
  arg_max(apply_url, o) FILTER (WHERE apply_url <> '') AS apply_url, array_to_string(arg_max(skills, o) FILTER (WHERE len(skills) > 0), ',') AS skills, min(coalesce(posted_at, scraped_at)) AS posted_at,
  arg_max(scraped_at, o) AS scraped_at, sha256(arg_max(description, {{'n': length(description), 'o': -o}})) AS description_sha256, CAST(max(seq % 3) AS BIGINT) AS batch FROM o GROUP BY content_hash""")
def upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches merged into a stored table, the second given once more after the third. `batch` is the last that
    brought a row of the hash."""
    n = F.col("seq")
    rows = L.listings(spark, sf_dir).withColumns({"salary": F.when(n % 4 != 0, n.cast("string")).otherwise(""), "experience": F.when(n % 5 != 0, F.concat(n.cast("string"), F.lit(" years"))).otherwise(""), "last": n % 3})
    told = lambda stored, batch: state.merge_listings(stored, batch).join(_last(stored, batch), "content_hash")
    schema, path = told(rows.limit(0), rows).schema, _folder(spark, "listings")
    tables.create(spark, path, schema)
    for k in (0, 1, 2, 1):
        tables.upsert(rows.where(n % 3 == k), k, path, schema, "content_hash", told)
    out = tables.read(spark, path, schema)
    return out.select("content_hash", "source", "salary", "experience", "location", "apply_url", F.array_join("skills", ",").alias("skills"), "posted_at", "scraped_at", F.sha2("description", 256).alias("description_sha256"), F.col("last").alias("batch"))


def _last(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return stored.select("content_hash", "last").union(batch.select("content_hash", "last")).groupBy("content_hash").agg(F.max("last").alias("last"))


@query(f"WITH {L.SQL}, f AS (SELECT content_hash, arg_min(seq, seq % 2 * 1000000000000 + seq) AS id FROM l GROUP BY content_hash) SELECT seq, id FROM l JOIN f USING (content_hash) WHERE seq % 2 = 1")
def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that the rows of a second batch have in the table, whose id is the seq of a hash's first row."""
    rows = L.listings(spark, sf_dir).withColumns({"salary": F.lit(""), "experience": F.lit("")})
    schema, path = state.merge_listings(rows.limit(0), rows).schema, _folder(spark, "ids")
    tables.create(spark, path, schema)
    for k in (0, 1):
        tables.upsert(rows.where(F.col("seq") % 2 == k), k, path, schema, "content_hash", state.merge_listings)
    return tables.ids_of(rows.where("seq % 2 = 1"), path, schema, "content_hash", "seq")


@query("SELECT vec_id, label, len(embedding) AS n, CAST(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS batch FROM embeddings")
def vector_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the vectors, then all of them, then all once more; `batch` is the one that brought a row."""
    rows, path = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), _folder(spark, "vectors")
    tables.create(spark, path, rows.schema)
    for number, batch in enumerate((rows.where("vec_id % 2 = 0"), rows, rows), 1):
        tables.append_new(batch, number, path, rows.schema, "vec_id")
    return tables.read(spark, path, rows.schema).select("vec_id", "label", F.size("embedding").cast("long").alias("n"), "batch")


@query(f"""WITH {L.SQL} SELECT CAST(seq % 3 AS INTEGER) AS run_id, seq, content_hash, CAST(seq * 37 % 101 + CASE WHEN seq % 3 = 1 THEN 1000 ELSE 0 END AS INTEGER) AS match_score FROM l
WHERE content_hash IN (SELECT content_hash FROM l WHERE seq % 2 = 0)""")
def saved_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of three runs whose listing is stored; then one run is saved again, which replaces its rows alone."""
    rows, path = L.listings(spark, sf_dir), _folder(spark, "matches")
    matches = rows.select((F.col("seq") % 3).cast("int").alias("run_id"), "seq", "content_hash", (F.col("seq") * 37 % 101).cast("int").alias("match_score"))
    again = matches.where("run_id = 1").withColumn("match_score", F.col("match_score") + 1000)
    for batch in (matches, again):
        sinks.save_matches(batch, rows.where("seq % 2 = 0"), path)
    return spark.read.parquet(path).select(F.col("run_id").cast("int").alias("run_id"), "seq", "content_hash", "match_score")


@query(f"WITH {L.SQL} SELECT seq, title, source, sha256(description) AS description_sha256 FROM l")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of each batch, written and read."""
    rows, path = L.listings(spark, sf_dir).select("seq", "title", "description", F.col("source").alias("origin")), _folder(spark, "snapshots")
    for k in (0, 1):
        sinks.snapshot(rows.where(F.col("seq") % 2 == k), path, "documents", str(k))
    back = spark.read.schema("seq long, title string, description string, origin string").json(path)
    return back.select("seq", "title", F.col("origin").alias("source"), F.sha2("description", 256).alias("description_sha256"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def appended_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended in two batches, and the last of each user."""
    rows, path = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), _folder(spark, "profiles")
    for k in (1, 0):
        sinks.append(rows.where(F.col("event_id") % 2 == k), path)
    return state.latest_of(spark.read.parquet(path), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT user_id || ':' || event_type AS state_key FROM events")
def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01 on a stream: the rows of each key that come first."""
    return notices.run_once(firsts.first_seen(notices.event_stream(spark, f"{sf_dir}/events.parquet"), "state_key", late="100 days").select("state_key"), "firsts")


# ---------------------------------------------------------------- budgets


@query("""WITH w AS (SELECT lang, source AS name, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, 10000 * n // CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) AS share FROM w),
r AS (SELECT *, 10000 - sum(share) OVER (PARTITION BY lang) AS gap, row_number() OVER (PARTITION BY lang ORDER BY n DESC, name) AS k, count(*) OVER (PARTITION BY lang) AS m FROM s)
SELECT lang, name, CAST(share + gap // m + CASE WHEN k <= gap % m THEN 1 ELSE 0 END AS INTEGER) AS budget FROM r""")
def weighted_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand rows of each language over its sources, by their documents, with the table function."""
    profile.register_budget(spark)
    sizes = table(spark, sf_dir, "documents").groupBy("lang", F.col("source").alias("name")).agg(F.count("*").cast("double").alias("weight"))
    out = spark.sql("SELECT b.* FROM weighted_budget(TABLE(SELECT concat_ws(chr(9), lang, name) AS name, weight, lang FROM {sizes}) PARTITION BY (lang), 10000, 1) b", sizes=sizes)
    return out.select(F.split_part("name", F.lit("\t"), F.lit(1)).alias("lang"), F.split_part("name", F.lit("\t"), F.lit(2)).alias("name"), "budget")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 23 AS INTEGER) AS total, CAST(o_orderkey % 7 AS INTEGER) AS n FROM orders)
SELECT o_orderkey, k, CAST(total // n + CASE WHEN k <= total % n THEN 1 ELSE 0 END AS INTEGER) AS part FROM (SELECT *, CAST(unnest(range(1, n + 1)) AS INTEGER) AS k FROM o WHERE n > 0)""")
def split_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit over queries."""
    n = F.col("o_orderkey")
    parts = profile.split_limits(n % 23, n % 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(parts).alias("k", "part")).select("o_orderkey", (F.col("k") + 1).alias("k"), "part")


# ---------------------------------------------------------------- texts

_NAMES = ", ".join(f"('{near}', '{name}')" for near, name in {n: name for name, others in reversed(D.SKILL_ALIASES.items()) for n in (name, *others)}.items())


@query(f"""WITH a(near, name) AS (VALUES {_NAMES}), t AS (SELECT p_partkey, (SELECT list(near ORDER BY near) FROM a) AS l FROM part),
u AS (SELECT p_partkey, l[CAST(p_partkey % len(l) + 1 AS INTEGER)] AS said FROM t) SELECT p_partkey, coalesce(name, said) AS skill FROM u LEFT JOIN a ON near = said""")
def canonical_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part says one of the known names of skills, in upper case."""
    known = sorted({n for name, others in D.SKILL_ALIASES.items() for n in (name, *others)})
    return table(spark, sf_dir, "part").select("p_partkey", profile.canonical_skills(F.upper(L.pick(known, F.col("p_partkey")))).alias("skill"))


@query(f"""WITH {L.SQL} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'https://www.google.com/search?q=' || replace(url_encode(title || ' ' || company || ' job apply'), '%20', '+')
  WHEN seq % 3 = 1 THEN 'https://b.example/jobs/' || seq ELSE apply_url END AS url FROM l""")
def apply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search link where there is no address, relative ones under a base, others as they are."""
    n = F.col("seq")
    given = F.when(n % 3 == 0, " ").when(n % 3 == 1, F.concat(F.lit("/jobs/"), n.cast("string"))).otherwise(F.col("apply_url"))
    return L.listings(spark, sf_dir).select("seq", X.apply_url(given, "company", "title", "https://b.example/").alias("url"))


_SIZES = (70, 72, 34, 33, 32, 27, 22, 14, 13, 9, 8, 7, 3)


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 80 = 15 THEN 2.0 WHEN p_partkey % 80 IN {_SIZES} THEN CAST(p_partkey % 80 AS DOUBLE) END AS size FROM part")
def model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25."""
    k = F.col("p_partkey")
    tag = F.concat(F.lit(" Model:"), F.when(k % 5 == 0, "1.5").otherwise((k % 80).cast("string")), F.lit("B-instruct"))
    return table(spark, sf_dir, "part").select("p_partkey", X.model_size(tag).alias("size"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '|' || p_type || ' (' || p_brand || ')' WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE '' END AS certifications FROM part""")
def certification_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of texts and objects, a single text, an object without a provider, and none."""
    k, name = F.col("p_partkey") % 4, F.to_json(F.array("p_name"))
    whole = lambda *c: F.to_json(F.struct(*c))
    item = F.regexp_extract(name, r"(?s)^\[(.*)\]$", 1)
    both = F.concat(F.lit("["), item, F.lit(', "  ", null, '), whole(F.col("p_type").alias("title"), F.col("p_brand").alias("issuer")), F.lit("]"))
    said = F.when(k == 0, both).when(k == 1, item).when(k == 2, F.concat(F.lit("["), whole(F.col("p_type").alias("name")), F.lit("]"))).otherwise("null")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.certifications(said), "|").alias("certifications"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"key": ' || p_partkey || ', "size": [' || p_size || ']}' WHEN 1 THEN '{"key": ' || p_partkey || '}' END AS json FROM part""")
def salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fenced reply with commas too many, a bare one among words, and one without JSON."""
    k = F.col("p_partkey").cast("string")
    fenced = F.concat(F.lit('Here it is:\n```json\n{"key": '), k, F.lit(', "size": ['), F.col("p_size").cast("string"), F.lit(", ], }\n```\nDone."))
    said = F.when(F.col("p_partkey") % 3 == 0, fenced).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('Sure. {"key": '), k, F.lit("} is all"))).otherwise(F.concat(F.lit("none "), k))
    return table(spark, sf_dir, "part").select("p_partkey", X.json_salvage(said).alias("json"))


_FLAT = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(rf"""SELECT doc_id, 'Name ' || doc_id AS head, sha256({_FLAT}) AS experience_sha256, CASE WHEN doc_id % 2 = 0 THEN 'one' || chr(10) || 'two' END AS skills FROM documents WHERE text IS NOT NULL AND {_FLAT} <> ''""")
def resume_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the experience of a resume, with skills in every second one."""
    docs = table(spark, sf_dir, "documents")
    flat = F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "))
    skills = F.when(F.col("doc_id") % 2 == 0, "\nTechnical Skills\n one\ntwo \n").otherwise("")
    parts = X.resume_sections(F.concat(F.lit("Name "), F.col("doc_id").cast("string"), F.lit("\nWork Experience:\n"), flat, skills))
    return docs.where(flat != "").select("doc_id", parts["header"].alias("head"), F.sha2(parts["work experience"], 256).alias("experience_sha256"), parts["technical skills"].alias("skills"))


@query("SELECT event_id, date_trunc('second', ts) - INTERVAL 330 MINUTE AS moved, date_trunc('second', ts) AS dropped FROM events")
def offset_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offset is converted, or dropped."""
    said = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'")
    events = spread(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    return events.select("event_id", T.posted_at(said, L.as_of()).alias("moved"), T.posted_at(said, L.as_of(), keep_offset=False).alias("dropped"))
