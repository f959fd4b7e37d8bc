"""Listings made from documents, alike in Spark and in SQL: titles, places and phrases come from small fixed lists by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_hash
from tessera.operators.profile import Profile

AS_OF_TEXT = "2024-01-31 00:00:00"
TITLES = ["Machine Learning Engineer", "Senior Python Developer", "Data Analyst Intern", "Sales Engineer", "Lead Platform Architect", "Junior Backend Developer", "SAP ABAP Consultant", "Head of Data", "NLP Scientist", "Office Manager", "Frontend Developer (React)", "VP Engineering", "Graduate Data Scientist"]
PLACES = ["Bangalore, Karnataka", "Remote", "New Delhi", "London, UK", "", "Mumbai / Pune", "San Francisco, CA", "Work from home", "Chennai", "Hyderabad, Telangana", "Paris"]
PHRASES = [
    "We need 3+ years of Python and SQL. Posted 2 days ago",
    "Fully remote role. Minimum 5 years experience with Kubernetes.",
    "Requirements: 1-3 years, full-time, PyTorch or TensorFlow",
    "An internship for students. Posted today",
    "Hybrid work; at least 10 years in sales",
    "Part time contract with React and JavaScript, posted 3 weeks ago",
    "On-site. 2 years of relevant experience",
]
CLAIMED = [["Python", "SQL"], ["Excel"], ["PyTorch", "python "], [], ["Communication", "Kubernetes"]]
PROFILE = Profile(skills=("PyTorch", "SQL", "Kubernetes", "Excel"), roles=("machine learning engineer", "data scientist"), location="Bangalore, Mumbai", tier=1, years_min=0, years_max=3)


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def pick(items: list, c: Column) -> Column:
    lit = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list) else F.lit(x)
    return F.element_at(F.array(*map(lit, items)), (F.pmod(c, F.lit(len(items))) + 1).cast("int"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    n = F.col("doc_id")
    out = docs.select(
        n.alias("seq"),
        "source",
        F.col("lang").alias("company"),
        pick(TITLES, n).alias("title"),
        F.concat_ws("\n", pick(PHRASES, n), "text").alias("description"),
        F.lit("").alias("requirements"),
        pick(CLAIMED, n).alias("skills"),
        pick(PLACES, n).alias("location"),
        F.when(n % 17 != 0, as_of() - F.make_dt_interval((n % 60).cast("int"), F.lit(1))).alias("posted_at"),
        (as_of() - F.make_dt_interval(F.lit(0), (n % 72).cast("int"), F.lit(30))).alias("scraped_at"),
        F.concat(F.lit("https://jobs.example.com/"), (n % 400).cast("string"), F.when(n % 2 == 0, "/?ref=a").otherwise("")).alias("apply_url"),
    )
    return out.withColumn("content_hash", content_hash("company", "title", "description"))


def _list(items: list) -> str:
    quoted = lambda x: "[" + ", ".join(map(quoted, x)) + "]::VARCHAR[]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'"
    return "[" + ", ".join(map(quoted, items)) + "]"


def sql_pick(items: list, c: str = "doc_id") -> str:
    return f"({_list(items)})[CAST({c} % {len(items)} + 1 AS INTEGER)]"


#: The same listings, as the start of a WITH clause.
SQL = f"""
d AS (
  SELECT doc_id AS seq, source, lang AS company, {sql_pick(TITLES)} AS title, {sql_pick(PHRASES)} || chr(10) || text AS description,
    {sql_pick(CLAIMED)} AS skills, {sql_pick(PLACES)} AS location,
    CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '{AS_OF_TEXT}' - to_days(CAST(doc_id % 60 AS INTEGER)) - INTERVAL 1 HOUR END AS posted_at,
    TIMESTAMP '{AS_OF_TEXT}' - to_hours(CAST(doc_id % 72 AS INTEGER)) - INTERVAL 30 MINUTE AS scraped_at,
    'https://jobs.example.com/' || (doc_id % 400) || CASE WHEN doc_id % 2 = 0 THEN '/?ref=a' ELSE '' END AS apply_url
  FROM documents
), l AS (
  SELECT *, sha256(lower(regexp_replace(company, '^\\s+|\\s+$', '', 'g')) || '|' || lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) || '|' ||
    lower(regexp_replace(substring(description, 1, 500), '^\\s+|\\s+$', '', 'g'))) AS content_hash
  FROM d
)"""
