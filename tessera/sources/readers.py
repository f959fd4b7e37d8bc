"""Readers of job boards' payloads into listings, and their union.

A payload is a column of JSON or XML text, one document in a row, so it may come from files, tables or a stream. Each reader
is a projection; a payload that doesn't parse gives no rows instead of an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import text as X
from tessera.functions.temporal import posted_at
from tessera.operators import matching, scoring, state
from tessera.operators.profile import Profile, even_budget
from tessera.session import checkpointed

LISTING = ["source", "company", "title", "description", "skills", "location", "salary", "apply_url", "posted_at", "content_hash", "place"]


def _either(*columns: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[F.nullif(X.strip(c), F.lit("")) for c in columns], F.lit(""))


def _words(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(c, X.strip), lambda s: s != ""), F.array().cast("array<string>"))


def _listings(rows: DataFrame, source: str, as_of: Column, *, company: Column, title: Column, description: Column, url: Column, posted: Column, skills: Column | None = None, location: Column | None = None, salary: Column | None = None, base: str = "") -> DataFrame:
    out = rows.select(
        F.struct("_seq", "_at").alias("place"),
        F.lit(source).alias("source"),
        X.strip(company).alias("company"),
        X.strip(title).alias("title"),
        X.strip_html(description).alias("description"),
        (F.array().cast("array<string>") if skills is None else _words(skills)).alias("skills"),
        (F.lit("Remote") if location is None else location).alias("location"),
        (F.lit("") if salary is None else X.text(salary)).alias("salary"),
        X.strip(url).alias("_url"),
        posted_at(posted, as_of).alias("posted_at"),
    )
    out = out.where(F.col("title") != "").withColumn("apply_url", X.apply_url("_url", "company", "title", base))
    return out.withColumn("content_hash", X.content_hash("company", "title", "description")).select(*LISTING)


def _items(payloads: DataFrame, column: str, schema: str, path: str | None = None) -> DataFrame:
    """The objects of a list, on its own or under a name."""
    source = F.concat(F.lit('{"items":'), F.col(column), F.lit("}")) if path is None else F.col(column)
    parsed = F.from_json(source, f"struct<{path or 'items'}:array<struct<{schema}>>>")
    return _placed(payloads, parsed[path or "items"]).where(F.col("i").isNotNull()).select("_seq", "_at", "i.*")


def _placed(payloads: DataFrame, items: Column) -> DataFrame:
    """(_seq, _at, i): each item with the payload's seq, 0 without one, and its place in the payload."""
    seq = F.col("seq").cast("long") if "seq" in payloads.columns else F.lit(0).cast("long")
    return payloads.select(seq.alias("_seq"), F.posexplode(items).alias("_at", "i"))


def remotive(p: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    r = _items(p, column, "title:string,company_name:string,description:string,tags:array<string>,candidate_required_location:string,salary:string,url:string,publication_date:string", "jobs")
    return _listings(r, "remotive", as_of, company=F.col("company_name"), title=F.col("title"), description=F.col("description"), url=F.col("url"), posted=F.col("publication_date"), skills=F.col("tags"), location=F.coalesce(F.nullif(X.strip("candidate_required_location"), F.lit("")), F.lit("Remote")), salary=F.col("salary"))


def remoteok(p: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    """The first element may be a legal notice; what has no title is left out."""
    r = _items(p, column, "position:string,title:string,company:string,description:string,tags:array<string>,location:string,salary_min:string,url:string,apply_url:string,date:string,epoch:string")
    return _listings(r, "remoteok", as_of, company=F.col("company"), title=_either(F.col("position"), F.col("title")), description=F.col("description"), url=_either(F.col("url"), F.col("apply_url")), posted=_either(F.col("date"), F.col("epoch")), skills=F.col("tags"), location=_either(F.col("location"), F.lit("Remote")), salary=F.col("salary_min"))


def arbeitnow(p: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    r = _items(p, column, "title:string,company_name:string,description:string,tags:array<string>,location:string,url:string,created_at:string", "data")
    return _listings(r, "arbeitnow", as_of, company=F.col("company_name"), title=F.col("title"), description=F.col("description"), url=F.col("url"), posted=F.col("created_at"), skills=F.col("tags"), location=_either(F.col("location"), F.lit("Remote")))


def jobicy(p: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    r = _items(p, column, "jobTitle:string,companyName:string,jobDescription:string,jobIndustry:string,jobGeo:string,annualSalaryMin:string,url:string,pubDate:string", "jobs")
    return _listings(r, "jobicy", as_of, company=F.col("companyName"), title=F.col("jobTitle"), description=F.col("jobDescription"), url=F.col("url"), posted=F.col("pubDate"), skills=F.array("jobIndustry"), location=_either(F.col("jobGeo"), F.lit("Remote")), salary=F.col("annualSalaryMin"))


def himalayas(p: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    r = _items(p, column, "title:string,companyName:string,description:string,categories:array<string>,applicationLink:string,slug:string,pubDate:string", "jobs")
    return _listings(r, "himalayas", as_of, company=F.col("companyName"), title=F.col("title"), description=F.col("description"), url=_either(F.col("applicationLink"), F.col("slug")), posted=F.col("pubDate"), skills=F.col("categories"), base="https://himalayas.app/jobs")


def themuse(p: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    r = _items(p, column, "name:string,contents:string,company:struct<name:string>,locations:array<struct<name:string>>,categories:array<struct<name:string>>,refs:struct<landing_page:string>,publication_date:string", "results")
    places = F.array_join(F.transform("locations", lambda x: x["name"]), ", ")
    return _listings(r, "themuse", as_of, company=F.col("company.name"), title=F.col("name"), description=F.col("contents"), url=F.col("refs.landing_page"), posted=F.col("publication_date"), skills=F.transform("categories", lambda x: x["name"]), location=_either(places, F.lit("Remote")))


def weworkremotely(p: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    """RSS; a title is `company: role`."""
    found = F.from_xml(column, "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>")
    r = _placed(p, found["channel"]["item"]).select("_seq", "_at", "i.*")
    two = F.split("title", ":", 2)
    company = F.when(F.size(two) > 1, two[0]).otherwise("Remote")
    return _listings(r, "weworkremotely", as_of, company=company, title=F.coalesce(F.try_element_at(two, F.lit(2)), F.col("title")), description=F.col("description"), url=F.col("link"), posted=F.col("pubDate"))


def workingnomads(p: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    """A bare list, or one under `jobs` or `results`; tags may be one text with commas."""
    v = F.try_parse_json(column)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.jobs", "array<variant>"), F.try_variant_get(v, "$.results", "array<variant>"))
    r = _placed(p, items)
    get = lambda *names: _either(*[F.try_variant_get("i", f"$.{n}", "string") for n in names])
    tags = F.coalesce(F.try_variant_get("i", "$.tags", "array<string>"), F.split(get("tags"), ","))
    return _listings(r, "workingnomads", as_of, company=get("company_name", "company"), title=get("title"), description=get("description"), url=get("url", "apply_url"), posted=get("pub_date", "date"), skills=tags, location=F.coalesce(F.nullif(get("location"), F.lit("")), F.lit("Remote")))


def cards(p: DataFrame, source: str, as_of: Column, column: str = "payload", link: str = "href") -> DataFrame:
    """Card texts of browsed boards: title, company and place on the first three lines that aren't blank."""
    p = p.withColumns({"_seq": F.col("seq").cast("long") if "seq" in p.columns else F.lit(0).cast("long"), "_at": F.lit(0)})
    lines = F.filter(F.transform(F.split(column, r"\r\n|\r|\n"), X.strip), lambda s: s != "")
    at = lambda k: F.coalesce(F.try_element_at(lines, F.lit(k)), F.lit(""))
    return _listings(p, source, as_of, company=at(2), title=at(1), description=F.col(column), url=F.col(link), posted=F.col(column), location=at(3))


READERS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {f.__name__: f for f in (remotive, remoteok, arbeitnow, jobicy, himalayas, themuse, weworkremotely, workingnomads)}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(D.SOURCES, "source string, kind string, safety string, default_on boolean")


def with_health(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Sources with their last health, ok where there is none."""
    return sources.join(health, "source", "left").withColumn("status", F.coalesce("status", F.lit("ok"))).withColumn("detail", F.coalesce("detail", F.lit("")))


def resolved(asked: list[str]) -> list[str]:
    """Known ids of those asked for, in order; the defaults if there is none."""
    known = [s[0] for s in D.SOURCES]
    return [s for s in known if s in asked] or [s[0] for s in D.SOURCES if s[3]]


def lookup(name: str) -> Callable[..., DataFrame]:
    """The reader of that name; all of them together for a name that isn't known."""
    return READERS.get(name, aggregate)


def aggregate(payloads: DataFrame, as_of: Column, asked: list[str] | None = None, limit: int | None = None, p: Profile | None = None, of: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Listings of the readers asked for over payloads (source, payload, seq), or of(source) for each source, with `seq`: in order of the registry, then of the
    payloads. Copies by hash go within each source; with a limit each then gives its first rows up to an even budget; then copies by
    hash or address go over all sources, the earlier stays; then the best `limit` stay, by early relevance to p if there is one, then
    by date. A payload with `error`, if there is such a column, gives no rows."""
    return _ranked(_distinct(_fetched(payloads, as_of, asked, limit, of)), limit, p)


def _fetched(payloads: DataFrame, as_of: Column, asked: list[str] | None, limit: int | None, of: Callable[[str], DataFrame] | None) -> DataFrame:
    """What the sources return: their own copies gone, cut to their budgets."""
    names = [s for s in resolved(asked or []) if s in READERS]
    budget = even_budget(limit, names) if limit is not None else {}
    out = None
    for k, name in enumerate(names):
        mine = of(name) if of else payloads.where(F.col("source") == name)
        mine = mine.where("error IS NULL") if "error" in mine.columns else mine
        one = state.first_of(READERS[name](mine, as_of), "content_hash", "place")
        if limit is not None:
            one = one.orderBy("place").limit(budget[name])
        one = one.withColumn("seq", F.struct(F.lit(k).alias("source"), "place"))
        out = one if out is None else out.unionByName(one)
    return out.drop("place")


def _distinct(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_identity", X.identity_key("apply_url", "company", "title"))
    return state.greedy_dedup(rows, ("content_hash", "_identity")).drop("_identity")


def _ranked(rows: DataFrame, limit: int | None, p: Profile | None) -> DataFrame:
    if limit is None:
        return rows
    hay = F.lower(F.concat_ws(" ", "title", "description", F.array_join("skills", " ")))
    early = scoring.early(F.col("title"), hay, matching.skill_hits(hay, p), p) if p else F.lit(0)
    return rows.withColumn("early", early.cast("int")).orderBy(F.desc("early"), F.desc_nulls_last("posted_at"), "seq").limit(limit)


def aggregate_with_report(payloads: DataFrame, as_of: Column, asked: list[str], limit: int, p: Profile | None = None, of: Callable[[str], DataFrame] | None = None, samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """(listings, report) of payloads (source, payload, seq, error). The report has a row for each source of the registry (source,
    status, requested, returned, kept, detail, sample_titles): skipped if it wasn't asked for, error with the first error of its
    payloads, empty without rows, else ok. A source keeps the rows of its good payloads, and other sources are not touched."""
    fetched = checkpointed(_fetched(payloads, as_of, asked, limit, of))
    kept = checkpointed(_distinct(fetched))
    names = [s for s in resolved(asked) if s in READERS]
    budget = even_budget(limit, names)
    told = fetched.groupBy("source").agg(F.count("*").alias("returned"), F.array_sort(F.collect_list(F.struct("seq", "title"))).alias("titles"))  # at most its budget
    told = told.select("source", "returned", F.array_join(F.transform(F.slice("titles", 1, samples), lambda t: t["title"]), "; ").alias("sample_titles"))
    bad = payloads.where("error IS NOT NULL").groupBy("source").agg(F.min_by("error", F.struct("seq", "error")).alias("error"))
    sources = payloads.sparkSession.createDataFrame([(s[0], budget.get(s[0])) for s in D.SOURCES], "source string, budget int")
    rows = sources.join(told, "source", "left").join(kept.groupBy("source").agg(F.count("*").alias("kept")), "source", "left").join(bad, "source", "left")
    skipped, none = F.col("budget").isNull(), F.col("returned").isNull()
    status = F.when(skipped, "skipped").when(F.col("error").isNotNull(), "error").when(none, "empty").otherwise("ok")
    detail = F.when(skipped, "not asked for").when(F.col("error").isNotNull(), F.substring("error", 1, 300)).when(none, "no rows").otherwise("")
    zero = lambda c: F.when(skipped, 0).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    report = rows.select("source", status.alias("status"), F.coalesce("budget", F.lit(0)).alias("requested"), zero("returned"), zero("kept"), detail.alias("detail"), F.when(skipped, "").otherwise(X.text("sample_titles")).alias("sample_titles"))
    return _ranked(kept, limit, p), report
