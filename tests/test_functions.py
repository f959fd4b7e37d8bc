"""Scalar rules on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.operators import matching as M
from tessera.operators.profile import Profile, cities_in, even_budget, expand_skill, split_limit, weighted_budget

AS_OF_TEXT = "2024-01-31 00:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def cases():
    AS_OF = F.lit(AS_OF_TEXT).cast("timestamp_ntz")
    return [
        (X.strip_html(F.lit("<li>one</li><li>two&nbsp;three</li> ")), "one  two three"),
        (X.strip_html(F.lit(None).cast("string")), ""),
        (X.identity_key(F.lit("HTTP://A.b/c/?x=1"), F.lit("C"), F.lit("T")), "url:http://a.b/c"),
        (X.identity_key(F.lit("/c"), F.lit(" Co "), F.lit("Dev ")), "ct:co|dev"),
        (X.absolute_url(F.lit("/jobs/1"), "https://a.example/"), "https://a.example/jobs/1"),
        (X.absolute_url(F.lit("slug"), "https://a.example/jobs"), "https://a.example/jobs/slug"),
        (X.absolute_url(F.lit("slug")), ""),
        (X.bare_url(F.lit("HTTPS://A.Example/Path/?q=1#f")), "https://a.example/Path"),
        (X.bare_url(F.lit("https://www.google.com/search?q=x")), ""),
        (X.remote_policy(F.lit("a Hybrid role"), F.lit("")), "hybrid"),
        (X.remote_policy(F.lit("x"), F.lit("Remote, EU")), "remote"),
        (X.employment_type(F.lit("a full-time job"), F.lit("x")), "full-time"),
        (X.json_salvage(F.lit('text ```json\n{"a": 1}\n``` more')), '{"a": 1}'),
        (X.json_salvage(F.lit('so {"a": [1, 2,],} done')), '{"a": [1, 2]}'),
        (X.json_salvage(F.lit("none")), None),
        (X.recommendation(F.lit("HIGHLY good")), "Highly Recommended"),
        (X.model_size(F.lit("llama:70b")), 70.0),
        (X.model_size(F.lit("tiny")), None),
        (X.redacted_url(F.lit("http://u:p@h:1/x")), "http://***@h:1/x"),
        (X.certifications(F.lit('[{"name": "A", "issuer": "B"}, "C", null]')), ["A (B)", "C"]),
        (X.certifications(F.lit(None).cast("string")), []),
        (X.dedup_words(F.array(F.lit("Sql"), F.lit(" sql"), F.lit(""), F.lit("R"))), ["Sql", "R"]),
        (X.clamped(F.lit(62.5)), 62),
        (X.clamped(F.lit(140.0)), 100),
        (M.required_years(F.lit("3-5 years experience")), 5),
        (M.required_years(F.lit("3-5 years of professional experience")), 3),
        (M.required_years(F.lit("none")), None),
        (M.job_tier(F.lit("Senior Engineer"), F.lit("")), 3),
        (M.job_tier(F.lit("Intern"), F.lit("")), 0),
        (M.job_tier(F.lit("Engineer"), F.lit("10+ years")), 4),
        (M.place_matches(F.lit("Bengaluru, Karnataka"), "Bangalore"), True),
        (M.place_matches(F.lit("Karnataka, India"), "Bangalore"), True),
        (M.place_matches(F.lit("London"), "Bangalore"), False),
        (M.is_remote(F.lit("Work-from-home")), True),
        (M.is_remote(F.lit("Anywhere")), True),
        (M.is_sales(F.lit("Pre-Sales Consultant")), True),
        (T.in_quiet_hours(F.lit(60), 1320, 420), True),
        (T.in_quiet_hours(F.lit(420), 1320, 420), False),
        (T.hiring_class(F.lit(None).cast("timestamp_ntz"), AS_OF), "unknown"),
        (T.relative_date(F.lit("Posted 2 weeks ago"), AS_OF), dt.datetime(2024, 1, 17)),
        (T.relative_date(F.lit("This shop has sold tea since it opened 12 years ago"), AS_OF), None),
        (T.posted_at(F.lit("1706659200000"), AS_OF), dt.datetime(2024, 1, 31)),
        (T.posted_at(F.lit("2024-01-05T10:00:00+02:00"), AS_OF), dt.datetime(2024, 1, 5, 8)),
        (T.posted_at(F.lit("2024-01-05T10:00:00+02:00"), AS_OF, False), dt.datetime(2024, 1, 5, 10)),
        (T.posted_at(F.lit("Fri, 05 Jan 2024 10:00:00 +0000"), AS_OF), dt.datetime(2024, 1, 5, 10)),
        (T.posted_at(F.lit("Jan 05, 2024"), AS_OF), dt.datetime(2024, 1, 5)),
        (T.posted_at(F.lit("soon"), AS_OF), None),
    ]


def test_scalars(spark):
    told = cases()
    got = spark.range(1).select(*[c.alias(f"x{k}") for k, (c, _) in enumerate(told)]).first()
    wrong = [(k, g, e) for k, (g, (_, e)) in enumerate(zip(got, told, strict=True)) if g != e]
    assert not wrong


def test_hash_ignores_case_and_space(spark):
    a, b, c = (X.content_hash(F.lit(x), F.lit("T"), F.lit("d")) for x in ("Co", " CO ", "Other"))
    assert one(spark, a) == one(spark, b) != one(spark, c)


def test_sections(spark):
    s = one(spark, X.listing_sections(F.lit("Hi\nRequirements:\nSQL\nNice to have\nRust")))
    assert tuple(s) == ("Hi", "SQL", "Rust")
    assert one(spark, X.resume_sections(F.lit("Me\nSkills:\nSQL\n"))) == {"header": "Me", "skills": "SQL"}


def test_contacts(spark):
    c = one(spark, X.contacts(F.lit("a.b@c.de +1 555 123 4567 linkedin.com/in/x https://my.site")))
    assert tuple(c) == ("a.b@c.de", "+1 555 123 4567", "https://linkedin.com/in/x", "", "https://my.site")


def test_a_shared_term_counts_once(spark):
    p = Profile(skills=("pytorch", "python"))
    assert "python" in expand_skill("pytorch")
    assert one(spark, M.skill_hits(F.lit("we use python"), p)) == 1
    assert one(spark, M.skill_hits(F.lit("we use python and machine learning"), p)) == 2


def test_budgets():
    assert even_budget(10, ["a", "b", "c"]) == {"a": 4, "b": 3, "c": 3}
    assert even_budget(2, ["a", "b", "c"]) == {"a": 1, "b": 1, "c": 0}
    assert sum(weighted_budget(100, {"a": 3, "b": 2, "c": 1}).values()) == 100
    assert split_limit(5, 2) == [3, 2]
    assert cities_in("New Delhi or greater noida") == ["noida", "delhi"]


def test_terms_seen_in_one_pass(spark):
    import random

    from tessera.functions.seen import Seen
    from tessera.functions.text import has_word

    r = random.Random(31)
    terms = ["sql", "c++", "go", "machine learning", "ml", "a", "é", "sq", "sql server", ".net"]
    parts = [*terms, " ", " ", "x", "_", "7", "é", ".", "\n", "-", "漢", "²"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, "", "sql"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    seen = Seen("_seen")
    rules = [c for t in terms for c in (seen.contains(t), has_word(seen, t))]
    plain = [c for t in terms for c in (F.col("t").contains(t), has_word(F.col("t"), t))]
    both = df.withColumn("_seen", seen.column(F.col("t"))).select("t", F.array(*rules).alias("a"), F.array(*[F.coalesce(c, F.lit(False)) for c in plain]).alias("b")).collect()
    assert len(both) == len(texts) and all(x.a == x.b for x in both)
