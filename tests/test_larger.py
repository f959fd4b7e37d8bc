"""What shows only on larger tables, on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.plans import listings as L


def test_a_notice_without_a_date_leaves_it_to_the_next(spark):
    from tessera.operators import ranking

    at = lambda day: dt.datetime(2024, 1, day)
    kind = "{} long, content_hash string, apply_url string, match_score int, posted_at timestamp_ntz, listing_fingerprint string"
    told = [(1, "h", "u1", 70, None, "f"), (2, "h", "u2", 10, at(5), "f"), (3, "k", "v", 70, None, "f")]
    rows = [(4, "h", "w", 70, at(9), "f"), (5, "h", "w", 70, at(5), "f"), (6, "k", "w", 70, at(9), "f"), (7, "x", "u1", 70, at(9), "f")]
    matches = spark.createDataFrame(rows, kind.format("seq")).withColumn("location", F.lit("Bangalore"))
    out = ranking.judged_for_digest(matches, spark.createDataFrame(told, kind.format("notice_id")), L.PROFILE, 60, L.as_of())
    assert {r.seq: r.notice for r in out.collect()} == {4: "listing_refreshed", 5: "already_notified", 6: "already_notified", 7: "already_notified"}


def test_phrases_are_judged_once_each(spark):
    from tessera.operators import fields
    from tessera.plans import careers

    own = careers.P
    said = spark.createDataFrame([(s,) for s in [*careers.CLAIMED, "RUST ", "rust", "fluent English"]] + [(None,)], "s string")
    for blob in ("", "speaks English"):
        told = said.select("s", fields.is_missing_skill("s", own, blob).alias("one"), (F.size(fields.missing_skills(F.array("s"), own, blob)) > 0).alias("all")).collect()
        assert all(r.one == r["all"] for r in told) and {r.s for r in told if r.one} >= {"Terraform", "rust"}
    plan = careers.missing_skill_cleanup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "mindset" not in plan  # no phrase is judged again for each line


def test_searches_tell_each_part_once(spark):
    from tessera.operators import fields
    from tessera.plans import careers

    plan = careers.search_queries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("problem solving") <= 1  # the skills to search for stand once in the plan
    assert "RepartitionByExpression" in plan
    rows = spark.createDataFrame([(None, None, None, None), (["a b", "A  B", "Python", "x"], ["R"], "", " AIML ")], "s array<string>, p array<string>, r string, f string")
    told = [r.q for r in rows.select(fields.search_queries(F.col("s"), F.col("p"), F.col("r"), F.col("f"), F.lit(3)).alias("q")).collect()]
    assert told[0] == ["software engineer"] and told[1][2] == "R" and "Python" in told[1]


def test_dates_parse_in_their_format_only(spark):
    from tessera.functions import temporal as T

    days = ["2024-01-05", "2024-01-05T10:20:30+05:30", "2024-01-05 10:20:30", "Fri, 05 Jan 2024 10:20:30 +0000", "05 Jan 2024", "Jan 05, 2024", "2 days ago", "Posted today", "agora", "1704412800", None]
    got = [r.d and r.d.isoformat() for r in spark.createDataFrame([(d,) for d in days], "s string").select(T.posted_at("s", L.as_of()).alias("d")).collect()]
    assert got == ["2024-01-05T00:00:00", "2024-01-05T04:50:30", *["2024-01-05T10:20:30"] * 2, *["2024-01-05T00:00:00"] * 2, "2024-01-29T00:00:00", "2024-01-31T00:00:00", None, "2024-01-05T00:00:00", None]
    assert isinstance(T.FORMATS, dict)  # a format is tried only on texts of its shape


def test_keys_of_dedup_are_not_broadcast(spark):
    from tessera.operators import state

    rows = spark.range(50).selectExpr("id AS seq", "concat('h', id % 7) AS h", "concat('i', id % 5) AS i")
    out = state.greedy_dedup(rows, ("h", "i"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.seq for r in out.collect()) == [0, 1, 2, 3, 4]


def test_batches_are_counted_in_slices():
    import pyarrow as pa

    from tessera.operators import retrieval

    lists = [["a"] * 5, None, [], ["b"] * 9, ["c"] * 2, ["d"]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["terms"])
    parts = [p["terms"].to_pylist() for p in retrieval._parts(batch, 6)]
    assert [x for p in parts for x in p] == lists and len(parts) == 3
    assert [len(retrieval._coded(p["terms"])[0]) for p in retrieval._parts(batch, 6)] == [5, 9, 3]


def test_keys_of_one_group_have_notices_of_their_own(spark, tmp_path, monkeypatch):
    """Python is called by group, not by key; keys of a group, null scores among them, give what a loop gives."""
    import random

    from tessera.streaming import notices

    r, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(r.randint(1, 60), r.choice("ab"), k, start + dt.timedelta(hours=r.randint(0, 900)), None if k % 9 == 0 else float(r.randint(0, 99))) for k in range(800)]
    kind = "user_id int, event_type string, event_id long, ts timestamp_ntz, value double"
    for part in (rows[:400], rows[400:], [(0, "z", 900, start + dt.timedelta(days=400), 1.0)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = notices.notices(notices.event_stream(spark, str(tmp_path / "e"), 1), late="60 days", keep_days=10, groups=3)
    got = {x.event_id: (x.match_score, x.reason) for x in notices.run_once(stream, "groups").collect()}
    last, want = {}, {}
    for user, event, k, ts, value in sorted(rows, key=lambda x: (x[3], x[2])):
        key, score = (user, event), None if value is None else int(value)
        before, seen = last.get(key, (None, None))
        if seen is None or ts - seen > dt.timedelta(days=10):
            why = "new"
        else:
            why = "score_jump" if score is not None and before is not None and score - before >= 10 else "already_notified"
        last[key] = (before if why == "already_notified" else score, ts)
        want[k] = (score, why)
    assert got == want
    plan = stream._jdf.queryExecution().logical().toString()
    assert "state_key" in plan and "xxhash64" in plan
