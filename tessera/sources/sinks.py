"""Writers: snapshots, tables replaced by run, append-only logs, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(listings: DataFrame, path: str, source: str, stamp: str) -> None:
    """JSON lines of one batch, in a folder of its own."""
    listings.write.mode("overwrite").json(f"{path}/source={source}/stamp={stamp}")


def save_matches(matches: DataFrame, listings: DataFrame, path: str) -> None:
    """Matches whose listing is stored; runs in this batch replace what their partitions held, others stay."""
    known = matches.join(listings.select("content_hash").distinct(), "content_hash", "left_semi")
    known.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def matches_of(matches: DataFrame, listings: DataFrame, run_id: int, key: str, score: str = "match_score", least: float = 0) -> DataFrame:
    """The matches of one run with what their listings say, from a score on; matches without a listing are left out. The filter
    reaches the partition of the run."""
    return matches.where((F.col("run_id") == run_id) & (F.col(score) >= max(0, least))).join(listings, key)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest_runs(log: DataFrame, limit: int = 20) -> DataFrame:
    """The last state of each run from an append-only log (run_id, status, at), newest runs first."""
    return log.groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at")).orderBy(F.desc("run_id")).limit(limit)


def digest_text(entries: DataFrame, path: str) -> None:
    """One text file of the entries in order; an entry count is bounded by the digest's cap."""
    entries.orderBy("place").select(F.col("entry").alias("value")).coalesce(1).write.mode("overwrite").text(path)
