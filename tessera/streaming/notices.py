"""Notices as a stream: each key remembers the score of its last notice, in order of event time, and is forgotten after a while."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tessera.session import shared_folder

OUT = "state_key string, event_id long, match_score int, reason string"


#: Keys are dealt to so many groups by their hash; a group's keys share its state and its calls to Python.
GROUPS = 1024
#: What a group keeps, as bytes: its waiting rows (key's number, microseconds, id, score), and of each key the score of its last
#: notice and when its last row was told.
KEPT = "names array<string>, rows binary, scores binary, seen_ms binary"
_ROW = np.dtype([("key", "<i4"), ("us", "<i8"), ("event", "<i8"), ("score", "<f8")])
#: A key of which no row was told yet; a row without an id. A score that is null is not a number.
_NEVER = np.iinfo(np.int64).min


def _folded(rows: np.ndarray, score: np.ndarray, seen: np.ndarray, delta: int, keep_ms: int) -> list[str]:
    """The reason of each of the rows, in order of key, time and id; score and seen, by key, are carried on."""
    why = []
    now, key = None, -1
    for k, at, new in zip(rows["key"].tolist(), (rows["us"] // 1000).tolist(), rows["score"].tolist(), strict=True):
        if k != key:
            if key >= 0:
                score[key], seen[key] = last, now
            key, last, now = k, float(score[k]), int(seen[k])
        if now == _NEVER or at - now > keep_ms:  # it was forgotten by then
            reason = "new"
        else:
            reason = "score_jump" if new - last >= delta else "already_notified"
        if reason != "already_notified":
            last = new
        now = at
        why.append(reason)
    if key >= 0:
        score[key], seen[key] = last, now
    return why


def _noticer(delta: int, keep_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The notices of each key of one group in order of event time. Rows wait until the watermark has passed them, so that neither
    their order within a micro-batch nor that of micro-batches matters; a key that has been quiet for `keep_ms` of event time leaves
    the state."""

    def told(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, waiting, score, seen = state.get if state.exists else ([], b"", b"", b"")
        names, parts = list(names), [np.frombuffer(bytes(waiting), _ROW)]
        number = {name: k for k, name in enumerate(names)}
        for met in batches:  # none if a timer woke the group up
            rows = np.empty(len(met), _ROW)
            rows["key"] = [number.setdefault(name, len(number)) for name in met["state_key"].tolist()]
            rows["us"], rows["event"], rows["score"] = met["ts_us"], met["event_id"].fillna(_NEVER), met["match_score"]
            parts.append(rows)
        names += list(number)[len(names) :]
        score = np.concatenate((np.frombuffer(bytes(score), "<f8"), np.zeros(len(names) - len(score) // 8)))
        seen = np.concatenate((np.frombuffer(bytes(seen), "<i8"), np.full(len(names) - len(seen) // 8, _NEVER, "<i8")))
        rows = np.concatenate(parts)
        now = state.getCurrentWatermarkMs()
        due = rows["us"] // 1000 <= now
        ready, later = rows[due], rows[~due]
        ready = ready[np.lexsort((ready["score"], ready["event"], ready["us"], ready["key"]))]
        why = _folded(ready, score, seen, delta, keep_ms)
        said = pd.DataFrame({"state_key": [names[k] for k in ready["key"].tolist()], "event_id": pd.Series(ready["event"]).astype("Int64").mask(ready["event"] == _NEVER), "match_score": pd.Series(ready["score"]).astype("Int32"), "reason": why})
        stays = np.zeros(len(names), bool)
        stays[later["key"]] = True
        stays |= (seen != _NEVER) & (now <= np.where(seen == _NEVER, 0, seen) + keep_ms)
        if not stays.any():
            if state.exists:
                state.remove()
        else:
            place = np.cumsum(stays) - 1
            later["key"] = place[later["key"]]
            score, seen = score[stays], seen[stays]
            state.update(([n for n, s in zip(names, stays.tolist(), strict=True) if s], later.tobytes(), score.tobytes(), seen.tobytes()))
            # a timer fires once the watermark is beyond it: for the first row that waits, or the first key to be forgotten; one that
            # waits is forgotten no earlier than its rows are told
            idle = np.ones(len(score), bool)
            idle[later["key"]] = False
            times = [int(later["us"].min()) // 1000 - 1] if len(later) else []
            times += [int(seen[idle].min()) + keep_ms] if idle.any() else []
            state.setTimeoutTimestamp(min(times))
        yield said

    return told


def notices(events: DataFrame, delta: int = 10, late: str = "1 hour", keep_days: float = 90, groups: int = GROUPS) -> DataFrame:
    """(state_key, event_id, match_score, reason) for each of events (state_key, event_id, ts, match_score), in order of ts and
    event_id: new, score_jump when the score is `delta` above that of the key's last notice, else already_notified. A row is told
    once the watermark, `late` behind the newest row, has passed it; rows that come later than that are dropped. A key without rows
    for `keep_days` of event time is forgotten. Keys are dealt to `groups` by their hash, and Python is called and state written by
    group, not by key: a micro-batch rewrites the groups that it touches. A stream that goes on must keep its number of groups."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    dealt = F.pmod(F.xxhash64("state_key"), F.lit(groups)).cast("int").alias("dealt")
    keyed = events.withWatermark("ts", late).select("*", F.unix_micros("ts").alias("ts_us"), dealt).groupBy("dealt")
    return keyed.applyInPandasWithState(_noticer(max(1, delta), int(keep_days * 86_400_000)), OUT, KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def event_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """events as a stream of (state_key, event_id, ts, match_score); a path may be a folder of files."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(re.sub(r"(.)$", r"[\1]", path))  # as a pattern: a stream takes no single file by its name
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type"))
    return rows.select(key.alias("state_key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.pmod(F.col("value"), F.lit(100))).cast("int").alias("match_score"))


def windowed(events: DataFrame, minutes: int = 60, late: str = "1 day") -> DataFrame:
    """Rows and scores of each window of event time. In update mode a window is given again whenever rows come, until the watermark
    has passed it; then it leaves the state, and rows that are later still are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes")).agg(F.count("*").alias("n"), F.sum("match_score").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total")


def run_once(stream: DataFrame, name: str, mode: str = "append", arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """All that is there now, as a table; the checkpoint is in the session's shared folder. In append mode the stream goes on after
    each of arrivals, which brings more."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
    if mode == "append":
        query.format("parquet").option("path", f"{root}/out").start().awaitTermination()
        for bring in arrivals:
            bring()
            query.start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/_n={number}")

    query.foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(f"{root}/out")
    # the last word on each key of the state: its columns are those that an aggregate groups by
    keys = [stream.columns[0]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("r")).select("r.*")
