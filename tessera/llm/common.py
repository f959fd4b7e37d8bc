"""Helpers that the corpus operators share: bounded slices of a batch, vectorised words and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_folder

#: Bytes of text that a task turns into arrays at a time.
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def exchanged(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """The join of two tables that grow with the input, by exchanges: neither goes through the driver, however small Spark takes
    it to be (after an explode, as small as before it)."""
    return left.join(right.hint("merge"), on, how)


def frequent_keys(df: DataFrame, *key: str, share: int = 1000, least: int = 10_000) -> tuple[DataFrame | None, int]:
    """(key, n) of the keys with more than a `share`-th of df's rows, so at most `share` keys, and the number of rows beyond
    which a key is one of them; `least` rows are never too many, and where df has no more there is no such table."""
    rows = df.count()
    if rows <= least:
        return None, least
    limit = max(rows // share, least)
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > limit), limit


def lookup(left: DataFrame, right: DataFrame, key: list[str], counts: DataFrame, share: int = 1000, least: int = 100_000) -> DataFrame:
    """left with the columns of right, which has a row for each key. counts (key, n) tells the rows of left by key: keys with more
    than a `share`-th of them, at most `share`, are looked up in a broadcast, so that they fill no task; `least` slim rows of one
    key are left to the join, which adaptive plans split."""
    rows = left.count()
    if rows <= least:
        return exchanged(left, right, key, "left")
    limit = max(rows // share, least)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(*key))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return exchanged(left.join(hot, key, "left_anti"), right, key, "left").unionByName(left.join(few, key))


def parts_for(spark: SparkSession, mb: float, mb_each: float = 16) -> int:
    """Partitions for so many MB, at least as many as the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(mb / mb_each) + 1)


def slices(batch: pa.RecordBatch | pa.Table, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Consecutive rows whose texts hold at most limit bytes together, or one row."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    size = np.cumsum(pc.fill_null(pc.binary_length(table[text]), 0).to_numpy())
    start = 0
    while start < table.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield table.slice(start, end - start)
        start = end


def utf8(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and each row's start in it (one more at the end). Nulls count as empty."""
    array = pc.fill_null(column, "").cast(pa.large_string()).combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1 ... n - 1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0], filled = 1, 1
        while filled < len(out):
            step = min(filled, len(out) - filled)
            out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        if n > 1 << 23:  # one very long text: not kept
            return out[:n]
        _powers[base] = have = out
    return have[:n]


class Words:
    """Words `[^ \\t-\\r]+` of the rows of a column: byte start, end and hash of each, and each row's first word (one more at the end)."""

    def __init__(self, column: pa.ChunkedArray, lower: bool = False):
        raw, rows = utf8(column)
        self.raw, self.rows = (_LOWER[raw] if lower else raw), rows
        word = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[rows] = True
        before = np.concatenate(([False], word[:-1])) & ~edge[:-1] if len(raw) else word
        after = np.concatenate((word[1:], [False])) & ~edge[1:] if len(raw) else word
        self.start, self.end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, rows)
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        if not len(start):
            return np.zeros(0, np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.raw] * powers(_BASE, len(self.raw)), dtype=np.uint64)))
        return mix((total[end] - total[start]) * powers(_BASE_INV, len(self.raw))[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n consecutive words of one row, and each row's first (one more at the end)."""
        count = np.maximum(np.diff(self.first) - n + 1, 0)
        first = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(self.first[:-1] - first[:-1], count) + np.arange(first[-1])
        out = np.zeros(len(at), np.uint64)
        for j in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + j]
        return mix(out), first


def ids_of(table: pa.Table, name: str) -> list:
    return table[name].to_pylist()


def prefixed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator reads, under names of its own: extra columns of any name do no harm."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over all columns, which keep their types and names; a name may hold dots or stand twice."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
