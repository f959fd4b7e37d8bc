"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Method: the hash space is a ring of CELLS equal cells. Each shard owns `vnodes` points on it, and a key belongs to the first
point clockwise of its cell. A shard holds at most its capacity. What its own keys exceed continues clockwise to the next
points whose shards have room. With capacity factor 1 every shard is full, so row counts differ by one at most; with a larger
factor fewer keys move. Only counts per cell reach the driver: CELLS rows, whatever the input. A key's place inside its cell is
its rank by hash, so only (id, size, hash) rows are shuffled, not texts. Rows that are equal in all of these are ranked as one
group for each partition they were read in and numbered within it, so that a key of very many rows fills no task.

Defined cases: a null text has size 1 and counts as empty; a very long text adds its size and checksum only; a row without an id is
placed by its text; repeated rows each get a slot of their own; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, prefixed, read

CELL_BITS = 14
CELLS = 1 << CELL_BITS


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the points in ring order, each in a cell of its own."""
    if shards * vnodes > CELLS:
        raise ValueError(f"at most {CELLS} points")
    taken: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(shards):
            cell = int.from_bytes(hashlib.blake2b(f"shard {s} point {v}".encode(), digest_size=8).digest(), "big") >> (64 - CELL_BITS)
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = s
    return sorted(taken.items())


def assign(counts: dict[int, int], shards: int, vnodes: int, factor: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first) for all keys, from the number of keys in each cell."""
    total = sum(counts.values())
    if factor <= 1:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        room = [-int(-factor * total // shards)] * shards
    points = ring(shards, vnodes)
    out: list[tuple[int, int, int, int, int]] = []
    used = [0] * shards

    def put(cell: int, start: int, end: int, s: int) -> int:
        n = min(end - start, room[s] - used[s])
        if n > 0:
            out.append((cell, start, start + n, s, used[s]))
            used[s] += n
        return start + max(n, 0)

    over: list[list[tuple[int, int, int]]] = []
    for k, (cell, s) in enumerate(points):
        before = points[k - 1][0]
        own = range(before + 1, cell + 1) if k else [*range(before + 1, CELLS), *range(cell + 1)]
        left = []
        for c in own:
            if n := counts.get(c, 0):
                start = put(c, 0, n, s)
                if start < n:
                    left.append((c, start, n))
        over.append(left)
    carried: deque[tuple[int, int, int]] = deque()
    for turn in range(2):
        for k, (_, s) in enumerate(points):
            while carried and used[s] < room[s]:
                c, start, end = carried.popleft()
                start = put(c, start, end, s)
                if start < end:
                    carried.appendleft((c, start, end))
            if not turn:
                carried.extend(over[k])
    return out


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 64, factor: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    spark = docs.sparkSession
    slim = prefixed(docs, doc_id=id_col, text=text_col)
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    cell = F.shiftrightunsigned(place, 64 - CELL_BITS).cast("int")
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 1
    same = ["place", "doc_id", "text_crc32", "size", "part"]
    rows = slim.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), place.alias("place"), cell.alias("cell"), F.spark_partition_id().alias("part"))
    rows = checkpointed(rows)  # so that part is the same wherever it is asked for
    groups = rows.groupBy("cell", *same).agg(F.count("*").alias("n"))
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame(assign(counts, shards, vnodes, factor) or [(0, 0, 0, 0, 0)], "cell int, first long, end long, shard int, slot long")
    before = Window.partitionBy("cell").orderBy(*same).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*[F.col(c).alias(f"_{c}") for c in same], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))) - 1)
    met = numbered.join(groups, [numbered[c].eqNullSafe(groups[f"_{c}"]) if c == "doc_id" else numbered[c] == groups[f"_{c}"] for c in same])
    ranked = met.withColumn("rank", F.col("rank") + F.col("start"))
    # at most CELLS rows and one more for each shard that a cell's keys pass
    return (
        ranked.join(F.broadcast(parts), "cell")
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"))
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: 16 shards under the law `rows`."""
    out = shard(read(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
