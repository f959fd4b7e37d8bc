"""Exact top-k by inner product over integer vectors.

Method (pivot-distance index): with one coordinate added, sqrt(M - |v|^2) for a vector (M the largest squared norm) and 0 for a
query, a larger inner product is a smaller Euclidean distance, so the triangle inequality holds. Each vector is keyed by its
nearest pivot and the distance r to it. A query at distance d from that pivot needs only vectors with |r - d| <= R, where R
follows from the k-th best score so far. It skips cells whose whole range of r is outside, and in a cell takes the sorted annuli
outwards from d, with R shrinking, until the bound ends it.

Pivots, and the first bound of each query, come from SAMPLE vectors with the smallest hashes: the bound is the k-th best score
of real rows, so it is safe whatever the sample. All vectors are indexed and results are exact: bounds are lowered by what floats
may round. Cells are cut by r into blocks of about BLOCK vectors (by hash where many share an r), and a query goes only to the
blocks that its radius meets. Queries are cut into parts of BLOCK, those of near pivots together, and a block goes only to parts
that ask for it. So no task grows with the input. Of equal vectors only those with the k + 1 smallest ids can be among a query's k
best, so only these are compared.

Defined cases: vectors that are null, empty, without an id, or hold null or non-finite components take no part; a shorter vector
counts as followed by zeros; repeated rows (same id and vector) are candidates of their own for every query of another id; fewer
than k candidates give fewer ranks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, prefixed, read

SAMPLE, PIVOTS, BLOCK, STEP = 1024, 32, 8192, 512
#: Ranges that a cell is cut into at most; beyond that, its ranges are cut by hash.
MOST_CUTS = 1000


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    slim = prefixed(vectors, vec_id=id_col, e=vector_col)
    finite = F.forall("e", lambda x: F.coalesce((x.cast("double") > float("-inf")) & (x.cast("double") < float("inf")), F.lit(False)))
    slim = slim.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(finite)
    return slim.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of `width` numbers, zeros at the end of short ones, that float64 multiplies exactly where they are small enough, else
    integers."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(array.offsets.to_numpy())
    out = np.zeros((len(array), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    small = not out.size or float(np.abs(out.astype(np.float64)).max()) ** 2 * width < 1 << 52
    return out.astype(np.float64) if small else out


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Indices of n rows far from each other: each the farthest from those before."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by `every`."""
    rows = usable(vectors, id_col, vector_col, scale)
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    whole = rows.agg(F.max(F.size("v")).alias("dim"), F.max(square).alias("norm"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("queries")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if whole["dim"] is None:
        return vectors.sparkSession.createDataFrame([], out)
    dim, norm, parts = whole["dim"], whole["norm"], whole["queries"] // BLOCK + 1
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    by_id = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    of_id = F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))
    rows = rows.withColumn("copy", by_id).where(F.col("copy") <= k + 1).withColumn("copy", of_id).where(F.col("copy") <= k).drop("copy")
    head = rows.orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = _matrix(pa.array([r["v"] for r in head], pa.list_(pa.int64())), dim).astype(np.float64)
    sample_ids = np.array([r["vec_id"] for r in head])
    wide = np.column_stack((sample, np.sqrt(np.maximum(norm - (sample**2).sum(1), 0))))
    pivots = wide[_spread(wide, PIVOTS)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b["v"], dim).astype(np.float64)
            if not len(m):
                continue
            m = np.column_stack((m, np.sqrt(np.maximum(norm - (m**2).sum(1), 0))))
            d = np.sqrt(np.maximum((m**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * m @ pivots.T, 0))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "v", "cell", "r"])

    index = checkpointed(rows.mapInArrow(keyed, "vec_id long, v array<long>, cell int, r double"))
    most = index.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    cut = min(most // BLOCK + 1, MOST_CUTS)
    shares = [k / cut for k in range(1, cut)]
    ranges = {c["cell"]: c for c in index.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.percentile_approx("r", F.lit(shares or [0.5]), 10 * MOST_CUTS).alias("cuts")).collect()}
    order = sorted(ranges)
    edges = {c: np.unique(ranges[c]["cuts"]) if shares else np.zeros(0) for c in order}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, r = b["cell"].to_numpy(), b["r"].to_numpy()
            at = np.zeros(len(cell), np.int32)
            for c in np.unique(cell).tolist():
                at[cell == c] = np.searchsorted(edges[c], r[cell == c], side="left")
            yield b.append_column("range", pa.array(at))

    index = index.mapInArrow(placed, "vec_id long, v array<long>, cell int, r double, range int")
    # one row for each range: its extent, and the blocks it needs by hash
    extents = index.groupBy("cell", "range").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).withColumn("blocks", (F.col("n") / (2 * BLOCK)).cast("int") + 1).orderBy("cell", "range").collect()
    low, high = np.array([x["low"] for x in extents]), np.array([x["high"] for x in extents])
    of_cell = np.array([order.index(x["cell"]) for x in extents])
    named = [(x["cell"], x["range"], x["blocks"]) for x in extents]
    slack = 1e-6 * (1 + norm**0.5)
    rounding = norm * dim * 2.0**-50  # of a product of two rows

    def reach(square: np.ndarray | float, bound: np.ndarray | float) -> np.ndarray:
        """R: no vector farther than that reaches the bound."""
        return np.sqrt(np.maximum(square + norm - 2 * bound, 0)) + slack

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, ids = _matrix(b["v"], dim).astype(np.float64), b["vec_id"].to_numpy()
            for k in range(0, len(m), STEP):
                own, own_ids = m[k : k + STEP], ids[k : k + STEP]
                square = (own**2).sum(1)
                scores = own @ sample.T
                scores[own_ids[:, None] == sample_ids[None, :]] = -np.inf
                bound = np.sort(scores, 1)[:, -top] - rounding if scores.shape[1] >= top else np.full(len(own), -np.inf)
                d = np.sqrt(np.maximum(square[:, None] + norm - 2 * own @ pivots[:, :-1].T, 0))[:, order]
                far = np.where(np.isfinite(bound), reach(square, np.where(np.isfinite(bound), bound, 0)), np.inf)
                mine = d[:, of_cell]
                q, x = np.nonzero((mine - far[:, None] <= high + slack) & (mine + far[:, None] >= low - slack))
                times = np.array([named[k][2] for k in x.tolist()], np.int64)
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q, x = np.repeat(q, times), np.repeat(x, times)
                told = np.array([named[k][:2] for k in x.tolist()], np.int32).reshape(-1, 2)
                part = (d.argmin(1) * spread + own_ids % spread)[q] % parts
                take = lambda c: c.take(pa.array(q + k))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([take(b["vec_id"]), take(b["v"]), *[pa.array(c.astype(np.int32)) for c in (told[:, 0], told[:, 1], block, part)], pa.array(d[q, of_cell[x]]), pa.array(bound[q])], ["vec_id", "v", "cell", "range", "block", "part", "d", "bound"])

    top, spread = k, max(1, -(-parts // len(order)))
    right = checkpointed(queries.mapInArrow(routed, "vec_id long, v array<long>, cell int, range int, block int, part int, d double, bound double"))
    keys = ["cell", "range", "block", "part"]
    needs = F.broadcast(vectors.sparkSession.createDataFrame(named, "cell int, range int, blocks int"))  # at most PIVOTS * MOST_CUTS rows
    left = index.join(needs, keys[:2]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    left = left.join(right.select(*keys).distinct().toDF(*keys), keys[:3])

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if own.num_rows and asked.num_rows:
            own = own.sort_by("r")
            m, ids, r = _matrix(own["v"], dim), own["vec_id"].to_numpy(), own["r"].to_numpy()
            q, q_ids, d, bounds = _matrix(asked["v"], dim), asked["vec_id"].to_numpy(), asked["d"].to_numpy(), asked["bound"].to_numpy()
            if m.dtype != q.dtype:
                m, q = m.astype(np.int64), q.astype(np.int64)
            squares = (q.astype(np.float64) ** 2).sum(1)
            for x in range(len(q)):
                a = b = int(np.searchsorted(r, d[x]))
                bound, scores, got = bounds[x], np.zeros(0, m.dtype), np.zeros(0, np.int64)
                while True:
                    far = reach(squares[x], bound) if np.isfinite(bound) else np.inf
                    low_end, high_end = np.searchsorted(r, d[x] - far), np.searchsorted(r, d[x] + far, side="right")
                    na, nb = max(a - STEP, int(low_end), 0), min(b + STEP, int(high_end), len(r))
                    na, nb = min(na, a), max(nb, b)
                    if na == a and nb == b:
                        break
                    fresh = np.concatenate((np.arange(na, a), np.arange(b, nb)))
                    s = m[fresh] @ q[x]
                    keep = (ids[fresh] != q_ids[x]) & (s >= bound)
                    scores, got = np.concatenate((scores, s[keep])), np.concatenate((got, ids[fresh][keep]))
                    best = _best(scores, got, k)
                    scores, got, a, b = scores[best], got[best], na, nb
                    if len(scores) == k:
                        bound = max(bound, float(scores[-1]) - rounding)
                found[0] += [q_ids[x]] * len(got)
                found[1] += got.tolist()
                found[2] += scores.astype(np.int64).tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), found, strict=True)})

    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each fiftieth vector."""
    return top_k(read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
