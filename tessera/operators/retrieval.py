"""BM25, vector similarity, their blend, and top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import matching as M
from tessera.session import checkpointed

#: Bytes up to which the terms of queries, and query vectors, are broadcast.
BROADCAST_BYTES = 32 << 20
#: Cells of a matrix that a task fills at a time, and terms of documents that it counts at a time.
DENSE = 1 << 20
SLICE = 1 << 18


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>> of a list of terms: runs of the sorted list, so that counting stays within the row."""

    def runs(items: Column) -> Column:
        first = F.filter(F.transform(items, lambda t, k: F.when((k == 0) | (t != F.get(items, k - 1)), k)), lambda k: k.isNotNull())
        return M.once(first, lambda starts: F.transform(starts, lambda k, j: F.struct(F.get(items, k).alias("term"), (F.coalesce(F.get(starts, j + 1), F.size(items)) - k).alias("tf"))))

    return M.once(F.array_sort(terms), runs)


def term_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, total): documents that hold a term, and how often it stands in all. Each slice of a batch counts its own documents, and
    the task adds them up, so one row for each of its terms reaches the exchange. Behind a checkpoint: everything else is told from it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _parts(batch)):
            codes, row = _coded(part["terms"])
            names = codes.dictionary
            both, times = np.unique(row * max(len(names), 1) + codes.indices.to_numpy(), return_counts=True)
            term = both % max(len(names), 1)
            df, total = np.bincount(term, minlength=len(names)), np.bincount(term, times, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(df, pa.int64()), pa.array(total)], ["term", "df", "total"])

    each = docs.select(tokens(text_col).alias("terms")).mapInArrow(counted, "term string, df long, total long")
    return checkpointed(each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))


def _parts(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of whole documents with about `most` terms, so that memory doesn't grow with a batch."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch["terms"]), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        begun = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, begun + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _coded(lists: pa.ListArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The items of all lists as numbers of a dictionary, and the row of each."""
    flat = lists.flatten()
    return flat.dictionary_encode(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())


def term_weights(docs: DataFrame, queries: DataFrame, text_col: str = "text", query_id: str = "item_id", query_text: str = "text", epsilon: float = 0.25) -> tuple[DataFrame, float]:
    """((query_id, term, weight), mean length): idf of each term of a query, times how often the query has it. A term in over half of
    the documents gets epsilon times the mean idf. Counts and lengths come from all documents."""
    table, n = term_table(docs, text_col), docs.count()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    low, total = table.agg(F.avg(idf), F.sum("total")).first()
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(query_text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weight = F.col("times") * F.when(idf < 0, F.lit(epsilon * (low or 0.0))).otherwise(idf)
    return asked.join(table, "term").select("query_id", "term", weight.alias("weight")), (total or 0) / max(n, 1)


class _Asked:
    """Weights of a bounded set of queries, by term."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("term", "ascending"), ("query_id", "ascending")]).combine_chunks()
        terms, queries = (rows[c].combine_chunks().dictionary_encode() for c in ("term", "query_id"))
        self.terms, self.queries = terms.dictionary, queries.dictionary
        self.query, self.weight = queries.indices.to_numpy(), rows["weight"].to_numpy()
        self.first = np.searchsorted(terms.indices.to_numpy(), np.arange(len(self.terms) + 1))

    def matrices(self, terms: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of these terms for queries low to high, and which of them are asked for."""
        at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in terms] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(terms)), self.first[terms + 1] - self.first[terms])
        mine = (self.query[at] >= low) & (self.query[at] < high)
        weight, asked = np.zeros((len(terms), high - low)), np.zeros((len(terms), high - low), np.float32)
        weight[row[mine], self.query[at][mine] - low] = self.weight[at][mine]
        asked[row[mine], self.query[at][mine] - low] = 1
        return weight, asked


def bm25_candidates(docs: DataFrame, weights: DataFrame, mean: float, k: int, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(query_id, id, score): of each slice of documents the k best for each query that reach the k-th best of the task so far. A
    slice is scored for a block of queries as one matrix product, so pairs never become rows; those that leave a task are a few for
    each query, whatever the number of documents. Queries beyond BROADCAST_BYTES come in several parts, a pass over the documents'
    terms for each. Scores are rounded, so that equal texts tie; ties go to the smaller id."""
    size = weights.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    parts = -(-size // BROADCAST_BYTES)
    told = docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("terms"))
    told = checkpointed(told) if parts > 1 else told
    kinds = {c: (weights if c == "query_id" else told).schema[c].dataType.simpleString() for c in ("query_id", "id")}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    out = None
    for p in range(parts):
        mine = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else weights
        asked = docs.sparkSession.sparkContext.broadcast(_Asked(mine.toArrow()))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            own: _Asked = asked.value
            best = np.full((k, len(own.queries)), -np.inf)
            rows = max(16, min(1024, DENSE // max(len(own.terms), 1)))
            for batch in batches:
                order = pc.sort_indices(batch["id"])
                for start in range(0, batch.num_rows, rows):
                    yield from _best(batch.take(order.slice(start, rows)), own, best, k, mean, k1, b, digits)

        one = told.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _best(part: pa.RecordBatch, own: _Asked, best: np.ndarray, k: int, mean: float, k1: float, b: float, digits: int) -> Iterator[pa.RecordBatch]:
    lists = part["terms"]
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    found = pc.index_in(lists.flatten(), own.terms)
    known = pc.is_valid(found).to_numpy(zero_copy_only=False)
    row, term = np.repeat(np.arange(len(lists)), length)[known], found.drop_null().to_numpy()
    terms, column = np.unique(term, return_inverse=True)
    tf = np.zeros((len(lists), len(terms)))
    np.add.at(tf, (row, column), 1)
    norm = k1 * (1 - b + b * length / mean) if mean else np.zeros(len(lists))
    impact = np.divide(tf * (k1 + 1), tf + norm[:, None], out=np.zeros_like(tf), where=tf > 0)
    step = max(1, DENSE // max(len(terms), len(lists), 1))
    for low in range(0, len(own.queries), step):
        high = min(low + step, len(own.queries))
        weight, asked = own.matrices(terms, low, high)
        met = (tf > 0).astype(np.float32) @ asked > 0
        score = np.where(met, np.round(impact @ weight, digits), -np.inf)
        most = score if len(score) <= k else -np.partition(-score, k - 1, axis=0)[:k]
        both = np.concatenate((best[:, low:high], most))
        best[:, low:high] = -np.partition(-both, k - 1, axis=0)[:k]
        at, query = np.nonzero(met & (score >= best[:, low:high].min(0)))
        order = np.lexsort((at, -score[at, query], query))
        at, query = at[order], query[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        at, query = at[keep], query[keep]
        yield pa.RecordBatch.from_arrays([own.queries.take(pa.array(query + low)), part["id"].take(pa.array(at)), pa.array(score[at, query])], ["query_id", "id", "score"])


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query, of those that share a term with it."""
    weights, mean = term_weights(docs, queries, text_col, query_id, query_text, epsilon)
    return top(bm25_candidates(docs, weights, mean, k, id_col, text_col, k1, b, digits), k, ["query_id"])


def bm25_of(pool: DataFrame, docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, id, score) of the pairs of pool (query_id, id), which names each once, that share a term. Only documents of the
    pool are scored; counts and lengths come from all documents."""
    weights, mean = term_weights(docs, queries, text_col, query_id, query_text, epsilon)
    told = docs.select(F.col(id_col).alias("id"), text_col).join(sent(pool.select("query_id", "id"), F.lit(32)), "id")
    told = told.select("query_id", "id", tokens(text_col).alias("terms")).select("query_id", "id", F.size("terms").alias("length"), F.explode(term_counts(F.col("terms"))).alias("c"))
    hit = told.select("query_id", "id", "length", "c.term", "c.tf").join(sent(weights, F.octet_length("term") + 32), ["query_id", "term"])
    norm = k1 * (1 - b + b * F.col("length") / (mean or 1.0))
    return hit.groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score"))


def sent(df: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked to be broadcast if its rows, of that many bytes each, have at most `most` together; else joined by an exchange."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def top(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each group with their rank; a filter on the rank lets each task keep k before the exchange."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def similarity(pool: DataFrame, queries: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """pool with sim: the inner product with the vector q of its query, within 0 to 1, as unit vectors have it. queries (key, q)
    has a row for each key; rows of pool without one are left out."""
    asked = sent(queries.select(key, "q"), F.size("q") * 8 + 16)
    return pool.join(asked, key).withColumn("sim", F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col(vector), F.col("q"))))).drop("q")


def min_max(c: Column, by: list[Column | str], flat: float = 1e-9) -> Column:
    """Within its group from 0 to 1; 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low < flat, 0.5).otherwise((c - low) / (high - low))


def hybrid(vector: DataFrame, words: DataFrame, by: str = "query_id", alpha: float = 0.65, flat: float = 1e-9) -> DataFrame:
    """(query, id, score) from (query, id, sim) and (query, id, bm25), both made 0 to 1 over the pool of each query; what is missing
    counts as 0. Bounds come from one aggregate, so no task holds a pool."""
    pool = vector.join(words, [by, "id"], "left").select(by, "id", F.coalesce("sim", F.lit(0.0)).alias("sim"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
    bounds = pool.groupBy(by).agg(*[x for c in ("sim", "bm25") for x in (F.min(c).alias(f"_{c}_low"), F.max(c).alias(f"_{c}_high"))])
    part = lambda c: F.when(F.col(f"_{c}_high") - F.col(f"_{c}_low") < flat, 0.5).otherwise((F.col(c) - F.col(f"_{c}_low")) / (F.col(f"_{c}_high") - F.col(f"_{c}_low")))
    return pool.join(bounds, by).select(by, "id", (alpha * part("sim") + (1 - alpha) * part("bm25")).alias("score"))
