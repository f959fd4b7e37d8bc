"""Tables that keep what batches bring: partitioned by a hash of their key, so that a batch rewrites only the partitions it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Partitions of a table. One is rewritten whole when a batch touches it: take more where batches are small against the table.
BUCKETS = 64


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty table at path. Besides its own columns it has the bucket of a row and the number of the batch that wrote it."""
    spark.createDataFrame([], stored_schema(schema)).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def stored_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(stored_schema(schema)).parquet(path)


def _open_buckets(batch: DataFrame, stored: DataFrame, number: int) -> list[int]:
    """Buckets of the batch that don't hold it yet. At most as many numbers as there are buckets."""
    touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
    last = stored.where(F.col("bucket").isin(touched)).groupBy("bucket").agg(F.max("batch").alias("last")).where(F.col("last") >= number)
    return sorted(set(touched) - {r["bucket"] for r in last.select("bucket").collect()})


def upsert(batch: DataFrame, number: int, path: str, schema: StructType, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Merge a batch into the table at path; the buckets that were rewritten. Batches are numbered upwards. A bucket that holds this
    batch, or a later one, is left as it is: so a replay changes nothing, and one that follows a crash goes on with the buckets
    that are missing. A lost executor costs nothing; a driver that dies while it swaps a bucket's files can lose that bucket, so keep
    the batches of a table for as long as that matters. merge(stored, batch) must leave rows without new ones as they are, and give the columns of schema."""
    spark, names = batch.sparkSession, schema.names
    stored, batch = read(spark, path, schema), batch.withColumn("bucket", bucket(key, buckets))
    open_ = _open_buckets(batch, stored, number)
    if open_:
        here = F.col("bucket").isin(open_)
        merged = merge(stored.where(here).select(*names), batch.where(here).drop("bucket")).select(*names)
        rows = merged.withColumns({"batch": F.lit(number).cast("long"), "bucket": bucket(key, buckets)}).repartition("bucket")
        # files are read before the job's end replaces the partitions that it wrote
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return open_


def ids_of(batch: DataFrame, path: str, schema: StructType, key: str, id_: str, buckets: int = BUCKETS, seq: str = "seq") -> DataFrame:
    """(seq, id) of the rows of a batch that is stored, in order of the batch; only its buckets are read."""
    rows = batch.select(F.col(seq), F.col(key)).withColumn("bucket", bucket(key, buckets))
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    stored = read(batch.sparkSession, path, schema).where(F.col("bucket").isin(touched)).select("bucket", key, F.col(id_).alias("id"))
    return rows.join(stored, ["bucket", key]).select(seq, "id").orderBy(seq)


def append_new(batch: DataFrame, number: int, path: str, schema: StructType, key: str, buckets: int = BUCKETS) -> None:
    """Add the rows of a batch whose key isn't stored, one for each key; stored rows stay as they are and only keys of the batch's
    buckets are read. A replay finds all its keys and adds nothing."""
    stored, rows = read(batch.sparkSession, path, schema), batch.withColumn("bucket", bucket(key, buckets))
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    known = stored.where(F.col("bucket").isin(touched)).select("bucket", key)
    fresh = rows.dropDuplicates(["bucket", key]).join(known, ["bucket", key], "left_anti")
    fresh.select(*schema.names, F.lit(number).cast("long").alias("batch"), "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def upsert_stream(stream: DataFrame, path: str, log: str, schema: StructType, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge all that a stream has now, a micro-batch at a time; a micro-batch that is given again changes nothing."""
    each = lambda batch, number: upsert(batch, number, path, schema, key, merge, buckets) and None
    stream.writeStream.foreachBatch(each).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
