"""Counts, reports, pages and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.temporal import hiring_class, hiring_order
from tessera.operators.profile import even_budget
from tessera.session import checkpointed


def source_report(listings: DataFrame, kept: Column, samples: int = 5) -> DataFrame:
    """Rows returned and kept of each source, and the titles of its first rows by seq."""
    first = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    titles = listings.withColumn("_n", first).where(F.col("_n") <= samples).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda t: t["title"]), "; ").alias("sample_titles"))
    counts = listings.groupBy("source").agg(F.count("*").alias("returned"), F.count_if(kept).alias("kept"))
    return counts.join(titles, "source", "left")


def sources_by_status(report: DataFrame, requested: DataFrame) -> DataFrame:
    """(status, sources): ok with rows, empty without, skipped where nothing was returned for a requested source."""
    told = requested.join(report, "source", "left").withColumn("status", F.when(F.col("returned").isNull(), "skipped").when(F.col("returned") == 0, "empty").otherwise("ok"))
    return told.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def match_stats(scored: DataFrame, threshold: int) -> DataFrame:
    return scored.agg(F.count("*").alias("scored"), F.count_if(F.col("match_score") >= 1).alias("viewable"), F.count_if(F.col("match_score") >= threshold).alias("above"), F.count_if(F.col("match_score") < threshold).alias("low"))


def by_hiring(matches: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """matches with hiring_class and the order that puts open listings first."""
    cls = hiring_class(F.col("posted_at"), as_of, days)
    return matches.withColumn("hiring_class", cls).withColumn("hiring_order", hiring_order(cls))


def page(ordered_by: list[Column], rows: DataFrame, number: int, size: int = 10, most: int = 15) -> DataFrame:
    """One page of rows in a total order. offset and limit take only the rows up to the page from each task."""
    size = max(1, min(size, most))
    return rows.orderBy(*ordered_by).offset((max(1, number) - 1) * size).limit(size)


def placed(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows with their place (from 1) in a total order, without a window in one task: ranges of the order are sorted by themselves
    behind a checkpoint, and the rows before each range, one number for each partition, are added."""
    span = 1 << 33  # monotonically_increasing_id counts from the partition's number times this
    ranges = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.floor(F.col("_id") / span).cast("int").alias("_part")
    counts = ranges.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = ranges.withColumn("_part", part).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return told.withColumn(name, (F.col("_before") + F.col("_id") % span + 1).cast("int")).drop("_id", "_part", "_before")


def page_count(rows: DataFrame, size: int = 10, most: int = 15) -> DataFrame:
    size = max(1, min(size, most))
    return rows.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("total_pages"))


def budgets(sources: DataFrame, total: int) -> DataFrame:
    """(source, budget): total over the sources in order of name, the remainder to the first. The registry is a fixed table."""
    place = F.row_number().over(Window.orderBy("source")) - 1
    n = F.count("*").over(Window.partitionBy())
    return sources.select("source", (F.floor(F.lit(total) / n) + F.when(place < F.lit(total) % n, 1).otherwise(0)).cast("int").alias("budget"))


def budget_of(total: int, ids: list[str]) -> dict[str, int]:
    return even_budget(total, ids)


def digest(matches: DataFrame, threshold: int, cap: int) -> DataFrame:
    """(place, entry) of the best matches, open listings first, as lines of text."""
    best = matches.where(F.col("match_score") >= threshold).orderBy("hiring_order", F.desc("match_score"), F.desc_nulls_last("posted_at"), "seq").limit(max(0, cap))
    place = F.row_number().over(Window.orderBy("hiring_order", F.desc("match_score"), F.desc_nulls_last("posted_at"), "seq"))
    return best.select(place.alias("place"), F.format_string("%d. %s - %s (%d%%)", place, "title", "company", "match_score").alias("entry"))


def skills_gap(claimed: Column, own: Column) -> Column:
    """struct<overlap, gap>: how many of the skills that a listing names the profile has, ignoring case."""
    low = F.array_distinct(F.transform(claimed, lambda s: F.lower(F.trim(s))))
    mine = F.transform(own, lambda s: F.lower(F.trim(s)))
    return F.struct(F.size(F.array_intersect(low, mine)).alias("overlap"), F.size(F.array_except(low, mine)).alias("gap"))

