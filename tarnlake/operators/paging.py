"""Sorted pages of a listing."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake.errors import InvalidArgument
from tarnlake.operators.predicates import check_page

SORTABLE = {
    "documents": ["title", "created_at", "updated_at", "priority_diabetes", "file_size_bytes"],
    "document_chunks": ["diabetes_score", "created_at", "updated_at"],
}


@dataclass
class Page:
    items: DataFrame
    total: int
    page: int
    limit: int

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.limit)


def sort_column(df: DataFrame, name: str, allowed: list[str] | None = None, fallback: str = "updated_at") -> str:
    """The column to sort by: one of the allowed, else the fallback; without a list any column of df."""
    if allowed is not None:
        return name if name in allowed else fallback
    if name not in df.columns:
        raise InvalidArgument("UNKNOWN_COLUMN", name)
    return name


def ordering(name: str, order: str, tie: str | list[str] | None = None) -> list[Column]:
    first = F.col(name).asc_nulls_first() if order == "asc" else F.col(name).desc_nulls_last()
    return [first, *[F.col(t).asc() for t in ([tie] if isinstance(tie, str) else tie or [])]]


def page_of(df: DataFrame, page: int = 1, limit: int = 10, sort_by: str = "updated_at", order: str = "desc", tie: str | None = "_id") -> DataFrame:
    """The page's rows. Spark takes the first page * limit rows of each partition, not a full sort."""
    check_page(page, limit, order)
    return df.orderBy(*ordering(sort_by, order, tie)).offset((page - 1) * limit).limit(limit)


def paginate(df: DataFrame, **options) -> Page:
    return Page(page_of(df, **options), df.count(), options.get("page", 1), options.get("limit", 10))


def page_counts(df: DataFrame, limit: int, *by: str) -> DataFrame:
    """total and total_pages, for each group."""
    return df.groupBy(*by).agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / limit))


class RankIndex:
    """Deep pages of a sorted listing at the price of shallow ones.

    `build` sorts a table once, over ranges of about range_rows rows, into folders that are numbered in their order, and
    keeps the ranges' row counts. A page is then a slice of one or two ranges, found by sums of the counts before: no
    other range is read, however deep the page. The ties given should make the order total; rows they can't tell apart
    share a range.

    Every range is a task, a folder and samples that the driver gets, so there are MOST_RANGES at most. Those of larger tables
    have more rows, each with its number in the range (`_n`) in its order: Parquet's pages hold range_rows of them, and a page of the
    listing reads those with its numbers alone.
    """

    MOST_RANGES = 256

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.order = ordering(about.sort_by, about.order, list(about.tie))
        counts = {r["_range"]: r.n for r in spark.read.parquet(f"{self.path}/counts").collect()}  # a row a range
        self.ranges = sorted(counts)
        self.ends = list(accumulate(counts[r] for r in self.ranges))
        self.rows = spark.read.schema(StructType.fromJson(json.loads(about.columns))).parquet(f"{self.path}/rows")

    @classmethod
    def build(cls, df: DataFrame, path: str, sort_by: str, order: str = "desc", tie: str | list[str] = "_id", range_rows: int = 1 << 16) -> RankIndex:
        spark, tie = df.sparkSession, [tie] if isinstance(tie, str) else tie
        ranges = min(cls.MOST_RANGES, max(1, -(-df.count() // range_rows)))
        by = ordering(sort_by, order, tie)
        dealt = df.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id())
        numbered = dealt.sortWithinPartitions("_range", *by).withColumn("_n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        numbered.write.mode("overwrite").option("parquet.page.row.count.limit", str(range_rows)).partitionBy("_range").parquet(f"{path}/rows")
        stored = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
        stored.groupBy("_range").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
        about = spark.createDataFrame([(sort_by, order, tie, numbered.schema.json())], "sort_by string, order string, tie array<string>, columns string")
        about.write.mode("overwrite").parquet(f"{path}/about")
        return cls(spark, path)

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def ranges_of(self, page: int, limit: int) -> tuple[list[int], int]:
        """The ranges that a page lies in, and how many rows of the first come before it."""
        first, last = (page - 1) * limit, min(page * limit, self.total)
        if first >= last:
            return [], 0
        low, high = bisect_right(self.ends, first), bisect_left(self.ends, last)
        return self.ranges[low : high + 1], first - (self.ends[low - 1] if low else 0)

    def page(self, page: int = 1, limit: int = 10) -> DataFrame:
        check_page(page, limit, "asc")
        ranges, before = self.ranges_of(page, limit)
        rows = self.rows.filter(F.col("_range").isin(ranges))
        if len(ranges) == 1:
            rows, before = rows.filter((F.col("_n") >= before) & (F.col("_n") < before + limit)), 0
        elif ranges:  # of the first range its end, of the others (each whole but the last) no more than the page has
            rows, before = rows.filter(F.when(F.col("_range") == ranges[0], F.col("_n") >= before).otherwise(F.col("_n") < limit)), 0
        return rows.drop("_range", "_n").orderBy(*self.order).offset(before).limit(limit)
