"""Deep pages by a rank index against a full sort."""

import re

import pytest
from pyspark.sql import functions as F

from tarnlake.errors import InvalidArgument
from tarnlake.operators.paging import RankIndex, page_of


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_equal_a_full_sort(spark, tmp_path, order):
    """With nulls and many ties, at every range's border, to beyond the last page."""
    df = spark.range(1000).select(F.col("id").alias("_id"), F.when(F.col("id") % 10 > 0, F.col("id") * 7 % 40).alias("v"), F.lit("x").alias("_r"))
    index = RankIndex.build(df, f"file://{tmp_path}/i", "v", order, range_rows=90)
    assert index.total == 1000 and len(index.ranges) >= 8
    for page, limit in [(1, 10), (2, 45), (9, 10), (10, 10), (50, 20), (1000, 1), (8, 100), (10, 100), (11, 100), (99, 100)]:
        want = page_of(df, page, limit, "v", order, "_id").collect()
        assert [r._id for r in index.page(page, limit).collect()] == [r._id for r in want], (page, limit)
    with pytest.raises(InvalidArgument):
        index.page(0, 10)


def test_a_deep_page_reads_few_rows(spark, tmp_path):
    df = spark.range(40_000).select(F.col("id").alias("_id"), F.xxhash64("id").alias("v"))
    index = RankIndex.build(df, f"file://{tmp_path}/i", "v", range_rows=1000)
    again = RankIndex(spark, f"file://{tmp_path}/i")
    for page in (1, 2000, 3999):
        ranges, _ = again.ranges_of(page, 10)
        assert len(ranges) <= 2 and again.rows.filter(F.col("_range").isin(ranges)).count() <= 4000
        assert re.search(r"PartitionFilters: \[[^\]]*_range", again.page(page, 10)._jdf.queryExecution().toString())
    assert index.ranges_of(4001, 10) == ([], 0) and again.page(4001, 10).collect() == []
    empty = RankIndex.build(df.limit(0), f"file://{tmp_path}/e", "v")
    assert empty.total == 0 and empty.page(1, 10).collect() == []


def test_few_ranges_however_large_the_table(spark, tmp_path, monkeypatch):
    """Tasks, folders and samples have a bound; pages equal a full sort, within ranges and over their borders."""
    monkeypatch.setattr(RankIndex, "MOST_RANGES", 5, raising=False)
    df = spark.range(3000).select(F.col("id").alias("_id"), F.when(F.col("id") % 10 > 0, F.col("id") * 7 % 400).alias("v"))
    index = RankIndex.build(df, f"file://{tmp_path}/i", "v", "desc", range_rows=10)
    assert len(index.ranges) <= 5 and index.total == 3000
    border = index.ends[0]
    for page, limit in [(1, 10), (7, 10), (border // 10, 10), (border // 10 + 1, 10), (border // 100 + 1, 100), (border // 99 + 1, 99), (300, 10), (301, 10)]:
        want = page_of(df, page, limit, "v", "desc", "_id").collect()
        assert [tuple(r) for r in index.page(page, limit).collect()] == [tuple(r) for r in want], (page, limit)
