import pytest
from pyspark.sql import functions as F

from tarnlake.llm.common import HOT_SHARE, attach, clear_scratch, scratch_count, scratch_dir, stored


def test_attach_hot_cold_null_and_missing(spark):
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 1500).cast("string"))).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("n > 1")
    assert groups.filter(F.col("n") >= 4000 / HOT_SHARE).count() >= 1
    got = {r.id: (r.n, r.low) for r in attach(rows, groups, ["k"], "n", 4000).collect()}
    members = {}
    for r in rows.collect():
        members.setdefault(r.k, []).append(r.id)
    assert got == {i: (len(m), min(m)) if len(m) > 1 else (None, None) for m in members.values() for i in m}


def test_scratch(spark):
    assert scratch_dir(spark).startswith("file:")
    df = stored(spark.range(3), "x")
    before = scratch_count(spark)
    stored(spark.range(2), "y")
    assert df.count() == 3 and clear_scratch(spark, before) == 1 and df.count() == 3
    assert clear_scratch(spark) >= 1 and clear_scratch(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(Session())
