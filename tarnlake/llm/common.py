"""What the operators share: scratch storage, Arrow batches, and a join that hot keys cannot stall."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package.
SPACE = "[\\x20\\x09-\\x0D]"

#: A key with at least 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot keys at any scale.
HOT_SHARE = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Without one this is an error: a folder of the driver's own would
    lose the rows that executors write. Only a master that runs in the driver's process gets a folder there."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='tarnlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # of each session, the tables not yet deleted


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession, keep: int = 0, last: int = 0) -> int:
    """Deletes the tables that `stored` has written for this session, but the first `keep` and the last `last`; to be
    called once results that read them are written. Returns their number."""
    jvm, paths = spark.sparkContext._jvm, _WRITTEN.get(spark, [])
    gone = paths[keep : len(paths) - last]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del paths[keep : len(paths) - last]
    return len(gone)


def scratch_count(spark: SparkSession) -> int:
    """How many tables of this session clear_scratch would delete."""
    return len(_WRITTEN.get(spark, []))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, as the optimizer estimates them without a job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows left join groups on keys (null-safe), whatever share of the rows one key holds.

    groups has one row per key, with its number of rows in `count`, out of `total` rows in all. Keys with at least
    total / HOT_SHARE rows, of which there can't be more than HOT_SHARE, are broadcast and their rows stay where they
    are or are spread at random; all other keys meet in a shuffle join. Columns of groups are null where nothing matches.
    """
    cold_limit = max(2, -(-total // HOT_SHARE))
    values = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col(count) >= cold_limit).select(
        *[F.col(k).alias(f"_hk{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_hot")
    )
    cold = groups.filter(F.col(count) < cold_limit).select(
        *[F.col(k).alias(f"_ck{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_cold"), F.lit(0).cast("bigint").alias("_cs")
    )
    own = rows.columns
    joined = rows.join(F.broadcast(hot), _same(rows, hot, keys, "_hk"), "left")
    # A row with a hot key has its values already: it takes a salt that no cold group has, which also spreads it.
    salt = F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(1 + F.pmod(F.xxhash64(*own), F.lit(1 << 40)))
    joined = joined.withColumn("_rs", salt)
    same = _same(joined, cold, keys, "_ck") & (joined["_rs"] == cold["_cs"])
    both = joined.join(cold, same, "left").withColumn("_v", F.coalesce("_hot", "_cold"))
    return both.select(*own, *[F.col(f"_v.{v}").alias(v) for v in values])


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    out = None
    for i, k in enumerate(keys):
        one = left[k].eqNullSafe(right[f"{prefix}{i}"])
        out = one if out is None else out & one
    return out


def row_count(df: DataFrame) -> int:
    return df.count()


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` (strings) has about max_bytes at most, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        first = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > max_bytes:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        yield batch.slice(first)


def as_batch(columns: dict[str, list | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip((columns[f.name] for f in schema), schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def arrow_schema(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)
