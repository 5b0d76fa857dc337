"""Duplicates of contents across all history, as a stream: Bloom filters per range of hashes, and an exact check of what they let through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "path string, file_hash string, duplicate_of string"


class HashHistory:
    """Hashes of all contents seen, in {folder}: `hashes` (by batch and range), `filters` (a Bloom filter per range, words of 64
    bits, merged a batch at a time) and `results` (by batch).

    A hash belongs to the range of its first two digits, and its `probes` bits come from the digits after them. Overfull
    filters let more through to the exact check and change no result; they have `bits` bits a range, so the table of all
    has 256 * bits / 64 rows at most. A batch reads what earlier batches wrote and replaces what it wrote itself, so
    that it may run again after a failure at any point.
    """

    def __init__(self, folder: str, bits: int = 1 << 22, probes: int = 4):
        self.folder, self.bits, self.probes = folder.rstrip("/"), bits, probes
        self.read: list[list[int]] = []  # of each batch the ranges of history that it had to read

    def _bits_of(self, hashes: DataFrame) -> DataFrame:
        """file_hash, range, word and bit: a row for each probe of each hash."""
        place = lambda i: F.pmod(F.conv(F.substring("file_hash", 3 + 7 * i, 7), 16, 10).cast("long"), F.lit(self.bits))
        rows = hashes.select("file_hash", F.conv(F.substring("file_hash", 1, 2), 16, 10).cast("int").alias("range"), F.explode(F.array(*[place(i) for i in range(self.probes)])).alias("_p"))
        return rows.select("file_hash", "range", F.shiftright("_p", 6).alias("word"), F.expr("shiftleft(1L, cast(_p & 63 as int))").alias("bit"))

    def _of(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return spark.read.option("basePath", path).schema(f"{schema}, batch long").parquet(path)

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """Results (RESULT) of a batch of files (path, content): duplicate_of is the path that had the content first, of the
        history or, in one batch, the smallest; null for new contents. Contents are read once, where they are; only paths and
        hashes move. A null content is none: it has no hash and is no duplicate."""
        spark = batch.sparkSession
        paths = f"{self.folder}/paths/batch={number}"
        batch.select(F.col("path").cast("string").alias("path"), F.md5("content").alias("file_hash")).write.mode("overwrite").parquet(paths)
        rows = spark.read.schema("path string, file_hash string").parquet(paths)
        firsts = rows.filter("file_hash is not null").groupBy("file_hash").agg(F.min("path").alias("first"))
        bits, known = self._bits_of(firsts), None
        self.read.append([])
        last = self._of(spark, "filters", "range int, word long, bits long").filter(F.col("batch") < number).agg(F.max("batch")).first()[0] if number else None
        if last is not None:
            before = self._of(spark, "filters", "range int, word long, bits long").filter(F.col("batch") == last).drop("batch")
            hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
            maybe = bits.join(before, ["range", "word"], "left").groupBy("file_hash", "range").agg(F.bool_and(hit).alias("maybe")).filter("maybe").select("file_hash", "range")
            path = f"{self.folder}/maybe/batch={number}"
            maybe.write.mode("overwrite").parquet(path)
            maybe = spark.read.schema("file_hash string, range int").parquet(path)
            ranges = sorted(r.range for r in maybe.select("range").distinct().collect())  # 256 at most
            self.read[-1] = ranges
            if ranges:
                old = self._of(spark, "hashes", "file_hash string, first string, range int").filter((F.col("batch") < number) & F.col("range").isin(ranges))
                known = old.select("file_hash", F.col("first").alias("known")).join(maybe.select("file_hash"), "file_hash", "left_semi")
        firsts = firsts.withColumn("known", F.lit(None).cast("string")) if known is None else firsts.join(known, "file_hash", "left")
        own = firsts.select(F.col("file_hash").alias("_h"), "first", "known")
        found = rows.join(own, F.col("file_hash") == F.col("_h"), "left")
        of = F.coalesce("known", F.when(F.col("path") != F.col("first"), F.col("first")))
        found.select("path", "file_hash", of.alias("duplicate_of")).write.mode("overwrite").parquet(f"{self.folder}/results/batch={number}")
        fresh = own.filter("known is null").select(F.col("_h").alias("file_hash"), "first", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int").alias("range"))
        fresh.write.mode("overwrite").partitionBy("range").parquet(f"{self.folder}/hashes/batch={number}")
        added = self._bits_of(fresh.select("file_hash")).select("range", "word", F.col("bit").alias("bits"))
        merged = (added if last is None else added.union(before.select("range", "word", "bits"))).groupBy("range", "word").agg(F.bit_or("bits").alias("bits"))
        merged.write.mode("overwrite").parquet(f"{self.folder}/filters/batch={number}")
        return spark.read.schema(RESULT).parquet(f"{self.folder}/results/batch={number}")

    def results(self, spark: SparkSession) -> DataFrame:
        return self._of(spark, "results", RESULT).drop("batch")


def deduplicate(files: DataFrame, history: HashHistory, checkpoint: str, once: bool = True):
    """Starts the stream of files (path, content) through the history."""
    writer = files.writeStream.foreachBatch(lambda batch, number: history.add(batch, number) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()
