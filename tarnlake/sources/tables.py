"""Collections as versioned Parquet tables: each change writes a new version, readers take the newest that is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.errors import NotFound
from tarnlake.schemas import DDL, conform, schema


class Store:
    """Tables under a root folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        """Numbers of the complete versions; a write that failed has no success mark."""
        fs, path = self._fs(f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        numbers = [int(f[1:]) for f in found if f.startswith("v") and f[1:].isdigit()]
        return sorted(n for n in numbers if self._done(name, n))

    def _done(self, name: str, version: int) -> bool:
        fs, path = self._fs(f"{self.root}/{name}/v{version}/_SUCCESS")
        return fs.exists(path)

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str) -> DataFrame:
        found = self.versions(name)
        if not found:
            raise NotFound("NO_TABLE", name)
        df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}/v{found[-1]}")
        return conform(df, name) if name in DDL else df

    def write(self, name: str, df: DataFrame, partition_by: str | None = None) -> int:
        number = (self.versions(name) or [0])[-1] + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/v{number}")
        return number

    def append(self, name: str, df: DataFrame) -> None:
        """Rows added to the newest version in place."""
        found = self.versions(name)
        if not found:
            self.write(name, df)
        else:
            df.write.mode("append").parquet(f"{self.root}/{name}/v{found[-1]}")

    def drop(self, name: str) -> None:
        fs, path = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)

    def vacuum(self, name: str, keep: int = 2) -> None:
        for n in self.versions(name)[:-keep]:
            fs, path = self._fs(f"{self.root}/{name}/v{n}")
            fs.delete(path, True)

    def bootstrap(self) -> None:
        """Empty tables where there are none; one settings row with the defaults."""
        for name in DDL:
            if not self.exists(name):
                empty = self.spark.createDataFrame([], schema(name))
                seed = conform(self.spark.range(1).select(F.lit("default").alias("_id")), name) if name == "settings" else empty
                self.write(name, seed)

    def health(self) -> DataFrame:
        """Each table with whether it can be read."""
        return self.spark.createDataFrame([(n, self.exists(n)) for n in DDL], "name string, available boolean")

    def lookup(self, name: str, **key) -> DataFrame:
        from tarnlake.operators.predicates import equals

        return self.read(name).filter(equals(**key)).limit(1)

    def insert_points(self, points: DataFrame, size: int = 768) -> None:
        """Vectors appended, with an id each where there is none; a vector of another size stops the write."""
        right = F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding of a wrong size")))
        given = F.col("id") if "id" in points.columns else F.lit(None).cast("string")
        self.append("points", points.withColumn("embedding", right).withColumn("id", F.coalesce(given, F.expr("uuid()"))))


def to_result_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as JSON with ISO timestamps."""
    return df.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias(column))
