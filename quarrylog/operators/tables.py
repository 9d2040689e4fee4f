"""Where intermediate relations are kept: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Written tables cut the lineage of loops and survive lost executors. drop() frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{self._folder().rstrip('/')}/relations-{uuid.uuid4().hex}"

    def _folder(self) -> str:
        context = self.spark.sparkContext
        found = self.spark.conf.get("spark.checkpoint.dir", None)
        if found:
            return found
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quarrylog-"))
            held = context._jsc.sc().getCheckpointDir()
        return held.get()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_counted(self, df: DataFrame, name: str, tags: int) -> tuple[DataFrame, list[int]]:
        """The table, and the number of rows of each value of its column __rel, counted while it is written."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        watched = df.observe(seen, *(F.count(F.when(F.col("__rel") == k, 1)).alias(f"n{k}") for k in range(tags)))
        table = self.write(watched, name)
        found = seen.get
        return table, [int(found.get(f"n{k}") or 0) for k in range(tags)]

    @staticmethod
    def size(table: DataFrame) -> int:
        """The bytes of a written table's files."""
        return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
