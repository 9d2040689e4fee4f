"""What several operators of this subpackage share: durable intermediate tables, Arrow plumbing, components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte, so that UTF-8 stays valid.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: ASCII white space, as [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        found = tempfile.mkdtemp(prefix="quarrylog-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


#: With it, the shuffle files of a query go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that one operator call writes to the shared folder, to cut lineage there.

    A table survives the loss of executors, and later plans read it instead of running its plan again; the shuffle files of
    its plan go at once. drop() removes tables that no returned plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/quarrylog-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        was = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(_CLEAN) if was is None else self.spark.conf.set(_CLEAN, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def fresh(self, name: str) -> str:
        return f"{name}-{uuid.uuid4().hex[:12]}"

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 500, size: str = "4m") -> None:
    """Keeps the batches that are read from Parquet and sent to Python workers small, as one text may be megabytes long.

    Plans are run after the operator returned, so this holds for the session; batches that are smaller already stay so."""
    for key in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, text binary): the two columns that a text operator reads, whatever else the table has."""
    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").cast("binary").alias(text))


def batch_of(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns.values()], names=list(columns))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that can be reached.

    Alternates large-star and small-star steps; each is a partial aggregate and an equi-join on the node, so a hub's
    neighbours are never gathered in one row, and AQE can split a hub's partition. Every round is written to the shared folder. Null
    ends and self-links are ignored; repeated links count once. Empty edges give an empty table.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    now = scratch.write(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    for k in range(1, rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.write(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}{k}")
        same = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(f"{name}{k - 1}")
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def schema(**kinds: str) -> str:
    return ", ".join(f"`{k}` {v}" for k, v in kinds.items())
