"""Checkpoints in the folder that the cluster shares, and row numbers without a task that sees all rows."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder for checkpoints, which driver and executors share."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/checkpoints"  # on one machine only, as in tests
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept as a checkpoint: the lineage ends here and survives lost executors."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as cut() keeps it, but compressed and by columns."""
    path = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles of what nothing refers to any more; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def put(uri: str, array) -> None:
    """Writes the bytes of a numpy array whole: a temporary name first, then a rename."""
    temp = f"{uri}.{uuid.uuid4().hex}.tmp"
    if uri.startswith("file:") or "://" not in uri:
        local = lambda u: "/" + u.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(local(uri)), exist_ok=True)
        array.tofile(local(temp))
        os.replace(local(temp), local(uri))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = fs.FileSystem.from_uri(temp)[1]
    with store.open_output_stream(temp) as out:
        out.write(memoryview(array).cast("B"))
    store.move(temp, path)


def got(uri: str, kind: str):
    """The array that put() wrote, mapped where the folder can be."""
    import numpy as np

    if uri.startswith("file:") or "://" not in uri:
        path = "/" + uri.removeprefix("file:").lstrip("/")
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return np.frombuffer(store.open_input_file(path).readall(), kind)


def numbered(df: DataFrame, by: list, name: str) -> DataFrame:
    """df with the place of each row from 0 in the order of the columns ``by``, from offsets of range partitions."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in a partition from 0
    ranged = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()).withColumn("__place", place))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    offsets = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each partition
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")
