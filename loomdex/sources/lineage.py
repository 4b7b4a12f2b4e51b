"""Lineage cuts for iterative operators: tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and Spark runs in this process alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = f"file://{tempfile.mkdtemp(prefix='loomdex-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as Parquet files in the shared folder: it survives lost executors, and later plans start there, with pruning and sizes known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomdex-cuts/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Removes all that cut() wrote; results that read it must have been consumed."""
    while _written:
        path, spark = _written.popitem()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            return
