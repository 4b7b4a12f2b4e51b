"""Helpers shared by the corpus operators: inputs, the shared work folder, lineage cuts, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words split on ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in
    this process alone. On a cluster executors would write to their own disks, so it must be set there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = f"file://{tempfile.mkdtemp(prefix='loomdex-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/loomdex"


_written: dict[str, SparkSession] = {}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it: later plans start from the files, whichever executors are lost.

    The JVM then collects its garbage, on which Spark drops the shuffle files of what has been written.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._loomdex_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of materialise()d tables that nothing will read again."""
    for path in [t._loomdex_path for t in tables]:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clear() -> None:
    """Removes all that materialise() wrote; results that read it must have been consumed."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node that it reaches.

    Minimum labels over neighbours, then a pointer jump, each round written to the shared folder. Hot nodes only meet
    partial minima and a join against one row per node, which adaptive execution can split.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialise(e.union(e.select("v", "u")).distinct(), f"{label}-edges")
    lab = e.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("node"), F.least("u", "l").alias("l"))
    lab = lab_table = materialise(lab, f"{label}-0")
    for k in range(1, 60):
        near = e.join(lab.select(F.col("node").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        step = lab.join(near, lab.node == near.u, "left").select("node", F.col("l").alias("was"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = lab.select(F.col("node").alias("l"), F.col("l").alias("j"))
        old, new = lab_table, materialise(step.join(jump, "l", "left").select("node", "was", F.least("l", F.coalesce("j", "l")).alias("l")), f"{label}-{k}")
        discard(old)
        lab, lab_table = new.select("node", "l"), new
        if new.where("was <> l").isEmpty():
            discard(e)
            return lab.select("node", F.col("l").alias("component"))
    raise RuntimeError(f"{label}: components did not settle")
