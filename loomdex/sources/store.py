"""Index versions as Parquet: a directory for each version, a table of contents, one pointer; and stored facts by content."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def digest(df: DataFrame) -> str:
    """Order-free digest of a table: rows, and two sums of row hashes."""
    h = df.select(F.xxhash64(*df.columns).alias("x")) if df.columns else df
    r = h.agg(F.count("*").alias("n"), F.bit_xor("x").alias("b"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.b}:{r.s}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through a temporary name and a rename, so that no reader sees half of it."""
    fs, tmp = _fs(spark, path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, p = _fs(spark, path)
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"could not publish {path}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], stamp: str = "", partition_by: dict[str, list[str]] | None = None) -> bool:
    """Writes a version and points to it; False, and nothing written, if the current version holds the same rows."""
    digests = {n: digest(t) for n, t in tables.items()}
    meta = {"schema_version": SCHEMA_VERSION, "stamp": stamp, "digests": digests}
    now = _read_text(spark, f"{root}/CURRENT")
    if now and json.loads(now)["meta"] == meta:
        return False
    version = hashlib.sha256(json.dumps(meta, sort_keys=True).encode()).hexdigest()[:16]
    for n, t in tables.items():
        keys = (partition_by or {}).get(n, [])
        t.write.mode("overwrite").partitionBy(*keys).parquet(f"{root}/{version}/{n}")
    _write_text(spark, f"{root}/CURRENT", json.dumps({"version": version, "meta": meta}))
    return True


def load(spark: SparkSession, root: str, verify: bool = False, stamp: str | None = None) -> dict[str, DataFrame]:
    """The tables of the current version. ValueError: missing, incompatible, or (with verify) corrupt."""
    text = _read_text(spark, f"{root}/CURRENT")
    if text is None:
        raise ValueError("missing")
    current = json.loads(text)
    meta = current["meta"]
    if meta["schema_version"] != SCHEMA_VERSION or stamp is not None and stamp != meta["stamp"]:
        raise ValueError("incompatible")
    out = {n: spark.read.parquet(f"{root}/{current['version']}/{n}") for n in meta["digests"]}
    if verify and any(digest(t) != meta["digests"][n] for n, t in out.items()):
        raise ValueError("corrupt")
    return out


def split_by_cache(files: DataFrame, facts: DataFrame | None, extractor: str, schema: int = SCHEMA_VERSION) -> tuple[DataFrame, DataFrame]:
    """(files whose facts are stored, files to extract) by content identity, language, extractor and schema."""
    keyed = files.withColumn("extractor", F.lit(extractor)).withColumn("schema", F.lit(schema))
    if facts is None:
        return keyed.limit(0), keyed
    keys = ["oid", "lang", "extractor", "schema"]
    have = facts.select(*keys).distinct()
    return keyed.join(have, keys, "left_semi"), keyed.join(have, keys, "left_anti")


def cache_outcomes(files: DataFrame, entries: DataFrame, extractor: str, schema: int = SCHEMA_VERSION) -> DataFrame:
    """path, outcome (hit, miss, corrupt) of files (path, oid, lang) against stored entries (oid, lang, extractor, schema, payload, checksum).

    An entry is corrupt if its payload isn't what its SHA-256 says; of repeated entries one sound one is enough.
    """
    sound = F.coalesce(F.sha2("payload", 256) == F.col("checksum"), F.lit(False))
    have = entries.where((F.col("extractor") == extractor) & (F.col("schema") == schema)).groupBy("oid", "lang").agg(F.max(sound).alias("__sound"))
    outcome = F.when(F.col("__sound"), "hit").when(~F.col("__sound"), "corrupt").otherwise("miss")
    return files.join(have, ["oid", "lang"], "left").select("path", outcome.alias("outcome"))
