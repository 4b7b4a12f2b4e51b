"""Co-change: which paths change together with given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Window of commits, floors, bulk limits.
WINDOW, TOGETHER, JACCARD_PPM, BULK_PATHS, BULK_SHARE = 50, 3, 300_000, 1000, (1, 5)


def window(commits: DataFrame, size: int = WINDOW) -> DataFrame:
    """The newest commits that aren't merges. commits: seq (higher is newer), parents."""
    return commits.where("parents < 2").orderBy(F.desc("seq")).limit(size)


def touched(touches: DataFrame) -> DataFrame:
    """seq, path, once each; a rename (old, new) counts as both."""
    both = F.array_distinct(F.array_compact(F.array("path", "source"))) if "source" in touches.columns else F.array("path")
    return touches.select("seq", F.explode(both).alias("path")).distinct()


def kept_touches(commits: DataFrame, touches: DataFrame, eligible: DataFrame, size: int = WINDOW, bulk_paths: int = BULK_PATHS) -> DataFrame:
    """seq, path of eligible paths in the window's commits that aren't bulk. Bulk commits use up the window, and their ineligible
    paths count toward their size: more than bulk_paths, or more than a fifth of the eligible paths."""
    files = eligible.select("path").distinct()
    inside = touched(touches).join(window(commits, size).select("seq"), "seq", "left_semi")
    most = files.count() * BULK_SHARE[0]
    counts = inside.groupBy("seq").agg(F.count("*").alias("n"))
    small = counts.where((F.col("n") <= bulk_paths) & (F.col("n") * BULK_SHARE[1] <= most))
    return inside.join(small.select("seq"), "seq", "left_semi").join(files, "path", "left_semi")


def co_changes(kept: DataFrame, seeds: DataFrame, together: int = TOGETHER, jaccard_ppm: int = JACCARD_PPM) -> DataFrame:
    """path, seed, together, commits_a, commits_b, jaccard_ppm: each path's strongest seed over both floors. seeds: path."""
    own = kept.groupBy("path").agg(F.count("*").alias("commits"))
    of = seeds.select("path").distinct()
    a = kept.join(of, "path", "left_semi").select("seq", F.col("path").alias("seed"))
    b = kept.join(of, "path", "left_anti")
    pairs = a.join(b, "seq").groupBy("seed", "path").agg(F.count("*").alias("together"))
    pairs = pairs.join(own.select(F.col("path").alias("seed"), F.col("commits").alias("commits_a")), "seed").join(own.select("path", F.col("commits").alias("commits_b")), "path")
    pairs = pairs.withColumn("jaccard_ppm", F.expr("together * 1000000 div (commits_a + commits_b - together)"))
    over = pairs.where((F.col("together") >= together) & (F.col("jaccard_ppm") >= jaccard_ppm))
    order = Window.partitionBy("path").orderBy(F.desc("jaccard_ppm"), F.desc("together"), "seed")
    return over.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("path", "seed", "together", "commits_a", "commits_b", "jaccard_ppm")


def history_key(tip: str, size: int, eligible: DataFrame, version: int = 1) -> str:
    """What a stored co-change table is valid for: tip, window, eligible paths, configuration."""
    import hashlib

    paths = eligible.select("path").distinct().agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path")).alias("x"), F.sum(F.xxhash64("path").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{tip}|{size}|{paths.n}|{paths.x}|{paths.s}|{version}".encode()).hexdigest()
