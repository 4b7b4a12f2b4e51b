"""State of a working tree: the text that version control prints, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, path string, source string"
KINDS = ["staged", "unstaged", "untracked", "renamed", "conflicted"]


def parse_status(output: bytes) -> tuple[list[tuple], int]:
    """(rows of kind, path, source) and the number of submodules left out, from the NUL-separated second porcelain format."""
    rows, skipped = [], 0
    parts = iter(output.decode("utf-8", "surrogateescape").split("\0"))
    for p in parts:
        mark, _, rest = p.partition(" ")
        if mark == "?":
            rows.append(("untracked", rest, None))
        elif mark in ("1", "2", "u"):
            fields = rest.split(" ", {"1": 7, "2": 8, "u": 9}[mark])
            source = next(parts) if mark == "2" else None
            if fields[1].startswith("S"):
                skipped += 1
            elif mark == "u":
                rows.append(("conflicted", fields[-1], None))
            else:
                if mark == "2":
                    rows.append(("renamed", fields[-1], source))
                rows += [(k, fields[-1], None) for k, c in (("staged", fields[0][0]), ("unstaged", fields[0][1])) if c not in ".R"]
    return rows, skipped


def status_frame(spark: SparkSession, output: bytes) -> DataFrame:
    return spark.createDataFrame(parse_status(output)[0], SCHEMA)


def state_label(changes: DataFrame) -> str:
    """clean, dirty or conflicted."""
    kinds = {r.kind for r in changes.select("kind").distinct().collect()}  # KINDS at most
    return "conflicted" if "conflicted" in kinds else "dirty" if kinds else "clean"


def refresh_changes(changes: DataFrame, present: DataFrame) -> DataFrame:
    """path, action, source for a refresh: what is gone (not in present, path) is removed, renames move, the rest is read again."""
    here = present.select("path", F.lit(True).alias("here")).distinct()
    c = changes.join(here, "path", "left")
    action = F.when(F.col("kind") == "renamed", "rename").when(F.col("here").isNull(), "remove").otherwise("recheck")
    return c.select("path", action.alias("action"), F.when(action == "rename", F.col("source")).alias("source"))


def rules_touched(delta: DataFrame) -> bool:
    """Whether a delta (path, source) touches a file that discovery follows; then everything is rebuilt."""
    from .tree import is_rule_file

    return not delta.where(is_rule_file("path") | F.coalesce(is_rule_file("source"), F.lit(False))).isEmpty()


def unchanged(first: DataFrame, second: DataFrame) -> bool:
    """Whether two scans (path, oid) of a tree agree: a race between them is none."""
    a, b = first.select("path", F.col("oid").alias("a")), second.select("path", F.col("oid").alias("b"))
    return a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
