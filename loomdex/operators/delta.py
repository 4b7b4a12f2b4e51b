"""Changes between two versions of a tree, and incremental maintenance."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_DIFF_BYTES = 64 * 1024


def tree_delta(base: DataFrame, target: DataFrame) -> DataFrame:
    """change (added, modified, deleted, type-changed, renamed), path, source, base_oid, target_oid between trees (path, oid, mode).

    A rename is a deleted and an added path of one oid, paired in path order; what is left over stays added or deleted.
    """
    b = base.select("path", F.col("oid").alias("base_oid"), F.col("mode").alias("base_mode"))
    t = target.select("path", F.col("oid").alias("target_oid"), F.col("mode").alias("target_mode"))
    both = b.join(t, "path", "full").where(~(F.col("base_oid").eqNullSafe(F.col("target_oid")) & F.col("base_mode").eqNullSafe(F.col("target_mode"))))
    kind = F.when(F.col("base_oid").isNull(), "added").when(F.col("target_oid").isNull(), "deleted").when(F.col("base_mode") != F.col("target_mode"), "type-changed").otherwise("modified")
    both = both.withColumn("change", kind)
    gone = both.where("change = 'deleted'").withColumn("n", F.row_number().over(Window.partitionBy("base_oid").orderBy("path"))).select(F.col("base_oid").alias("oid"), "n", F.col("path").alias("source"))
    came = both.where("change = 'added'").withColumn("n", F.row_number().over(Window.partitionBy("target_oid").orderBy("path"))).select(F.col("target_oid").alias("oid"), "n", "path")
    pairs = came.join(gone, ["oid", "n"], "full")
    moved = F.when(F.col("path").isNotNull() & F.col("source").isNotNull(), "renamed").when(F.col("path").isNotNull(), "added").otherwise("deleted")
    pairs = pairs.select(moved.alias("change"), F.coalesce("path", "source").alias("path"), F.when(F.col("path").isNotNull(), F.col("source")).alias("source"), F.when(F.col("source").isNotNull(), F.col("oid")).alias("base_oid"), F.when(F.col("path").isNotNull(), F.col("oid")).alias("target_oid"))
    rest = both.where("change in ('modified', 'type-changed')").select("change", "path", F.lit(None).cast("string").alias("source"), "base_oid", "target_oid")
    return pairs.unionByName(rest)


def hunks(pairs: DataFrame) -> DataFrame:
    """key, hunks (old_start, old_lines, new_start, new_lines; lines from 1) of pairs (key, old, new); none for texts over 64 KiB or null ones.

    Line differences come from a longest-match diff; where equal lines repeat its hunks can be others than a histogram diff's.
    """
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("old_start", "old_lines", "new_start", "new_lines")]))

    def one(old, new):
        if old is None or new is None or max(len(old.encode()), len(new.encode())) > MOST_DIFF_BYTES:
            return []
        m = difflib.SequenceMatcher(None, old.splitlines(True), new.splitlines(True), autojunk=False)
        return [{"old_start": i + (j > i), "old_lines": j - i, "new_start": k + (n > k), "new_lines": n - k} for tag, i, j, k, n in m.get_opcodes() if tag != "equal"]

    def run(batches):
        for b in batches:
            out = [one(o, n) for o, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["key", "hunks"])

    return pairs.select(F.col("key").cast("string"), "old", "new").mapInArrow(run, "key string, hunks array<struct<old_start: bigint, old_lines: bigint, new_start: bigint, new_lines: bigint>>")


def pair_definitions(base: DataFrame, target: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """kind, qualified, base_id, target_id: definitions of two versions by (path, kind, qualified), duplicates first come first paired.

    renamed (path, source): target paths whose base is another path. There, if nothing pairs by name, the rest pairs by place.
    base, target: path, id, kind, qualified, start.
    """
    if renamed is not None:
        moved = renamed.select(F.col("source").alias("path"), F.col("path").alias("to"))
        base = base.join(moved, "path", "left").withColumn("path", F.coalesce("to", "path")).drop("to")
    nth = F.row_number().over(Window.partitionBy("path", "kind", "qualified").orderBy("start", "id"))
    b = base.withColumn("n", nth).select("path", "kind", "qualified", "n", F.col("id").alias("base_id"), F.col("start").alias("bs"))
    t = target.withColumn("n", nth).select("path", "kind", "qualified", "n", F.col("id").alias("target_id"), F.col("start").alias("ts"))
    out = b.join(t, ["path", "kind", "qualified", "n"], "full")
    if renamed is not None:
        none = out.groupBy("path").agg(F.count_if(F.col("base_id").isNotNull() & F.col("target_id").isNotNull()).alias("p")).where("p = 0").join(renamed.select("path"), "path", "left_semi").select("path")
        lone = out.join(none, "path", "left_semi")
        place = lambda c: F.row_number().over(Window.partitionBy("path", "kind").orderBy(c))
        lb = lone.where("base_id is not null").withColumn("n", place("bs")).select("path", "kind", F.col("qualified").alias("bq"), "n", "base_id")
        lt = lone.where("target_id is not null").withColumn("n", place("ts")).select("path", "kind", F.col("qualified").alias("tq"), "n", "target_id")
        by_place = lb.join(lt, ["path", "kind", "n"], "full").select("path", "kind", F.coalesce("tq", "bq").alias("qualified"), "base_id", "target_id")
        out = out.join(none, "path", "left_anti").select("path", "kind", "qualified", "base_id", "target_id").unionByName(by_place)
    return out.select("path", "kind", "qualified", "base_id", "target_id")


def classify_definitions(pairs: DataFrame, touched_base: DataFrame, touched_target: DataFrame, renamed: DataFrame) -> DataFrame:
    """pairs with change: added, removed, modified (either side touched), moved (its file renamed, not touched), or null. touched_*: id."""
    p = pairs.join(touched_base.select(F.col("id").alias("base_id"), F.lit(True).alias("__b")).distinct(), "base_id", "left")
    p = p.join(touched_target.select(F.col("id").alias("target_id"), F.lit(True).alias("__t")).distinct(), "target_id", "left")
    p = p.join(renamed.select("path", F.lit(True).alias("__m")).distinct(), "path", "left")
    change = F.when(F.col("base_id").isNull(), "added").when(F.col("target_id").isNull(), "removed").when(F.coalesce("__b", "__t"), "modified").when(F.col("__m"), "moved")
    return p.select("path", "kind", "qualified", "base_id", "target_id", change.alias("change"))


# incremental maintenance

# Why everything is rebuilt.
FULL_REASONS = ["requested", "no-index", "index-invalid", "rules-changed", "extractor-changed", "history-rewritten", "no-version-control"]
_PRIORITY = {"recheck": 3, "rename": 2, "remove": 1}


def refresh_plan(changes: DataFrame) -> DataFrame:
    """path, action, source of changes (path, action, source): recheck beats rename beats remove.

    Renames of one path from several sources contradict each other: action conflict.
    """
    order = F.element_at(F.create_map(*[F.lit(x) for kv in _PRIORITY.items() for x in kv]), F.col("action"))
    g = changes.groupBy("path").agg(F.max_by("action", order).alias("action"), F.countDistinct(F.when(F.col("action") == "rename", F.col("source"))).alias("sources"), F.min(F.when(F.col("action") == "rename", F.col("source"))).alias("source"))
    action = F.when((F.col("action") == "rename") & (F.col("sources") > 1), "conflict").otherwise(F.col("action"))
    return g.select("path", action.alias("action"), F.when(action == "rename", F.col("source")).alias("source"))


def retained(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Files that a refresh keeps as they are: neither rechecked, removed, renamed nor the source of a rename."""
    sources = plan.where("source is not null").select(F.col("source").alias("path"))
    return files.join(plan.select("path").union(sources).distinct(), "path", "left_anti")


def refreshed(facts: DataFrame, plan: DataFrame, extracted: DataFrame) -> DataFrame:
    """The rows of a full build: kept rows of facts and newly extracted ones."""
    return retained(facts, plan).unionByName(extracted)


def is_no_op(plan: DataFrame) -> bool:
    return plan.isEmpty()


def full_reason(known: dict) -> str | None:
    """The first reason to rebuild everything, by FULL_REASONS; None if a refresh can be incremental."""
    return next((r for r in FULL_REASONS if known.get(r)), None)


def status(index: DataFrame, tree: DataFrame) -> DataFrame:
    """One row: label (fresh, stale) and counts of files that are new, gone or changed between index and tree (path, oid)."""
    both = index.select("path", F.col("oid").alias("i")).join(tree.select("path", F.col("oid").alias("t")), "path", "full")
    c = both.agg(F.count_if(F.col("i").isNull()).alias("added"), F.count_if(F.col("t").isNull()).alias("removed"), F.count_if(F.col("i") != F.col("t")).alias("changed"), F.count_if(F.col("i") == F.col("t")).alias("unchanged"))
    return c.select(F.when(F.col("added") + F.col("removed") + F.col("changed") == 0, "fresh").otherwise("stale").alias("label"), "added", "removed", "changed", "unchanged")


def commits_left_index_true(delta: DataFrame, indexed: DataFrame) -> bool:
    """Whether a committed delta (path, target_oid) only holds what the index (path, oid) has already."""
    want = delta.select("path", F.col("target_oid").alias("oid"))
    have = indexed.select("path", F.col("oid").alias("now"))
    return want.join(have, "path", "full").where(F.col("path").isNotNull() & ~F.col("oid").eqNullSafe(F.col("now")) & F.col("oid").isNotNull()).isEmpty()
