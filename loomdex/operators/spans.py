"""Interval operators. All joins carry equi keys, the group and a bucket, so none becomes a nested loop or a product of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """The power of two that a span of so many units fits into."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)))).cast("int")


def containing(outer: DataFrame, points: DataFrame, group: str, start: str, end: str, at: str) -> DataFrame:
    """Rows of outer whose [start, end] holds a row's position at, joined to it by group. Column names must differ but for group.

    A span lies in two buckets at most of the power of two above its length; a point looks into one bucket of each power that
    occurs. So a row meets spans near its place only, however long others are.
    """
    spans = outer.withColumn("__l", _level(F.col(end) - F.col(start) + 1))
    levels = sorted(r[0] for r in spans.select("__l").distinct().collect() if r[0] is not None)  # 64 values at most
    if not levels:
        levels = [0]
    size = F.pow(F.lit(2), F.col("__l")).cast("long")
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    looks = points.withColumn("__l", F.explode(F.array(*map(F.lit, levels)))).withColumn("__b", F.floor(F.col(at) / size))
    return looks.join(spans, [group, "__l", "__b"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("__l", "__b")


def nearest_owner(points: DataFrame, spans: DataFrame, group: str = "file") -> DataFrame:
    """point_id, owner: the smallest span that contains a point's [start, end], ties by lowest id; null if there is none.

    points: group, point_id, start, end. spans: group, id, start, end.
    """
    o = spans.select(group, F.col("id").alias("owner"), F.col("start").alias("s"), F.col("end").alias("e"))
    hit = containing(o, points.select(group, "point_id", "start", "end"), group, "s", "e", "start").where("end <= e")
    best = hit.groupBy("point_id").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("len"), "owner")).alias("m")).select("point_id", "m.owner")
    return points.select("point_id").join(best, "point_id", "left")


def parents(spans: DataFrame, group: str = "file") -> DataFrame:
    """id, parent: the smallest span of the group that strictly contains each one, ties by lowest id."""
    a = spans.select(group, F.col("id").alias("parent"), F.col("start").alias("s"), F.col("end").alias("e"))
    hit = containing(a, spans.select(group, "id", "start", "end"), group, "s", "e", "start").where("end <= e and (s < start or end < e) and parent <> id")
    best = hit.groupBy("id").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("len"), "parent")).alias("m")).select("id", "m.parent")
    return spans.select("id").join(best, "id", "left")


def touched(definitions: DataFrame, hunks: DataFrame, group: str = "file") -> DataFrame:
    """group, id of the definitions that line hunks touch.

    A hunk [start, start + lines) touches those it meets, without those that enclose another one it meets; a hunk of no lines
    is the point max(start, 1), which touches the innermost definition around it. definitions: group, id, start_line, end_line.
    """
    d = definitions.select(group, "id", "start_line", "end_line")
    h = hunks.select(group, F.struct("start", "lines").alias("hunk"), F.when(F.col("lines") > 0, F.col("start")).otherwise(F.greatest("start", F.lit(1))).alias("first"))
    h = h.withColumn("last", F.when(F.col("hunk.lines") > 0, F.col("first") + F.col("hunk.lines") - 1).otherwise(F.col("first"))).distinct()
    # a definition and a hunk meet where one holds the first line of the other
    cols = [group, "hunk", "id", "start_line", "end_line"]
    met = containing(d, h, group, "start_line", "end_line", "first").select(*cols)
    met = met.union(containing(h, d, group, "first", "last", "start_line").select(*cols)).distinct()
    other = met.select(group, "hunk", F.col("id").alias("id2"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2"))
    # pairs only among the definitions that one hunk meets
    outer = met.join(other, [group, "hunk"]).where("id <> id2 and start_line <= s2 and e2 <= end_line and (start_line < s2 or e2 < end_line)").select(group, "hunk", "id").distinct()
    return met.join(outer, [group, "hunk", "id"], "left_anti").select(group, "id").distinct()


def window_lines(lines: DataFrame, spans: DataFrame, context: int = 3, most_lines: int = 120, most_bytes: int = 65_536) -> DataFrame:
    """key, line, text: a verified window around each span: its own lines first, then context before and after, while both
    budgets last. lines: key, line (from 1), text. spans: key, start_line, end_line."""
    near = lines.join(spans, "key").where((F.col("line") >= F.col("start_line") - context) & (F.col("line") <= F.col("end_line") + context))
    inside = F.col("line").between(F.col("start_line"), F.col("end_line"))
    order = Window.partitionBy("key").orderBy(F.when(inside, 0).otherwise(1), F.when(F.col("line") < F.col("start_line"), F.col("start_line") - F.col("line")).when(F.col("line") > F.col("end_line"), F.col("line") - F.col("end_line")).otherwise(0), "line")
    size = F.sum(F.octet_length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = near.withColumn("__n", F.row_number().over(order)).withColumn("__b", size)
    return out.where((F.col("__n") <= most_lines) & (F.col("__b") <= most_bytes)).select("key", "line", "text")


# What can come of a request for source.
SOURCE_STATUSES = ["served", "refused", "missing", "changed", "size-mismatch", "not-text", "too-large", "out-of-range", "raced"]


def source_status(rows: DataFrame, most_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Adds status, in order: refused, missing, changed (representation or identity), size-mismatch, too-large, not-text, raced, out-of-range.

    rows: refused, oid, current_oid, again_oid, representation, current_representation, size, current_size, is_text, lines, start_line.
    """
    s = F.when(F.col("refused"), "refused").when(F.col("current_oid").isNull(), "missing")
    s = s.when((F.col("representation") != F.col("current_representation")) | (F.col("oid") != F.col("current_oid")), "changed")
    s = s.when(F.col("size") != F.col("current_size"), "size-mismatch").when(F.col("current_size") > most_bytes, "too-large").when(~F.col("is_text"), "not-text")
    s = s.when(~F.col("again_oid").eqNullSafe(F.col("current_oid")), "raced").when(F.col("start_line") > F.col("lines"), "out-of-range")
    return rows.withColumn("status", s.otherwise("served"))


def whole_file_span(content):
    """(start_line, end_line) of a text: 1 to its number of lines."""
    n = F.regexp_count(content, F.lit("\n")) + F.when(content.endswith("\n") | (content == ""), 0).otherwise(1)
    return F.struct(F.lit(1).cast("long").alias("start_line"), F.greatest(n, F.lit(1)).cast("long").alias("end_line"))
