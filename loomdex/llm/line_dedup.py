"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines are those between line feeds that hold a word, compared exactly; words are split at ASCII white space. A window is
the shortest run of lines with MATCH_WORDS words from a line on, or up to a line where that ends later (both ways, as a run
may end after the shortest window). Winnowing:

1. Each window selects its minimum, the smallest line hash (the last of equal ones), as a fingerprint: a hash and a position.
   Equal windows select the same place in them, so any repeated run of MATCH_WORDS words is guaranteed a shared fingerprint.
2. Positions join on the fingerprint: a fingerprint selected at one position only can't be part of a repeated run, and the
   windows around it leave here.
3. The others are extended both ways, to the whole window, which has to equal (128 bits over its lines) the first place
   (by doc_id, then line) of such a window. A window that is not the first is a later copy. Every line of a longest
   repeated run lies in such a window within the run, so the union of the copies is the longest matches' lines.
4. Copies merge into spans per document and are deleted; blank lines between two deleted lines go with them.

So a line goes exactly if it lies in a run of MATCH_WORDS words at least that also stands at an earlier place. Each window
joins one first place, never each other: rows grow with the lines, also for one document of equal lines or for a hot line.

Null texts stay null, empty ones and those without a repeated run stay as they are. Rows with a null doc_id stay as they
are. Identical rows are one document (all copies lose the same lines); different texts of one doc_id count one after the
other by text hash. A very long text is a row a line, sorted by Spark. Every other column is carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialise

MATCH_WORDS = 50


def _pair(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


def windows(docs: DataFrame) -> DataFrame:
    """A row for each window of docs(doc_id, text): doc_id, th, backward, the places (line, number among lines with words) of its
    ends a and b, key (its content's hash), print and place of the selected minimum."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    rows = texts.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    rows = rows.select("doc_id", "th", "line", F.regexp_count("s", F.lit(WORD)).cast("long").alias("w"), *_pair(F.col("s"))).where("w > 0")
    # identical rows of one document collapse where the windows below need its lines anyway
    rows = rows.repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "line"])
    own = Window.partitionBy("doc_id", "th").orderBy("line")
    rows = rows.withColumn("u", F.row_number().over(own)).withColumn("end", F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("c", F.col("end") - F.col("w"))
    here = Window.partitionBy("doc_id", "th")
    ahead, behind = here.orderBy("c").rangeBetween(0, MATCH_WORDS - 1), here.orderBy("end").rangeBetween(1 - MATCH_WORDS, 0)

    def window(over, backward: bool, a: Column, b: Column) -> Column:
        low = F.min(F.struct("h1", (-F.col("u")).alias("u"))).over(over)
        lists = [F.collect_list(h).over(over) for h in ("h1", "h2")]
        key = F.struct(F.xxhash64(lists[0]).alias("x"), F.xxhash64(lists[1]).alias("y"))
        return F.struct(F.lit(backward).alias("backward"), a.alias("a"), b.alias("b"), key.alias("key"), low["h1"].alias("print"), (-low["u"]).alias("place"))

    at = F.struct("line", "u")
    rows = rows.withColumn("fw", window(ahead, False, at, F.max(at).over(ahead))).withColumn("ft", F.sum("w").over(ahead))
    rows = rows.withColumn("bw", window(behind, True, F.min(at).over(behind), at)).withColumn("bt", F.sum("w").over(behind))
    # a window up to a line adds to those from a line on only where it holds MATCH_WORDS without its last line
    both = F.array(F.when(F.col("ft") >= MATCH_WORDS, F.col("fw")), F.when(F.col("bt") - F.col("w") >= MATCH_WORDS, F.col("bw")))
    return rows.select("doc_id", "th", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("v")).select("doc_id", "th", "v.*")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), spans (first, last: numbers from 0 of the lines to delete, in order) of docs(doc_id, text)."""
    every = materialise(windows(docs), "windows")
    place = F.struct("doc_id", "th", "place")
    prints = every.groupBy("print").agg(F.min(place).alias("one"), F.max(place).alias("two")).where("one <> two").select("print")
    near = every.join(prints, "print", "left_semi").select("doc_id", "th", "backward", "a", "b", "key")
    here = F.struct("doc_id", "th", "a.line")
    first = near.groupBy("backward", "key").agg(F.min(here).alias("f"), F.max(here).alias("l")).where("f <> l").select("backward", "key", "f")
    first = materialise(first, "first-windows")  # so that a hot window's rows are split in the join
    copies = near.join(first, ["backward", "key"]).where(here != F.col("f")).select("doc_id", "th", "a", "b").distinct()
    order = Window.partitionBy("doc_id", "th").orderBy("a.u", "b.u")
    reach = F.max("b.u").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = copies.withColumn("new", (F.coalesce(reach, F.lit(-1)) + 1 < F.col("a.u")).cast("int")).withColumn("span", F.sum("new").over(order))
    spans = spans.groupBy("doc_id", "th", "span").agg(F.struct(F.min("a.line").alias("first"), F.max("b.line").alias("last")).alias("s"))
    out = materialise(spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("s")).alias("spans")), "repeats")
    discard(every, first)
    return out


def _with_repeats(docs: DataFrame) -> DataFrame:
    """docs and __spans: the lines to delete, or null."""
    gone = repeated_lines(docs).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    # by shuffle at every size: spans grow with the documents
    out = docs.join(gone.hint("merge"), (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__th")), "left")
    return out.select(*docs.columns, "__spans")


def _left() -> Column:
    """The text without the spans' lines, as the slices between them: time grows with the lines."""
    parts, n = F.split("text", "\n", -1), F.size("__spans")
    begin = lambda k: F.when(k == 0, 0).otherwise(F.element_at("__spans", F.greatest(k, F.lit(1)))["last"] + 1)
    stop = lambda k: F.when(k == n, F.size(parts)).otherwise(F.element_at("__spans", F.least(k + 1, n))["first"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(parts, begin(k) + 1, stop(k) - begin(k))))
    return F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text without later repeated runs, and n_lines, n_removed (0 for null texts); they replace columns of that name."""
    out = _with_repeats(docs)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    cols = [_left().alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*cols, lines.alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, same columns, without later repeated runs; n_chars follows the text, and a document that lost every line with a
    word is dropped."""
    out = _with_repeats(docs).withColumn("__left", _left()).where(F.col("__spans").isNull() | F.col("__left").rlike(WORD))
    of = {"text": F.col("__left")}
    if "n_chars" in docs.columns:
        of["n_chars"] = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("__left").cast(docs.schema["n_chars"].dataType))
    return out.select(*[of[c].alias(c) if c in of else F.col(c) for c in docs.columns])


#: DuckDB SQL over a relation with unique doc_id, and text: doc_id, lines to delete. By the definition alone: every pair of
#: equal lines, the longest runs of such pairs, those of MATCH_WORDS words; then the blank lines between deleted ones.
REPEATED_SQL = rf"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {{documents}} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS s FROM s),
r AS (SELECT *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS w FROM x),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS u FROM r WHERE w > 0),
m AS (SELECT p.doc_id, q.doc_id AS doc0, p.u - q.u AS shift, p.line, p.u, p.w FROM o p JOIN o q ON q.s = p.s AND (q.doc_id, q.u) < (p.doc_id, p.u)),
i AS (SELECT *, u - row_number() OVER (PARTITION BY doc_id, doc0, shift ORDER BY u) AS run FROM m),
k AS (SELECT doc_id, line, sum(w) OVER (PARTITION BY doc_id, doc0, shift, run) AS words FROM i),
g AS (SELECT DISTINCT doc_id, line FROM k WHERE words >= {MATCH_WORDS}),
v AS (SELECT o.doc_id, o.line, g.line IS NOT NULL AS del, lead(o.line) OVER n AS next, lead(g.line IS NOT NULL) OVER n AS also FROM o LEFT JOIN g USING (doc_id, line) WINDOW n AS (PARTITION BY o.doc_id ORDER BY o.line)),
e AS (SELECT doc_id, unnest(range(line, CASE WHEN also THEN next ELSE line + 1 END)) AS line FROM v WHERE del),
gone AS (SELECT doc_id, list(line) AS lines FROM e GROUP BY 1)
"""
