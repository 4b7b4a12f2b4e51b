"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

A document's size is its number of words. Sources by code point, null last, weigh CYCLE in turn and share SHARE of all
words; a source's target stops at CAP times its own words, the excess going to the others by weight (water filling).
A source takes as many whole copies of itself as fit its target; the rest is a quota of blocks (documents by hash),
drawn without replacement in the order of a permutation. The last block is cut into sub-blocks, and the last of these
into documents, of which one may be taken in part, so that taken words meet the rounded target.

Each drawn block, once a copy, is a unit. The tree splits the sources' unit counts among SHARDS output shards: a ticket
per unit bears its source's name only, all tickets are shuffled (ranked by hash), and each node of the tree gives the
first half of its tickets to the left, one more if they are odd. The number of a source's tickets in a shard is
multivariate hypergeometric, and every shard's total is exact. The counts are then filled: a source's units, in an order
of their own, go to its shards by these counts, disjointly. Within a shard documents are in hash order.

All draws are hashes: reruns agree. Ranks come from counts per range of hashes (or range-partitioned sources) and a window
over those counts; other windows are over one source's blocks, sub-blocks, or one sub-block's documents. No window holds all
sources, units or a source's documents.

Null and empty texts have size 0 and take 0. A null source is a source of its own. An empty table gives no rows; if no
document has a word all targets are 0. Equal hashes rank by doc_id and size. Repeated rows and null doc_ids keep a row each. A very
long text is one document like others. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

SHARE, CAP, CYCLE = 1.5, 2, (5, 2, 1)
BLOCKS, SUB_BLOCKS, SHARDS, RANGES = 256, 4096, 8, 4096


def _mark(*parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def _running(partition: list[str], order: list, value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def _ranged(rows: DataFrame, order: list, label: str) -> DataFrame:
    """rows with part, which numbers ranges of rows in the given order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), label)


def _offsets(rows: DataFrame, part: str, **sums: Column) -> DataFrame:
    """part, and each sum over the rows of all lower parts; a window over one row per part."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(part).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    return per.select(part, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums))


def targets(sizes: DataFrame) -> DataFrame:
    """skey, source_size, target for sizes(skey, source_size); a row per source. Sources are ranked, and filled in the order of
    cap by weight, within range partitions."""
    null, turn = F.col("skey") == "n", Window.partitionBy("part").orderBy(F.col("skey") == "n", "skey")
    s = _ranged(sizes, [null, "skey"], "sources")
    s = s.join(_offsets(s, "part", number=F.lit(1)), "part").withColumn("turn", F.row_number().over(turn) + F.col("number_before")).drop("part", "number_before")
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, CYCLE)), ((F.col("turn") - 1) % len(CYCLE) + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * CAP)
    s = _ranged(s, [F.col("cap") / F.col("w"), "skey"], "caps")
    up = Window.partitionBy("part").orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    s = s.join(_offsets(s, "part", cap=F.col("cap"), w=F.col("w")), "part")
    s = s.withColumn("caps", F.coalesce(F.sum("cap").over(up), F.lit(0)) + F.col("cap_before")).withColumn("ws", F.coalesce(F.sum("w").over(up), F.lit(0.0)) + F.col("w_before"))
    every = s.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    s = s.withColumn("level", (F.lit(every["size"] or 0) * SHARE - F.col("caps")) / (F.lit(every["w"] or 0.0) - F.col("ws")))
    level = s.where(F.col("level") <= F.col("cap") / F.col("w")).agg(F.min(F.struct(F.col("cap") / F.col("w"), "skey", "level"))["level"].alias("level")).first()["level"]
    share = F.col("cap").cast("double") if level is None else F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w"))
    return s.select("skey", "source_size", share.alias("target"))


def shard_counts(units: DataFrame) -> DataFrame:
    """skey, shard, ticket for units(skey, k), k from 1 on: ticket numbers a source's units from 1, shard by shard of the tree."""
    rows = units.select("skey", _mark("skey", "k", F.lit("ticket")).alias("h"), "k").withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / (2**32 // RANGES)))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("h", "skey", "k"))
    rows = rows.join(_offsets(rows, "range", number=F.lit(1)), "range").withColumn("at", rank - 1 + F.col("number_before"))
    rows = rows.withColumn("n", F.lit(units.count())).withColumn("shard", F.lit(0))
    for _ in range(SHARDS.bit_length() - 1):
        half = F.floor((F.col("n") + 1) / 2)
        right = F.col("at") >= half
        rows = rows.select("skey", (F.col("shard") * 2 + right.cast("int")).alias("shard"), F.when(right, F.col("at") - half).otherwise(F.col("at")).alias("at"), F.when(right, F.col("n") - half).otherwise(half).alias("n"))
    counts = rows.groupBy("skey", "shard").agg(F.count("*").alias("count"))
    upto = _running(["skey"], ["shard"], "count")
    return counts.withColumn("upto", upto).select("skey", "shard", F.explode(F.sequence(F.col("upto") - F.col("count") + 1, "upto")).alias("ticket"))


def _drawn(parts: DataFrame, by: list[str], order: list, size: str, quota: str) -> DataFrame:
    """Adds part: 'all', 'some' or 'none' of each row's words by a running quota, and left: what 'some' may take."""
    end = _running(by, order, size)
    out = parts.withColumn("end", end).withColumn("left", F.col(quota) - F.col("end") + F.col(size))
    return out.withColumn("part", F.when(F.col("end") <= F.col(quota), "all").when(F.col("left") > 0, "some").otherwise("none")).drop("end")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, draws (copy, shard, words) for every row of docs(doc_id, text, source)."""
    source = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", source.alias("skey"), size.alias("size"), _mark(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("h"))
    number = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    rows = materialise(rows.withColumn("b1", F.floor(number / (2**32 // BLOCKS))).withColumn("b2", F.pmod(F.floor(number / 2**8), F.lit(SUB_BLOCKS))), "sizes")
    blocks = rows.groupBy("skey", "b1").agg(F.sum("size").alias("words"))
    goal = targets(blocks.groupBy("skey").agg(F.sum("words").alias("source_size")))
    whole = F.floor((F.col("target") + 0.5) / F.greatest("source_size", F.lit(1)))
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, whole).otherwise(0)).withColumn("quota", F.floor(F.col("target") + 0.5) - F.col("copies") * F.col("source_size"))
    blocks = materialise(_drawn(blocks.join(goal, "skey"), ["skey"], [_mark("skey", "b1"), "b1"], "words", "quota").drop("quota"), "blocks")
    # one row per block and copy of it that is drawn, numbered within its source in an order by hash
    copy = F.sequence(F.lit(0), F.col("copies") + F.when(F.col("part") == "none", -1).otherwise(0))
    units = blocks.where("copies > 0 or part <> 'none'").select("skey", "b1", F.explode(copy).alias("copy"))
    units = units.withColumn("ticket", F.row_number().over(Window.partitionBy("skey").orderBy(_mark("skey", "b1", "copy"), "b1", "copy")).cast("long"))
    units = materialise(units, "units")
    units = units.join(shard_counts(units.select("skey", F.col("ticket").alias("k"))), ["skey", "ticket"])
    drawn = blocks.join(units.groupBy("skey", "b1").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("draws")), ["skey", "b1"], "left").drop("words")
    rows = rows.join(drawn, ["skey", "b1"])
    # the one block of a source that is drawn in part: by sub-blocks, then by documents
    cut = rows.where("part = 'some'")
    subs = _drawn(cut.groupBy("skey", "b1", "b2").agg(F.sum("size").alias("words"), F.first("left").alias("quota")), ["skey", "b1"], [_mark("skey", "b1", "b2"), "b2"], "words", "quota")
    cut = cut.drop("left", "part").join(subs.select("skey", "b1", "b2", "part", "left"), ["skey", "b1", "b2"])
    # documents of size 0 at the quota's edge draw nothing either way
    last = _drawn(cut.where("part = 'some'").withColumnRenamed("left", "quota"), ["skey", "b1", "b2"], ["h", "doc_id", "size"], "size", "quota")
    last = last.withColumn("extra", F.when(F.col("part") == "all", F.col("size")).when(F.col("part") == "some", F.col("left")).otherwise(0))
    one = lambda df, extra: df.select("doc_id", "size", "source_size", "target", "copies", F.coalesce("draws", F.array().cast("array<struct<copy:bigint,shard:int>>")).alias("draws"), extra.cast("long").alias("extra"))
    every = F.when(F.col("part") == "all", F.col("size")).otherwise(0)
    out = one(rows.where("part <> 'some'"), every).unionByName(one(cut.where("part <> 'some'"), every)).unionByName(one(last, F.col("extra")))
    draws = F.transform("draws", lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.when(d["copy"] < F.col("copies"), F.col("size")).otherwise(F.col("extra")).alias("words")))
    out = out.withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def shards(mixed: DataFrame) -> DataFrame:
    """A row for each draw of mix(): shard, place (the order within the shard), doc_id, copy, words."""
    d = mixed.select("doc_id", F.explode("draws").alias("d")).select("d.shard", "doc_id", "d.copy", "d.words")
    return d.withColumn("place", _mark(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy"))


def draws_text(draws: Column) -> Column:
    """copy:shard:words of each draw, comma-joined."""
    return F.array_join(F.transform(draws, lambda d: F.concat_ws(":", *(d[k].cast("string") for k in ("copy", "shard", "words")))), ",")


def mixing_sql(documents: str) -> str:
    """The same rows, with draws as draws_text(), in DuckDB SQL over a relation with doc_id, text and source. Ranks are over all
    sources and tickets at once here."""
    levels = SHARDS.bit_length() - 1
    right = "pos >= (n + 1) // 2"
    tree = "".join(
        f",\nt{j + 1} AS (SELECT skey, CASE WHEN {right} THEN pos - (n + 1) // 2 ELSE pos END AS pos, CASE WHEN {right} THEN n // 2 ELSE (n + 1) // 2 END AS n, shard * 2 + CAST({right} AS INTEGER) AS shard FROM t{j})"
        for j in range(levels)
    )
    return rf"""
WITH r AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM {documents}
), rows AS MATERIALIZED (
  SELECT *, CAST(('0x' || h[1:8]) AS BIGINT) // {2**32 // BLOCKS} AS b1, (CAST(('0x' || h[1:8]) AS BIGINT) // 256) % {SUB_BLOCKS} AS b2 FROM r
), tot AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY 1),
w AS (
  SELECT *, source_size * {CAP} AS cap,
    CAST([{', '.join(map(str, CYCLE))}][(row_number() OVER (ORDER BY skey = 'n', skey) - 1) % {len(CYCLE)} + 1] AS DOUBLE) AS w FROM tot
), l AS (
  SELECT *, row_number() OVER o AS n, CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} - coalesce(CAST(sum(cap) OVER p AS DOUBLE), 0) AS free,
    sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS rest
  FROM w WINDOW o AS (ORDER BY cap / w, skey), p AS (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (SELECT *, min(CASE WHEN free / rest <= cap / w THEN n END) OVER () AS open_n FROM l),
t AS (
  SELECT skey, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT any_value(x.free / x.rest) FROM g x WHERE x.n = x.open_n) * w, CAST(cap AS DOUBLE))) AS target FROM g
), goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor((target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS copies FROM t
), q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - copies * source_size AS quota FROM goal),
b AS (SELECT skey, b1, CAST(sum(size) AS BIGINT) AS words FROM rows GROUP BY 1, 2),
bd AS (
  SELECT skey, b1, words, q.*  EXCLUDE (skey), CAST(sum(words) OVER (PARTITION BY skey ORDER BY md5(skey || ':' || b1), b1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM b JOIN q USING (skey)
), bp AS (SELECT *, CASE WHEN e <= quota THEN 'all' WHEN quota - e + words > 0 THEN 'some' ELSE 'none' END AS part, quota - e + words AS lft FROM bd),
rb AS (SELECT rows.*, bp.source_size, bp.target, bp.copies, bp.part, bp.lft FROM rows JOIN bp USING (skey, b1)),
s AS (SELECT skey, b1, b2, CAST(sum(size) AS BIGINT) AS words, any_value(lft) AS quota FROM rb WHERE part = 'some' GROUP BY 1, 2, 3),
sd AS (SELECT *, CAST(sum(words) OVER (PARTITION BY skey, b1 ORDER BY md5(skey || ':' || b1 || ':' || b2), b2 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM s),
sp AS (SELECT skey, b1, b2, CASE WHEN e <= quota THEN 'all' WHEN quota - e + words > 0 THEN 'some' ELSE 'none' END AS part2, quota - e + words AS lft2 FROM sd),
rs AS (SELECT rb.*, sp.part2, sp.lft2 FROM rb LEFT JOIN sp USING (skey, b1, b2)),
d AS (SELECT *, CAST(sum(size) OVER (PARTITION BY skey, b1, b2, part = 'some' AND part2 = 'some' ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM rs),
x AS (
  SELECT *, CAST(CASE WHEN part = 'all' THEN size WHEN part = 'none' THEN 0 WHEN part2 = 'all' THEN size WHEN part2 = 'none' THEN 0
    WHEN e <= lft2 THEN size ELSE greatest(lft2 - e + size, 0) END AS BIGINT) AS extra FROM d
), un AS (
  SELECT skey, b1, copy, row_number() OVER (PARTITION BY skey ORDER BY md5(skey || ':' || b1 || ':' || copy), b1, copy) AS k
  FROM (SELECT skey, b1, unnest(range(copies + CASE WHEN part = 'none' THEN 0 ELSE 1 END)) AS copy FROM bp)
), t0 AS (SELECT skey, row_number() OVER (ORDER BY md5(skey || ':' || k || ':ticket'), skey, k) - 1 AS pos, count(*) OVER () AS n, 0 AS shard FROM un){tree},
pl AS (SELECT skey, shard, row_number() OVER (PARTITION BY skey ORDER BY shard) AS k FROM t{levels}),
us AS (SELECT un.skey, un.b1, un.copy, pl.shard FROM un JOIN pl USING (skey, k)),
dr AS (SELECT skey, b1, list({{'copy': copy, 'shard': shard}} ORDER BY copy) AS draws FROM us GROUP BY 1, 2)
SELECT doc_id, size, source_size, target, CAST(copies * size + extra AS BIGINT) AS taken,
  coalesce(array_to_string([y.copy || ':' || y.shard || ':' || CASE WHEN y.copy < copies THEN size ELSE extra END FOR y IN draws IF (CASE WHEN y.copy < copies THEN size ELSE extra END) > 0], ','), '') AS draws
FROM x LEFT JOIN dr USING (skey, b1)"""
