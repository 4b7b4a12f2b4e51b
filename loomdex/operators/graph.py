"""Change impact over a directed graph: edges, closure, cycles, test evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut

MOST_DEPTH, DEPTH = 8, 2
# Kinds in the order that decides between edges at one distance.
EDGE_KINDS = ["call", "reference", "import"]


def edge_kind(reference_kind):
    return F.when(reference_kind.isin("call", "macro"), "call").when(reference_kind == "import", "import").otherwise("reference")


def edges_of(references: DataFrame, endpoint: str) -> DataFrame:
    """source, target, kind, line, endpoint from resolved rows (path, owner, target, kind, line); a row without owner comes from its file's node."""
    source = F.concat_ws("#", "path", F.coalesce("owner", F.lit("")))
    return references.where("target is not null").select(source.alias("source"), "target", edge_kind(F.col("kind")).alias("kind"), "line", F.lit(endpoint).alias("endpoint")).distinct()


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for (source, target, kind): endpoint both if base and target have it; line from target if it has it, the lowest of its lines."""
    of = lambda e: F.min(F.when(F.col("endpoint") == e, F.col("line")))
    m = edges.groupBy("source", "target", "kind").agg(of("base").alias("b"), of("target").alias("t"))
    end = F.when(F.col("b").isNotNull() & F.col("t").isNotNull(), "both").when(F.col("t").isNotNull(), "target").otherwise("base")
    return m.select("source", "target", "kind", F.coalesce("t", "b").alias("line"), end.alias("endpoint"))


def incident(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that start or end at a seed (node)."""
    s = edges.join(seeds.select(F.col("node").alias("source")), "source", "left_semi")
    t = edges.join(seeds.select(F.col("node").alias("target")), "target", "left_semi")
    return s.select("source", "target", "kind").union(t.select("source", "target", "kind")).distinct()


def closure(edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, reverse: bool = True) -> DataFrame:
    """node, distance, via: what reaches the seeds (reverse) or what they reach, within depth steps.

    via is the first kind by EDGE_KINDS among the edges that arrive at the smallest distance. A seed that an edge arrives at
    is listed at distance 0, with via from its first arrival; one that nothing arrives at isn't listed.
    """
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth is 0 to {MOST_DEPTH}")
    order = F.array_position(F.array(*map(F.lit, EDGE_KINDS)), F.col("kind")).cast("int")
    steps = edges.select(F.col("target" if reverse else "source").alias("at"), F.col("source" if reverse else "target").alias("to"), order.alias("k")).distinct()
    front = seeds.select(F.col("node").alias("at")).distinct()
    seen = front.withColumn("arrived", F.lit(False)).withColumn("distance", F.lit(0).cast("long")).withColumn("k", F.lit(None).cast("int"))
    for d in range(1, depth + 1):
        came = front.join(steps, "at").groupBy("to").agg(F.min("k").alias("nk"))
        both = seen.join(came.withColumnRenamed("to", "at"), "at", "full")
        fresh = F.col("distance").isNull()
        seen = cut(both.select("at", (F.coalesce("arrived", F.lit(False)) | F.col("nk").isNotNull()).alias("arrived"), F.coalesce("distance", F.lit(d)).alias("distance"), F.coalesce(F.col("k"), F.col("nk")).alias("k"), fresh.alias("fresh")))
        front = seen.where("fresh").select("at")
        seen = seen.drop("fresh")
        if front.isEmpty():
            break
    return seen.where("arrived").select(F.col("at").alias("node"), "distance", F.element_at(F.array(*map(F.lit, EDGE_KINDS)), F.col("k")).alias("via"))


def cycles(edges: DataFrame, nodes: DataFrame | None = None, most: int = 200) -> DataFrame:
    """node, cycle: strongly connected components of the subgraph that nodes induce, named by their smallest node; single nodes only with a self-loop.

    Colours spread forward (smallest reachable-from), then backward inside a colour; what a root reaches back is its
    component and leaves; the rest goes on. RuntimeError if most rounds don't settle it.
    """
    e = edges.select("source", "target").distinct()
    if nodes is not None:
        n = nodes.select("node").distinct()
        e = e.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")
    loops = e.where("source = target").select(F.col("source").alias("node"))
    left = cut(e.where("source <> target"))
    out = None
    for k in range(most + 1):
        if k == most and not left.isEmpty():
            raise RuntimeError(f"cycles are not settled after {most} rounds")
        # nodes without an edge in or without one out are in no cycle
        while True:
            kept = cut(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            done = kept.count() == left.count()
            left = kept
            if done:
                break
        if left.isEmpty():
            break
        colour = cut(left.select(F.col("source").alias("node")).union(left.select("target")).distinct().withColumn("c", F.col("node")))
        while True:
            came = left.join(colour.withColumnRenamed("node", "source"), "source").groupBy("target").agg(F.min("c").alias("n"))
            new = cut(colour.join(came.withColumnRenamed("target", "node"), "node", "left").select("node", F.col("c").alias("was"), F.least("c", F.coalesce("n", "c")).alias("c")))
            colour = new.select("node", "c")
            if new.where("was <> c").isEmpty():
                break
        inside = left.join(colour.withColumnRenamed("node", "source").withColumnRenamed("c", "cs"), "source").join(colour.withColumnRenamed("node", "target").withColumnRenamed("c", "ct"), "target").where("cs = ct").select("source", "target")
        inside = cut(inside)
        back = cut(colour.where("node = c"))
        while True:
            more = inside.join(back.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("node"), "c").distinct().join(back, ["node", "c"], "left_anti")
            more = cut(more)
            if more.isEmpty():
                break
            back = cut(back.union(more.select("node", "c")))
        out = back if out is None else cut(out.union(back))
        gone = back.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))
    single = loops.withColumn("c", F.col("node"))
    if out is None:
        return single.select("node", F.col("c").alias("cycle")).distinct()
    big = out.groupBy("c").count().where("count > 1").select("c")
    members = out.join(big, "c", "left_semi").select("node", "c")
    return members.union(single.join(members.select("node"), "node", "left_anti").select("node", "c")).distinct().select("node", F.col("c").alias("cycle"))


# Why a test file counts, and how sure that is.
REASONS = {"resolved-reference": "exact", "affected-test": "exact", "lexical-name": "probable", "co-change": "probable"}


def test_evidence(frames: dict[str, DataFrame]) -> DataFrame:
    """path, confidence (exact before probable), reasons (sorted) from a frame of paths for each reason."""
    every = None
    for reason, df in frames.items():
        row = df.select("path", F.lit(REASONS[reason]).alias("confidence"), F.lit(reason).alias("reason"))
        every = row if every is None else every.union(row)
    return every.groupBy("path").agg(F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def observations(rows: DataFrame) -> DataFrame:
    """path, resolved, and unresolved and ambiguous calls, references and imports: counts of the target side where a path has
    one, else of the base side. rows: path, endpoint, kind (of reference, or import), resolution."""
    kind = edge_kind(F.col("kind"))
    of = lambda r, k: F.count_if((F.col("resolution") == r) & (kind == k)).alias(f"{r}_{k}s")
    cols = [of(r, k) for r in ("unresolved", "ambiguous") for k in EDGE_KINDS]
    side = rows.groupBy("path", "endpoint").agg(F.count_if(F.col("resolution") == "resolved").alias("resolved"), *cols)
    names = [c for c in side.columns if c not in ("path", "endpoint")]
    return side.groupBy("path").agg(F.max_by(F.struct(*names), "endpoint").alias("m")).select("path", *[f"m.{c}" for c in names])


def sections(rows: DataFrame, section: str, order: list, limit: int) -> DataFrame:
    """The first rows of each section, with shown and total."""
    from pyspark.sql import Window

    w = Window.partitionBy(section)
    out = rows.withColumn("total", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= limit)
    return out.withColumn("shown", F.least("total", F.lit(limit)))
