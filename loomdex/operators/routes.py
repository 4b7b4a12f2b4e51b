"""Learned answers: lookup, learning, eviction, retirement, text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOUND = 1024
COLUMNS = ["key", "anchor", "map", "api_identity", "confidence"]
SCHEMA = "key string, anchor string, map string, api_identity string, confidence float"


def lookup(routes: DataFrame, questions: DataFrame, anchors: DataFrame, identities: DataFrame) -> DataFrame:
    """query_id, anchor, confidence of learned answers that still hold: the anchor is unique and its map's identity unchanged.

    questions: query_id, key. anchors: anchor, once for each symbol that has it. identities: map, api_identity.
    """
    one = anchors.groupBy("anchor").agg(F.count("*").alias("__n")).where("__n = 1").select("anchor")
    return questions.join(routes, "key").join(one, "anchor", "left_semi").join(identities, ["map", "api_identity"], "left_semi").select("query_id", "anchor", "confidence")


def learn(answers: DataFrame) -> DataFrame:
    """Routes of direct symbol answers with a confidence, given without a path. answers: key, anchor, map, api_identity, confidence, decision, is_symbol, path_given."""
    return answers.where("decision = 'direct' and is_symbol and confidence is not null and not path_given and key <> ''").select(*COLUMNS)


def upsert(routes: DataFrame, learned: DataFrame, order: str = "seq") -> DataFrame:
    """The last answer of each key; learned rows carry an order column and win over routes."""
    every = routes.select(*COLUMNS, F.lit(None).cast("long").alias(order)).unionByName(learned.select(*COLUMNS, F.col(order).cast("long").alias(order)))
    last = Window.partitionBy("key").orderBy(F.desc_nulls_last(order), "anchor")
    return every.withColumn("__r", F.row_number().over(last)).where("__r = 1").select(*COLUMNS)


def evict(routes: DataFrame, bound: int = BOUND) -> DataFrame:
    """The bound routes of highest confidence, of equal ones the smallest keys."""
    return routes.orderBy(F.desc("confidence"), "key").limit(bound)


def reconcile(routes: DataFrame, anchors: DataFrame, identities: DataFrame) -> DataFrame:
    """Routes whose anchor exists and whose map has the same identity."""
    return routes.join(anchors.select("anchor").distinct(), "anchor", "left_semi").join(identities, ["map", "api_identity"], "left_semi").select(*COLUMNS)


def render(routes: DataFrame) -> str:
    """The table as text with front matter, by key; at most BOUND rows."""
    rows = evict(routes).orderBy("key").collect()
    for r in rows:
        if any("\t" in str(r[c]) or "\n" in str(r[c]) for c in COLUMNS):
            raise ValueError("a field holds a tab or a line feed")
    return "---\nformat: 2\n---\n" + "\t".join(COLUMNS) + "\n" + "".join("\t".join([*(str(r[c]) for c in COLUMNS[:-1]), f"{r.confidence:.6f}"]) + "\n" for r in rows)


def parse(text: str) -> list[tuple]:
    """Rows of render(); ValueError on a wrong head, field count, order, repeated key or confidence. All or nothing."""
    head = "---\nformat: 2\n---\n" + "\t".join(COLUMNS) + "\n"
    if not text.startswith(head) or text[len(head) :] and not text.endswith("\n"):
        raise ValueError("wrong head or end")
    rows: list[tuple] = []
    for line in text[len(head) :].split("\n")[:-1]:
        f = line.split("\t")
        if len(f) != len(COLUMNS):
            raise ValueError(f"{len(f)} fields")
        if not 0 <= (c := float(f[-1])) <= 1:
            raise ValueError("confidence out of range")
        if rows and f[0] <= rows[-1][0]:
            raise ValueError("keys out of order or repeated")
        rows.append((*f[:-1], c))
    return rows
