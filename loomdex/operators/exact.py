"""Exact routing: qualified names, then symbols, then paths; disambiguation; anchors; dispatch to ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexing import atom_kind, query_terms, strip_punctuation, tokens

# Order of the atom kinds, precedence of definition kinds for one anchor.
ATOM_ORDER = {"qualified": 1, "symbol": 2, "path": 3}
TYPE_KINDS = ["struct", "enum", "union", "trait", "class", "interface", "record", "type-alias"]
CONTENT_FIELDS = ["signature", "body", "documentation"]


def parse_question(text: str) -> dict:
    """A question on the driver: its trimmed text and words. Blank is an error."""
    text = text.strip()
    if not text:
        raise ValueError("the question is empty")
    return {"raw": text, "words": [w for w in (strip_punctuation(x) for x in text.split()) if w]}


def atoms(questions: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """query_id, pos, atom, kind for questions (query_id, words)."""
    each = questions.select("query_id", F.posexplode("words").alias("pos", "atom"), (F.size("words") == 1).alias("lone"))
    if paths is None:
        each = each.withColumn("known", F.lit(False))
    else:
        each = each.join(paths.select(F.col("path").alias("atom"), F.lit(True).alias("known")).distinct(), "atom", "left").na.fill(False, ["known"])
    return each.withColumn("kind", atom_kind(F.col("atom"), F.col("lone"), F.col("known"))).where("kind is not null").select("query_id", "pos", "atom", "kind")


def route(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """query_id, atom, kind, symbol_id of the atom that decides each question.

    found: atoms(). Qualified atoms go first, then symbols, then paths; within a kind the first that something matches.
    symbols: symbol_id, name, qualified, path. A path match is of the file: symbol_id is null.
    """
    q = found.where("kind = 'qualified'").join(symbols.select(F.col("qualified").alias("atom"), "symbol_id", "path"), "atom")
    s = found.where("kind = 'symbol'").join(symbols.select(F.col("name").alias("atom"), "symbol_id", "path"), "atom")
    p = found.where("kind = 'path'").join(symbols.select(F.col("path").alias("atom")).distinct(), "atom").withColumn("symbol_id", F.lit(None).cast("long")).withColumn("path", F.col("atom"))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in ATOM_ORDER.items() for x in kv]), F.col("kind"))
    cols = ["query_id", "pos", "atom", "kind", "symbol_id", "path"]
    every = q.select(*cols).union(s.select(*cols)).union(p.select(*cols)).withColumn("__o", order)
    return every.withColumn("__r", F.rank().over(Window.partitionBy("query_id").orderBy("__o", "pos"))).where("__r = 1").select(*cols)


def with_path(routed: DataFrame, qualifier: str | None) -> DataFrame:
    """Only what is in the file that the caller names."""
    return routed if qualifier is None else routed.where(F.col("path") == qualifier)


def outcome(routed: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, outcome (direct, ambiguous, miss), matches."""
    n = routed.groupBy("query_id").agg(F.count("*").alias("matches"))
    out = queries.select("query_id").distinct().join(n, "query_id", "left").na.fill(0, ["matches"])
    return out.select("query_id", F.when(F.col("matches") == 0, "miss").when(F.col("matches") == 1, "direct").otherwise("ambiguous").alias("outcome"), "matches")


def kind_precedence(kind):
    return F.when(kind.isin(*TYPE_KINDS), 2).when(kind == "constructor", 0).otherwise(1)


def overlaps(routed: DataFrame, questions: DataFrame, symbols: DataFrame, carries: DataFrame) -> DataFrame:
    """query_id, symbol_id, overlap of the candidates of ambiguous questions.

    overlap = 3 * (other terms of the question in the qualified name or path) + (terms that the file carries in signature,
    body or documentation, and not there). carries: path, term.
    """
    terms = questions.select("query_id", query_terms("text").alias("terms"))
    cands = routed.where("symbol_id is not null").join(terms, "query_id").withColumn("left", F.array_except("terms", query_terms("atom")))
    cands = cands.join(symbols.select("symbol_id", "qualified"), "symbol_id")
    near = F.array_union(tokens("qualified"), tokens("path"))
    cands = cands.select("query_id", "symbol_id", "path", F.size(F.array_intersect("left", near)).alias("named"), F.array_except("left", near).alias("rest"))
    said = cands.select("query_id", "symbol_id", "path", F.explode("rest").alias("term")).join(carries.select("path", "term").distinct(), ["path", "term"], "left_semi")
    said = said.groupBy("query_id", "symbol_id").agg(F.count("*").alias("carried"))
    out = cands.join(said, ["query_id", "symbol_id"], "left").na.fill(0, ["carried"])
    return out.select("query_id", "symbol_id", (F.col("named") * len(CONTENT_FIELDS) + F.col("carried")).cast("long").alias("overlap"))


def disambiguate(scored: DataFrame, symbols: DataFrame, shown: int = 3) -> DataFrame:
    """query_id, symbol_id, overlap, rank, direct: the best shown candidates, one for each anchor.

    Of candidates with one anchor (path, name) the higher overlap stays, then the higher kind precedence, then the first.
    The leader is direct if its overlap is above zero and beats the second's.
    """
    rows = scored.join(symbols.select("symbol_id", "path", "name", "qualified", "kind", "start_line"), "symbol_id")
    same = Window.partitionBy("query_id", "path", "name").orderBy(F.desc("overlap"), F.desc(kind_precedence(F.col("kind"))), "symbol_id")
    rows = rows.withColumn("__r", F.row_number().over(same)).where("__r = 1").drop("__r")
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "qualified", "path", "start_line", "symbol_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("overlap").over(order)).where(F.col("rank") <= shown)
    direct = (F.col("rank") == 1) & (F.col("overlap") > 0) & (F.col("next").isNull() | (F.col("overlap") > F.col("next")))
    return rows.select("query_id", "symbol_id", "path", "name", "overlap", "rank", direct.alias("direct"))


def unique_anchors(symbols: DataFrame) -> DataFrame:
    """path, name, symbol_id of the anchors that exactly one symbol has."""
    return symbols.groupBy("path", "name").agg(F.count("*").alias("__n"), F.min("symbol_id").alias("symbol_id")).where("__n = 1").drop("__n")


def dispatch(exact: DataFrame, path_given: bool) -> DataFrame:
    """query_id, how: exact, lexical for a miss, none for a miss below a path."""
    return exact.select("query_id", F.when(F.col("outcome") != "miss", "exact").otherwise("none" if path_given else "lexical").alias("how"))
