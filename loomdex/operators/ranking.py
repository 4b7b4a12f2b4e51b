"""Lexical ranking: bounded candidate union, per-field BM25 in millionths, anchors, decision. One or many questions at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexing import quotient
from ..sources.lineage import cut

# Boost and length normalisation of each field.
BOOST = {"name": 8.0, "qualified": 5.0, "path": 5.0, "signature": 4.0, "body": 1.5, "documentation": 2.0, "attribute": 1.0, "callee": 3.0, "caller": 3.0, "import": 2.0}
B = {"name": 0.0, "qualified": 0.3, "path": 0.3, "signature": 0.75, "body": 0.75, "documentation": 0.75, "attribute": 0.5, "callee": 0.5, "caller": 0.5, "import": 0.5}


@dataclass(frozen=True)
class Profile:
    """Parameters of a ranking. Thresholds are fitted on a corpus: refit them (quality.fit_thresholds) for another."""

    version: int = 1
    k1: float = 1.2
    retained: int = 64
    shown: int = 3
    none_below: int = 20_770_970
    direct_score: int = 30_723_125
    direct_margin_ppm: int = 181_211
    boost: dict = field(default_factory=lambda: dict(BOOST))
    b: dict = field(default_factory=lambda: dict(B))

    def __post_init__(self):
        if self.k1 <= 0 or self.retained < 1 or self.shown < 1 or set(self.boost) != set(self.b) or any(not 0 <= x <= 1 for x in self.b.values()) or any(x <= 0 for x in self.boost.values()):
            raise ValueError("invalid ranking profile")

    def stamp(self) -> str:
        """What an index is marked with; another stamp means that its thresholds don't hold."""
        import hashlib

        return hashlib.sha256(repr((self.version, self.k1, self.retained, sorted(self.boost.items()), sorted(self.b.items()))).encode()).hexdigest()

    def accepts(self, stamp: str) -> None:
        if stamp != self.stamp():
            raise ValueError("the index was ranked under another profile")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def streams(post: DataFrame, terms: DataFrame) -> DataFrame:
    """field, term, symbol_id, tf, df of the terms that some question (query_id, term) has: one list for each field and term.

    The postings are first cut to the terms asked for; df is counted there, which is all of a term's list.
    """
    asked = post.join(terms.select("term").distinct(), "term", "left_semi")
    return asked.join(asked.groupBy("field", "term").agg(F.count("*").alias("df")), ["field", "term"])


def candidates(opened: DataFrame, terms: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """query_id, symbol_id, rarest_df, matched_terms, place: the retained union; rows up to one past the bound, whose place tells.

    Rank goes by the rarest list first, so a question's shortest list beyond the bound ends what can matter: its symbols
    alone fill the bound, and no symbol of longer lists only comes before them. Questions multiply the lists up to that one;
    of common terms just the entries of those symbols are counted. opened is best written once (lineage.cut).
    """
    asked = terms.select("query_id", "term").distinct()
    lists = asked.join(opened.select("field", "term", "df").distinct(), "term")
    bound = lists.groupBy("query_id").agg(F.min(F.when(F.col("df") > profile.retained, F.col("df"))).alias("bound"))
    short = lists.join(bound, "query_id").where("bound is null or df <= bound").select("query_id", "field", "term")
    rare = short.join(opened.select("field", "term", "symbol_id", "df"), ["field", "term"]).groupBy("query_id", "symbol_id").agg(F.min("df").alias("rarest_df"))
    matched = rare.join(asked, "query_id").join(opened.select("term", "symbol_id").distinct(), ["term", "symbol_id"])
    union = matched.groupBy("query_id", "symbol_id").agg(F.first("rarest_df").alias("rarest_df"), F.count("*").alias("matched_terms"))
    order = Window.partitionBy("query_id").orderBy("rarest_df", F.desc("matched_terms"), "symbol_id")
    return union.withColumn("place", F.row_number().over(order)).where(F.col("place") <= profile.retained + 1)


def cap_cut_a_tie(cands: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """query_id, cut: whether the first candidate left out ranks like the last one kept."""
    edge = cands.where(F.col("place") >= profile.retained)
    return edge.groupBy("query_id").agg(((F.count("*") == 2) & (F.min(F.struct("rarest_df", "matched_terms")) == F.max(F.struct("rarest_df", "matched_terms")))).alias("cut"))


def _per_field(values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("field"))


def scores(opened: DataFrame, terms: DataFrame, cands: DataFrame, lengths: DataFrame, stats: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """query_id, symbol_id, score (millionths, half up) of the retained candidates only.

    The retained candidates meet the lists by symbol and term, so the whole union is never built with its frequencies.
    Contributions are added in one order (term, then field) so that the sum doesn't depend on the partitioning.
    """
    kept = cands.where(F.col("place") <= profile.retained).select("query_id", "symbol_id").join(terms.select("query_id", "term"), "query_id")
    stats = stats.select("field", F.col("document_count").cast("double").alias("document_count"), (F.col("total_term_frequency") / F.col("document_count")).alias("avg"))
    rows = kept.join(opened, ["symbol_id", "term"]).join(lengths, ["field", "symbol_id"]).join(stats, "field")
    b = _per_field(profile.b)
    norm = F.when((b == 0) | (F.col("avg") <= 0), F.lit(profile.k1)).otherwise(profile.k1 * (1 - b + b * F.col("len") / F.col("avg")))
    part = _per_field(profile.boost) * idf(F.col("document_count"), F.col("df")) * F.col("tf") * (profile.k1 + 1) / (F.col("tf") + norm)
    summed = rows.groupBy("query_id", "symbol_id").agg(F.array_sort(F.collect_list(F.struct("term", "field", part.alias("x")))).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["x"])
    return summed.select("query_id", "symbol_id", F.floor(total * 1_000_000 + 0.5).cast("long").alias("score"))


def collapse(scored: DataFrame, anchors: DataFrame) -> DataFrame:
    """The best symbol of each anchor (path, name). anchors: symbol_id, path, name."""
    order = Window.partitionBy("query_id", "path", "name").orderBy(F.desc("score"), "symbol_id")
    return scored.join(anchors, "symbol_id").withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def ranked(collapsed: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """The first anchors of each question with rank, and margin_ppm of each over the next."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "symbol_id")
    second = F.coalesce(F.lead("score").over(order), F.lit(0))
    top = collapsed.withColumn("rank", F.row_number().over(order)).withColumn("second", second).where(F.col("rank") <= profile.shown)
    margin = F.when(F.col("score") > 0, quotient((F.col("score") - F.col("second")).cast("decimal(38,0)") * 1_000_000, F.col("score"))).otherwise(0)
    return top.withColumn("margin_ppm", margin).drop("second")


def decide(top: DataFrame, queries: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """query_id, decision (direct, candidates, none), reason, score, margin_ppm, confidence, answers (symbol ids in order).

    A question without a candidate isn't found; one whose best score is low is none too.
    """
    best = top.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rank") == 1, F.col("margin_ppm"))).alias("margin_ppm"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol_id"))), lambda x: x["symbol_id"]).alias("ids"))
    out = queries.select("query_id").distinct().join(best, "query_id", "left")
    direct = (F.col("score") >= profile.direct_score) & (F.col("margin_ppm") >= profile.direct_margin_ppm)
    decision = F.when(F.col("score").isNull() | (F.col("score") < profile.none_below), "none").when(direct, "direct").otherwise("candidates")
    out = out.withColumn("decision", decision)
    reason = F.when(F.col("score").isNull(), "not-found").when(F.col("decision") == "none", "low-confidence")
    empty = F.array().cast("array<bigint>")
    answers = F.when(F.col("decision") == "none", empty).when(F.col("decision") == "direct", F.slice("ids", 1, 1)).otherwise(F.col("ids"))
    return out.select("query_id", "decision", reason.alias("reason"), "score", "margin_ppm", F.when(F.col("decision") == "direct", (F.col("margin_ppm") / 1_000_000).cast("float")).alias("confidence"), answers.alias("answers"))


def evidence(opened: DataFrame, terms: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """query_id, postings, union_size, terms, scored, dropped: what a ranking touched."""
    per = opened.groupBy("term", "symbol_id").agg(F.count("*").alias("fields")).join(terms.select("query_id", "term"), "term")
    e = per.groupBy("query_id", "symbol_id").agg(F.sum("fields").alias("postings")).groupBy("query_id").agg(F.sum("postings").alias("postings"), F.count("*").alias("union_size"))
    e = e.join(terms.groupBy("query_id").agg(F.count("*").alias("terms")), "query_id")
    return e.withColumn("scored", F.least("union_size", F.lit(profile.retained)).cast("long")).withColumn("dropped", F.col("union_size") - F.col("scored"))


def rank(post: DataFrame, lengths: DataFrame, stats: DataFrame, anchors: DataFrame, terms: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """The shown anchors of each question: query_id, symbol_id, path, name, score, rank, margin_ppm."""
    opened = cut(streams(post, terms))
    return ranked(collapse(scores(opened, terms, candidates(opened, terms, profile), lengths, stats, profile), anchors), profile)
