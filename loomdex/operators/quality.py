"""Routing quality: verdicts, metrics, gates, shards, threshold fitting."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import at_least, exceeds, ratio_ppm

# Bounds of the performance and recall gates, answerable cases of the oracle, cases that top-1 may lose.
POINT, INTERVAL, TOP3_OF_40 = (11, 10), (21, 20), (36, 40)
ORACLE, TOP1_SLACK = 40, 1


def hit_at(rank: int) -> Column:
    """The accepted answer is within rank, and no forbidden one comes before it."""
    a, f = F.col("accepted_rank"), F.col("forbidden_rank")
    return F.coalesce(a <= rank, F.lit(False)) & (f.isNull() | F.coalesce(f > a, F.lit(False)))


def false_direct() -> Column:
    """A direct answer that was forbidden, on a case to abstain on, or not the accepted one."""
    return F.col("answered_direct") & (~F.col("direct_permitted") | (F.col("expectation") == "must-abstain") | ~hit_at(1))


def routing_metrics(verdicts: DataFrame) -> DataFrame:
    """One row of counts and ppm. verdicts: expectation (answerable, must-abstain), direct_permitted, answered_direct, accepted_rank, forbidden_rank."""
    answerable, must = F.col("expectation") == "answerable", F.col("expectation") == "must-abstain"
    c = verdicts.agg(
        F.count_if(answerable).alias("answerable"), F.count_if(must).alias("must_abstain"), F.count("*").alias("cases"),
        F.count_if(answerable & hit_at(1)).alias("top1"), F.count_if(answerable & hit_at(3)).alias("top3"),
        F.count_if("answered_direct").alias("directs"), F.count_if(false_direct()).alias("false_directs"),
        F.count_if(~F.col("answered_direct")).alias("abstained"), F.count_if(must & ~F.col("answered_direct")).alias("kept_back"),
    )
    ppm = lambda a, b, name: ratio_ppm(F.col(a), F.col(b)).alias(name)
    return c.select("*", ppm("top1", "answerable", "top1_ppm"), ppm("top3", "answerable", "top3_ppm"), ratio_ppm(F.col("directs") - F.col("false_directs"), F.col("directs")).alias("direct_precision_ppm"), ppm("abstained", "cases", "abstention_ppm"), ppm("kept_back", "must_abstain", "required_abstention_ppm"))


def release_gate(metrics: DataFrame, safety: DataFrame, performance: DataFrame, top1_baseline: int | None = None, oracle: int = ORACLE) -> DataFrame:
    """failure: a row for each kind of thing that stops a release; evidence that wasn't measured does too.

    metrics: the row of routing_metrics(). safety: passed, a row a case. performance: blocked, a row a case (performance_gate()).
    """
    fails = {
        "oracle-under-sized": F.col("answerable") != oracle,
        "top3-below-gate": ~at_least(F.col("top3"), F.col("answerable"), *TOP3_OF_40),
        "false-direct": F.col("false_directs") > 0,
        "direct-precision-below-one": F.col("directs") - F.col("false_directs") != F.col("directs"),
        "required-abstention-below-one": F.col("kept_back") != F.col("must_abstain"),
    }
    if top1_baseline is not None:
        fails["top1-regressed-beyond-slack"] = F.col("top1") + TOP1_SLACK < top1_baseline
    out = metrics.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fails.items()]))).alias("failure"))
    missing = lambda df: df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("evidence-missing").alias("failure"))
    failed = lambda df, bad, name: df.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("n")).where("n > 0").select(F.lit(name).alias("failure"))
    out = out.union(failed(safety, ~F.col("passed"), "safety-case-failed")).union(failed(performance, F.col("blocked"), "performance-regression"))
    return out.union(missing(metrics)).union(missing(safety)).union(missing(performance)).distinct()


def performance_gate(cases: DataFrame) -> DataFrame:
    """case_id, blocked: both the ratio and the lower bound of its interval are over. cases: case_id, time, baseline, low, low_base (integers)."""
    return cases.select("case_id", (exceeds(F.col("time"), F.col("baseline"), *POINT) & exceeds(F.col("low"), F.col("low_base"), *INTERVAL)).alias("blocked"))


def shard_of(case_id: Column | str, shards: int = 4) -> Column:
    """SHA-256 of the id modulo a power of two."""
    return F.pmod(F.conv(F.substring(F.sha2(case_id, 256), 57, 8), 16, 10).cast("long"), F.lit(shards))


def aggregate_shards(expected: DataFrame, reported: DataFrame, shards: int = 4) -> DataFrame:
    """case_id, anomaly (missing, unexpected, repeated, wrong-kind, wrong-shard, other-manifest): none means that every case was reported once and rightly.

    expected: case_id, kind, manifest. reported: case_id, kind, shard, manifest.
    """
    r = reported.groupBy("case_id").agg(F.count("*").alias("n"), F.min("kind").alias("rk"), F.min("shard").alias("shard"), F.min("manifest").alias("lo"), F.max("manifest").alias("hi"))
    both = expected.join(r, "case_id", "full")
    a = F.when(F.col("n").isNull(), "missing").when(F.col("kind").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.col("rk") != F.col("kind"), "wrong-kind")
    a = a.when(F.col("shard") != shard_of("case_id", shards), "wrong-shard").when((F.col("lo") != F.col("manifest")) | (F.col("hi") != F.col("manifest")), "other-manifest")
    return both.select("case_id", a.alias("anomaly")).where("anomaly is not null")


def verify_manifest(declared: DataFrame, present: DataFrame) -> DataFrame:
    """path, problem (missing, undeclared, changed) of files (path, digest)."""
    both = declared.select("path", F.col("digest").alias("d")).join(present.select("path", F.col("digest").alias("p")), "path", "full")
    return both.select("path", F.when(F.col("p").isNull(), "missing").when(F.col("d").isNull(), "undeclared").when(F.col("d") != F.col("p"), "changed").alias("problem")).where("problem is not null")


def decode_strict(text: str, fields: dict[str, type]) -> dict:
    """A JSON object with exactly these fields; ValueError on others, missing ones, wrong types or trailing text."""
    value = json.loads(text)
    if not isinstance(value, dict) or set(value) != set(fields) or any(not isinstance(value[k], t) or isinstance(value[k], bool) and t is not bool for k, t in fields.items()):
        raise ValueError("not the declared fields")
    return value


def fit_thresholds(cases: DataFrame) -> DataFrame:
    """none_below: the middle of the widest range of score bounds with the most cases right. cases: answerable boolean, score long.

    A case is right if it is answerable and at the bound or above, or not answerable and below. Counts come from running sums over distinct
    scores, not from a product of cases and bounds.
    """
    from pyspark.sql import Window

    per = cases.groupBy("score").agg(F.count_if("answerable").alias("yes"), F.count_if(~F.col("answerable")).alias("no"))
    w = Window.orderBy("score")  # a row per distinct score of a labelled set
    every = Window.partitionBy(F.lit(0))
    s = per.withColumn("below", F.coalesce(F.sum("no").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("above", F.sum("yes").over(every) - F.coalesce(F.sum("yes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("right", F.col("below") + F.col("above")).withColumn("before", F.coalesce(F.lag("score").over(w), F.lit(-1)))
    best = s.orderBy(F.desc("right"), F.desc(F.col("score") - F.col("before")), "score").limit(1)
    return best.select(F.expr("(before + 1 + score) div 2").alias("none_below"), "right", F.col("before").alias("after"), F.col("score").alias("upto"))


def leave_one_out(cases: DataFrame, group: str) -> DataFrame:
    """group, none_below, right, cases: a bound fitted without each group, judged on it. Groups are few; each costs a small job."""
    out = None
    for (g,) in cases.select(group).distinct().orderBy(group).collect():
        fit = fit_thresholds(cases.where(F.col(group) != g)).first()
        held = cases.where(F.col(group) == g).withColumn("none_below", F.lit(fit.none_below if fit else 0).cast("long"))
        row = held.agg(F.lit(g).alias(group), F.max("none_below").alias("none_below"), F.count_if(F.col("answerable") == (F.col("score") >= F.col("none_below"))).alias("right"), F.count("*").alias("cases"))
        out = row if out is None else out.union(row)
    return out


def outcomes(cases: DataFrame) -> DataFrame:
    """One row: mean reciprocal rank in ppm over answerable cases, and outcome counts. cases: answerable, decision, accepted_rank."""
    inverse = F.when(F.col("accepted_rank").isNotNull(), F.expr("1000000 div accepted_rank")).otherwise(0)
    right = F.col("answerable") & (F.col("decision") == "direct") & F.coalesce(F.col("accepted_rank") == 1, F.lit(False))
    return cases.agg(
        ratio_ppm(F.sum(F.when(F.col("answerable"), inverse)), F.count_if("answerable") * 1_000_000).alias("mrr_ppm"),
        F.count_if(right).alias("correct_directs"), F.count_if((F.col("decision") == "direct") & ~right).alias("wrong_directs"),
        F.count_if(~F.col("answerable") & (F.col("decision") != "direct")).alias("correct_abstentions"),
    )
