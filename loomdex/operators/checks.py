"""Consistency checks: one frame of diagnostics for each rule, counts and exit code."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["fatal", "error", "warning"]
# Rules by number, with severity and what to do.
RULES = {
    "0001_SNAPSHOT_MISSING": ("fatal", "build the index"), "0002_SNAPSHOT_CORRUPT": ("error", "rebuild the index"), "0003_SNAPSHOT_INCOMPATIBLE": ("error", "rebuild the index"),
    "0004_SNAPSHOT_STALE": ("warning", "refresh the index"), "0101_MAP_MISSING": ("error", "write the pages"), "0102_MAP_INVALID": ("error", "write the pages again"),
    "0103_MAP_STALE": ("warning", "write the pages again"), "0104_MAP_OVER_BUDGET": ("warning", "raise the budget"), "0106_MAP_NOT_WRITABLE": ("error", "move the file away"),
    "0201_SYMBOLS_MISSING": ("error", "write the symbol list"), "0202_SYMBOLS_INVALID": ("error", "write the symbol list again"), "0203_SYMBOLS_STALE": ("warning", "write the symbol list again"),
    "0206_SYMBOLS_NOT_WRITABLE": ("error", "move the file away"), "0301_ROUTES_INVALID": ("warning", "drop the learned answers"), "0302_ROUTE_ANCHOR_MISSING": ("warning", "refresh"),
    "0303_ROUTE_API_STALE": ("warning", "refresh"), "0401_CACHE_CORRUPT": ("warning", "drop the entry"), "0604_LOCAL_IGNORE_INVALID": ("warning", "repair the block"),
}
RESERVED = ["0105_MAP_RECORD_INDIVISIBLE", "0601_CONTRACT_MISSING", "0602_CONTRACT_NOT_OWNED", "0603_CONTRACT_STALE"]
COLUMNS = ["rule_id", "severity", "message", "path", "anchor", "expected", "actual", "remediation"]


def emit(rows: DataFrame, rule: str, message) -> DataFrame:
    """Diagnostics of one rule from offending rows, which may have path, anchor, expected and actual."""
    severity, fix = RULES[rule]
    field = lambda c: (F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")).alias(c)
    message = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), message.alias("message"), field("path"), field("anchor"), field("expected"), field("actual"), F.lit(fix).alias("remediation"))


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# Why an index can't be used, and conflicts of artifacts that must not be written.
CORRUPT = ["bad-magic", "length-mismatch", "checksum-mismatch", "invalid-payload", "trailing-bytes", "invalid-invariant"]
INCOMPATIBLE = ["unsupported-version", "build-version-mismatch", "ranking-profile-mismatch", "lexical-mismatch"]
NOT_WRITABLE = ["not-owned", "symlink", "merge-conflict", "case-collision", "unreadable"]


def snapshot_diagnostics(observed: DataFrame) -> DataFrame:
    """Rules of the index from observed (path, outcome, label): outcome missing, ready, or why it can't be used; label fresh or stale.

    A stale label counts for a ready index only, as nothing else can be asked of one that isn't there.
    """
    o = observed.withColumn("actual", F.when(F.col("outcome") == "ready", F.col("label")).otherwise(F.col("outcome")))
    of = lambda c: o.where(F.coalesce(c, F.lit(False)))
    return union(
        emit(of(F.col("outcome") == "missing"), "0001_SNAPSHOT_MISSING", "no index has been published"),
        emit(of(F.col("outcome").isin(CORRUPT)), "0002_SNAPSHOT_CORRUPT", F.concat(F.lit("the index is damaged: "), "outcome")),
        emit(of(F.col("outcome").isin(INCOMPATIBLE)), "0003_SNAPSHOT_INCOMPATIBLE", F.concat(F.lit("the index is of another build: "), "outcome")),
        emit(of((F.col("outcome") == "ready") & (F.col("label") == "stale")).withColumn("expected", F.lit("fresh")), "0004_SNAPSHOT_STALE", "the tree has moved on from the index"),
    )


def artifact_diagnostics(states: DataFrame, kind: str) -> DataFrame:
    """Map or symbol-list rules from scopes.compare_generation(); kind: map or symbols. A conflict without a reason is not-owned."""
    family = kind.upper()
    number = {"map": {"missing": "0101", "invalid": "0102", "stale": "0103", "blocked": "0106"}, "symbols": {"missing": "0201", "invalid": "0202", "stale": "0203", "blocked": "0206"}}[kind]
    reason = F.coalesce(F.col("reason"), F.lit("not-owned")) if "reason" in states.columns else F.lit("not-owned")
    hit = states.where("state = 'conflict'").withColumn("actual", reason)
    return union(
        emit(states.where("state = 'missing'").select("path"), f"{number['missing']}_{family}_MISSING", f"the {kind} page is not there"),
        emit(hit.where(~F.col("actual").isin(NOT_WRITABLE)), f"{number['invalid']}_{family}_INVALID", F.col("actual")),
        emit(states.where("state = 'stale'").select("path"), f"{number['stale']}_{family}_STALE", f"the {kind} page is of an older state"),
        emit(hit.where(F.col("actual").isin(NOT_WRITABLE)), f"{number['blocked']}_{family}_NOT_WRITABLE", F.col("actual")),
    )


def budget_diagnostics(pages: DataFrame) -> DataFrame:
    """A directory once, if a section of its page (scopes.pages) doesn't fit."""
    return emit(pages.where("over").select(F.col("scope").alias("path")).distinct(), "0104_MAP_OVER_BUDGET", "no page of this directory fits the budget")


def ignore_diagnostics(states: DataFrame) -> DataFrame:
    """Ignore files (path, reason) whose managed block is repeated or malformed."""
    return emit(states.where("reason = 'managed-ignore'").select("path", F.col("reason").alias("actual")), "0604_LOCAL_IGNORE_INVALID", "the managed block is repeated or malformed")


def fault_diagnostics(faults: DataFrame) -> DataFrame:
    """Tables of learned answers (path, fault) that couldn't be read and start empty."""
    return emit(faults.where("fault is not null").select("path", F.col("fault").alias("actual")), "0301_ROUTES_INVALID", "the learned answers could not be read")


def cache_diagnostics(outcomes: DataFrame) -> DataFrame:
    """Files whose stored facts are damaged, from store.cache_outcomes()."""
    return emit(outcomes.where("outcome = 'corrupt'").select("path", F.col("outcome").alias("actual")), "0401_CACHE_CORRUPT", "stored facts do not decode")


def route_diagnostics(routes: DataFrame, anchors: DataFrame, identities: DataFrame) -> DataFrame:
    """Routes whose anchor is gone, and once if any map's identity changed."""
    gone = routes.join(anchors.select("anchor").distinct(), "anchor", "left_anti")
    stale = routes.join(identities, ["map", "api_identity"], "left_anti").orderBy("key").limit(1).select(F.col("map").alias("path"), "anchor")
    return union(emit(gone, "0302_ROUTE_ANCHOR_MISSING", "the learned answer's anchor is gone"), emit(stale, "0303_ROUTE_API_STALE", "learned answers are of another state"))


def ordered(diagnostics: DataFrame) -> DataFrame:
    """By all printed fields, most severe first."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return diagnostics.orderBy(rank, "rule_id", "path", "anchor", "message", "expected", "actual")


def counts(diagnostics: DataFrame) -> DataFrame:
    """One row: fatal, errors, warnings, status, exit_code (4 without an index, 3 with errors, 1 with warnings, else 0)."""
    of = lambda s: F.count_if(F.col("severity") == s)
    c = diagnostics.agg(of("fatal").alias("fatal"), of("error").alias("errors"), of("warning").alias("warnings"))
    by = lambda *v: F.when(F.col("fatal") > 0, v[0]).when(F.col("errors") > 0, v[1]).when(F.col("warnings") > 0, v[2]).otherwise(v[3])
    return c.select("*", by("snapshot-missing", "errors", "warnings", "ok").alias("status"), by(4, 3, 1, 0).alias("exit_code"))


def render_json(diagnostics: DataFrame, most: int = 1000) -> str:
    """A report on the driver: the counts of all, the first most diagnostics."""
    row = counts(diagnostics).first().asDict()
    return json.dumps({"schema_version": 1, **row, "diagnostics": [r.asDict() for r in ordered(diagnostics).limit(most).collect()]})
