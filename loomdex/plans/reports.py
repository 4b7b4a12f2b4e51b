"""Reports as JSON: refresh, status, impact, quality findings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Versions of the reports, and what each gate failure is called.
REFRESH_SCHEMA, STATUS_SCHEMA, IMPACT_SCHEMA = 4, 3, 1
FINDINGS = {
    "no-cases": "0501_CORPUS_EMPTY", "no-answerable-cases": "0502_NO_ANSWERABLE_CASES", "no-must-abstain-cases": "0503_NO_ABSTAIN_CASES",
    "top3-below-floor": "0504_RECALL_BELOW_FLOOR", "false-directs": "0505_FALSE_DIRECT", "required-abstention-missed": "0506_ABSTENTION_MISSED",
}


def refresh_report(mode: str, plan: DataFrame, files: int, reparsed: int, cached: int, statuses: DataFrame, updated: bool) -> dict:
    """Counters of one refresh, in the order of the printed report."""
    n = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
    s = {r.status: r["count"] for r in statuses.groupBy("status").count().collect()}
    return {
        "schema_version": REFRESH_SCHEMA, "mode": mode, "files": files, "changed": n.get("recheck", 0) + n.get("rename", 0), "reparsed": reparsed, "cached": cached,
        "removed": n.get("remove", 0), "renamed": n.get("rename", 0), "degraded": s.get("degraded", 0), "recovered": s.get("recovered", 0), "tags": s.get("tags", 0), "conflicted": n.get("conflict", 0), "snapshot_updated": updated,
    }


def status_report(git: str, snapshot: DataFrame) -> dict:
    """The label of a tree and that of its index (delta.status)."""
    r = snapshot.first().asDict()
    return {"schema_version": STATUS_SCHEMA, "git": git, "snapshot": r.pop("label"), **r}


_SECTIONS = {
    "changed_files": ["path", "change"], "changed_definitions": ["path", "qualified", "kind"], "direct_edges": ["source", "target", "kind"],
    "affected": ["distance", "node"], "dependencies": ["distance", "node"], "cycles": ["cycle", "node"], "tests": ["confidence", "path"],
    "resolution": ["path"], "unfollowed_imports": ["path", "line", "specifier"],
}


def impact_report(result: dict, limit: int = 1000) -> dict:
    """A report of workspace.impact(): the first limit rows of each section in order, with shown and total."""
    out = {k: result[k] for k in ("schema_version", "status", "depth")}
    for name, order in _SECTIONS.items():
        df = result[name]
        rows = [json.loads(x) for x in df.orderBy(*order).limit(limit).select(F.to_json(F.struct(*df.columns))).toPandas().iloc[:, 0]]
        out[name] = {"shown": len(rows), "total": df.count(), "rows": rows}
    return out


def render(report: dict) -> str:
    return json.dumps(report)


def findings(failures: DataFrame, manifest: str) -> dict:
    """Quality findings for the failures of a release gate."""
    rows = [r.failure for r in failures.orderBy("failure").collect()]  # FINDINGS at most
    return {"schema_version": 1, "manifest_digest": manifest, "findings": [{"rule_id": FINDINGS[f], "blocked": True, "message": f} for f in rows]}


def adjudicate(report: str, manifest: str) -> list[dict]:
    """The blocking findings of a report; ValueError if it is of another manifest or names unknown rules."""
    from ..operators.quality import decode_strict

    r = decode_strict(report, {"schema_version": int, "manifest_digest": str, "findings": list})
    if r["schema_version"] != 1 or r["manifest_digest"] != manifest:
        raise ValueError("a report of something else")
    for f in r["findings"]:
        decode_strict(json.dumps(f), {"rule_id": str, "blocked": bool, "message": str})
        if f["rule_id"] not in FINDINGS.values():
            raise ValueError(f"unknown rule {f['rule_id']}")
    return [f for f in r["findings"] if f["blocked"]]
