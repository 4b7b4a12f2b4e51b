"""Directory roll-ups and budgeted text pages."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fidelity from best to worst, sizes of a purpose line.
FIDELITY = ["complete", "tags", "lexical", "degraded"]
SEED_TERMS, SEED_BYTES = 8, 160


def ancestors(path: Column | str) -> Column:
    """The directories above a path, '' for the root first."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def rollup(files: DataFrame) -> DataFrame:
    """scope, files, fidelity of every directory: each file counts for all above it, the worst fidelity wins. files: path, fidelity."""
    rank = F.array_position(F.array(*map(F.lit, FIDELITY)), F.col("fidelity")).cast("int")
    each = files.select(F.explode(ancestors("path")).alias("scope"), rank.alias("f"))
    return each.groupBy("scope").agg(F.count("*").alias("files"), F.max("f").alias("f")).select("scope", "files", F.element_at(F.array(*map(F.lit, FIDELITY)), F.col("f")).alias("fidelity"))


def parent(scope: Column | str) -> Column:
    c = F.col(scope) if isinstance(scope, str) else scope
    return F.when(c == "", None).otherwise(F.regexp_replace(c, r"(^|/)[^/]*$", ""))


def children(scopes: DataFrame) -> DataFrame:
    """scope, child: direct subdirectories."""
    return scopes.where("scope <> ''").select(parent("scope").alias("scope"), F.col("scope").alias("child")).join(scopes.select("scope"), "scope", "left_semi")


def records(symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """API and test records of each directory. Private symbols are in neither; a test file without a named test has one record.

    symbols: path, name, qualified, kind, visibility, signature, start_line, is_test. files: path, is_test_file.
    """
    s = symbols.withColumn("scope", parent("path"))
    api = s.where("visibility <> 'private' and not is_test").select("scope", "path", "name", "qualified", "kind", "visibility", "signature", "start_line")
    tests = s.where("is_test").select("scope", "path", "name", "start_line")
    bare = files.where("is_test_file").join(tests.select("path").distinct(), "path", "left_anti").select(parent("path").alias("scope"), "path", F.lit(None).cast("string").alias("name"), F.lit(1).cast("long").alias("start_line"))
    return api.orderBy("scope", "qualified", "kind", "path", "start_line"), tests.unionByName(bare).orderBy("scope", "path", "start_line", "name")


def api_hashes(api: DataFrame) -> DataFrame:
    """scope, api_hash over its records in order, without line numbers: moving code doesn't change it."""
    part = F.concat_ws("\x1f", "qualified", "kind", "visibility", F.coalesce("signature", F.lit("")), "path")
    g = api.groupBy("scope").agg(F.array_sort(F.collect_list(part)).alias("rows"))
    return g.select("scope", F.sha2(F.array_join("rows", "\x1e"), 256).alias("api_hash"))


def corpus_identity(hashes: DataFrame) -> str:
    """One hash over all directories, from an order-free digest of rows so that no task gathers them."""
    row = hashes.select(F.xxhash64("scope", "api_hash").alias("x")).agg(F.count("*").alias("n"), F.bit_xor("x").alias("b"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{row.n}|{row.b}|{row.s}".encode()).hexdigest()


def symbol_lines(api: DataFrame) -> DataFrame:
    """symbol, visibility, path, line of all public symbols in order; repeats tells how many rows have one identity (an error above 1)."""
    w = Window.partitionBy("qualified", "kind", "path", "start_line")
    return api.select(F.col("qualified").alias("symbol"), "visibility", "path", F.col("start_line").alias("line"), F.count("*").over(w).alias("repeats")).orderBy("symbol", "path", "line")


def seed_terms(terms: DataFrame) -> DataFrame:
    """scope, purpose: the SEED_TERMS terms with most symbols (scope, symbol_id, term), one vote a symbol, within SEED_BYTES."""
    votes = terms.select("scope", "symbol_id", "term").distinct().groupBy("scope", "term").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("scope").orderBy(F.desc("votes"), "term")
    top = votes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEED_TERMS)
    top = top.withColumn("size", F.sum(F.octet_length("term") + 2).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 2).where(F.col("size") <= SEED_BYTES)
    return top.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("purpose"))


def keep_purposes(seeds: DataFrame, existing: DataFrame) -> DataFrame:
    """A purpose that somebody wrote (scope, written) stays before the seed."""
    return seeds.join(existing, "scope", "full").select("scope", F.coalesce("written", "purpose").alias("purpose"))


_SECTIONS = ("api", "tests", "children")


def _fit(sizes: list[int], budget: int, omission: int) -> int:
    """Longest prefix that fits; a cut section pays for the line that says what is missing."""
    if sum(sizes) <= budget:
        return len(sizes)
    used = n = 0
    for n, s in enumerate(sizes):
        if used + s + omission > budget:
            return n
        used += s
    return n


def plan_page(sizes: dict[str, list[int]], budget: int, overhead: int, omission: int = 48) -> dict[str, int]:
    """How many records of each section a page keeps.

    Capacity is 4 * budget - overhead bytes. Sections that fit in a third give what is left to api, tests and children in
    turn; if omission lines still push the sum over, children, tests and api lose one record at a time.
    """
    capacity = max(0, 4 * budget - overhead)
    need = {s: sum(sizes.get(s, [])) for s in _SECTIONS}
    if sum(need.values()) <= capacity:
        return {s: len(sizes.get(s, [])) for s in _SECTIONS}
    share = {s: min(need[s], capacity // 3) for s in _SECTIONS}
    left = capacity - sum(share.values())
    for s in _SECTIONS:
        more = min(left, need[s] - share[s])
        share[s] += more
        left -= more
    kept = {s: _fit(sizes.get(s, []), share[s], omission) for s in _SECTIONS}
    cost = lambda: sum(sum(sizes.get(s, [])[: kept[s]]) + (omission if kept[s] < len(sizes.get(s, [])) else 0) for s in _SECTIONS)
    while cost() > capacity and any(kept.values()):
        for s in ("children", "tests", "api"):
            if kept[s]:
                kept[s] -= 1
                break
    return kept


def pages(rows: DataFrame, budget: int, overhead: int = 256) -> DataFrame:
    """scope, section, kept, total, over of records (scope, section, place, bytes). One directory's records meet in a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = {s: g.sort_values("place")["bytes"].tolist() for s, g in pdf.groupby("section")}
        kept = plan_page(sizes, budget, overhead)
        over = 4 * budget < overhead or any(v and not kept[s] for s, v in sizes.items())
        return pd.DataFrame([(pdf["scope"].iloc[0], s, kept[s], len(v), over) for s, v in sizes.items()], columns=["scope", "section", "kept", "total", "over"])

    return rows.groupBy("scope").applyInPandas(one, "scope string, section string, kept long, total long, over boolean")


# Lines around the managed block of an ignore file.
BLOCK = ("# begin loomdex", "# end loomdex")


def conflict_reason(text: Column | str, is_symlink: Column) -> Column:
    """Why a page must be left alone or is no longer what was written: null if it is one of ours, intact. Null text: unreadable.

    Reasons are symlink, unreadable, merge-conflict, not-owned, frontmatter, unsupported-format, purpose (over SEED_BYTES) and
    generated-edited, the first that holds. Pages of render_map() have no markers or anchors that could break.
    """
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, r"\n---\n", 2)
    head, body = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    digest = F.regexp_extract(head, r"\ndigest: ([0-9a-f]{64})(?:\n|$)", 1)
    purpose = F.get(F.split(body, "\n", -1), F.lit(2))
    return (
        F.when(is_symlink, "symlink").when(text.isNull(), "unreadable").when(text.rlike(r"(?m)^(?:<{7}|>{7}) "), "merge-conflict")
        .when(~text.startswith("---\nformat: "), "not-owned").when((F.size(parts) < 2) | (digest == ""), "frontmatter")
        .when(F.regexp_extract(head, r"^---\nformat: ([^\n]*)", 1) != "2", "unsupported-format")
        .when(F.octet_length(purpose) > SEED_BYTES, "purpose").when(F.sha2(body, 256) != digest, "generated-edited")
    )


def ignore_reason(text: Column | str) -> Column:
    """managed-ignore if the lines around the managed block are repeated, unpaired or in the wrong order; else null."""
    lines = F.split(F.col(text) if isinstance(text, str) else text, "\n", -1)
    count = lambda x: F.size(F.filter(lines, lambda y: y == x))
    first, last = (F.array_position(lines, x) for x in BLOCK)
    return F.when((count(BLOCK[0]) != count(BLOCK[1])) | (count(BLOCK[0]) > 1) | (first > last), "managed-ignore")


def compare_generation(planned: DataFrame, present: DataFrame) -> DataFrame:
    """path, state (fresh, stale, missing, removable, conflict), reason of planned and present artifacts (path, digest; owned in present).

    present may have a reason (conflict_reason); one that isn't null is a conflict, as is a page that isn't owned, and a planned
    path that another present one equals but for case.
    """
    p = present.withColumn("reason", F.col("reason") if "reason" in present.columns else F.lit(None).cast("string"))
    p = p.select("path", F.col("digest").alias("have"), "owned", F.coalesce("reason", F.when(~F.col("owned"), "not-owned")).alias("reason"))
    both = planned.select("path", F.col("digest").alias("want")).join(p, "path", "full")
    alike = p.select(F.lower("path").alias("__l"), F.col("path").alias("__other")).distinct()
    clash = planned.select("path", F.lower("path").alias("__l")).join(alike, "__l").where("path <> __other").select("path").distinct().withColumn("__clash", F.lit("case-collision"))
    both = both.join(clash, "path", "left").withColumn("reason", F.coalesce("reason", "__clash"))
    s = F.when(F.col("reason").isNotNull(), "conflict").when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "removable").when(F.col("want") == F.col("have"), "fresh").otherwise("stale")
    return both.select("path", s.alias("state"), "reason")


def index_hash(budget: int, fidelity: str, sections: dict[str, DataFrame]) -> str:
    """One hash over the rows of an index's sections (directories, records with their lines, tests, symbols): moved code changes it,
    purposes, which are left out of the sections, don't. Sections go by name, their rows in any order."""
    parts = [str(budget), fidelity]
    for name in sorted(sections):
        df = sections[name]
        row = df.select(F.xxhash64(*sorted(df.columns)).alias("x")).agg(F.count("*").alias("n"), F.bit_xor("x").alias("b"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).first()
        parts.append(f"{name}|{row.n}|{row.b}|{row.s}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def render_map(scope: str, purpose: str, api: list[dict], tests: list[dict], subdirs: list[str], omitted: dict[str, int] | None = None) -> str:
    """One directory's page on the driver, its own digest in the front matter."""
    omitted = omitted or {}
    body = [f"# {scope or '.'}", "", purpose or "", ""]
    for title, key, rows in (("API", "api", [f"- `{r['qualified']}` {r['kind']}" for r in api]), ("Tests", "tests", [f"- {r.get('name') or r['path']}" for r in tests]), ("Directories", "children", [f"- {c}" for c in subdirs])):
        if rows or omitted.get(key):
            body += [f"## {title}", "", *rows, *([f"- {omitted[key]} more"] if omitted.get(key) else []), ""]
    text = "\n".join(body)
    return f"---\nformat: 2\ndigest: {hashlib.sha256(text.encode()).hexdigest()}\n---\n{text}"


def parse_map(text: str) -> dict:
    """A page read back; ValueError if its front matter or digest is wrong."""
    head, sep, body = text.removeprefix("---\n").partition("\n---\n")
    fields = dict(x.split(": ", 1) for x in head.split("\n") if ": " in x)
    if not text.startswith("---\n") or not sep or fields.get("format") != "2" or fields.get("digest") != hashlib.sha256(body.encode()).hexdigest():
        raise ValueError("not a page, or changed by hand")
    lines = body.split("\n")
    return {"scope": "" if lines[0] == "# ." else lines[0].removeprefix("# "), "purpose": lines[2], "rows": [x for x in lines if x.startswith("- ")]}
