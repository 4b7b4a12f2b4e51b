"""Facts of source files: definitions, references, imports. One row each, from an extractor by language and tier."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import languages

#: What each language gets: complete facts, definitions and imports by pattern, or identifiers only.
TIERS = {"python": "complete", "rust": "complete", **dict.fromkeys(["typescript", "tsx", "javascript", "jsx", "go", "java", "csharp", "c", "cpp", "ruby", "lua", "php", "swift"], "tags")}
MOST_BYTES, FALLBACK_BYTES, FALLBACK_IDENTS = 16 * 1024 * 1024, 256 * 1024, 16_384

FACT = pa.schema([
    ("path", pa.string()), ("lang", pa.string()), ("status", pa.string()), ("fact", pa.string()), ("idx", pa.int64()), ("owner", pa.int64()),
    ("name", pa.string()), ("qualified", pa.string()), ("kind", pa.string()), ("visibility", pa.string()),
    ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_line", pa.int64()), ("end_line", pa.int64()),
    ("signature", pa.string()), ("documentation", pa.string()), ("attributes", pa.list_(pa.string())), ("body", pa.list_(pa.string())),
    ("is_test", pa.bool_()), ("import_path", pa.string()), ("alias", pa.string()), ("is_glob", pa.bool_()), ("is_public", pa.bool_()),
])
DDL = "path string, lang string, status string, fact string, idx long, owner long, name string, qualified string, kind string, visibility string, start_byte long, end_byte long, start_line long, end_line long, signature string, documentation string, attributes array<string>, body array<string>, is_test boolean, import_path string, alias string, is_glob boolean, is_public boolean"


def facts_of(path: str, lang: str, content: bytes) -> list[dict]:
    """All facts of one file; a file without any has one row of fact 'file', as has each file for its status."""
    from . import lexical, python, rust, tags

    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = None
    tier = TIERS.get(lang, "lexical")
    if text is None or len(content) > MOST_BYTES or tier == "lexical":
        found, status = lexical.extract(content), "degraded" if tier != "lexical" else "lexical"
    elif lang == "python":
        found, status = python.extract(text)
    elif lang == "rust":
        found, status = rust.extract(text)
    else:
        found, status = tags.extract(text, lang), "tags"
    nest(found)
    return [{"path": path, "lang": lang, "status": status, **f} for f in [{"fact": "file"}, *found]]


def nest(found: list[dict]) -> None:
    """Gives each fact its index and its nearest enclosing definition (smallest, then first)."""
    found.sort(key=lambda f: (f.get("start_byte", 0), -f.get("end_byte", 0), f["fact"], f.get("name") or ""))
    defs, stack = [], []
    for f in found:
        while stack and stack[-1]["end_byte"] < f.get("end_byte", 0) or stack and stack[-1]["end_byte"] <= f.get("start_byte", 0):
            stack.pop()
        f["owner"] = stack[-1]["idx"] if stack else None
        if f["fact"] == "definition":
            f["idx"] = len(defs)
            defs.append(f)
            stack.append(f)


def extract(files: DataFrame) -> DataFrame:
    """Facts of files (path, content binary, lang). Files are dealt out by path, so that big directories spread."""

    def run(batches):
        for b in batches:
            rows = [f for p, c, g in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for f in facts_of(p, g, c or b"")]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in FACT.names} for r in rows], schema=FACT)

    return files.select("path", "content", "lang").where("lang is not null").mapInArrow(run, DDL)


def symbols(facts: DataFrame) -> DataFrame:
    """Definitions with module and qualified name: file, path, lang, idx, parent idx, name, qualified, module, kind, ..."""
    module = languages.module_prefix("path", "lang")
    d = facts.where("fact = 'definition'").withColumn("module", module)
    return d.withColumn("local", F.col("qualified")).withColumn("qualified", languages.qualify(F.col("module"), F.col("qualified"), F.col("name"), "lang"))


def status_counts(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'file'").groupBy("status").agg(F.count("*").alias("files"))


def invalid(facts: DataFrame) -> DataFrame:
    """Rows that break what facts promise: ordered spans, lines from 1, names, owners that enclose."""
    own = facts.where("fact = 'definition'").select("path", F.col("idx").alias("owner"), F.col("start_byte").alias("os"), F.col("end_byte").alias("oe"))
    rows = facts.where("fact <> 'file'").join(own, ["path", "owner"], "left")
    return rows.where("start_byte > end_byte or start_line < 1 or start_line > end_line or (fact <> 'import' and coalesce(name, '') = '') or (owner is not null and (os is null or start_byte < os or end_byte > oe))")


def span_problem(content: bytes, start: int, end: int, first: int, last: int) -> str | None:
    """What is wrong with a span of a file: out of bounds, inside a character, or other lines than it says."""
    if not 0 <= start <= end <= len(content):
        return "bounds"
    if any(k < len(content) and content[k] & 0xC0 == 0x80 for k in (start, end)):
        return "character"
    if (first, last) != (content.count(b"\n", 0, start) + 1, content.count(b"\n", 0, max(start, end - 1)) + 1):
        return "lines"
    return None


def invalid_spans(facts: DataFrame, files: DataFrame) -> DataFrame:
    """path, start_byte, problem of facts whose span doesn't fit their file (path, content)."""
    spans = facts.where("start_byte is not null").groupBy("path").agg(F.collect_list(F.struct("start_byte", "end_byte", "start_line", "end_line")).alias("spans"))

    def run(batches):
        for b in batches:
            bad = [(p, s["start_byte"], e) for p, c, ss in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for s in ss if (e := span_problem(c, *s.values()))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in bad], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "start_byte", "problem"])

    return files.select("path", "content").join(spans, "path").select("path", "content", "spans").mapInArrow(run, "path string, start_byte long, problem string")
