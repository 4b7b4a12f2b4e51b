"""Source trees: discovery with ignore rules, content, identities."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import languages

# Directories that are never read; files that rule what is tracked or read.
EXCLUDED = [".git", "node_modules", "target", "dist", "build", ".venv", "vendor"]
RULE_FILES = [".gitignore", ".ignore", ".gitattributes", ".gitmodules"]


def normal_path(c: Column | str) -> Column:
    """A relative path without . segments; raises on an empty one, a root or .. segments."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.filter(F.split(c, "/", -1), lambda x: x != ".")
    bad = (c == "") | c.startswith("/") | c.rlike(r"^[A-Za-z]:") | F.array_contains(parts, "..") | F.exists(parts, lambda x: x == "") | (F.size(parts) == 0)
    return F.when(bad, F.raise_error(F.concat(F.lit("not a relative path: "), c)).cast("string")).otherwise(F.array_join(parts, "/"))


def glob_regex(glob: str) -> str:
    """A regular expression for an ignore glob; ValueError if it is malformed."""
    if not glob.strip("/!") or glob.count("[") != glob.count("]"):
        raise ValueError(f"invalid glob: {glob}")
    anchored, only_dir = "/" in glob.rstrip("/"), glob.endswith("/")
    out = re.escape(glob.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    out = re.sub(r"\\\[(!|\\!)?(.*?)\\\]", lambda m: f"[{'^' if m[1] else ''}{m[2]}]", out)
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if only_dir else '(?:/.*)?'}$"


def ignored(path: Column | str, globs: list[str]) -> Column:
    """Whether the last glob that matches isn't a ! one."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for g in globs:
        out = F.when(path.rlike(glob_regex(g.removeprefix("!"))), not g.startswith("!")).otherwise(out)
    return out


@F.pandas_udf(StringType())
def _regex(globs: pd.Series) -> pd.Series:
    """Of ignore globs; null for malformed ones, which rule nothing."""

    def one(glob):
        try:
            return glob_regex(glob)
        except (ValueError, re.error):
            return None

    return globs.map(one)


def ignore_rules(tree: DataFrame) -> DataFrame:
    """dir, place, regex, keep: the rules that the ignore files of a tree (path, content) hold, .ignore after .gitignore, for
    paths below their directory. Blank lines and comments are none."""
    files = tree.where(languages.file_name("path").isin(".gitignore", ".ignore"))
    lines = files.select(F.regexp_replace("path", "[^/]*$", "").alias("dir"), languages.file_name("path").alias("name"), F.posexplode(F.split(F.decode("content", "utf-8"), r"\r?\n", -1)).alias("n", "line"))
    lines = lines.withColumn("line", F.rtrim("line")).where("line <> '' and not startswith(line, '#')")
    rules = lines.select("dir", F.struct(F.length("dir").alias("deep"), (F.col("name") == ".ignore").alias("later"), "n").alias("place"), _regex(F.regexp_replace("line", "^!", "")).alias("regex"), F.col("line").startswith("!").alias("keep"))
    return rules.where("regex is not null")


def ignored_paths(tree: DataFrame) -> DataFrame:
    """path of the files that ignore files of their own tree rule out: the last rule that matches, in the deepest directory, decides."""
    parts = F.split("path", "/", -1)
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    at = tree.select("path", F.explode(F.transform(up, lambda x: F.when(x == "", x).otherwise(F.concat(x, F.lit("/"))))).alias("dir"))
    hit = at.join(ignore_rules(tree), "dir").where(F.expr("rlike(substr(path, length(dir) + 1), regex)"))
    return hit.groupBy("path").agg(F.max_by("keep", "place").alias("keep")).where("not keep").select("path")


def excluded(path: Column | str, names: list[str] = EXCLUDED) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/", -1)
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, names))) & (F.size(parts) > 1)


def is_rule_file(path: Column | str) -> Column:
    return languages.file_name(path).isin(*RULE_FILES)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), content, size of all regular files, by Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    # %-escapes of the reader's URIs are left as they are in the name
    return files.select(F.element_at(F.split(F.col("path"), re.escape(root.rstrip("/").removeprefix("file://")) + "/", 2), 2).alias("path"), "content", F.col("length").alias("size"), base.alias("root")).drop("root")


def discover(tree: DataFrame, langs: list[str] | None = None, globs: list[str] = (), names: list[str] = EXCLUDED, reserved: list[str] = (), most: int | None = None) -> DataFrame:
    """path, lang, generated, is_test, content of the files that count as sources, by path; most: the first so many.

    Ignore files of the tree count, then globs, whose ! ones let in what the tree ignores.
    """
    ruled = ignored_paths(tree)
    if globs:
        let_in = [g for g in globs if g.startswith("!")]
        ruled = ruled.where(~ignored("path", [g[1:] for g in let_in])) if let_in else ruled
    t = tree.join(ruled, "path", "left_anti").withColumn("lang", languages.language("path")).where("lang is not null").where(~excluded("path", names) & ~ignored("path", list(globs)) & languages.is_code("lang"))
    if reserved:
        t = t.where(~languages.file_name("path").isin(*reserved))
    if langs:
        t = t.where(F.col("lang").isin(*langs))
    head = F.decode(F.substring("content", 1, 2048), "utf-8")
    out = t.select("path", "lang", languages.is_generated("path", head).alias("generated"), languages.is_test("path", "lang").alias("is_test"), "content")
    out = out.orderBy("path")
    return out if most is None else out.limit(most)


def blob_oid(content: Column, bits: int = 160) -> Column:
    """Identity of a blob as version control computes it: a hash over its kind, length and bytes."""
    whole = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.unhex(F.lit("00")), content)
    return F.sha1(whole) if bits == 160 else F.sha2(whole, 256)


def oid_shard(oid: Column | str, digits: int = 2) -> Column:
    return F.substring(oid, 1, digits)


def valid_oid(oid: Column | str) -> Column:
    oid = F.col(oid) if isinstance(oid, str) else oid
    return oid.rlike(r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$")


def reusable(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path, size and time are known: path, oid. The rest must be read."""
    return found.join(known.select("path", "size", "mtime", "oid"), ["path", "size", "mtime"]).select("path", "oid")


def rules_digest(tree: DataFrame, settings: str) -> str:
    """A hash of the settings and rule files; a change means that discovery has to run again."""
    import hashlib

    rows = tree.where(is_rule_file("path")).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()  # rule files only
    return hashlib.sha256(repr((settings, [(r.path, r.h) for r in rows])).encode()).hexdigest()
