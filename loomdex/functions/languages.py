"""The language table: extensions, whether a language is code, its separator, its test-file conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language, extensions.
EXTENSIONS = {
    "rust": ["rs"], "python": ["py", "pyw", "pyi"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "javascript": ["js", "mjs", "cjs"], "jsx": ["jsx"],
    "go": ["go"], "java": ["java"], "csharp": ["cs"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"], "ruby": ["rb"], "php": ["php"],
    "swift": ["swift"], "kotlin": ["kt", "kts"], "scala": ["scala", "sc"], "zig": ["zig"], "lua": ["lua"], "shell": ["sh", "bash", "zsh"],
    "toml": ["toml"], "json": ["json"], "yaml": ["yaml", "yml"], "markdown": ["md", "markdown"], "html": ["html", "htm"],
    "css": ["css", "scss", "sass", "less"], "sql": ["sql"], "proto": ["proto"],
}
DATA = {"toml", "json", "yaml", "markdown", "html", "css"}
# Patterns of a test file's stem, by language.
_TEST_STEMS = {
    r"^(test|tests)$|_(test|tests)$": ["rust"],
    r"^test_|_test$": ["python", "shell"],
    r"\.(test|spec)$": ["typescript", "tsx", "javascript", "jsx"],
    r"_test$": ["go", "zig"],
    r"(Test|Tests|TestCase|Spec)$": ["java", "csharp", "kotlin", "scala", "swift"],
    r"^test_|_(test|spec)$": ["ruby", "lua"],
    r"Test$": ["php"],
    r"^test_|_(test|tests)$": ["c", "cpp"],
}
BY_EXTENSION = {e: lang for lang, es in EXTENSIONS.items() for e in es}


def _path(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_path(path), "/", -1), -1)


def language(path: Column | str) -> Column:
    """By extension, whatever its ASCII case; null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)))


def is_code(lang: Column | str) -> Column:
    return ~_path(lang).isin(*sorted(DATA))


def separator(lang: Column | str) -> Column:
    return F.when(_path(lang) == "rust", "::").otherwise(".")


def is_test(path: Column | str, lang: Column | str) -> Column:
    """A directory named tests anywhere, or a stem by the language's convention."""
    path, lang = _path(path), _path(lang)
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    rule = F.lit(False)
    for pattern, langs in _TEST_STEMS.items():
        rule = rule | (lang.isin(*langs) & stem.rlike(pattern))
    return path.rlike("(^|/)tests/") | rule


def is_generated(path: Column | str, head: Column | str | None = None) -> Column:
    """By path markers, or by a marker in the first five lines that hold something of the first 2,048 bytes."""
    path = _path(path)
    name = F.lower(file_name(path))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    by_path = path.rlike("(?i)(^|/)generated/") | name.rlike(r"\.pb\.|_pb2|\.generated\.|^generated\.") | (stem == "generated") | stem.rlike(r"[_.]generated$")
    if head is None:
        return by_path
    lines = F.slice(F.filter(F.split(F.substring(_path(head), 1, 2048), r"\r?\n"), lambda x: F.trim(x) != ""), 1, 5)
    return by_path | F.coalesce(F.exists(lines, lambda x: x.contains("@generated") | F.upper(x).contains("DO NOT EDIT")), F.lit(False))


def module_prefix(path: Column | str, lang: Column | str) -> Column:
    """Module segments of a path: without a leading src, its own extension, and file names that stand for their directory."""
    path, lang = _path(path), _path(lang)
    parts = F.split(path, "/", -1)
    parts = F.when((F.element_at(parts, 1) == "src") & (F.size(parts) > 1), F.slice(parts, 2, F.size(parts) - 1)).otherwise(parts)
    last = F.when(language(path) == lang, F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")).otherwise(F.element_at(parts, -1))
    parts = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(last))
    implicit = F.when(lang == "rust", last.isin("lib", "main", "mod")).when(lang == "python", last.isin("__init__", "__main__")).otherwise(False)
    return F.when(implicit, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def qualify(module: Column, local: Column, name: Column, lang: Column | str) -> Column:
    """Module segments and the local qualified name, else the name, by the language's separator."""
    suffix = F.coalesce(local, name)
    return F.when(F.size(module) == 0, suffix).otherwise(F.concat(F.when(separator(lang) == "::", F.array_join(module, "::")).otherwise(F.array_join(module, ".")), separator(lang), suffix))


def table(spark: SparkSession, tier: dict[str, str] | None = None) -> DataFrame:
    """lang, extensions, is_code, separator, tier: a row for each language."""
    tier = tier or {}
    rows = [(lang, es, lang not in DATA, "::" if lang == "rust" else ".", tier.get(lang, "lexical")) for lang, es in EXTENSIONS.items()]
    return spark.createDataFrame(rows, "lang string, extensions array<string>, is_code boolean, separator string, tier string")
