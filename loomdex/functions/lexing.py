"""Lexical functions as Column expressions: terms of identifiers and prose, stop words, stems, route keys, query atoms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no meaning in a question.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "can", "could", "did", "do", "does", "for", "from",
    "had", "has", "have", "how", "i", "in", "into", "is", "it", "of", "on", "or", "please", "should", "show", "that", "the",
    "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "with", "would",
]

# Surface forms and the stem that a query gets besides.
STEMS = {
    "authenticated": "authenticate", "authenticating": "authenticate", "authentication": "authenticate", "authorization": "authorize",
    "configuration": "configure", "configured": "configure", "configuring": "configure",
    "deserialization": "deserialize", "deserialized": "deserialize", "deserializing": "deserialize",
    "generated": "generate", "generating": "generate", "generation": "generate", "handled": "handle", "handling": "handle",
    "indexed": "index", "indexing": "index", "initialization": "initialize", "initialized": "initialize", "initializing": "initialize",
    "normalization": "normalize", "normalized": "normalize", "normalizing": "normalize", "parsed": "parse", "parsing": "parse",
    "resolution": "resolve", "resolved": "resolve", "resolving": "resolve", "routed": "route", "routing": "route",
    "serialization": "serialize", "serialized": "serialize", "serializing": "serialize",
    "validated": "validate", "validating": "validate", "validation": "validate", "verification": "verify", "verifications": "verify",
}

#: A token: a run of uncased letters; a cased run, which ends before an upper after a lower and before the last upper of a
#: run of them that a lower follows, and keeps its digits only if a letter follows them; or a run of digits.
TOKEN = r"\p{Lo}+|(?:\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+)(?:\p{N}+(?=\p{L}))?|\p{N}+"
#: Steps with the same tokens for engines without look-ahead (letters in NFC, no uncased scripts): replace, then extract.
TOKEN_STEPS = [(r"(\p{Ll})(\p{Lu})", r"\1 \2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"), (r"(\p{L})(\p{N}+)([^\p{L}\p{N}]|$)", r"\1 \2\3"), (r"(\p{N})(\p{L})", r"\1 \2")]
TOKEN_RE2 = r"[\p{L}\p{N}]+"


def strip_raw(c: Column | str) -> Column:
    """Without the r# marker of raw identifiers, at the start or after what is no letter or digit."""
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}])r#", "")


def tokens(c: Column | str) -> Column:
    """Lower-case tokens in order, with repetitions; an empty array for null. Text is taken to be in NFC (see nfc)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(F.regexp_extract_all(strip_raw(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0)), F.lower)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, for text that may not be composed."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def not_stop(terms: Column) -> Column:
    return F.filter(terms, lambda x: ~x.isin(STOP_WORDS))


def stem(c: Column) -> Column:
    """The stem of a listed form, else null."""
    table = F.create_map(*[F.lit(x) for pair in STEMS.items() for x in pair])
    return F.element_at(table, c)


def query_terms(c: Column | str) -> Column:
    """Distinct terms of a question in first-occurrence order, each followed by its stem; stop words left out."""
    both = F.transform(not_stop(tokens(c)), lambda x: F.array_compact(F.array(x, stem(x))))
    return F.array_distinct(F.flatten(both))


def route_key(c: Column | str) -> Column:
    """Sorted distinct terms without stop words, joined by spaces: questions that mean the same share a key."""
    return F.array_join(F.array_sort(F.array_distinct(not_stop(tokens(c)))), " ")


def display_signature(c: Column | str) -> Column:
    """One line: white space and control characters folded."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Cc}  ]+", " "))


IDENTIFIER = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*"


def atom_kind(c: Column, lone: Column, known_path: Column | None = None) -> Column:
    """path, qualified or symbol for a word of a question, else null. lone: whether it is the only word; known_path: whether it names an indexed file."""
    qualified = (c.contains("::") & c.rlike(rf"^{IDENTIFIER}(?:::{IDENTIFIER})+$")) | (~c.contains("::") & c.contains(".") & c.rlike(rf"^{IDENTIFIER}(?:\.{IDENTIFIER})+$"))
    name = c.rlike(f"^{IDENTIFIER}$")
    shaped = name & (c.contains("_") | c.rlike(r"\p{Ll}\p{Lu}"))
    path = c.contains("/") if known_path is None else c.contains("/") | known_path
    return F.when(path, "path").when(qualified, "qualified").when(shaped | (lone & name), "symbol")


_PAIRS = {"`": "`", '"': '"', "'": "'", "(": ")", "[": "]", "{": "}"}


def strip_punctuation(word: str) -> str:
    """A word without surrounding quotes, brackets and , ; ? ! to a fixed point. For a question on the driver."""
    while True:
        shorter = word[1:-1] if len(word) >= 2 and _PAIRS.get(word[0]) == word[-1] else word.strip(",;?!")
        if shorter == word:
            return word
        word = shorter


def quotient(a: Column, b: Column) -> Column:
    """a / b without its fraction, by integers: a decimal quotient has six places at these widths, and rounds up just below a whole number."""
    return F.call_function("div", a, b)


def six_decimals(c: Column | str) -> Column:
    """Millionths as a decimal number."""
    c = (F.col(c) if isinstance(c, str) else c).cast("long")
    rest = F.pmod(c, F.lit(1_000_000))
    return F.format_string("%d.%06d", quotient(c - rest, F.lit(1_000_000)), rest)


def ratio_ppm(part: Column, whole: Column) -> Column:
    """part / whole in millionths, half up; null where whole is 0."""
    p, w = part.cast("decimal(38,0)"), whole.cast("decimal(38,0)")
    return F.when(whole != 0, quotient(p * 2_000_000 + w, w * 2))


def at_least(part: Column, whole: Column, num: int, den: int) -> Column:
    """part / whole >= num / den by cross-multiplication; false where whole is 0."""
    return (whole > 0) & (part.cast("decimal(38,0)") * den >= whole.cast("decimal(38,0)") * num)


def exceeds(part: Column, whole: Column, num: int, den: int) -> Column:
    return (whole > 0) & (part.cast("decimal(38,0)") * den > whole.cast("decimal(38,0)") * num)


def structural_hash(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts: no two different lists give the same bytes. Arrays add their size first."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]), 256)


def tokens_sql(text: str) -> str:
    """DuckDB SQL for tokens()."""
    out = f"coalesce({text}, '')"
    for a, b in TOKEN_STEPS:
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"list_transform(regexp_extract_all({out}, '{TOKEN_RE2}'), lambda x: lower(x))"


def stop_sql() -> str:
    return ", ".join(f"'{w}'" for w in STOP_WORDS)
