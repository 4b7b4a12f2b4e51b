"""Encodings of anchors and of Markdown parts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def encode_anchor(c: Column | str) -> Column:
    """Percent-encodes %, # and ASCII control characters only."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("#"), F.lit("%23"))
    for k in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(k)), F.lit(f"%{k:02X}")) if k else out
    return out


def anchor(path: Column, name: Column) -> Column:
    """path#symbol."""
    return F.concat(encode_anchor(path), F.lit("#"), encode_anchor(name))


def decode_anchor_text(text: str | None) -> str | None:
    """The decoded part, or None if an escape isn't one that encode_anchor writes."""
    if text is None or re.search(r"%(?!25|23|7F|[01][0-9A-F])", text):
        return None
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


@F.pandas_udf(StringType())
def decode_anchor(s: pd.Series) -> pd.Series:
    return s.map(decode_anchor_text)


def markdown_destination(c: Column | str) -> Column:
    """A link destination: spaces, parentheses, angle brackets and percent signs escaped."""
    c = F.col(c) if isinstance(c, str) else c
    for a in "% ()<>":
        c = F.replace(c, F.lit(a), F.lit(f"%{ord(a):02X}"))
    return c


def code_span(c: Column | str) -> Column:
    """A Markdown code span whose fence is longer than any run of backticks inside."""
    c = F.col(c) if isinstance(c, str) else c
    runs = F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(c.startswith("`") | c.endswith("`"), " ").otherwise("")
    return F.concat(fence, pad, c, pad, fence)


def link_label(c: Column | str) -> Column:
    """A link label with its brackets and backslashes escaped."""
    return F.regexp_replace(c, r"([\\\[\]])", r"\\$1")
