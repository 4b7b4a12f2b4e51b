"""Identifiers only, from bounded bytes."""

from __future__ import annotations

import re

_NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_]*")


def extract(content: bytes) -> list[dict]:
    from . import FALLBACK_BYTES, FALLBACK_IDENTS

    names = [m[0].decode() for m in _NAME.finditer(content[:FALLBACK_BYTES])][:FALLBACK_IDENTS]
    if not names:
        return []
    lines = content.count(b"\n") + 1
    return [{"fact": "identifiers", "name": names[0], "start_byte": 0, "end_byte": len(content), "start_line": 1, "end_line": lines, "body": names}]
