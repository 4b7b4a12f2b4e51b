"""Definitions and imports by pattern, for languages with braces or end keywords."""

from __future__ import annotations

import re

_ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:export|default|declare|abstract|public|private|protected|internal|open|final|static|async|override|readonly|sealed|virtual|partial|unsafe|inline|extern|local|fileprivate|mutating|synchronized|native)\s+)*"
_TYPES = {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "trait": "trait", "protocol": "interface", "record": "record", "namespace": "module", "module": "module", "extension": "extension", "union": "union", "actor": "class", "type": "type-alias"}
_JS = [(rf"{_MODS}(class|interface|enum|namespace)\s+({_ID})", None), (rf"{_MODS}(type)\s+({_ID})\s*(?:<[^=]*>)?=", None), (rf"{_MODS}function\s*\*?\s*({_ID})\s*[(<]", "function"), (rf"{_MODS}(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>", "function"), (rf"{_MODS}(?:const|let|var)\s+({_ID})\b", "variable"), (rf"{_MODS}(?:get\s+|set\s+)?({_ID})\s*\([^;{{}}]*\)\s*(?::[^;{{}}]+)?\{{", "method")]
_C_LIKE = [(rf"{_MODS}(class|interface|enum|struct|record|namespace|union)\s+(?:class\s+)?({_ID})", None), (rf"{_MODS}(?:[\w:<>,\[\]?*&.]+[\s*&]+)+((?:{_ID}::)?~?{_ID})\s*\([^;{{}}=]*\)\s*(?:const|noexcept|throws\s[\w,\s.]+|override|:[^{{;]*)?\s*\{{", "function")]
# Fixed values: (pattern, kind); no kind means that group 1 is the keyword and group 2 the name.
SPECS = {
    **dict.fromkeys(["typescript", "tsx", "javascript", "jsx"], _JS),
    "go": [(r"func\s+\([^)]*\)\s*(\w+)\s*[\[(]", "method"), (r"func\s+(\w+)\s*[\[(]", "function"), (r"type\s+(\w+)\s+struct\b", "struct"), (r"type\s+(\w+)\s+interface\b", "interface"), (r"type\s+(\w+)\b", "type-alias"), (r"(?:var|const)\s+(\w+)\b", "variable")],
    **dict.fromkeys(["java", "csharp", "c", "cpp"], _C_LIKE),
    "ruby": [(r"(class|module)\s+([A-Z]\w*)", None), (r"def\s+(?:self\.)?(\w+[?!=]?)", "method")],
    "lua": [(r"(?:local\s+)?function\s+([\w.:]+)\s*\(", "function"), (r"(?:local\s+)?([\w.]+)\s*=\s*function\b", "function")],
    "php": [(rf"{_MODS}(class|interface|trait|enum|namespace)\s+(\w+)", None), (rf"{_MODS}function\s+&?(\w+)\s*\(", "function")],
    "swift": [(rf"{_MODS}(class|struct|enum|protocol|extension|actor)\s+(\w+)", None), (rf"{_MODS}func\s+(\w+)\s*[(<]", "function"), (rf"{_MODS}(init)\b[?!]?\s*\(", "constructor")],
}
IMPORTS = {
    **dict.fromkeys(["typescript", "tsx", "javascript", "jsx"], [r"(?:import|export)\s+(?:[^'\";]+?\s+from\s+)?['\"]([^'\"]+)['\"]", r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"]),
    "go": [r"import\s+(?:\w+\s+)?\"([^\"]+)\"", r"(?m)^\s+(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$"],
    "java": [r"import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"],
    "csharp": [r"using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"],
    **dict.fromkeys(["c", "cpp"], [r"#\s*include\s*[<\"]([^>\"]+)[>\"]"]),
    "ruby": [r"require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]"],
    "lua": [r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]"],
    "php": [r"(?m)^\s*use\s+([\w\\]+)", r"(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"],
    "swift": [r"(?m)^\s*import\s+(?:\w+\s+)?([\w.]+)"],
}
_KEYWORDS = set("if for while switch catch return new else do try using lock foreach sizeof function typeof await match unless elif elsif when until case throw delete super".split())
_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_HASH_NOISE = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_DASH_NOISE = re.compile(r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def _block_end(code: str, at: int, lang: str) -> int:
    if lang in ("ruby", "lua"):
        depth = 1
        opens = r"\b(?:class|module|def|do|begin|case|if|unless|while)\b" if lang == "ruby" else r"\b(?:function|do|then)\b"
        for m in re.finditer(rf"(?m){'^[ \t]*' if lang == 'ruby' else ''}(?:{opens})|\bdo\b|\bend\b", code[at:]):
            depth += -1 if m[0].strip() == "end" else 1
            if depth <= 0:
                return at + m.end()
        return len(code)
    m = re.compile(r"[{;]").search(code, at - 1)
    if not m or m[0] == ";":
        return m.end() if m else len(code)
    depth = 0
    for b in re.finditer(r"[{}]", code[m.start() :]):
        depth += 1 if b[0] == "{" else -1
        if not depth:
            return m.start() + b.end()
    return len(code)


def extract(text: str, lang: str) -> list[dict]:
    noise = _HASH_NOISE if lang == "ruby" else _DASH_NOISE if lang == "lua" else _NOISE
    code = noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    plain = text.isascii()
    byte = (lambda k: k) if plain else (lambda k: len(text[:k].encode()))
    line = lambda k: text.count("\n", 0, k) + 1
    out, seen = [], set()
    for pattern, kind in SPECS[lang]:
        for m in re.finditer(rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:@\w+[^\n]*\n[ \t]*)*{pattern}", code):
            name = m[2] if kind is None else m[1]
            if name in _KEYWORDS or (spot := m.start(2 if kind is None else 1)) in seen:
                continue
            seen.add(spot)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            end = _block_end(code, m.end(), lang)
            head = text[start : min(end, m.end())].strip().rstrip("{").strip()
            mods = m[0].split()
            vis = "private" if {"private", "fileprivate", "local"}.intersection(mods) or name.startswith("_") or lang == "go" and name[:1].islower() else "protected" if "protected" in mods else "public"
            found = kind or _TYPES[m[1]]
            out.append({"fact": "definition", "name": re.split(r"[.:]+", name)[-1], "qualified": name, "kind": found, "visibility": vis, "signature": re.sub(r"\s+", " ", head), "documentation": None, "attributes": [], "body": re.findall(_ID, code[m.end() : end]) if found in ("function", "method") else [], "is_test": bool(re.match(r"(?i)test", name)), "start_byte": byte(start), "end_byte": byte(end), "start_line": line(start), "end_line": line(max(start, end - 1))})
    qualify(out)
    for pattern in IMPORTS[lang]:
        for m in re.finditer(pattern, text):
            path = m[1]
            glob = path.endswith(".*")
            out.append({"fact": "import", "name": None if glob else re.split(r"[./\\]+", path.rstrip("/"))[-1], "kind": "import", "import_path": path.removesuffix(".*"), "alias": None, "is_glob": glob, "is_public": False, "start_byte": byte(m.start()), "end_byte": byte(m.end()), "start_line": line(m.start()), "end_line": line(m.end() - 1)})
    for m in re.finditer(rf"(\.\s*|->\s*)?({_ID})\s*\(", code):
        if m[2] not in _KEYWORDS and m.start(2) not in seen:
            out.append({"fact": "reference", "name": m[2], "kind": "method" if m[1] else "call", "start_byte": byte(m.start(2)), "end_byte": byte(m.end(2)), "start_line": line(m.start(2)), "end_line": line(m.start(2))})
    return out


def qualify(defs: list[dict]) -> None:
    """Local qualified names by span containment; a function in a type is a method."""
    defs.sort(key=lambda d: (d["start_byte"], -d["end_byte"]))
    stack: list[dict] = []
    for d in defs:
        while stack and stack[-1]["end_byte"] <= d["start_byte"]:
            stack.pop()
        if stack:
            d["qualified"] = f"{stack[-1]['qualified']}.{d['name']}"
            if d["kind"] == "function" and stack[-1]["kind"] in ("class", "struct", "interface", "trait", "enum", "record", "extension"):
                d["kind"] = "constructor" if d["name"] == stack[-1]["name"] else "method"
        stack.append(d)
