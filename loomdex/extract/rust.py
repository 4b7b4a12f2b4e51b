"""Rust facts by a scanner: comments and literals are blanked, items are found by keyword, blocks by their braces."""

from __future__ import annotations

import bisect
import re

_BLANK = re.compile(r"//[^\n]*|r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.)|[^'\\\n])'", re.S)
_NAME = r"(?:r#)?[A-Za-z_][A-Za-z0-9_]*"
_ITEM = re.compile(rf"(?<![\w#])(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|extern\s*(?:\"[^\"]*\")?)\s+)*(?P<kw>fn|struct|enum|union|trait|mod|type|static|const|macro_rules\s*!|impl)\b(?:\s+(?:mut\s+)?(?P<name>{_NAME}))?")
_USE = re.compile(r"(?<!\w)(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?:use\s+(?P<tree>[^;]+);|extern\s+crate\s+(?P<crate>\w+)(?:\s+as\s+(?P<alias>\w+))?\s*;)")
_CALL = re.compile(rf"(?P<dot>\.\s*)?(?P<path>{_NAME}(?:\s*::\s*{_NAME})*)\s*(?:::\s*<[^<>()]*>\s*)?(?P<open>!?\s*[(\[{{])")
_WORDS = set("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type unsafe use where while Some Ok Err None".split())
# Kinds by keyword; attributes that mark tests.
_KINDS = {"struct": "struct", "enum": "enum", "union": "union", "trait": "trait", "mod": "module", "type": "type-alias", "static": "static", "const": "constant", "macro_rules": "macro"}
_TEST = re.compile(r"^(?:\w+::)*(?:test|rstest|test_case)\b")
_CFG_TEST = re.compile(r"^cfg\s*\(.*\btest\b")


def blank(text: str) -> str:
    """text with comments and literals replaced by spaces of the same length."""
    space = lambda s: re.sub(r"[^\n]", " ", s)
    out, at, depth = [], 0, 0
    for m in re.finditer(r"/\*|\*/|" + _BLANK.pattern, text, re.S):
        if m.start() < at:
            continue
        if depth or m[0] == "/*":
            if not depth:
                out.append(text[at : m.start()])
                at = m.start()
            depth += (m[0] == "/*") - (m[0] == "*/")
            if not depth:
                out.append(space(text[at : m.end()]))
                at = m.end()
            continue
        out += [text[at : m.start()], space(m[0])]
        at = m.end()
    out.append(space(text[at:]) if depth else text[at:])
    return "".join(out)


def expand(tree: str, prefix: str = "") -> list[tuple[str, str | None, str | None, bool]]:
    """(path, leaf, alias, glob) for each leaf of a use tree."""
    tree = tree.strip()
    join = lambda a, b: f"{a}::{b}" if a and b else a or b
    if tree.endswith("}") and "{" in tree:
        head, _, inner = tree.partition("{")
        head, parts, depth, cur = join(prefix, head.strip().removesuffix("::").strip()), [], 0, ""
        for c in inner[:-1]:
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(cur)
                cur = ""
            else:
                cur += c
        return [x for p in [*parts, cur] if p.strip() for x in expand(p, head)]
    path, _, alias = re.sub(r"\s+as\s+", "\0", tree).partition("\0")
    path = join(prefix, re.sub(r"\s", "", path))
    if path.endswith("::*") or path == "*":
        return [(path.removesuffix("*").removesuffix("::"), None, None, True)]
    if path.endswith("::self"):
        path = path.removesuffix("::self")
    return [(path, path.rpartition("::")[2], alias.strip() or None, False)]


def extract(text: str) -> tuple[list[dict], str]:
    code = blank(text)
    at_line = [0, *(m.end() for m in re.finditer("\n", text))]
    offset = [0]
    for line in text.split("\n"):
        offset.append(offset[-1] + len(line.encode()) + 1)
    plain = text.isascii()

    def byte(k):
        if plain:
            return k
        n = bisect.bisect_right(at_line, k) - 1
        return offset[n] + len(text[at_line[n] : k].encode())

    span = lambda i, j: {"start_byte": byte(i), "end_byte": byte(j), "start_line": bisect.bisect_right(at_line, i), "end_line": bisect.bisect_right(at_line, max(i, j - 1))}
    pair, stack, bad = {}, [], False
    for m in re.finditer(r"[{}()\[\]]", code):
        if m[0] in "{([":
            stack.append(m.start())
        elif stack and code[stack[-1]] == {"}": "{", ")": "(", "]": "["}[m[0]]:
            pair[stack.pop()] = m.start() + 1
        else:
            bad = True
    bad = bad or bool(stack)

    def end_of(i):
        """After an item's block or semicolon."""
        k = i
        while k < len(code):
            if code[k] == "{":
                return pair.get(k, len(code)), k
            if code[k] == ";":
                return k + 1, k
            k = pair.get(k, k + 1) if code[k] in "([" else k + 1
        return len(code), len(code)

    out, open_items, items = [], [], []
    for m in _ITEM.finditer(code):
        kw = m["kw"].replace(" ", "").removesuffix("!")
        if kw != "impl" and not m["name"] or kw in ("const", "static") and m["name"] in ("fn", "_"):
            continue
        end, head = end_of(m.end("kw") if kw == "impl" else m.end())
        items.append((m, kw, m.start(), end, head))
    for m, kw, start, end, head in items:
        while open_items and open_items[-1]["end"] <= start:
            open_items.pop()
        parent = open_items[-1] if open_items else None
        # attributes and documentation right above
        above, first = text[:start].rstrip(), start
        marks, doc = [], []
        while True:
            if above.endswith("]") and (a := re.search(r"#\[(?:[^\[\]]|\[[^\[\]]*\])*\]\Z", above)):
                marks.insert(0, a[0][2:-1].strip())
                above, first = above[: a.start()].rstrip(), a.start()
            elif d := re.search(r"(?:^|\n)[ \t]*///([^\n]*)\Z", above):
                doc.insert(0, d[1].strip())
                first = above.rindex("///")
                above = above[: d.start()].rstrip()
            else:
                break
        cfg = any(_CFG_TEST.match(a) for a in marks)
        testing = cfg or bool(parent and parent["testing"])
        item = {"end": end, "kw": kw, "testing": testing, "scope": parent["scope"] if parent else [], "trait": None}
        if kw == "impl":
            sign = re.sub(r"\s+", " ", code[m.end("kw") : head]).strip()
            if sign.startswith("<"):
                depth = 0
                for k, c in enumerate(sign):
                    depth += (c == "<") - (c == ">" and sign[k - 1] != "-")
                    if not depth:
                        sign = sign[k + 1 :].strip()
                        break
            sign = re.split(r"\bwhere\b", sign)[0].strip()
            what, _, of = sign.partition(" for ")
            bare = lambda s: re.sub(r"<.*", "", s).strip().lstrip("&").strip()
            item["scope"] = [*item["scope"], f"<{bare(of)} as {bare(what)}>" if of else bare(what)]
            item["trait"] = bare(what) if of else None
            open_items.append(item)
            continue
        name = m["name"]
        vis = re.sub(r"\s", "", m["vis"] or "")
        up = parent["kw"] if parent else None
        kind = {"impl": "method", "trait": "trait-method"}.get(up, "function") if kw == "fn" else _KINDS[kw]
        if kw == "type" and up in ("impl", "trait"):
            kind = "associated-type"
        item["scope"] = [*item["scope"], name.removeprefix("r#")]
        body = re.findall(_NAME, code[head:end]) if kw == "fn" else []
        out.append({"fact": "definition", "name": name.removeprefix("r#"), "qualified": "::".join(item["scope"]), "kind": kind, "visibility": "public" if vis == "pub" or up == "trait" or parent and parent["trait"] else f"restricted:{vis[4:-1]}" if vis else "private", "signature": re.sub(r"\s+", " ", text[start:head]).strip(), "documentation": "\n".join(doc) or None, "attributes": marks, "body": [b for b in body if b not in _WORDS], "is_test": kw == "fn" and any(_TEST.match(a) for a in marks) or testing, **span(first, end)})
        open_items.append(item)
    for m in _USE.finditer(code):
        public = bool(m["vis"])
        leaves = [(m["crate"], m["crate"], m["alias"], False)] if m["crate"] else expand(m["tree"])
        for path, leaf, alias, glob in leaves:
            out.append({"fact": "import", "name": leaf, "kind": "extern-crate" if m["crate"] else "use", "import_path": path, "alias": alias, "is_glob": glob, "is_public": public, **span(m.start(), m.end())})
    defined = {m.end("name") for m, *_ in items if m["name"]}
    for m in _CALL.finditer(code):
        path, macro = re.sub(r"\s", "", m["path"]), "!" in m["open"]
        leaf = path.rpartition("::")[2]
        if leaf in _WORDS or m.end("path") in defined or not macro and "(" not in m["open"]:
            continue
        if re.search(r"\b(?:fn|struct|enum|union|mod|trait)\s+\Z", code[max(0, m.start() - 12) : m.start()]):
            continue
        out.append({"fact": "reference", "name": leaf.removeprefix("r#"), "qualified": path if "::" in path else None, "kind": "macro" if macro else "method" if m["dot"] else "call", **span(m.start("path"), m.end("path"))})
    return out, "recovered" if bad else "complete"
