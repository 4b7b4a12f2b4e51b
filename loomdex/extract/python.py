"""Python facts by the standard parser."""

from __future__ import annotations

import ast

from . import lexical


def extract(text: str) -> tuple[list[dict], str]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return lexical.extract(text.encode()), "degraded"
    lines = text.splitlines(keepends=True)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()))
    out: list[dict] = []

    def span(n, first=None):
        a = first or n
        return {"start_byte": starts[a.lineno - 1] + a.col_offset, "end_byte": starts[n.end_lineno - 1] + n.end_col_offset, "start_line": a.lineno, "end_line": n.end_lineno}

    def names(nodes):
        return [x.id if isinstance(x, ast.Name) else x.attr for n in nodes for x in ast.walk(n) if isinstance(x, (ast.Name, ast.Attribute))]

    def define(n, kind, name, scope, sign=None, doc=None, marks=(), body=(), test=False, first=None):
        out.append({"fact": "definition", "name": name, "qualified": ".".join([*scope, name]), "kind": kind, "visibility": "private" if name.startswith("_") and not name.endswith("__") else "public", "signature": sign, "documentation": doc, "attributes": list(marks), "body": list(body), "is_test": test, **span(n, first)})

    def visit(n, scope, inside):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            function = not isinstance(n, ast.ClassDef)
            marks = [ast.unparse(d) for d in n.decorator_list]
            kind = "class" if not function else "function" if inside != "class" else "constructor" if n.name == "__init__" else "method"
            head = f"{'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "") if function else f"class {n.name}" + (f"({', '.join(map(ast.unparse, n.bases))})" if n.bases else "")
            define(n, kind, n.name, scope, head, ast.get_docstring(n), marks, names([c for c in n.body if not isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]), n.name.startswith(("test_", "Test")), n.decorator_list[0] if n.decorator_list else None)
            for d in n.decorator_list:
                visit(d, scope, inside)
            for c in [*(n.args.defaults if function else n.bases), *n.body]:
                visit(c, [*scope, n.name], "function" if function else "class")
            return
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            base = "." * n.level + (n.module or "") if isinstance(n, ast.ImportFrom) else ""
            for a in n.names:
                glob = a.name == "*"
                path = base if glob else f"{base}{'.' if base.strip('.') else ''}{a.name}" if base else a.name
                out.append({"fact": "import", "name": None if glob else a.name.rpartition(".")[2], "kind": "from" if isinstance(n, ast.ImportFrom) else "import", "import_path": path, "alias": a.asname, "is_glob": glob, "is_public": not scope, **span(n)})
            return
        if isinstance(n, (ast.Assign, ast.AnnAssign)) and inside != "function":
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name):
                    define(n, "constant" if t.id.isupper() else "field" if inside == "class" else "variable", t.id, scope, None)
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                out.append({"fact": "reference", "name": f.id, "kind": "call", **span(f)})
            elif isinstance(f, ast.Attribute):
                out.append({"fact": "reference", "name": f.attr, "kind": "method", **span(f)})
        for c in ast.iter_child_nodes(n):
            visit(c, scope, inside)

    try:
        for n in tree.body:
            visit(n, [], "module")
    except RecursionError:
        return lexical.extract(text.encode()), "degraded"
    return out, "complete"
