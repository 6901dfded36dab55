"""Python files by the standard library's own parser."""

from __future__ import annotations

import ast
import re

from tessera.lang.model import Import, Node, Parsed, Ref


def visibility(name: str) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else "public"


def module_of(path: str) -> str:
    bare = re.sub(r"\.py$", "", path)
    return re.sub(r"(^|/)__init__$", "", bare).replace("/", ".")


class _Reader:
    def __init__(self, path: str, source: str):
        self.source = source
        self.lines = source.splitlines(keepends=True)
        self.offsets = [0]
        for line in self.lines:
            self.offsets.append(self.offsets[-1] + len(line.encode()))
        self.out = Parsed(path, "python", module_of(path))

    def add(self, node: ast.AST, kind: str, name: str | None = None, parent: int | None = None, first: int | None = None, **more) -> int:
        start = first or node.lineno
        a = self.offsets[start - 1] + (node.col_offset if first is None else 0)
        z = self.offsets[node.end_lineno - 1] + node.end_col_offset
        body = self.source.encode()[a:z].decode(errors="replace")
        self.out.nodes.append(Node(name, kind, start, node.end_lineno, a, z, body, parent, visibility=visibility(name) if name else None, comment=self.comment_above(start), **more))
        return len(self.out.nodes) - 1

    def comment_above(self, line: int) -> str | None:
        """Contiguous comment lines above, with at most one blank line between."""
        at, blank, found = line - 2, 0, []
        while at >= 0:
            text = self.lines[at].strip()
            if text.startswith("#"):
                found.append(text.lstrip("#").strip())
            elif not text and not found and not blank:
                blank = 1
            else:
                break
            at -= 1
        return "\n".join(reversed(found)) or None

    def header(self, node) -> str:
        first = node.body[0]
        a = self.offsets[node.lineno - 1] + node.col_offset
        line, col = (first.decorator_list[0].lineno, 0) if getattr(first, "decorator_list", None) else (first.lineno, first.col_offset)
        text = self.source.encode()[a : self.offsets[line - 1] + col].decode(errors="replace")
        depth, cut = 0, len(text)
        for i, c in enumerate(text):
            depth += (c in "([{") - (c in ")]}")
            if c == ":" and depth == 0:
                cut = i
                break
        return text[:cut].strip()

    def parameters(self, f) -> list[dict]:
        a = f.args
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        rows = [("", p, d) for p, d in zip(plain, defaults)]
        rows += [("*", a.vararg, None)] if a.vararg else []
        rows += [("", p, d) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
        rows += [("**", a.kwarg, None)] if a.kwarg else []
        return [{"name": s + p.arg, "type": ast.unparse(p.annotation) if p.annotation else None, "default": ast.unparse(d) if d else None} for s, p, d in rows]

    def function(self, node, parent: int | None, kind: str) -> None:
        decorators = [ast.unparse(d) for d in node.decorator_list]
        first = node.decorator_list[0].lineno if node.decorator_list else None
        self.add(
            node, kind, node.name, parent, first, docstring=ast.get_docstring(node), signature=self.header(node), parameters=self.parameters(node), decorators=decorators,
            return_type=ast.unparse(node.returns) if node.returns else None, modifiers=["async"] if isinstance(node, ast.AsyncFunctionDef) else [],
        )

    def assignment(self, node, parent: int | None) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        for t in targets:
            for one in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                if isinstance(one, (ast.Name, ast.Attribute, ast.Subscript)):
                    name = ast.unparse(one)
                    self.add(node, "constant" if re.match("^[A-Z][A-Z0-9_]*$", name) else "variable", name, parent)

    def imports(self, node, parent: int | None) -> None:
        raw = ast.get_source_segment(self.source, node) or ""
        self.add(node, "import", None, parent)
        if isinstance(node, ast.Import):
            for a in node.names:
                self.out.imports.append(Import(raw, a.name, a.asname))
            return
        base = node.module or ""
        if node.level:
            parts = self.out.path.split("/")[: -node.level]
            base = ".".join([*parts, *([node.module] if node.module else [])])
        for a in node.names:
            if a.name == "*":
                self.out.imports.append(Import(raw, base, None, True, external=not node.level))
            else:
                self.out.imports.append(Import(raw, base, a.asname or a.name, bool(node.level), external=not node.level))

    def statements(self, body: list[ast.stmt], parent: int | None, within: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(n, parent, "method" if within == "class" else "function")
            elif isinstance(n, ast.ClassDef):
                first = n.decorator_list[0].lineno if n.decorator_list else None
                at = self.add(n, "class", n.name, parent, first, docstring=ast.get_docstring(n), signature=self.header(n), decorators=[ast.unparse(d) for d in n.decorator_list])
                self.statements(n.body, at, "class")
            elif isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                self.assignment(n, parent)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                self.imports(n, parent)
            elif isinstance(n, ast.If):
                at = self.add(n, "if", None, parent, signature="if " + ast.unparse(n.test))
                self.statements(n.body, at, within)
                self.statements(n.orelse, at, within)
            elif isinstance(n, (ast.Try, ast.TryStar)):
                at = self.add(n, "trycatch", None, parent)
                for part in (n.body, *(h.body for h in n.handlers), n.orelse, n.finalbody):
                    self.statements(part, at, within)
            elif isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) and n is body[0]:
                continue  # a docstring
            elif within != "class" or not isinstance(n, ast.Pass):
                self.add(n, "literal", None, parent)

    def calls(self, tree: ast.AST) -> None:
        for n in ast.walk(tree):
            if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
                raw = ast.unparse(n.func)
                self.out.refs.append(Ref(raw.rsplit(".", 1)[-1], raw, "call"))


def parse(path: str, content: bytes) -> Parsed:
    source = content.decode("utf-8", "replace")
    reader = _Reader(path, source)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        reader.out.nodes.append(Node(None, "literal", 1, source.count("\n") + 1, 0, len(content), source))
        return reader.out.finish()
    reader.out.docstring = ast.get_docstring(tree)
    reader.statements(tree.body, None, "module")
    reader.calls(tree)
    return reader.out.finish()
