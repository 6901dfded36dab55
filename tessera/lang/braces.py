"""Go, Java, JavaScript and TypeScript by a lexer that knows strings, comments and braces, and tables of declarations.

The lexer blanks out strings and comments, so patterns see code only; braces
give every declaration its extent and its parent.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tessera.lang.model import Import, Node, Parsed, Ref, dedented

_NAME = r"[A-Za-z_$][\w$]*"
_CONTROL = "if for while switch catch return new else do try function class func synchronized super this await typeof throw case delete void in of yield import require var const type".split()


def blanked(source: str) -> tuple[str, list[tuple[int, int]]]:
    """The source with strings and comments as spaces, and the extents of comments."""
    out, comments, i, n = list(source), [], 0, len(source)
    while i < n:
        c, two = source[i], source[i : i + 2]
        a = i
        if two == "//":
            i = source.find("\n", i)
            i = n if i < 0 else i
            comments.append((a, i))
        elif two == "/*":
            i = source.find("*/", i + 2)
            i = n if i < 0 else i + 2
            comments.append((a, i))
        elif c in "\"'`":
            i += 1
            while i < n and source[i] != c and (c == "`" or source[i] != "\n"):
                i += 1 + (source[i] == "\\")
            i = min(n, i + 1)
            for k in range(a + 1, max(a + 1, i - 1)):
                if out[k] != "\n":
                    out[k] = " "
            continue
        else:
            i += 1
            continue
        for k in range(a, i):
            if out[k] != "\n":
                out[k] = " "
    return "".join(out), comments


def closing(code: str, at: int) -> int:
    """End of the bracket that opens at `at`."""
    pairs = {"{": "}", "(": ")", "[": "]"}
    depth, a, z = 0, code[at], pairs[code[at]]
    for k in range(at, len(code)):
        depth += (code[k] == a) - (code[k] == z)
        if depth == 0:
            return k + 1
    return len(code)


_JS = [
    ("class", re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:export|default|abstract|declare)\s+)*)class\s+(?P<name>{_NAME})[^{{;]*(?P<open>\{{)")),
    ("function", re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:export|default|async|declare)\s+)*)function\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^(]*>)?\s*(?P<args>\()")),
    ("function", re.compile(rf"(?m)^[ \t]*(?P<mod>(?:export\s+)?)(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^)]*\)|{_NAME})\s*(?::[^=\n]+)?=>)")),
    ("constant", re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:export|declare)\s+)*)const\s+(?P<name>{_NAME})\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|{_NAME}\s*=>))")),
    ("variable", re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:export|declare)\s+)*)(?:let|var)\s+(?P<name>{_NAME})\s*(?::[^=;\n]+)?(?:=(?!\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>))|;)")),
]
_TS = [
    ("interface", re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:export|declare)\s+)*)interface\s+(?P<name>{_NAME})[^{{;]*(?P<open>\{{)")),
    ("enum", re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:export|declare|const)\s+)*)enum\s+(?P<name>{_NAME})\s*(?P<open>\{{)")),
    ("namespace", re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:export|declare)\s+)*)(?:namespace|module)\s+(?P<name>{_NAME})\s*(?P<open>\{{)")),
    ("type_alias", re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:export|declare)\s+)*)type\s+(?P<name>{_NAME})\s*(?:<[^=]*>)?\s*=")),
]
_MEMBER = re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:public|private|protected|static|async|abstract|readonly|override|get|set)\s+)*)\*?(?P<name>#?{_NAME})\??\s*(?:<[^(\n]*>)?(?P<args>\()")
_FIELD = re.compile(rf"(?m)^[ \t]*(?P<mod>(?:(?:public|private|protected|static|readonly|declare)\s+)*)(?P<name>#?{_NAME})[?!]?\s*(?::[^=;\n]+)?(?:=|;)")
_JAVA_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|transient|volatile|sealed)\s+)*"
_JAVA_ANNOTATIONS = r"(?:@[\w.]+(?:\([^)]*\))?\s+)*"
_JAVA = [
    (kind, re.compile(rf"(?m)^[ \t]*{_JAVA_ANNOTATIONS}(?P<mod>{_JAVA_MODS}){word}\s+(?P<name>{_NAME})[^{{;]*(?P<open>\{{)"))
    for kind, word in (("class", r"(?:class|record)"), ("interface", r"(?<!@)interface"), ("enum", "enum"), ("annotation", "@interface"))
]
_JAVA_METHOD = re.compile(rf"(?m)^[ \t]*{_JAVA_ANNOTATIONS}(?P<mod>{_JAVA_MODS})(?:<[^>]+>\s+)?(?P<type>[\w$.<>\[\],? ]+?\s+)?(?P<name>{_NAME})\s*(?P<args>\()")
_JAVA_FIELD = re.compile(rf"(?m)^[ \t]*{_JAVA_ANNOTATIONS}(?P<mod>{_JAVA_MODS})(?P<type>[\w$.]+(?:<[^;=]*>)?(?:\[\])*)\s+(?P<name>{_NAME})\s*(?:=|;)")
_GO = [
    ("function", re.compile(rf"(?m)^func\s+(?P<name>{_NAME})\s*(?:\[[^\]]*\])?(?P<args>\()")),
    ("method", re.compile(rf"(?m)^func\s+\(\s*(?:\w+\s+)?\*?(?P<of>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>{_NAME})\s*(?P<args>\()")),
    ("class", re.compile(rf"(?m)^(?:type\s+|\t(?=\w+\s+struct\b))(?P<name>{_NAME})(?:\[[^\]]*\])?\s+struct\s*(?P<open>\{{)")),
    ("interface", re.compile(rf"(?m)^(?:type\s+|\t(?=\w+\s+interface\b))(?P<name>{_NAME})(?:\[[^\]]*\])?\s+interface\s*(?P<open>\{{)")),
    ("type_alias", re.compile(rf"(?m)^type\s+(?P<name>{_NAME})\b(?!(?:\[[^\]]*\])?\s+(?:struct|interface)\b)")),
    ("constant", re.compile(rf"(?m)^const\s+(?P<name>{_NAME})\b")),
    ("variable", re.compile(rf"(?m)^var\s+(?P<name>{_NAME})\b")),
]


class _Source:
    def __init__(self, path: str, content: bytes, language: str):
        self.path, self.language = path, language
        self.text = content.decode("utf-8", "replace")
        self.code, self.comments = blanked(self.text)
        self.out = Parsed(path, language, None)
        self.extents: list[tuple[int, int]] = []
        self.named: set[int] = set()
        self.depth = self._depths()

    def _depths(self) -> list[int]:
        depth, out = 0, []
        for c in self.code:
            if c == "}":
                depth -= 1
            out.append(depth)
            if c == "{":
                depth += 1
        return out

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def comment_before(self, at: int) -> str | None:
        """Comments directly above."""
        found = []
        for a, z in reversed([c for c in self.comments if c[1] <= at]):
            if self.text[z:at].strip() or self.text[z:at].count("\n") > 1:
                break
            found.append(self.text[a:z])
            at = a
        return dedented("\n".join(reversed(found))) if found else None

    def add(self, kind: str, name: str | None, a: int, z: int, parent: int | None = None, visibility: str | None = "public", modifiers: list[str] | None = None, head: int | None = None, **more) -> int:
        a += len(self.code[a:z]) - len(self.code[a:z].lstrip())
        signature = self.text[a : head if head is not None else z].split("\n")[0 if head is None else slice(None)]
        signature = " ".join(signature if isinstance(signature, list) else [signature]).strip().rstrip("{;").strip()
        byte = lambda k: len(self.text[:k].encode())
        self.out.nodes.append(Node(name, kind, self.line(a), self.line(max(a, z - 1)), byte(a), byte(z), self.text[a:z], parent, visibility=visibility, modifiers=modifiers or [], signature=signature, docstring=self.comment_before(a), **more))
        self.extents.append((a, z))
        return len(self.out.nodes) - 1

    def end_of_statement(self, at: int) -> int:
        """Where a statement ends: a semicolon, or a line end outside brackets."""
        k = at
        while k < len(self.code):
            if self.code[k] in "({[":
                k = closing(self.code, k)
                continue
            if self.code[k] == ";":
                return k + 1
            if self.code[k] == "\n" and not re.match(r"\s*(?:[.?:&|+*/=]|=>)", self.code[k:]) and not re.search(r"(?:=>|[=,|&+(:])\s*$", self.code[at:k]):
                return k
            k += 1
        return k

    def body_after(self, at: int) -> tuple[int, int] | None:
        """The braces that follow a parameter list, if it has a body."""
        k = closing(self.code, at)
        m = re.compile(r"[^{};=]*").match(self.code, k)
        k = m.end() if m else k
        return (k, closing(self.code, k)) if k < len(self.code) and self.code[k] == "{" else None

    def parameters(self, at: int) -> list[dict]:
        inner = self.text[at + 1 : closing(self.code, at) - 1]
        parts, depth, held = [], 0, ""
        for c in inner:
            depth += (c in "([{<") - (c in ")]}>")
            if c == "," and depth == 0:
                parts.append(held)
                held = ""
            else:
                held += c
        return [{"name": p.strip()} for p in [*parts, held] if p.strip()]


def _shown(name: str, modifiers: list[str], language: str) -> str:
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    for v in ("private", "protected", "public"):
        if v in modifiers:
            return v
    if name.startswith("#"):
        return "private"
    return "package" if language == "java" else "public"


def _members(s: _Source, parent: int, a: int, z: int, kind: str) -> None:
    """Members of a class, interface or enum whose braces are a..z."""
    inside = s.depth[a] + 1 if a < len(s.depth) else 1
    java = s.language == "java"
    if kind == "enum":
        stop = s.code.find(";", a, z)
        for m in re.finditer(rf"(?:^|[,{{])\s*({_NAME})(?=\s*(?:\([^)]*\)|=[^,}}]*|\{{|,|\}}|;|$))", s.code[a : stop if java and stop > 0 else z]):
            if s.depth[a + m.start(1)] == inside:
                s.named.add(a + m.start(1))
                s.add("constant", m[1], a + m.start(1), a + m.end(1), parent)
    owner = s.out.nodes[parent].name
    for m in (_JAVA_METHOD if java else _MEMBER).finditer(s.code, a + 1, z):
        name = m["name"]
        if s.depth[m.start("name")] != inside or name in _CONTROL or (java and not m["type"] and name != owner) or (java and (m["type"] or "").strip() in ("new", "return", "else", "throw")):
            continue
        s.named.add(m.start("name"))
        body = s.body_after(m.start("args"))
        end = body[1] if body else s.end_of_statement(closing(s.code, m.start("args")) - 1)
        mods = m["mod"].split()
        s.add("method" if body else "method_def", name, m.start(), end, parent, "public" if kind == "interface" else _shown(name, mods, s.language), mods, body[0] if body else None, parameters=s.parameters(m.start("args")))
    for m in (_JAVA_FIELD if java else _FIELD).finditer(s.code, a + 1, z):
        name, mods = m["name"], m["mod"].split()
        if s.depth[m.start("name")] != inside or name in _CONTROL or (java and m["type"] in _CONTROL):
            continue
        s.add("constant" if {"static", "final"} <= set(mods) else "property", name, m.start(), s.end_of_statement(m.end() - 1), parent, _shown(name, mods, s.language), mods)


def _go_members(s: _Source, parent: int, a: int, z: int, kind: str) -> None:
    at = a + 1
    for line in s.code[a + 1 : z - 1].split("\n"):
        text = line.strip()
        if text and s.depth[at + line.index(text[0])] == s.depth[a] + 1:
            start = at + line.index(text[0])
            if kind == "interface" and (m := re.match(rf"({_NAME})\s*\(", text)):
                s.named.add(start)
                s.add("method_def", m[1], start, start + len(text), parent, _shown(m[1], [], "go"))
            elif kind == "class":
                m = re.match(rf"((?:{_NAME}\s*,\s*)*{_NAME})\s+[\[\]*\w.(]", text) or re.match(r"\*?(?:\w+\.)?(\w+)\s*(?:`|$)", text)
                for name in re.split(r"\s*,\s*", m[1]) if m else []:
                    s.add("property", name, start, start + len(text), parent, _shown(name, [], "go"))
        at += len(line) + 1


def _imports(s: _Source) -> None:
    folder = s.path.rsplit("/", 1)[0] if "/" in s.path else ""
    if s.language == "go":
        for m in re.finditer(r'(?m)^import\s+(?:\(([^)]*)\)|((?:[\w.]+\s+)?"[^"]*"))', s.text):
            for one in re.finditer(r'(?m)(?:^|\s)([\w.]+\s+)?"([^"]+)"', m[1] or m[2]):
                alias = (one[1] or "").strip() or None
                s.out.imports.append(Import(one[0].strip(), one[2], None if alias == "." else alias, alias == "."))
                s.add("import", None, m.start(), m.end()) if m[2] or one.start() == 0 else None
        return
    if s.language == "java":
        for m in re.finditer(r"(?m)^import\s+(static\s+)?([\w.]+)(\.\*)?\s*;", s.code):
            s.out.imports.append(Import(m[0], m[2], None, bool(m[3])))
            s.add("import", None, m.start(), m.end())
        return
    shape = re.compile(r"""(?m)^[ \t]*(?:import\s+(?:type\s+)?(?P<what>[^'"();]+?)\s+from\s+|import\s+|export\s+(?P<again>\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+|(?:const|let|var|import)\s+(?P<bound>[\w{},\s:]+?)\s*=\s*require\(\s*)['"](?P<path>[^'"]+)['"]""")
    for m in shape.finditer(s.text):
        path = m["path"]
        local = path.startswith(".")
        target = path
        if local:
            parts = folder.split("/") if folder else []
            for p in path.split("/"):
                if p == "..":
                    parts = parts[:-1]
                elif p not in (".", ""):
                    parts.append(p)
            target = "/".join(parts)
        what = (m["what"] or m["bound"] or "").strip()
        alias = re.sub(r"^\*\s+as\s+", "", what) if re.match(rf"^(?:\*\s+as\s+)?{_NAME}$", what) else None
        s.out.imports.append(Import(m[0].strip(), target.replace("/", ".") if local else path, alias, external=not local, physical_path=target if local else None))
        s.add("import", None, m.start(), m.end())


def _refs(s: _Source) -> None:
    for m in re.finditer(rf"(?<![\w$.#@])(new\s+)?({_NAME}(?:\s*\??\.\s*{_NAME})*)\s*(?:<[\w\s,.]*>)?\(", s.code):
        raw = re.sub(r"\s|\?", "", m[2])
        last = raw.rsplit(".", 1)[-1]
        before = s.code[: m.start()].rstrip()[-8:]
        if last in _CONTROL or re.search(r"(?:func|function|\bclass)$", before) or m.start(2) in s.named:
            continue
        s.out.refs.append(Ref(last, raw, "type" if m[1] and s.language == "java" else "call"))
    if s.language in ("java", "typescript", "go"):
        shape = {"java": r"\b(?:extends|implements|throws)\s+([A-Z][\w.]*)", "typescript": r"(?:\b(?:extends|implements)\s+|:\s*)([A-Z][\w.]*)", "go": r"(?:\[\]|\*|\bmap\[\w+\]|\s)([A-Z]\w*|\w+\.[A-Z]\w*)\s*\{"}[s.language]
        for m in re.finditer(shape, s.code):
            s.out.refs.append(Ref(m[1].rsplit(".", 1)[-1], m[1], "type"))


def _go_blocks(s: _Source) -> None:
    """Names in grouped const and var declarations."""
    for m in re.finditer(r"(?m)^(const|var)\s*(\()", s.code):
        z = closing(s.code, m.start(2))
        at = m.end()
        for line in s.code[m.end() : z - 1].split("\n"):
            if one := re.match(rf"\s*({_NAME}(?:\s*,\s*{_NAME})*)", line):
                for name in re.split(r"\s*,\s*", one[1]):
                    s.add("constant" if m[1] == "const" else "variable", name, at, at + len(line), None, _shown(name, [], "go"))
            at += len(line) + 1


def _parse(path: str, content: bytes, language: str) -> Parsed:
    s = _Source(path, content, language)
    m = None
    if language == "java":
        m = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", s.code)
        s.out.package = m[1] if m else None
    elif language == "go":
        m = re.search(r"(?m)^package\s+(\w+)", s.code)
        folder = path.rsplit("/", 1)[0] if "/" in path else ""
        s.out.package = folder or (m[1] if m else None)
    else:
        s.out.package = re.sub(r"\.\w+$", "", path).replace("/", ".")
    if m:
        s.add("package", None, m.start(), m.end())
    _imports(s)
    for kind, shape in {"go": _GO, "java": _JAVA, "javascript": _JS, "typescript": _TS + _JS}[language]:
        for m in shape.finditer(s.code):
            name, groups = m["name"], m.groupdict()
            s.named.add(m.start("name"))
            mods = (groups.get("mod") or "").split()
            if language != "java" and s.depth[m.start("name")] > 0:
                inner = next((i for i, ((a, z), n) in reversed(list(enumerate(zip(s.extents, s.out.nodes, strict=True)))) if a < m.start() < z and n.kind == "namespace"), None)
                if inner is None:
                    continue
            else:
                inner = None
            if language == "java" and s.depth[m.start("name")] > 0:
                inner = next((i for i, ((a, z), n) in reversed(list(enumerate(zip(s.extents, s.out.nodes, strict=True)))) if a < m.start() < z and n.kind in ("class", "interface", "enum")), None)
            if groups.get("open"):
                body = (m.start("open"), closing(s.code, m.start("open")))
            elif groups.get("args"):
                body = s.body_after(m.start("args"))
            else:
                body = None
            end = body[1] if body else s.end_of_statement(m.end() - 1)
            at = s.add(kind, name, m.start(), end, inner, _shown(name, mods, language), mods, body[0] if body else None, parameters=s.parameters(m.start("args")) if groups.get("args") else [], subtype=groups.get("of"))
            if body and kind in ("class", "interface", "enum", "annotation"):
                (_go_members if language == "go" else _members)(s, at, *body, kind)
    if language == "go":
        _go_blocks(s)
        classes = {n.name: i for i, n in enumerate(s.out.nodes) if n.kind == "class"}
        for n in s.out.nodes:
            if n.kind == "method" and n.subtype in classes:
                n.parent = classes[n.subtype]
    _refs(s)
    out = s.out.finish()
    if language == "go":
        for n in out.nodes:
            if n.kind == "method" and n.parent is None and n.subtype:
                n.fqn = f"{out.package}.{n.subtype}.{n.name}" if out.package else f"{n.subtype}.{n.name}"
    return out


def parser(language: str) -> Callable[[str, bytes], Parsed]:
    return lambda path, content: _parse(path, content, language)
