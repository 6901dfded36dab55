"""What parsers give."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Node:
    name: str | None
    kind: str
    start_line: int
    end_line: int
    start_byte: int
    end_byte: int
    body: str
    parent: int | None = None
    fqn: str | None = None
    subtype: str | None = None
    visibility: str | None = None
    exported: bool | None = None
    modifiers: list[str] = field(default_factory=list)
    signature: str | None = None
    parameters: list[dict] = field(default_factory=list)
    return_type: str | None = None
    decorators: list[str] = field(default_factory=list)
    docstring: str | None = None
    comment: str | None = None


@dataclass
class Import:
    raw: str
    virtual_path: str | None
    alias: str | None = None
    dot: bool = False
    external: bool = True
    physical_path: str | None = None


@dataclass
class Ref:
    name: str
    raw: str
    type: str
    to_package: str | None = None


@dataclass
class Parsed:
    path: str
    language: str
    package: str | None
    docstring: str | None = None
    nodes: list[Node] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)

    def finish(self) -> Parsed:
        """Qualified names, top-level exports, and the package that each reference leads to."""
        for n in self.nodes:
            if n.name is not None:
                above = self.nodes[n.parent].fqn if n.parent is not None else self.package
                n.fqn = f"{above}.{n.name}" if above else n.name
            if n.parent is None:
                n.exported = n.visibility != "private"
        for r in self.refs:
            r.to_package = r.to_package or bound(r.raw, self.imports)
        return self


def bound(raw: str, imports: list[Import]) -> str | None:
    """The first import whose alias, path, or last part of the path begins the name."""
    for i in imports:
        path = i.virtual_path or ""
        last = re.split(r"[./]", path)[-1] if path else ""
        for known in ([i.alias] if i.alias else [path, last]):
            if known and (raw == known or raw.startswith(known + ".")):
                return i.virtual_path
    return None


def dedented(comment: str) -> str:
    """A comment without its marks and common margin."""
    lines = []
    for line in comment.strip().splitlines():
        line = re.sub(r"^\s*(///?|#|/\*+|\*(?!/))\s?", "", line)
        lines.append(re.sub(r"\s*\*/\s*$", "", line).rstrip())
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)
