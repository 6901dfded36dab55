"""Markdown and plain text."""

from __future__ import annotations

import re

from tessera.lang.model import Node, Parsed
from tessera.operators.chunking import chunk_spans

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^\s*(```|~~~)")


def _add(out: Parsed, text: str, a: int, z: int, parent: int | None, title: str | None, most: int, least: int) -> int:
    """A literal node; one without sections of its own that is too long has its chunks as children."""
    byte = lambda k: len(text[:k].encode())
    row = lambda k: text.count("\n", 0, k) + 1
    out.nodes.append(Node(None, "literal", row(a), row(max(a, z - 1)), byte(a), byte(z), text[a:z], parent, docstring=title, visibility="public"))
    return len(out.nodes) - 1


def _chunks(out: Parsed, text: str, a: int, z: int, parent: int | None, most: int, least: int) -> None:
    spans = chunk_spans(text[a:z], most, least)
    if len(spans) > 1 or parent is None:
        for s, e in spans:
            if e > s:
                _add(out, text, a + s, a + e, parent, None, most, least)


def parse_text(path: str, content: bytes, most: int = 512, least: int = 64) -> Parsed:
    """Chunks as top-level nodes."""
    out = Parsed(path, "text", None)
    text = content.decode("utf-8", "replace")
    _chunks(out, text, 0, len(text), None, most, least)
    return out.finish()


def parse_markdown(path: str, content: bytes, most: int = 512, least: int = 64) -> Parsed:
    """Sections by heading, nested by level; the heading is the node's docstring."""
    out = Parsed(path, "markdown", None)
    text = content.decode("utf-8", "replace")
    heads: list[tuple[int, int, str]] = []
    at, fenced = 0, False
    for line in text.splitlines(keepends=True):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and (m := _HEADING.match(line.rstrip("\r\n"))):
            heads.append((at, len(m[1]), m[2]))
        at += len(line)
    if heads and text[: heads[0][0]].strip() or not heads and text.strip():
        top = _add(out, text, 0, heads[0][0] if heads else len(text), None, None, most, least)
        _chunks(out, text, 0, heads[0][0] if heads else len(text), top, most, least)
    above: list[tuple[int, int]] = []
    for k, (a, level, title) in enumerate(heads):
        end = next((b for b, other, _ in heads[k + 1 :] if other <= level), len(text))
        while above and above[-1][0] >= level:
            above.pop()
        node = _add(out, text, a, end, above[-1][1] if above else None, title, most, least)
        above.append((level, node))
        if k + 1 == len(heads) or heads[k + 1][1] <= level:
            _chunks(out, text, a, end, node, most, least)
    return out.finish()
