"""Ignore files: an ordered list of patterns, the last that matches decides."""

from __future__ import annotations

import re
from collections.abc import Iterable


def rewritten(line: str, folder: str) -> str | None:
    """A pattern of the ignore file in `folder`, relative to the root; None for comments and blank lines."""
    line = line.rstrip()
    if not line or line.lstrip().startswith("#"):
        return None
    mark, pattern = ("!", line[1:]) if line.startswith("!") else ("", line)
    pattern = pattern.replace("\\", "/")
    base = f"{folder}/" if folder else ""
    if not base:
        return mark + pattern
    if pattern.startswith("/"):
        return mark + base + pattern.lstrip("/")
    return mark + base + (pattern if "/" in pattern else "**/" + pattern)


def as_regex(pattern: str) -> str:
    """Regular expression of the paths that a pattern, without its mark, covers."""
    folder_only = pattern.endswith("/")
    body = pattern.strip("/")
    anchored = pattern.startswith("/") or "/" in body
    out, i = "", 0
    while i < len(body):
        if body[i : i + 3] == "**/" and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body[i:] == "**" and (i == 0 or body[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif body[i] == "*":
            while body[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            inner = body[i + 1 : j]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", j + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return f"^{'' if anchored else '(?:[^/]+/)*'}{out}{'/.*' if folder_only else '(?:/.*)?'}$"


class IgnoreRules:
    """Compiled rules of all ignore files of a tree."""

    def __init__(self, files: Iterable[tuple[str, str]]):
        """files: (folder relative to the root, content)."""
        self.rules: list[tuple[re.Pattern, bool]] = []
        for folder, content in sorted(files):
            for line in content.splitlines():
                if (p := rewritten(line, folder)) is not None:
                    self.rules.append((re.compile(as_regex(p.removeprefix("!"))), not p.startswith("!")))

    def ignored(self, path: str) -> bool:
        found = False
        for rule, hides in self.rules:
            if rule.match(path):
                found = hides
        return found
