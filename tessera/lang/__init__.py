"""Source files as nodes, imports and references."""

from __future__ import annotations

from tessera.lang import braces, markup, python
from tessera.lang.model import Parsed

#: Suffix to language; a later entry may replace an earlier one.
SUFFIXES = {
    ".py": "python", ".go": "go", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".md": "markdown", ".markdown": "markdown", ".txt": "text",
}

PARSERS = {
    "python": python.parse,
    "go": braces.parser("go"),
    "java": braces.parser("java"),
    "javascript": braces.parser("javascript"),
    "typescript": braces.parser("typescript"),
    "markdown": markup.parse_markdown,
    "text": markup.parse_text,
}


def language_of(path: str, suffixes: dict[str, str] = SUFFIXES) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return suffixes.get("." + name.rsplit(".", 1)[-1].lower()) if "." in name else None


def parse(path: str, content: bytes) -> Parsed | None:
    """The file's nodes, imports and references; None without a parser for it. A file that can't be parsed has one node that holds its text."""
    language = language_of(path)
    return PARSERS[language](path, content) if language else None
