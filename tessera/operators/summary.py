"""Summaries of symbols and files, rendered from nodes."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Mode(str, Enum):
    SKIP = "skip"
    DEFINITION = "definition"
    DOCUMENTATION = "documentation"
    SOURCE = "source"


#: Line comment, and what stands for a body that is left out.
_STYLE = {"python": ("#", ":\n{pad}    ..."), "go": ("//", " { ... }"), "java": ("//", " { ... }"), "javascript": ("//", " { ... }"), "typescript": ("//", " { ... }")}
_WHOLE = ("constant", "variable", "property", "import", "package", "type_alias", "method_def", "literal")


def _padded(text: str, pad: str) -> str:
    return "\n".join(pad + line if line else line for line in text.splitlines())


def symbol_text(node: dict, children: dict[str, list[dict]], language: str | None, docs: bool = False, depth: int = 0, only: set[str] | None = None) -> str:
    """Header of a symbol with its members; bodies are left out. `only` restricts members to those on the way to a hit."""
    mark, rest = _STYLE.get(language or "", ("#", ""))
    pad = "    " * depth
    if language in (None, "text", "markdown"):
        return node.get("body") or ""
    lines = []
    if docs and node.get("comment"):
        lines.append(_padded("\n".join(f"{mark} {x}" for x in node["comment"].splitlines()), pad))
    if docs and node.get("docstring") and language != "python":
        lines.append(_padded("\n".join(f"{mark} {x}" for x in node["docstring"].splitlines()), pad))
    lines += [f"{pad}@{d}" for d in node.get("decorators") or []]
    below = [c for c in children.get(node.get("id"), []) if (only is None or c.get("id") in only) and (docs or c.get("kind") != "comment")]
    if node["kind"] in _WHOLE or not node.get("signature"):
        if not below or node["kind"] in _WHOLE:
            lines.append(_padded((node.get("body") or "").strip(), pad))
            return "\n".join(lines)
    head = pad + " ".join((node.get("signature") or "").split())
    if not below:
        if docs and node.get("docstring") and language == "python":
            lines += [head + ":", _padded('"""' + node["docstring"] + '"""', pad + "    "), pad + "    ..."]
        else:
            lines.append(head + rest.replace("{pad}", pad))
        return "\n".join(lines)
    lines.append(head + (":" if language == "python" else " {"))
    if docs and node.get("docstring") and language == "python":
        lines.append(_padded('"""' + node["docstring"] + '"""', pad + "    "))
    lines += [symbol_text(c, children, language, docs, depth + 1, only) for c in below]
    if language != "python":
        lines.append(pad + "}")
    return "\n".join(lines)


def _forest(rows: list[dict]) -> tuple[list[dict], dict[str, list[dict]]]:
    known = {r["id"] for r in rows}
    children: dict[str, list[dict]] = {}
    tops = []
    for r in sorted(rows, key=lambda r: (r["start_line"], r["start_byte"])):
        if r["parent_id"] in known:
            children.setdefault(r["parent_id"], []).append(r)
        else:
            tops.append(r)
    return tops, children


def hit_text(hit: str, rows: list[dict], language: str | None, docs: bool = False) -> str:
    """A hit within its ancestors, which show only the way to it. rows: the nodes of its file."""
    by = {r["id"]: r for r in rows}
    _, children = _forest(rows)
    way, at = [hit], by[hit]["parent_id"]
    while at in by and by[at]["kind"] != "literal":
        way.append(at)
        at = by[at]["parent_id"]
    below = [hit]
    for x in below:
        below += [c["id"] for c in children.get(x, [])]
    return symbol_text(by[way[-1]], children, language, docs, only=set(way) | set(below))


def file_summaries(files: DataFrame, nodes: DataFrame, paths: list[str], mode: Mode = Mode.DEFINITION, contents: DataFrame | None = None) -> DataFrame:
    """(path, summary) of the files that are known, in one pass over their nodes; a group holds the nodes of one file.

    A file without a language, or any file in source mode, is shown as it is,
    from `contents` (path, content). Skip gives nothing.
    """
    mode = Mode(mode)
    spark = files.sparkSession
    if mode is Mode.SKIP or not paths:
        return spark.createDataFrame([], "path string, summary string")
    wanted = files.where(F.col("path").isin(paths)).select("path", "language")
    raw = wanted if mode is Mode.SOURCE else wanted.where(F.col("language").isNull())
    out = None
    if contents is not None:
        out = contents.select("path", F.decode("content", "UTF-8").alias("summary")).join(raw.select("path"), "path", "left_semi")
    if mode is Mode.SOURCE:
        return out if out is not None else spark.createDataFrame([], "path string, summary string")
    docs = mode is Mode.DOCUMENTATION
    columns = ["id", "parent_id", "path", "kind", "signature", "body", "docstring", "comment", "decorators", "start_line", "start_byte"]
    some = nodes.select(*columns).join(wanted.where(F.col("language").isNotNull()), "path")

    def render(frame):
        import pandas as pd

        rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
        for r in rows:
            r["decorators"] = list(r["decorators"]) if r["decorators"] is not None else []
        tops, children = _forest(rows)
        text = "\n".join(symbol_text(t, children, rows[0]["language"], docs) for t in tops if docs or t["kind"] != "comment")
        return pd.DataFrame({"path": [rows[0]["path"]], "summary": [text]})

    shown = some.groupBy("path").applyInPandas(render, "path string, summary string")
    return shown if out is None else shown.unionByName(out)
