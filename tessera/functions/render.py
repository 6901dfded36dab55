"""Results as JSON or as text that people and models read."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import mimetypes
import re
from collections.abc import Callable

_FENCE = re.compile(r"^`{3,}", re.M)


def plain(value):
    """Rows, dataclasses and sets as dicts and lists."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    elif hasattr(value, "__dataclass_fields__"):
        value = {k: getattr(value, k) for k in value.__dataclass_fields__}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return sorted(value) if isinstance(value, (set, frozenset)) else value


def without_nulls(value):
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


def _other(value):
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def as_json(value) -> str:
    """JSON without nulls; letters beyond ASCII stay as they are."""
    return json.dumps(without_nulls(plain(value)), ensure_ascii=False, default=_other)


def scalar(value) -> str:
    if isinstance(value, (dict, list)):
        try:
            value = json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False, default=_other)
        except ValueError:
            value = str(value)
    elif isinstance(value, decimal.Decimal):
        value = str(value)
    return re.sub(r"\r\n?", "\n", str(value))


def line(key, value, most: int | None) -> str:
    """key: value, or the value between fences that don't occur in it if it has several lines."""
    text = scalar(value)
    if "\n" in text:
        ticks = "`" * max([3, *(len(m) + 1 for m in _FENCE.findall(text))])
        return f"{key}:\n{ticks}text\n{text}\n{ticks}"
    return f"{key}: {text[:most] + '…' if most is not None and len(text) > most else text}"


def as_text(value, most: int | None = None, between: str = "\n---\n") -> str:
    """Records of sorted lines; a list of other things is numbered."""
    value = plain(value)
    if isinstance(value, dict):
        records = [value]
    elif isinstance(value, list):
        records = value if all(isinstance(v, dict) for v in value) else [{"idx": i, "value": v} for i, v in enumerate(value)]
    else:
        records = [{"value": value}]
    return between.join("\n".join(line(k, r[k], most) for k in sorted(r, key=str)) for r in records)


def file_response(path: str | None, read: Callable[[str], bytes | None]) -> dict:
    """Status, type and body of a file: 400 without a path, 404 if unknown, 500 if it can't be read; text as it is, else base64."""
    if not path:
        return {"status": 400, "error": "a path is needed"}
    try:
        content = read(path)
    except OSError as why:
        return {"status": 500, "error": str(why)}
    if content is None:
        return {"status": 404, "error": f"not found: {path}"}
    kind = mimetypes.guess_type(path)[0]
    try:
        return {"status": 200, "content_type": kind or "text/plain", "encoding": "utf-8", "body": content.decode("utf-8")}
    except UnicodeDecodeError:
        return {"status": 200, "content_type": kind or "application/octet-stream", "encoding": "base64", "body": base64.b64encode(content).decode()}


def response_text(response: dict) -> str:
    """A response as a status line, headers, a blank line and the body."""
    names = {200: "OK", 400: "Bad Request", 404: "Not Found", 500: "Internal Server Error"}
    head = [f"{response['status']} {names[response['status']]}"]
    head += [f"{n}: {response[k]}" for n, k in (("Content-Type", "content_type"), ("Content-Encoding", "encoding")) if k in response]
    return "\n".join(head) + "\n\n" + response.get("body", response.get("error", ""))
