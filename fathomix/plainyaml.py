"""The part of YAML that settings need: nested mappings, lists of scalars, quoted and plain scalars, comments."""

from __future__ import annotations

import json
import re
from typing import Any

_SPECIAL = re.compile(r"^$|^[\s\-?:,\[\]{}#&*!|>'\"%@`]|: |\s#|:$|\s$")
_WORDS = {"true": True, "false": False, "null": None, "~": None, "": None}


def scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] == '"':
        return json.loads(text[: text.rindex('"') + 1])
    if text[:1] == "'":
        return text[1 : text.rindex("'")].replace("''", "'")
    text = re.split(r"(?:^|\s)#", text, maxsplit=1)[0].strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [scalar(x) for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)""", text[1:-1]) if x.strip()]
    if text == "{}":
        return {}
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def load(text: str) -> dict[str, Any]:
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("#", "---"))]

    def block(at: int, indent: int) -> tuple[Any, int]:
        if at < len(lines) and lines[at][1].startswith("-"):
            items = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                items.append(scalar(lines[at][1][1:]))
                at += 1
            return items, at
        out: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == indent:
            key, sign, rest = lines[at][1].partition(":")
            if not sign:
                raise ValueError(f"no setting: {lines[at][1]}")
            at += 1
            if rest.split("#")[0].strip() or rest.strip()[:1] in ("'", '"'):
                out[str(scalar(key))] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
                out[str(scalar(key))], at = block(at, lines[at][0])
            else:
                out[str(scalar(key))] = None
        return out, at

    if not lines:
        return {}
    out, at = block(0, lines[0][0])
    if at < len(lines) or not isinstance(out, dict):
        raise ValueError(f"wrong indentation: {lines[min(at, len(lines) - 1)][1]}")
    return out


def _shown(value: Any) -> str:
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False) if _SPECIAL.search(value) or not isinstance(scalar(value), str) else value
    return json.dumps(value)


def dump(values: dict[str, Any], indent: int = 0) -> str:
    out, pad = "", " " * indent
    for key, value in values.items():
        if isinstance(value, dict) and value:
            out += f"{pad}{key}:\n{dump(value, indent + 2)}"
        elif isinstance(value, list) and value:
            out += f"{pad}{key}:\n" + "".join(f"{pad}  - {_shown(x)}\n" for x in value)
        else:
            out += f"{pad}{key}: {_shown(value)}\n"
    return out
