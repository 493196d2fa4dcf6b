"""Configurations: reading plain YAML and JSON, writing with comments, a schema, and views."""

from __future__ import annotations

import json
import re

COMPARISONS = ("<", "<=", ">", ">=", "==", "!=")
PROFILES = ("extreme", "standard", "relaxed")
_NOTES = {
    "languages": "thresholds by language; a language that isn't named has the defaults",
    "ignore_patterns": "files that no command reads", "use_gitignore": "whether .gitignore leaves files out too",
    "profile": "how much a function that tells a story may compute: extreme, standard or relaxed",
    "tree_shape": "bounds of folders, and layers, the outermost first", "import_graph": "cycles and stable dependencies",
    "narrative": "how code reads", "allowed_words": "words that names may hold besides those of the vocabulary",
}


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "[{" and text[-1:] in "]}" and len(text) > 1:
        if text[0] == "[":
            return [_scalar(x) for x in _split(text[1:-1])]
        return {k.strip().strip("\"'"): _scalar(v) for k, _, v in (x.partition(":") for x in _split(text[1:-1]))}
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    plain = {"": None, "~": None, "null": None, "true": True, "false": False}
    if text.lower() in plain:
        return plain[text.lower()]
    if re.fullmatch(r"[-+]?[0-9]+", text):
        return int(text)
    return float(text) if re.fullmatch(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][-+]?[0-9]+)?", text) else text


def _split(text: str) -> list[str]:
    """Parts by commas outside of brackets and quotes."""
    out, deep, quote, begin = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "," and not deep:
            out.append(text[begin:i])
            begin = i + 1
        else:
            deep += (c in "[{") - (c in "]}")
    return [x for x in [*out, text[begin:]] if x.strip()]


def _bare(line: str) -> str:
    """A line without its comment."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'[^']*'|[^\s:#"'\[{][^:#]*?)\s*:(?:\s+(.*)|)$""")


def parsed(text: str) -> dict:
    """JSON, or YAML of nested mappings, lists and plain, quoted and bracketed values; anchors, tags and text of several
    lines aren't known and are an error."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in map(_bare, text.splitlines()) if x.strip() and x.strip() != "---"]
    at = 0

    def block(indent: int):
        nonlocal at
        if lines[at][1].startswith(("- ", "-")) and (lines[at][1] == "-" or lines[at][1][1] == " "):
            items = []
            while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
                rest = lines[at][1][1:].strip()
                if not rest:
                    at += 1
                    items.append(block(lines[at][0]) if at < len(lines) and lines[at][0] > indent else None)
                elif _KEY.match(rest) and rest[0] not in "[{":
                    inner = indent + len(lines[at][1]) - len(rest)
                    lines[at] = (inner, rest)
                    items.append(block(inner))
                else:
                    at += 1
                    items.append(_scalar(rest))
            return items
        out: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            m = _KEY.match(lines[at][1])
            if not m:
                raise ValueError(f"{lines[at][1]!r} isn't a key and a value")
            if (m[2] or "")[:1] in ("&", "*", "!", "|", ">"):
                raise ValueError(f"{lines[at][1]!r}: anchors, tags and text of several lines aren't read")
            at += 1
            key = _scalar(m[1])
            if m[2]:
                out[key] = _scalar(m[2])
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                out[key] = block(lines[at][0])
            else:
                out[key] = None
        return out

    if not lines:
        return {}
    found = block(lines[0][0])
    if at < len(lines):
        raise ValueError(f"{lines[at][1]!r} stands at no level")
    return found


def as_yaml(value, comments: bool = False, indent: int = 0) -> str:
    pad, out = "  " * indent, []
    if isinstance(value, dict):
        for k, v in value.items():
            if comments and not indent and k in _NOTES:
                out.append(f"# {_NOTES[k]}")
            nested = isinstance(v, (dict, list)) and v
            out.append(f"{pad}{k}:" + ("" if nested else f" {json.dumps(v)}"))
            if nested:
                out.append(as_yaml(v, False, indent + 1).rstrip("\n"))
    else:
        for v in value:
            if isinstance(v, dict) and v:
                out.append(f"{pad}- " + as_yaml(v, False, indent + 1).strip())
            else:
                out.append(f"{pad}- {json.dumps(v)}")
    return "\n".join(out) + "\n"


def schema() -> dict:
    """A JSON Schema of configurations."""
    metric = {"type": "object", "required": ["type", "threshold"], "properties": {"type": {"type": "string"}, "threshold": {"type": "number"}, "comparison": {"enum": list(COMPARISONS)}, "enabled": {"type": "boolean"}}}
    lang = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "extensions": {"type": "array", "items": {"type": "string", "pattern": "^\\."}}, "metrics": {"type": "array", "items": metric}}}
    texts = {"type": "array", "items": {"type": "string"}}
    plain = {k: {"type": "object"} for k in ("tree_shape", "import_graph", "narrative")}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "properties": {"languages": {"type": "array", "items": lang}, "ignore_patterns": texts, "use_gitignore": {"type": "boolean"}, "profile": {"enum": list(PROFILES)}, "allowed_words": texts, **plain}}


def view(settings: dict, form: str, raw: str = "") -> str:
    """A configuration as summary, table, yaml, json, or raw, as it was written."""
    rows = [(lang["name"], m["type"], m.get("comparison", "<="), m["threshold"], m.get("enabled", True)) for lang in settings.get("languages") or () for m in lang.get("metrics") or ()]
    if form == "raw":
        return raw
    if form == "json":
        return json.dumps(settings, indent=2) + "\n"
    if form == "yaml":
        return as_yaml(settings)
    if form == "table":
        text = [("language", "metric", "", "threshold", "enabled"), *(tuple(map(str, r)) for r in rows)]
        widths = [max(len(r[k]) for r in text) for k in range(5)]
        return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in text) + "\n"
    counts = {lang["name"]: sum(m.get("enabled", True) for m in lang.get("metrics") or ()) for lang in settings.get("languages") or ()}
    lines = [f"{name}: {n} thresholds" for name, n in counts.items()]
    return "\n".join([*lines, f"ignored: {len(settings.get('ignore_patterns') or ())} patterns", f"profile: {settings.get('profile', 'standard')}"]) + "\n"
