"""Column functions on paths, and patterns over them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

LANGUAGES = {
    "python": ("py", "pyw", "pyi", "ipynb"),
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "typescript": ("ts", "tsx", "mts", "cts"),
}


def language(path: Column) -> Column:
    """Language by the extension, in any case; unknown for others."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("unknown")
    for name, ends in LANGUAGES.items():
        out = F.when(end.isin(*ends), name).otherwise(out)
    return out


def is_test(path: Column) -> Column:
    """True for what lies in a folder tests, and for files named test_* or *_test.py."""
    name = F.element_at(F.split(path, "/"), -1)
    return path.contains("/tests/") | path.startswith("tests/") | name.startswith("test_") | name.endswith("_test.py")


def ancestors(path: Column) -> Column:
    """The folders that hold a path, the root "." first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))


def folder(path: Column) -> Column:
    """The folder that holds a path; "." at the root."""
    return F.element_at(ancestors(path), -1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def module(path: Column, keep_init: bool = False) -> Column:
    """Dotted name of a file: without its suffix and, unless kept, a last __init__; null for the root's __init__."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    if not keep_init:
        bare = F.regexp_replace(bare, r"(^|/)__init__$", "")
    return F.nullif(F.replace(bare, F.lit("/"), F.lit(".")), F.lit(""))


def package(module: Column) -> Column:
    """A module's name without the last part; (top) where that leaves nothing."""
    return F.when(module.contains("."), F.regexp_replace(module, r"\.[^.]*$", "")).otherwise("(top)")


def shown(path: Column, style: str = "relative", width: int = 30) -> Column:
    """A path for display: whole if style is full, else cut from the left to width; parent keeps the last two parts."""
    if style == "full":
        return path
    parts = F.split(path, "/")
    text = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/") if style == "parent" else path
    return F.when(F.length(text) > width, F.concat(F.lit("..."), F.substring(text, F.length(text) - (width - 4), F.lit(width - 3)))).otherwise(text)


def glob_regex(pattern: str) -> str:
    """Regular expression of a file-name pattern in which * also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            inner = pattern[i:j].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
            i = j + 1
        else:
            out += re.escape(c)
    return f"^(?s:{out})$"


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression of paths, whether it ignores) for a line of an ignore file; None for blank lines and comments.

    A pattern with a slash before its end is anchored at the root; one that ends in a slash means folders alone; ** spans
    any number of folders, * and ? stay within one; ! takes back what earlier lines ignored.
    """
    text = line.rstrip("\n\r").rstrip()
    if not text or text.startswith("#"):
        return None
    ignores = not text.startswith("!")
    text = text if ignores else text[1:]
    text = text[1:] if text.startswith("\\") else text
    only_folders = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.removeprefix("/")
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out, i = out + "/.+", i + 3
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and "]" in text[i + 2 :]:
            j = text.index("]", i + 2)
            inner = text[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", j + 1
        else:
            out, i = out + re.escape(text[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_folders else "(?:/|$)"), ignores


def ignored(path: Column, patterns: Sequence[str], include: Sequence[str] = ()) -> Column:
    """Whether the patterns, the last that matches deciding, ignore a path; never if one of include matches it."""
    out = F.lit(False)
    for compiled in map(ignore_regex, patterns):
        if compiled:
            out = F.when(path.rlike(compiled[0]), F.lit(compiled[1])).otherwise(out)
    for compiled in map(ignore_regex, include):
        if compiled and compiled[1]:
            out = out & ~path.rlike(compiled[0])
    return out
