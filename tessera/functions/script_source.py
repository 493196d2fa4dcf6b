"""Metric rows of one JavaScript or TypeScript file, from its tokens."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[A-Za-z_$][\w$]*|\d[\w.]*|=>|&&|\|\||\?\?|\?\.|[^\s\w]|\n|[^\S\n]+""", re.S)
#: Text of a template up to its end or to an expression in it.
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?:`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_DECIDES = frozenset(("if", "for", "while", "case", "catch", "&&", "||", "?", "??"))
_WORDS = frozenset("if for while switch catch with function return typeof new await of in do else try finally delete void throw super import".split())


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, line) without comments and white space; literals stand as they are, but for templates, whose parts stand
    around the tokens of the expressions in them."""
    out: list[tuple[str, int]] = []
    open_: list[int] = []  # braces open in each template expression
    i, line, inside = 0, 1, False
    while i < len(text):
        c = text[i]
        if inside:
            m = _TEMPLATE.match(text, i)
            inside = False
            if m[0].endswith("${"):
                open_.append(0)
        elif c == "}" and open_ and open_[-1] == 0:
            open_.pop()
            inside, i = True, i + 1
            continue
        elif c == "`":
            inside, i = True, i + 1
            continue
        else:
            before = out[-1][0] if out else ""
            literal = c == "/" and not (before[-1:] in ")]}" and before or re.match(r"[\w$\"'`]", before) and before not in _WORDS)
            m = (_REGEX.match(text, i) if literal else None) or _TOKEN.match(text, i)
            if open_:
                open_[-1] += (c == "{") - (c == "}")
        if not (m[0].isspace() or m[0].startswith(("//", "/*"))):
            out.append((m[0], line))
        line += m[0].count("\n")
        i = m.end()
    return out


def _closing(toks: list[tuple[str, int]], at: int) -> int:
    """The place of the bracket that closes the one at a place; the last place if none does."""
    depth = 0
    for k in range(at, len(toks)):
        depth += (toks[k][0] in "([{") - (toks[k][0] in ")]}")
        if depth == 0:
            return k
    return len(toks) - 1


def _generic(toks: list[tuple[str, int]], k: int) -> int:
    """The place before type parameters that end at a place; that place itself if none do."""
    if k < 0 or toks[k][0] != ">":
        return k
    depth = 0
    for j in range(k, -1, -1):
        t = toks[j][0]
        depth += (t == ">") - (t == "<")
        if depth == 0:
            return j - 1
        if t in (";", "{", "}") and depth == 1 and t == ";":
            break
    return k


_GOES_ON = frozenset(("|", "&", "<", ",", ":", "=>", "(", "[", "keyof", "typeof", "extends", "is", "."))


def _after_type(toks: list[tuple[str, int]], at: int) -> int:
    """The place after a type that begins at a place: a type ends at its line's end unless an operator carries it on."""
    begin = at
    while at < len(toks):
        t, line = toks[at]
        if at > begin and line > toks[at - 1][1] and toks[at - 1][0] not in _GOES_ON and t not in ("{", "=>", "|", "&", "["):
            return len(toks)
        if t == "{" and (at == begin or toks[at - 1][0] in _GOES_ON):
            at = _closing(toks, at) + 1
        elif t == "<":
            depth = 0
            while at < len(toks):
                depth += (toks[at][0] == "<") - (toks[at][0] == ">")
                at += 1
                if depth == 0:
                    break
        elif t in ("{", "=>", ";", ",", "}", ")"):
            return at
        else:
            at = _closing(toks, at) + 1 if t in ("(", "[") else at + 1
            if t == "(" and at < len(toks) and toks[at][0] == "=>":  # a type of functions
                at += 1
    return at


def _carries_on(toks: list[tuple[str, int]], k: int) -> bool:
    """False where a token begins a line and neither it nor the one before carries an expression on."""
    before, t = toks[k - 1], toks[k]
    sign = lambda x: not re.match(r"[\w$\"'`]", x)
    return t[1] == before[1] or (sign(before[0]) and before[0] not in (")", "]", "}")) or (sign(t[0]) and t[0] not in ("{", "!", "@", "#", "~"))


def functions(text: str) -> list[dict]:
    """name, line, end_line, nloc and cyclomatic complexity of each function with a body in braces, and of each arrow
    function that a name is given; what lies in a function within counts for that alone."""
    toks = tokens(text)
    name = re.compile(r"[A-Za-z_$][\w$]*$")
    found: list[tuple[str, int, int, int]] = []
    for k, (t, _) in enumerate(toks):
        if t != "(":
            continue
        end = _closing(toks, k)
        at = _generic(toks, k - 1)
        before = toks[at][0] if at >= 0 else ""
        after = end + 1
        if after < len(toks) and toks[after][0] == ":":  # a type of what is returned
            after = _after_type(toks, after + 1)
        nxt = toks[after][0] if after < len(toks) else ""
        if nxt == "{" and name.match(before) and (before not in _WORDS or before == "function"):
            label = before if before != "function" else _given(toks, at)
            found.append((label, at, after, _closing(toks, after)))
        elif nxt == "=>":
            label = _given(toks, (at if at < k - 1 else k) - (before == "async") + (at < k - 1))
            body = after + 1
            if body < len(toks) and toks[body][0] == "{":
                found.append((label, k, body, _closing(toks, body)))
            elif label != "(anonymous)":
                stop = body
                while stop < len(toks) and toks[stop][0] not in (";", ",", ")", "}") and (stop == body or _carries_on(toks, stop)):
                    stop = _closing(toks, stop) + 1 if toks[stop][0] in "([{" else stop + 1
                found.append((label, k, body, min(stop, len(toks)) - 1))
    owner = [-1] * len(toks)
    for n, (_, _, a, b) in sorted(enumerate(found), key=lambda x: x[1][3] - x[1][2], reverse=True):
        owner[a : b + 1] = [n] * (b + 1 - a)
    out = []
    for n, (label, start, a, b) in enumerate(found):
        decides = 0
        for k in range(a, b + 1):
            t = toks[k][0]
            if owner[k] == n and t in _DECIDES and not (t == "?" and k + 1 < len(toks) and toks[k + 1][0] in (":", ")", ",", ".")):
                decides += 1
        lines = {toks[k][1] for k in range(start, b + 1)}
        out.append({"name": label, "line": toks[start][1], "end_line": toks[b][1], "nloc": len(lines), "cyclomatic": 1 + decides})
    return sorted(out, key=lambda f: (f["line"], f["name"]))


def _given(toks: list[tuple[str, int]], k: int) -> str:
    """The name to which what begins at a place is given."""
    k -= 1
    if k >= 1 and toks[k][0] in ("=", ":") and re.match(r"[A-Za-z_$]", toks[k - 1][0]):
        return toks[k - 1][0]
    return "(anonymous)"


def analyse(text: str) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {k: [] for k in ("metrics", "imports", "callables", "classes", "clones", "errors")}

    def metric(name: str, value: float, line: int | None = None, function: str | None = None, kind: str = "file") -> None:
        out["metrics"].append({"metric": name, "value": float(value), "line": line, "function": function, "kind": kind, "owner": None, "ord": len(out["metrics"])})

    found = functions(text)
    for f in found:
        metric("cyclomatic_complexity", f["cyclomatic"], f["line"], f["name"], "function")
    if found:
        metric("cyclomatic_complexity", sum(f["cyclomatic"] for f in found) / len(found), kind="average")
    metric("source_lines_of_code", len({line for _, line in tokens(text)}))
    metric("lines_of_code", len(text.splitlines()))
    return out
