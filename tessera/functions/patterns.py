"""Shapes of Python code that a simpler one could replace. As an analyser, Patterns() gives a metric row for each."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from tessera.functions.python_source import walk

#: Conditions of a chain from which on a table would be plainer.
LONG = 4


def _chain(node: ast.If) -> int:
    n = 1
    while len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
        n, node = n + 1, node.orelse[0]
    return n


def _truth(s: ast.AST) -> bool:
    return isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, bool)


def _appends(s: ast.stmt) -> bool:
    return isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Attribute) and s.value.func.attr == "append"


def found(tree: ast.AST) -> Iterator[tuple[str, str | None, int, int]]:
    """(pattern, function, line, size): branches with an else within branches or tries, by depth; chains of LONG or more
    conditions, from each on that so many follow, by length; branches that only set a truth value; loops that append;
    loops that set one and break off; tries within branches or tries, by depth."""
    todo: list[tuple[ast.AST, str | None, int]] = [(tree, None, 0)]
    while todo:
        node, function, depth = todo.pop()
        if isinstance(node, ast.FunctionDef):
            function = node.name
        elif isinstance(node, ast.If):
            depth += 1
            if depth > 1 and node.orelse:
                yield "nested_if_else", function, node.lineno, depth
            if (n := _chain(node)) >= LONG:
                yield "long_elif_chain", function, node.lineno, n
            if len(node.body) == 1 and _truth(node.body[0]):
                yield "boolean_flag", function, node.lineno, 1
        elif isinstance(node, ast.Try):
            depth += 1
            if depth > 1:
                yield "nested_try", function, node.lineno, depth
        elif isinstance(node, ast.For):
            if any(map(_appends, node.body)):
                yield "accumulator_loop", function, node.lineno, 1
            below = walk(node)
            if any(isinstance(n, ast.Break) for n in below) and any(map(_truth, below)):
                yield "boolean_search", function, node.lineno, 1
        todo += [(c, function, depth) for c in ast.iter_child_nodes(node)]


class Patterns:
    """An analyser of Python files for plugins.RUNNERS."""

    names = ("accumulator_loop", "boolean_flag", "boolean_search", "long_elif_chain", "nested_if_else", "nested_try")

    def available(self) -> bool:
        return True

    def analyse(self, text: str, test_file: bool) -> dict[str, list[dict]]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return {}
        rows = sorted(found(tree), key=lambda r: (r[2], r[0]))
        return {"metrics": [{"metric": p, "value": float(n), "line": line, "function": f, "kind": "pattern", "owner": None, "ord": k} for k, (p, f, line, n) in enumerate(rows)]}
