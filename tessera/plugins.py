"""What users may add: analysers of languages, and tables derived from a whole project."""

from __future__ import annotations

from collections.abc import Callable, Container, Mapping
from typing import Protocol

from tessera.functions import python_source, script_source


class Runner(Protocol):
    """Analyses the text of one file. Rows are as in functions.python_source.analyse; names lists the metrics that it gives."""

    names: tuple[str, ...]

    def available(self) -> bool: ...

    def analyse(self, text: str, test_file: bool) -> dict[str, list[dict]]: ...


class _Own:
    """An analyser of this package; all metrics of it are given."""

    names: tuple[str, ...] = ()

    def __init__(self, run: Callable[..., dict[str, list[dict]]]):
        self.run = run

    def available(self) -> bool:
        return True

    def analyse(self, text: str, test_file: bool) -> dict[str, list[dict]]:
        return self.run(text, test_file)

    def part(self, text: str, test_file: bool, only: Mapping[str, Container[str] | None]) -> dict[str, list[dict]]:
        return self.run(text, test_file, only)


def _script(text: str, _: bool, __: object = None) -> dict[str, list[dict]]:
    return script_source.analyse(text)


#: By language, the analysers whose rows are put together.
RUNNERS: dict[str, list[Runner]] = {"python": [_Own(python_source.analyse)], "javascript": [_Own(_script)], "typescript": [_Own(_script)]}


def analyse(runners: dict[str, list[Runner]], language: str, text: str, test_file: bool, only: Mapping[str, Container[str] | None] | None = None) -> dict[str, list[dict]]:
    """The rows of all analysers of a language that are available; those without rows of metrics may say why by errors.
    only: the kinds of rows that are given, of metrics with their names (None: all), so that analysers with a method part
    needn't find the others."""
    out: dict[str, list[dict]] = {}
    for runner in runners.get(language, ()):
        if runner.available():
            found = runner.analyse(text, test_file) if only is None or not hasattr(runner, "part") else runner.part(text, test_file, only)
            for kind, rows in found.items():
                if only is not None:
                    names = only.get(kind)
                    rows = [] if kind not in only else rows if names is None else [r for r in rows if r["metric"] in names]
                have = out.setdefault(kind, [])
                have += [{**r, "ord": len(have) + k} for k, r in enumerate(rows)] if have else rows
    return out
