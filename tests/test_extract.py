from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import python_source
from tessera.operators import extract
from tessera.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TEXT = "import os\nclass A(B):\n    def f(self, q):  # TODO\n        self.x = q + 1\n        return os\n\ndef test_g(a):\n    assert a and [1, 2, 3, 4, 5, 6, 7, 8]\n    return A()\n"
#: What each query asks the extraction for; it used to find and write all kinds of rows.
ASKED = {
    "q_source_halstead": {"metrics": ["halstead_volume", "halstead_difficulty", "halstead_effort"]},
    "q_source_lines": {"metrics": ["lines_of_code", "comment_lines", "marker_density", "comment_density"]},
    "q_source_style": {"metrics": ["exception_discipline", "global_state_reach", "pipeline_linearity"]},
    "q_source_callables": {"callables": None},
    "q_source_facts": {"imports": None, "classes": None},
    "q_ast_gate": {"metrics": ["cyclomatic_complexity", "function_arity"]},
    "q_ast_functions": {"metrics": ["function_arity", "boolean_flag_parameters", "message_chain_depth", "function_statements", "expression_flatness", "pipeline_linearity", "exception_discipline", "global_state_reach", "cyclomatic_complexity", "cognitive_complexity", "halstead_volume", "halstead_bugs"]},
    "q_ast_callables": {"callables": None},
    "q_ast_files": {"metrics": ["lines_of_code", "logical_lines_of_code", "source_lines_of_code", "comment_lines", "blank_lines", "comment_density", "marker_density", "halstead_difficulty"]},
    "q_source_tests": {"metrics": ["assertions_per_test", "mock_call_assertions", "big_literal_assertions"]},
    "q_source_errors": {"callables": None, "errors": None},
    "q_source_classes": {"metrics": ["coupling_between_objects", "cyclomatic_complexity"], "imports": None, "callables": None, "classes": None},
    "q_source_edges": {"imports": None},
    "q_source_narrative": {"callables": None, "classes": None},
    "q_project_violations": {"metrics": ["cyclomatic_complexity"]},
    "q_ast_clones": {"clones": None},
}


@pytest.mark.parametrize("name", ASKED)
def test_queries_ask_for_what_they_give(spark, monkeypatch, name):
    seen, runner = [], extract._runner
    monkeypatch.setattr(extract, "_runner", lambda runners, only: seen.append(only) or runner(runners, only))
    QUERIES[name](spark, FOLDER)
    assert seen == [{k: None if v is None else frozenset(v) for k, v in ASKED[name].items()}]


def test_a_part_is_as_in_the_whole():
    bare = lambda rows: [{k: v for k, v in r.items() if k != "ord"} for r in rows]
    whole = python_source.analyse(TEXT, True)
    assert len({m["metric"] for m in whole["metrics"]}) == 28
    for name in {m["metric"] for m in whole["metrics"]}:
        part = python_source.analyse(TEXT, True, {"metrics": {name}})
        assert bare(part["metrics"]) == bare(m for m in whole["metrics"] if m["metric"] == name) and not part["callables"]
    for kind in ("imports", "callables", "classes", "clones"):
        part = python_source.analyse(TEXT, True, {kind: None})
        assert part[kind] == whole[kind] and sum(map(bool, part.values())) == 1


def test_what_is_not_asked_for_is_an_error(spark):
    files = spark.createDataFrame([("a.py", TEXT), ("b.py", None), ("c.py", "def (")], "path string, content string")
    part = extract.Extract(files, only={"metrics": ["function_arity"]})
    assert sorted((r.function, r.value) for r in part.metrics.collect()) == [("f", 1.0), ("test_g", 1.0)]
    assert part.all.filter("kind_of_row <> 'metrics'").count() == 0
    with pytest.raises(LookupError):
        part.imports
    assert {r.path for r in extract.Extract(files, only={"errors": None}).errors.collect()} == {"b.py", "c.py"}


def test_rows_are_passed_on_by_chunk(spark):
    files = spark.range(2 * extract.CHUNK + 1).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), F.lit("x = 1\n").alias("content"))
    batches = lambda d: d.coalesce(1).mapInArrow(extract._runner(extract.plugins.RUNNERS, {"metrics": {"lines_of_code"}}), "path string, language string, kind_of_row string, payload string")
    known = files.withColumn("language", F.lit("python")).withColumn("_test", F.lit(False))
    assert batches(known).count() == 2 * extract.CHUNK + 1
