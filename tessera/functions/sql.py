"""Functions on names and paths, for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

_WORDS = "transform(filter(regexp_extract_all(name, '([A-Z]?[a-z]+|[A-Z]|[0-9]+)', 1), x -> NOT x RLIKE '^[0-9]'), x -> lower(x))"
FUNCTIONS = {
    "identifier_words": ("name STRING", "ARRAY<STRING>", _WORDS),
    "is_test_path": ("path STRING", "BOOLEAN", "contains(path, '/tests/') OR startswith(path, 'tests/') OR startswith(element_at(split(path, '/'), -1), 'test_') OR endswith(path, '_test.py')"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL; they are expressions, which the optimizer sees through."""
    for name, (argument, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURNS {kind} RETURN {body}")
