"""How code reads: what each function does, in what order functions stand, and how they are named.

callables: module, name, lineno, ord, call_names array<string>, computation_weight, statements, nesting, returns_value,
return_annotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.names import clarity, lies

#: By profile: how much computation a function that tells a story may hold.
TOLERANCE = {"extreme": 0, "standard": 4, "relaxed": 8}
TRIVIAL, STEPS, STATEMENTS, NESTING, SHARE, CALLERS = 3, 9, 8, 1, 0.2, 5


def ambient(calls: DataFrame, functions: int | Column) -> DataFrame:
    """(name, callers) of names that at least ``CALLERS`` functions, and that share of all, call. calls: caller, name."""
    by = calls.groupBy("name").agg(F.count_distinct("caller").alias("callers"))
    return by.filter(F.col("callers") >= F.greatest(F.lit(CALLERS), F.floor(F.lit(SHARE) * functions)))


def kind(statements: Column, tells: Column, weight: Column, tolerance: int) -> Column:
    """trivial, mixed, narrator or computer; tells: whether the function calls others of the project."""
    return F.when(statements < TRIVIAL, "trivial").when(tells & (weight > tolerance), "mixed").when(tells, "narrator").otherwise("computer")


def over_budget(of: Column, statements: Column, nesting: Column) -> Column:
    return F.when(of == "narrator", statements > STEPS).when(of == "computer", (statements > STATEMENTS) | (nesting > NESTING)).otherwise(False)


def classified(callables: DataFrame, tolerance: int = 4) -> DataFrame:
    """callables with a column kind. A call counts for a story if its name is a function of the project, not its own and
    not ambient."""
    marked = callables.withColumn("_id", F.monotonically_increasing_id())
    calls = marked.select("_id", F.col("name").alias("own"), F.explode("call_names").alias("name"))
    often = ambient(calls.select(F.col("_id").alias("caller"), "name"), F.lit(callables.count()))
    told = calls.filter("own <> name").join(callables.select("name").distinct(), "name", "left_semi").join(often, "name", "left_anti").select("_id").distinct().withColumn("tells", F.lit(True))
    out = marked.join(told, "_id", "left")
    return out.withColumn("kind", kind(F.col("statements"), F.coalesce("tells", F.lit(False)), F.col("computation_weight"), tolerance)).drop("_id", "tells")


def step_down(calls: DataFrame, lines: DataFrame) -> DataFrame:
    """(module, ratio): share of calls (module, caller, caller_line, callee) within a module whose callee (module, name,
    lineno, ord: the last definition counts) stands below the caller; 1 without any."""
    last = lines.groupBy("module", F.col("name").alias("callee")).agg(F.max_by("lineno", "ord").alias("callee_line"))
    by = calls.filter("caller <> callee").join(last, ["module", "callee"]).groupBy("module").agg(F.avg((F.col("callee_line") > F.col("caller_line")).cast("int")).alias("ratio"))
    return lines.select("module").distinct().join(by, "module", "left").select("module", F.coalesce("ratio", F.lit(1.0)).alias("ratio"))


def report(callables: DataFrame, vocabulary: DataFrame, tolerance: int = 4) -> DataFrame:
    """(module, metric, value, names): counts of mixed functions and of those over budget, of names that lie, the share
    of calls in order and the mean clarity of names, with up to ten names each (five for clarity)."""
    of = classified(callables, tolerance)
    over = over_budget(F.col("kind"), F.col("statements"), F.col("nesting"))
    flags = {
        "narrative_mixed_functions": F.col("kind") == "mixed",
        "narrator_budget_exceeded": (F.col("kind") == "narrator") & over,
        "computer_budget_exceeded": (F.col("kind") == "computer") & over,
        "naming_antipatterns": lies(F.col("name"), F.col("return_annotation"), F.col("returns_value")),
    }
    listed = lambda c: F.slice(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "name")))), lambda x: x["name"]), 1, 10)
    counts = of.groupBy("module").agg(*(F.struct(F.count_if(c).cast("double").alias("value"), listed(c).alias("names")).alias(m) for m, c in flags.items()))
    rows = counts.select("module", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m)["value"].alias("value"), F.col(m)["names"].alias("names")) for m in flags))).alias("r")).select("module", "r.*")
    calls = callables.select("module", F.col("name").alias("caller"), F.col("lineno").alias("caller_line"), F.explode("call_names").alias("callee"))
    order = step_down(calls, callables.select("module", "name", "lineno", "ord")).select("module", F.lit("step_down_ordering").alias("metric"), F.round("ratio", 4).alias("value"), F.array().cast("array<string>").alias("names"))
    plain = callables.filter(~F.col("name").rlike("^__.*__$")).select("module", "name")
    scored = plain.join(clarity(plain, vocabulary), "name").groupBy("module").agg(F.round(F.avg("score"), 4).alias("value"), F.array_sort(F.collect_list(F.struct("score", "name"))).alias("all"))
    worst = F.transform(F.filter(F.slice("all", 1, 5), lambda x: x["score"] < 0.7), lambda x: x["name"])
    clear = callables.select("module").distinct().join(scored, "module", "left").select("module", F.lit("name_clarity").alias("metric"), F.coalesce("value", F.lit(1.0)).alias("value"), F.coalesce(worst, F.array().cast("array<string>")).alias("names"))
    return rows.unionByName(order).unionByName(clear)
