"""Classes of a project: which base is which class, depth of inheritance, children and single responsibility.

classes: module, name, lineno, ord, bases array<string>, keywords array<string>, methods array<struct<name,
decorators, fields_read, fields_written, calls_local>>. bindings: module, bound, target: what imports bind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.graph import cohesion, depths
from tessera.operators.imports import first
from tessera.sources.tables import cut, joined


def single_responsibility(lcom: Column, weighted: Column, statements: Column) -> Column:
    """Groups of methods times bands of complexity and size; a small cohesive class has about 1."""
    return F.greatest(lcom, F.lit(1)) * (1 + weighted / 30.0) * (1 + statements / 60.0)


def bindings(imports: DataFrame) -> DataFrame:
    """(module, bound, target) of what import facts (module of the file as source_module, module, names, level, ord) bind;
    the last of equal names counts."""
    dots = F.repeat(F.lit("."), F.col("level"))
    prefix = F.concat(dots, F.coalesce("module", F.lit("")))
    named = imports.filter(F.size("names") > 0).select("source_module", "ord", F.explode("names").alias("bound"), prefix.alias("prefix")).select("source_module", "ord", "bound", F.when(F.col("prefix") != "", F.concat("prefix", F.lit("."), "bound")).otherwise(F.col("bound")).alias("target"))
    plain = imports.filter((F.size("names") == 0) & (F.col("module") != "")).select("source_module", "ord", F.substring_index("module", ".", 1).alias("bound"), F.col("module").alias("target"))
    return first(named.unionByName(plain), ["source_module", "bound"], [F.desc("ord")]).select(F.col("source_module").alias("module"), "bound", "target")


def resolved_bases(classes: DataFrame, bound: DataFrame) -> DataFrame:
    """(node, base, known): bases of each class as module::name: of the same module, else of the module that an import
    names, whole or after a dot; others are kept as written and not known. object isn't a base."""
    one = first(classes, ["module", "name"], [F.desc("ord")]).withColumn("node", F.concat("module", F.lit("::"), "name"))
    each = one.select("node", "module", F.explode_outer("bases").alias("raw")).withColumn("base", F.trim(F.substring_index("raw", "[", 1)))
    each = each.withColumn("base", F.when(F.col("base") != "object", F.col("base")))
    here = one.select("module", F.col("name").alias("base"), F.col("node").alias("own"))
    each = each.join(here, ["module", "base"], "left")
    each = each.withColumn("head", F.substring_index("base", ".", 1)).join(bound.withColumnsRenamed({"bound": "head"}), ["module", "head"], "left")
    each = each.withColumn("wanted", F.substring_index("base", ".", -1)).withColumn("from", F.regexp_replace(F.regexp_replace("target", r"^\.+", ""), r"\.[^.]*$", ""))
    each = cut(each)
    # a module answers to its name and to what stands after each of its dots
    parts = F.split("module", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    there = one.select(F.col("name").alias("wanted"), F.explode(ends).alias("from"), F.col("module").alias("at"), F.col("node").alias("other"), F.col("ord").alias("o"))
    far = joined(each.filter("own IS NULL AND from IS NOT NULL").select("node", "raw", "wanted", "from"), there, ["wanted", "from"])
    found = first(far, ["node", "raw"], ["at", "o"]).select("node", "raw", "other")
    out = each.join(found, ["node", "raw"], "left").withColumn("to", F.coalesce("own", "other"))
    return out.select("node", F.coalesce("to", "base").alias("base"), F.col("to").isNotNull().alias("known")).distinct()


def children(bases: DataFrame) -> DataFrame:
    """(node, children): how many classes have each as a base, not counting itself."""
    by = bases.filter("known AND node <> base").groupBy(F.col("base").alias("node")).agg(F.count_distinct("node").alias("children"))
    return bases.select("node").distinct().join(by, "node", "left").na.fill(0, ["children"])


def is_abstract(bases: Column, keywords: Column, methods: Column) -> Column:
    """True for a class of ABC or Protocol, of a metaclass ABCMeta, or with an abstract method."""
    last = lambda b: F.substring_index(F.trim(F.substring_index(b, "[", 1)), ".", -1)
    return F.exists(bases, lambda b: last(b).isin("ABC", "Protocol")) | F.exists(keywords, lambda k: k.contains("ABCMeta")) | F.exists(methods, lambda m: F.exists(m["decorators"], lambda d: d.contains("abstractmethod")))


def lack_of_cohesion(classes: DataFrame) -> DataFrame:
    """(class, lcom) with class as module::name; special methods but __init__ don't count."""
    own = classes.select(F.concat("module", F.lit("::"), "name").alias("class"), F.explode_outer("methods").alias("m"))
    own = own.withColumn("method", F.when(~F.col("m.name").rlike("^__.*__$") | (F.col("m.name") == "__init__"), F.col("m.name")))
    some = own.filter("method IS NOT NULL")
    fields = some.select("class", "method", F.lit("f").alias("kind"), F.explode(F.array_union("m.fields_read", "m.fields_written")).alias("other"))
    calls = some.select("class", "method", F.lit("m").alias("kind"), F.explode("m.calls_local").alias("other")).join(some.select("class", F.col("method").alias("other")).distinct(), ["class", "other"], "left_semi").select("class", "method", "kind", "other")
    return cohesion(own.select("class", "method"), fields.unionByName(calls))


def report(classes: DataFrame, bound: DataFrame, weighted: DataFrame, statements: DataFrame) -> DataFrame:
    """(node, depth, approximate, children, lcom, weighted, statements, single_responsibility) of every class. weighted:
    node, weighted (summed cyclomatic complexity of its methods); statements: node, statements; 0 where there is none."""
    bases = resolved_bases(classes, bound)
    out = depths(bases).withColumnsRenamed({"flagged": "approximate"}).join(children(bases), "node")
    out = out.join(lack_of_cohesion(classes).withColumnsRenamed({"class": "node"}), "node", "left").join(weighted, "node", "left").join(statements, "node", "left").na.fill(0, ["lcom", "weighted", "statements"])
    return out.withColumn("single_responsibility", F.round(single_responsibility(F.col("lcom"), F.col("weighted"), F.col("statements")), 2))
