"""Import graphs: from statements to edges, and what is derived from edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.functions.paths import package
from tessera.sources.tables import cut, joined

#: How much less stable than its source a target may be.
TOLERANCE = 0.2


def _prefixes(name: Column) -> Column:
    """The dotted prefixes of a name, the longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def absolute(module: Column, level: Column, source: Column, is_package: Column | None = None) -> Column:
    """The prefix that a statement in source addresses: of a relative one, source without its last level parts (one fewer
    in a package's __init__), then module; empty parts beyond the root."""
    parts = F.split(source, r"\.")
    up = level - F.when(is_package, 1).otherwise(0) if is_package is not None else level
    base = F.when(up <= F.size(parts), F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    own = F.when(F.coalesce(module, F.lit("")) != "", F.array(module)).otherwise(F.array().cast("array<string>"))
    return F.when(level == 0, F.coalesce(module, F.lit(""))).otherwise(F.array_join(F.concat(base, own), "."))


def resolve(imports: DataFrame, modules: DataFrame, root: str) -> DataFrame:
    """(source, target), distinct: imports are source, prefix and names array<string>; modules are module.

    A name is looked up under its prefix, else the prefix alone; the longest prefix that is a module wins, and leading
    parts that equal root are stripped only where nothing is found with them. Edges to a module itself or to a package
    that holds it are dropped.
    """
    plain = F.when(F.size("names") > 0, F.transform("names", lambda n: F.when(F.col("prefix") != "", F.concat("prefix", F.lit("."), n)).otherwise(n))).otherwise(F.array("prefix"))
    each = cut(imports.withColumn("wanted", F.explode(plain)).select("source", "wanted", F.col("prefix").alias("second")).filter("wanted <> ''").distinct())
    # what is imported often is looked up once, and so are prefixes that many names share
    tried = each.select("wanted", "second").distinct().select("wanted", "second", F.posexplode(F.array("wanted", "second")).alias("turn", "name")).filter("name <> ''")
    # how often the root's name leads decides how often it may be stripped
    lead = F.size(F.split(F.col("name"), r"\.")) - F.size(F.filter(F.split(F.regexp_replace("name", rf"^(?:{root.replace('.', chr(92) + '.')}\.)+", ""), r"\."), lambda x: F.lit(True)))
    cuts = tried.withColumn("strip", F.explode(F.sequence(F.lit(0), lead)))
    rest = F.array_join(F.slice(F.split("name", r"\."), F.col("strip") + 1, F.size(F.split("name", r"\."))), ".")
    prefixes = cut(cuts.select("wanted", "second", "turn", "strip", F.posexplode(_prefixes(rest)).alias("short", "module")))
    found = joined(prefixes, modules.select("module").distinct(), ["module"])
    best = cut(found.groupBy("wanted", "second").agg(F.min_by("module", F.struct("turn", "strip", "short")).alias("target")))
    return hygiene(joined(each, best, ["wanted", "second"]).select("source", "target").distinct())


def hygiene(edges: DataFrame) -> DataFrame:
    """Edges without loops and without those to a package that holds the source."""
    return edges.filter((F.col("source") != F.col("target")) & ~F.col("source").startswith(F.concat("target", F.lit("."))))


def coupling(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, efferent, afferent, instability) of every module; instability is 0 where there are no edges."""
    out = edges.groupBy(F.col("source").alias("module")).agg(F.count(F.lit(1)).alias("efferent"))
    into = edges.groupBy(F.col("target").alias("module")).agg(F.count(F.lit(1)).alias("afferent"))
    both = modules.select("module").distinct().join(out, "module", "left").join(into, "module", "left").na.fill(0, ["efferent", "afferent"])
    return both.withColumn("instability", F.when(F.col("efferent") + F.col("afferent") == 0, 0.0).otherwise(F.col("efferent") / (F.col("efferent") + F.col("afferent"))))


def unstable_dependencies(edges: DataFrame, of: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(module, violations): how many targets of each module are less stable than it by more than the tolerance."""
    i = lambda name: of.select(F.col("module").alias(name), F.col("instability").alias(f"i_{name}"))
    bad = edges.join(i("source"), "source").join(i("target"), "target").groupBy(F.col("source").alias("module")).agg(F.count_if(F.col("i_target") - F.col("i_source") > tolerance).alias("violations"))
    return of.select("module").join(bad, "module", "left").na.fill(0, ["violations"])


def package_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges between packages, without loops."""
    return edges.select(package(F.col("source")).alias("source"), package(F.col("target")).alias("target")).filter("source <> target").distinct()


def main_sequence(classes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """(module, abstractness, distance, inversion): share of abstract classes (module, abstract), null without classes;
    |abstractness + instability - 1|; and the mean abstractness of targets, those without classes counting 0."""
    return main_sequence_of(abstractness(classes, "module"), edges, of)


def abstractness(classes: DataFrame, by: str) -> DataFrame:
    """(by, abstractness): the share of abstract classes."""
    return classes.groupBy(by).agg(F.avg(F.col("abstract").cast("int")).alias("abstractness"))


def main_sequence_of(share: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """main_sequence, of modules whose shares of abstract classes (module, abstractness) are known."""
    onto = edges.join(share.withColumnRenamed("module", "target"), "target", "left").groupBy(F.col("source").alias("module")).agg(F.avg(F.coalesce("abstractness", F.lit(0.0))).alias("inversion"))
    out = of.select("module", "instability").join(share, "module", "left").join(onto, "module", "left")
    return out.select("module", "abstractness", F.abs(F.col("abstractness") + F.col("instability") - 1).alias("distance"), "inversion")


def layering(edges: DataFrame, modules: DataFrame, layers: list[str]) -> DataFrame:
    """(module, violations, targets) of each module in a layer: its edges into layers that come before its own, and the
    first ten of them, joined by commas. layers lists top names, the outermost first."""
    top = lambda c: F.substring_index(c, ".", 1)
    place = F.create_map(*(F.lit(x) for i, name in enumerate(layers) for x in (name, i)))
    mine = modules.select("module", place[top(F.col("module"))].alias("layer")).filter("layer IS NOT NULL")
    up = edges.withColumn("a", place[top(F.col("source"))]).withColumn("b", place[top(F.col("target"))]).filter("b < a")
    by = up.groupBy(F.col("source").alias("module")).agg(F.count_distinct("target").alias("violations"), F.array_join(F.slice(F.array_sort(F.collect_set("target")), 1, 10), ",").alias("targets"))
    return mine.select("module").join(by, "module", "left").select("module", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("targets", F.lit("")).alias("targets"))


def first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
