"""What reports show. Parts stand for files, in folders by brand and type; lines of orders for functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import names as nm
from tessera.functions.sql import register
from tessera.operators import maps
from tessera.plans.registry import registry
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

_SQL_F = "f AS (SELECT p_partkey, p_size AS value, 'src/' || lower(p_brand) || '/' || CASE WHEN p_size % 2 = 0 THEN 'even/' ELSE '' END || 'p' || p_partkey || '.py' AS path FROM part)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/"), F.when(F.col("p_size") % 2 == 0, "even/").otherwise(""), F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return p.select("p_partkey", F.col("p_size").alias("value"), path.alias("path"))


@query(f"""WITH {_SQL_F}, g AS (SELECT * FROM f WHERE value >= 10), a AS (SELECT value, unnest([regexp_replace(path, '/[^/]*$', ''), regexp_replace(path, '^(src/[^/]*)/.*$', '\\1'), 'src', '.']) AS id, path FROM g),
d AS (SELECT id, sum(value) AS value FROM (SELECT DISTINCT path, id, value FROM a) GROUP BY id),
n AS (SELECT path AS id, regexp_replace(path, '/[^/]*$', '') AS parent, value, false AS is_folder FROM g UNION ALL SELECT id, CASE WHEN id = '.' THEN NULL WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') ELSE '.' END, value, true FROM d)
SELECT id, parent, regexp_replace(id, '^.*/', '') AS label, CAST(value AS BIGINT) AS value, is_folder, row_number() OVER (PARTITION BY parent ORDER BY value DESC, id) AS place FROM n""")
def q_tree_totals(spark, sf_dir):
    return maps.placed(maps.totals(files(spark, sf_dir), 10)).withColumn("value", F.col("value").cast("long"))


@query(f"WITH {_SQL_F} SELECT 'src' AS base UNION ALL SELECT 'src/' || min(lower(p_brand)) || '/even' FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size % 2 = 0")
def q_common_base(spark, sf_dir):
    """Of all files, and of those of the first brand in one folder."""
    f, p = files(spark, sf_dir), table(spark, sf_dir, "part")
    one = p.agg(F.min(F.lower("p_brand")).alias("b"))
    some = f.join(F.broadcast(one), F.col("path").startswith(F.concat(F.lit("src/"), F.col("b"), F.lit("/even/")))).select("path")
    return maps.common_base(f).unionByName(maps.common_base(some))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity AS value, CASE l_linenumber % 4 WHEN 0 THEN 20.0 WHEN 1 THEN 30.0 WHEN 2 THEN 0.0 END AS t, l_linenumber % 4 = 1 AS low, l_linenumber % 8 <> 3 AS scaled FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN coalesce(t, 0) > 0 THEN CASE WHEN low THEN CASE WHEN value <= 0 THEN 1.5 ELSE t / value END ELSE value / t END WHEN scaled THEN value / 45.0 ELSE 0 END, 6) AS badness,
 coalesce(t > 0 AND CASE WHEN low THEN value < t ELSE value > t END, false) AS beyond FROM m""")
def q_badness(spark, sf_dir):
    l, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 4
    t = F.when(n == 0, 20.0).when(n == 1, 30.0).when(n == 2, 0.0)
    scale = F.when(F.col("l_linenumber") % 8 != 3, 45.0)
    value = F.col("l_quantity").cast("double")
    return l.select("l_orderkey", "l_linenumber", F.round(maps.badness(value, t, n == 1, scale), 6).alias("badness"), maps.beyond(value, t, n == 1).alias("beyond"))


@query("SELECT l_returnflag AS metric, max(abs(l_quantity - 25)) AS scale FROM lineitem GROUP BY l_returnflag")
def q_delta_scale(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return maps.delta_scale(l.select(F.col("l_returnflag").alias("metric"), (F.col("l_quantity") - 25).alias("delta")))


@query("""WITH s AS (SELECT 'p' || l_partkey AS path, 'f' || l_orderkey || '_' || l_linenumber AS name, greatest(CASE WHEN l_quantity > 5 THEN l_quantity END, CASE WHEN l_linenumber > 2 THEN l_linenumber * 8.0 END) AS score FROM lineitem)
SELECT path, name, score, CAST(row_number() OVER (ORDER BY score DESC, path, name) AS INTEGER) AS rank, (SELECT count(*) FROM s WHERE score IS NOT NULL) AS total FROM s WHERE score IS NOT NULL ORDER BY score DESC, path, name LIMIT 50""")
def q_listed_functions(spark, sf_dir):
    """The fifty worst that a page lists, with how many there are."""
    l = table(spark, sf_dir, "lineitem")
    f = l.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("name"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("double")).alias("cyclomatic"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") * 8.0).alias("cognitive"),
    )
    return maps.listed(f).select("path", "name", "score", "rank", "total")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS path, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size % 2 = 0) AS here FROM lineitem")
def q_located(spark, sf_dir):
    """Functions of a baseline, and whether the files of today hold theirs."""
    now = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("path"))
    return maps.located(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path")), now)


@query("SELECT * FROM (VALUES ('directory', 'folders'), ('module', 'packages')) AS v(kind, of)")
def q_grouping_kind(spark, sf_dir):
    f = files(spark, sf_dir)
    folders = maps.grouping_kind(f.select(F.regexp_replace("path", "/[^/]*$", "").alias("k")), "k").withColumn("of", F.lit("folders"))
    return folders.unionByName(maps.grouping_kind(f.select(F.element_at(F.split("path", "/"), 2).alias("k")), "k").withColumn("of", F.lit("packages")))


@query(r"""WITH m AS (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part UNION SELECT unnest(string_split(lower(p_name), ' ')) || 's' FROM part WHERE p_size = 3),
v AS (SELECT DISTINCT lower(unnest(string_split(p_type, ' '))) AS word FROM part), j AS (SELECT min(word) AS word FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part))
SELECT word, 'word' AS role FROM v UNION SELECT word, 'noise' FROM j UNION SELECT word, 'word' FROM m WHERE word NOT IN (SELECT word FROM j) UNION SELECT 'kept', 'word'""")
def q_vocabulary(spark, sf_dir):
    """Words of a list, of the names of modules and classes but for noise, and those that settings allow."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_type", " ")).alias("word"), F.lit(nm.WORD).alias("role"))
    names = p.select(F.explode(F.split("p_name", " ")).alias("word"))
    noise = names.agg(F.min(F.lower("word")).alias("word")).withColumn("role", F.lit(nm.NOISE))
    known = words.unionByName(noise)
    modules = p.select(F.concat(F.lit(""), F.replace(F.lower("p_name"), F.lit(" "), F.lit("."))).alias("name"))
    plurals = p.filter("p_size = 3").select(F.explode(F.transform(F.split("p_name", " "), lambda w: F.concat(F.initcap(w), F.lit("s")))).alias("name"))
    return nm.vocabulary(known, nm.anchors(modules.unionByName(plurals), known), ["Kept"])


@query("""SELECT p_partkey, 'get' || upper(p_name[1]) || lower(p_name[2:4]) || '_v' || p_size AS name, 'get ' || trim(lower(p_name[1:4])) || ' v' AS words,
 p_size % 2 = 0 AS test FROM part""")
def q_sql_functions(spark, sf_dir):
    """The functions that SQL knows after register()."""
    register(spark)
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('get', upper(substring(p_name, 1, 1)), lower(substring(p_name, 2, 3)), '_v', p_size) AS name", "concat(CASE WHEN p_size % 2 = 0 THEN 'tests/' ELSE 'src/' END, 'p.py') AS path")
    return p.selectExpr("p_partkey", "name", "array_join(identifier_words(name), ' ') AS words", "is_test_path(path) AS test")
