"""Gates, statistics, scalar functions and snapshots. Line items stand for functions, with four metrics each; customers
for files in folders region/nation; parts for files in packages by brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import names as nm, paths
from tessera.operators import gates, snapshots, stats
from tessera.plans.registry import registry
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

_METRICS = ("line_quantity", "l_quantity"), ("line_price", "l_extendedprice"), ("line_discount", "l_discount"), ("line_tax", "l_tax")
_LIMITS = [
    ("A", "line_quantity", 40.0, "<=", True, 0), ("A", "line_price", 5000.0, ">=", True, 1), ("A", "line_discount", 0.1, "<", True, 2), ("A", "line_tax", 0.0, "!=", True, 3),
    ("N", "line_quantity", 10.0, ">", True, 4), ("N", "line_price", 90000.0, "<=", True, 5), ("N", "line_discount", 0.05, "==", False, 6), ("N", "line_tax", 0.02, ">=", True, 7),
    ("R", "line_quantity", 1.0, "<=", True, 8), ("R", "line_quantity", 49.0, "<", True, 9), ("R", "line_price", 2000.0, ">", True, 10), ("R", "line_discount", 0.03, "==", True, 11),
]
_SQL_METRICS = " UNION ALL ".join(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag AS language, '{m}' AS metric, {c} AS value FROM lineitem" for m, c in _METRICS)
_SQL_LIMITS = ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE), '{d}')" for a, b, c, d, on, o in _LIMITS if on and o != 8)
_SQL_BAD = f"""
WITH m AS ({_SQL_METRICS}), t(language, metric, threshold, comparison) AS (VALUES {_SQL_LIMITS}),
v AS (SELECT m.*, threshold, comparison FROM m JOIN t ON t.language = m.language AND t.metric = m.metric WHERE CASE comparison
  WHEN '<' THEN value >= threshold WHEN '<=' THEN value > threshold WHEN '>' THEN value <= threshold WHEN '>=' THEN value < threshold
  WHEN '==' THEN value <> threshold ELSE value = threshold END)
"""


def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ", ".join(f"'{m}', {c}" for m, c in _METRICS)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_returnflag").alias("language"), F.expr(f"stack({len(_METRICS)}, {pairs}) AS (metric, value)"))
    return rows.withColumn("function", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")))


def line_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.violations(line_metrics(spark, sf_dir), spark.createDataFrame(_LIMITS, gates.SCHEMA))


@query(_SQL_BAD + "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, language, metric, value, threshold, comparison FROM v")
def q_threshold_violations(spark, sf_dir):
    return line_violations(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "language", "metric", "value", "threshold", "comparison")


@query(_SQL_BAD + """SELECT l_orderkey, 'o' || l_orderkey || ':' || l_linenumber || ' (f' || l_linenumber || '): ' || CASE metric WHEN 'line_quantity' THEN 'Line Quantity' WHEN 'line_price'
 THEN 'Line Price' WHEN 'line_tax' THEN 'Line Tax' ELSE 'Line Discount' END || ' is ' || printf('%.2f', value) || ' (threshold: ' || comparison || ' ' || CAST(threshold AS VARCHAR) || ')' AS message FROM v""")
def q_violation_message(spark, sf_dir):
    v = line_violations(spark, sf_dir)
    text = gates.message(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.col("l_linenumber"), F.col("function"), F.col("metric"), F.col("value"), F.col("threshold"), F.col("comparison"))
    return v.select("l_orderkey", text.alias("message"))


@query(_SQL_BAD + """, f AS (SELECT DISTINCT l_orderkey AS path FROM lineitem)
SELECT (SELECT count(*) FROM f) AS total_files, (SELECT count(DISTINCT l_orderkey) FROM v) AS files_with_violations, (SELECT count(*) FROM v) AS total_violations,
 (SELECT string_agg(metric || '=' || n, ',' ORDER BY metric) FROM (SELECT metric, count(*) AS n FROM v GROUP BY metric)) AS by_type, false AS success""")
def q_gate_summary(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.lit("order").alias("language")).distinct()
    out = gates.summary(files, line_violations(spark, sf_dir).withColumn("path", F.col("l_orderkey")))
    types = F.array_join(F.transform(F.map_entries("violations_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("total_files", "files_with_violations", "total_violations", types.alias("by_type"), "success")


@query("""
WITH s AS (SELECT p_brand AS path, p_name || ' ' || p_partkey AS name, greatest(CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END, CASE WHEN p_retailprice > 1000 THEN round(p_retailprice / 50, 2) END) AS score FROM part)
SELECT path, name, score, CAST(row_number() OVER (ORDER BY score DESC, path, name) AS INTEGER) AS rank FROM s WHERE score IS NOT NULL ORDER BY rank LIMIT 50""")
def q_worst_topk(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_brand").alias("path"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("cyclomatic"), F.when(F.col("p_retailprice") > 1000, F.round(F.col("p_retailprice") / 50, 2)).alias("cognitive"))
    return gates.worst(f, 50).select("path", "name", "score", "rank")


@query(f"WITH m AS ({_SQL_METRICS}) SELECT language, metric, count(value) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(coalesce(stddev_samp(value), 0), 6) AS std FROM m GROUP BY language, metric")
def q_metric_stats(spark, sf_dir):
    out = stats.by_metric(line_metrics(spark, sf_dir), "language")
    return out.select("language", "metric", "n", F.round("avg", 6).alias("avg"), "min", "max", F.round("std", 6).alias("std"))


@query("""SELECT count(DISTINCT p_brand) AS files, count(DISTINCT (p_brand, p_name)) AS functions, CAST(sum(CASE WHEN p_size > 0 THEN p_size END) AS DOUBLE) AS total_loc, round(avg(CASE WHEN p_size > 0 THEN p_size END), 6) AS avg_loc,
 CAST(min(CASE WHEN p_size > 0 THEN p_size END) AS DOUBLE) AS min_loc, CAST(max(p_size) AS DOUBLE) AS max_loc, round(coalesce(stddev_samp(CASE WHEN p_size > 0 THEN p_size END), 0), 6) AS std_loc, round(avg(p_retailprice), 6) AS avg_cyc, min(p_retailprice) AS min_cyc, max(p_retailprice) AS max_cyc FROM part""")
def q_overall_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("function"), F.expr("stack(2, 'lines_of_code', cast(p_size as double), 'cyclomatic_complexity', p_retailprice) AS (metric, value)"))
    return stats.overall(rows).select("files", "functions", "total_loc", F.round("avg_loc", 6).alias("avg_loc"), "min_loc", "max_loc", F.round("std_loc", 6).alias("std_loc"), F.round("avg_cyc", 6).alias("avg_cyc"), "min_cyc", "max_cyc")


def customer_files(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.col("c_acctbal").alias("value"))


_SQL_FILES = "SELECT r_name AS r, n_name AS n, c_name AS c, c_acctbal AS value FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"
_SQL_FOLDERS = f"f AS ({_SQL_FILES}), e AS (SELECT '.' AS folder, * FROM f UNION ALL SELECT r, * FROM f UNION ALL SELECT r || '/' || n, * FROM f)"


@query(f"WITH {_SQL_FOLDERS} SELECT folder, count(*) AS files, round(sum(value), 2) AS total_bal, round(avg(value), 6) AS avg_bal FROM e GROUP BY folder")
def q_directory_rollup(spark, sf_dir):
    return stats.by_folder(customer_files(spark, sf_dir), {"bal": "value"}).select("folder", "files", F.round("total_bal", 2).alias("total_bal"), F.round("avg_bal", 6).alias("avg_bal"))


@query(f"WITH {_SQL_FOLDERS}, k AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY value DESC, r || '/' || n || '/' || c) AS i FROM e) SELECT folder, r || '/' || n || '/' || c AS path, value AS greatest FROM k WHERE i = 1")
def q_treemap_argmax(spark, sf_dir):
    return stats.greatest_by_folder(customer_files(spark, sf_dir), "value").select("folder", "path", "greatest")


@query(f"""WITH {_SQL_FOLDERS}, p AS (SELECT r || '/' || n || '/' || c AS path, r || '/' || n AS parent, c AS label, max(value) AS v FROM f GROUP BY ALL)
SELECT path AS id, parent, label, coalesce(nullif(v, 0), 1) AS value FROM p UNION ALL
SELECT DISTINCT folder, CASE WHEN folder = '.' THEN NULL WHEN contains(folder, '/') THEN r ELSE '.' END, CASE WHEN contains(folder, '/') THEN n ELSE folder END, CAST(NULL AS DOUBLE) FROM e""")
def q_treemap_nodes(spark, sf_dir):
    return snapshots.nodes(customer_files(spark, sf_dir))


@query("SELECT p_brand AS package, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS total_size, round(avg(p_size), 6) AS avg_size, round(avg(p_retailprice), 6) AS avg_price FROM part GROUP BY p_brand")
def q_module_stats(spark, sf_dir):
    out = stats.by_package(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "package"), "package", {"size": "p_size", "price": "p_retailprice"})
    return out.select("package", "files", "total_size", F.round("avg_size", 6).alias("avg_size"), F.round("avg_price", 6).alias("avg_price"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_tax DESC) AS i FROM lineitem)
SELECT l_partkey, l_suppkey, min(l_linenumber) AS line, max(CASE WHEN i = 1 THEN l_quantity END) AS quantity, max(CASE WHEN i = 1 THEN l_tax END) AS tax FROM o GROUP BY l_partkey, l_suppkey""")
def q_function_grouping(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_linenumber").alias("line"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax").alias("ord"), F.expr("stack(2, 'quantity', l_quantity, 'tax', l_tax) AS (metric, value)"))
    out = stats.functions_of(rows, "l_partkey", "l_suppkey")
    return out.select("l_partkey", "l_suppkey", "line", F.col("values")["quantity"].alias("quantity"), F.col("values")["tax"].alias("tax"))


@query("SELECT o_orderstatus AS language, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS metrics FROM orders GROUP BY o_orderstatus")
def q_language_coverage(spark, sf_dir):
    return stats.coverage_by_language(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("language"), F.col("o_orderpriority").alias("metric")))


@query("WITH l AS (SELECT p_brand, list_sort(list(p_retailprice)) AS v FROM part GROUP BY p_brand) SELECT p_brand, v[least(len(v) - 1, len(v) * 9 // 10) + 1] AS p90, len(v) AS n FROM l")
def q_p90_floor(spark, sf_dir):
    return stats.ninth_decile(table(spark, sf_dir, "part"), "p_retailprice", "p_brand")


@query(f"WITH {_SQL_FOLDERS}, k AS (SELECT DISTINCT r, n, c FROM f) SELECT '.' AS folder, 0 AS modules, count(DISTINCT r) AS children FROM k UNION ALL SELECT r, 0, count(DISTINCT n) FROM k GROUP BY r UNION ALL SELECT r || '/' || n, count(*), count(*) FROM k GROUP BY r, n")
def q_tree_shape(spark, sf_dir):
    return stats.fan_out(customer_files(spark, sf_dir)).select("folder", "modules", "children")


# --- scalar functions


def part_names(spark, sf_dir) -> DataFrame:
    """Parts as functions: camel-cased names with a verb by type, and a number."""
    verb = F.when(F.col("p_size") < 15, "get_").when(F.col("p_size") < 25, "is_").when(F.col("p_size") < 35, "build").otherwise("tmp_")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(verb, F.replace(F.initcap("p_name"), F.lit(" ")), F.lit("_"), F.col("p_size").cast("string")).alias("name"))


_SQL_NAMES = """n AS (SELECT p_partkey, p_size, CASE WHEN p_size < 15 THEN 'get_' WHEN p_size < 25 THEN 'is_' WHEN p_size < 35 THEN 'build' ELSE 'tmp_' END ||
 list_reduce(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), lambda a, b: a || b) || '_' || p_size AS name FROM part),
w AS (SELECT *, list_transform(list_filter(regexp_extract_all(name, '[A-Z]?[a-z]+|[A-Z]|[0-9]+'), lambda x: NOT regexp_matches(x, '^[0-9]')), lambda x: lower(x)) AS words FROM n)"""


@query(f"WITH {_SQL_NAMES} SELECT p_partkey, name, array_to_string(words, ' ') AS words FROM w")
def q_identifier_split(spark, sf_dir):
    return part_names(spark, sf_dir).select("p_partkey", "name", F.array_join(nm.words(F.col("name")), " ").alias("words"))


#: Roles of words in the clarity query, besides the words of p_type, which are plain ones.
_ROLES = [("build", nm.ACTION), ("get", nm.ACTION), ("is", nm.ACTION), ("is", nm.WORD), ("get", nm.WORD), ("tmp", nm.NOISE), ("anodized", nm.NOISE)]
_SQL_SETS = {role: "(" + ", ".join(f"'{w}'" for w, r in _ROLES if r == role) + ")" for role in (nm.WORD, nm.NOISE, nm.ACTION)}


@query(f"""WITH {_SQL_NAMES}, v AS (SELECT DISTINCT lower(unnest(regexp_extract_all(p_type, '[A-Za-z]+'))) AS word FROM part),
d AS (SELECT DISTINCT name, words FROM w), e AS (SELECT name, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
s AS (SELECT word, unnest([word, CASE WHEN word LIKE '%ies' THEN left(word, -3) || 'y' END, CASE WHEN word LIKE '%es' THEN left(word, -2) END, CASE WHEN word LIKE '%s' THEN left(word, -1) END,
 CASE WHEN word LIKE '%ed' THEN left(word, -2) END, CASE WHEN word LIKE '%ed' THEN left(word, -2) || 'e' END, CASE WHEN word LIKE '%ed' THEN left(word, -1) END, CASE WHEN word LIKE '%ing' THEN left(word, -3) END, CASE WHEN word LIKE '%ing' THEN left(word, -3) || 'e' END]) AS stem FROM (SELECT DISTINCT word FROM e)),
h AS (SELECT word, bool_or(stem IN (SELECT word FROM v) OR stem IN {_SQL_SETS[nm.WORD]}) AS hit FROM s WHERE stem IS NOT NULL GROUP BY word),
c AS (SELECT name, avg(CASE WHEN hit THEN 1 ELSE 0 END) AS rate, avg(CASE WHEN e.word IN {_SQL_SETS[nm.NOISE]} THEN 1 ELSE 0 END) AS noise, bool_or(i = 1 AND e.word IN {_SQL_SETS[nm.ACTION]}) AS acts FROM e JOIN h ON h.word = e.word GROUP BY name)
SELECT name, round(greatest(rate * CASE WHEN acts THEN 1.0 ELSE 0.7 END - noise, 0), 6) AS score FROM c""")
def q_name_clarity(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all("p_type", F.lit("([A-Za-z]+)"))).alias("word"))
    roles = spark.createDataFrame(_ROLES, "word string, role string")
    known = nm.vocabulary(words.select("word", F.lit(nm.WORD).alias("role")).unionByName(roles))
    return nm.clarity(part_names(spark, sf_dir), known).select("name", F.round("score", 6).alias("score"))


@query(f"""WITH {_SQL_NAMES}, a AS (SELECT *, CASE WHEN p_size > 20 THEN 'str' WHEN p_size > 17 THEN 'bool' END AS annotation, p_size > 7 AS returns FROM w)
SELECT p_partkey, name, (regexp_matches(name, '^(is|has|should|can)_') AND coalesce(NOT contains(annotation, 'bool'), false)) OR (regexp_matches(name, '^(get|fetch)_') AND NOT returns) OR contains(name, '_and_') AS lies FROM a""")
def q_antipatterns(spark, sf_dir):
    annotation = F.when(F.col("p_size") > 20, "str").when(F.col("p_size") > 17, "bool")
    return part_names(spark, sf_dir).select("p_partkey", "name", nm.lies(F.col("name"), annotation, F.col("p_size") > 7).alias("lies"))


@query(r"""WITH d AS (SELECT doc_id, text, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS lines,
 len(regexp_extract_all(lower(text), '(?:^|[^a-z0-9_])(the|der|los|les)(?:$|[^a-z0-9_])')) AS marks FROM documents)
SELECT doc_id, CAST(lines AS INTEGER) AS total_lines, CAST(marks AS INTEGER) AS marks, round(CASE WHEN lines = 0 THEN 0 ELSE 1000.0 * marks / lines END, 6) AS density FROM d""")
def q_marker_density(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    marks = F.regexp_count(F.lower("text"), F.lit(r"(?:^|[^a-z0-9_])(the|der|los|les)(?:$|[^a-z0-9_])"))
    # generated columns, so that the count of marks isn't put in place of each use of it
    counted = d.select("doc_id", total_lines(F.col("text")).alias("total_lines"), marks.alias("marks"))
    return counted.select("doc_id", F.inline(F.array(F.struct("total_lines", "marks")))).withColumn("density", F.round(density(F.col("marks"), F.col("total_lines")), 6))


def density(marks, lines, per: float = 1000.0):
    """Marks per so many lines; 0 without lines."""
    return F.when(lines == 0, 0.0).otherwise(per * marks / lines)


def total_lines(text):
    """Lines of a text; a last one counts without its newline too, an empty text has none."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n"), 0).otherwise(1))


_ENDS = ("py", "PY", "ipynb", "ts", "mjs", "tsx", "txt")
_PLACES = ("src", "tests", "build/out", "docs/tests/unit", "src/generated")


def part_paths(spark, sf_dir) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    p = table(spark, sf_dir, "part")
    stem = F.concat(F.when(F.col("p_size") < 10, "test_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") > 40, "_test").otherwise(""))
    return p.select("p_partkey", F.concat(pick(_PLACES, F.col("p_partkey") % 5), F.lit("/"), stem, F.lit("."), pick(_ENDS, F.col("p_size") % 7)).alias("path"))


_SQL_PATHS = f"""p AS (SELECT p_partkey, {list(_PLACES)}[p_partkey % 5 + 1] || '/' || CASE WHEN p_size < 10 THEN 'test_' ELSE '' END || replace(p_name, ' ', '_') || CASE WHEN p_size > 40 THEN '_test' ELSE '' END || '.' || {list(_ENDS)}[p_size % 7 + 1] AS path FROM part)"""


@query(f"""WITH {_SQL_PATHS}, g AS (SELECT *, CASE WHEN path LIKE 'src/%blue\\_%' ESCAPE '\\' AND NOT path LIKE 'src/%/%' THEN false WHEN regexp_matches(path, '^src/generated/') THEN true WHEN path LIKE '%.txt' THEN true WHEN path LIKE 'build/%' THEN true WHEN regexp_matches(path, '(^|/)test_[^/]*\\.py$') THEN true ELSE false END AS raw FROM p)
SELECT p_partkey, path, raw AND NOT path LIKE '%red\\_%' ESCAPE '\\' AS ignored FROM g""")
def q_ignore_filter(spark, sf_dir):
    rules = ["# made by tools", "**/test_*.py", "build/", "", "*.txt", "src/generated/**", "!src/*blue_*"]
    return part_paths(spark, sf_dir).select("p_partkey", "path", paths.ignored(F.col("path"), rules, ["*red_*"]).alias("ignored"))


@query(f"WITH {_SQL_PATHS} SELECT p_partkey, path, path LIKE '%/tests/%' OR path LIKE 'tests/%' OR regexp_matches(path, '(^|/)test_[^/]*$') OR path LIKE '%\\_test.py' ESCAPE '\\' AS is_test FROM p")
def q_test_path(spark, sf_dir):
    return part_paths(spark, sf_dir).select("p_partkey", "path", paths.is_test(F.col("path")).alias("is_test"))


@query(f"WITH {_SQL_PATHS} SELECT CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'ipynb' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'mjs' THEN 'javascript' ELSE 'unknown' END AS language, count(*) AS files FROM p GROUP BY 1")
def q_language_detect(spark, sf_dir):
    return part_paths(spark, sf_dir).groupBy(paths.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {_SQL_PATHS} SELECT p_partkey, CASE WHEN length(path) > 30 THEN '...' || right(path, 27) ELSE path END AS shown, array_to_string(string_split(path, '/')[-2:], '/') AS parent FROM p")
def q_display_path(spark, sf_dir):
    return part_paths(spark, sf_dir).select("p_partkey", paths.shown(F.col("path")).alias("shown"), paths.shown(F.col("path"), "parent", 100).alias("parent"))


# --- snapshots: parts before and after a ship date


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.expr("stack(2, 'quantity', l_quantity, 'maintainability_index', 100 * l_tax) AS (metric, value)"), (F.col("l_shipdate") < "1998-06-01").alias("early"))
    old, new = (l.filter(c).groupBy("path", "name", "metric").agg(F.max("value").alias("value")) for c in (F.col("early"), ~F.col("early")))
    return old, new


_SQL_SIDES = """l AS (SELECT 's' || l_suppkey AS path, 'p' || l_partkey AS name, metric, value, l_shipdate < TIMESTAMP '1998-06-01' AS early FROM (SELECT *, 'quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT *, 'maintainability_index', 100 * l_tax FROM lineitem)),
o AS (SELECT path, name, metric, max(value) AS value FROM l WHERE early GROUP BY path, name, metric), n AS (SELECT path, name, metric, max(value) AS value FROM l WHERE NOT early GROUP BY path, name, metric)"""


@query(f"""WITH {_SQL_SIDES}, a AS (SELECT DISTINCT path, name FROM o), b AS (SELECT DISTINCT path, name FROM n)
SELECT coalesce(a.path, b.path) AS path, coalesce(a.name, b.name) AS name, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'common' END AS status FROM a FULL JOIN b ON a.path = b.path AND a.name = b.name""")
def q_snapshot_diff_files(spark, sf_dir):
    return snapshots.changed_keys(*sides(spark, sf_dir), "path", "name")


_SQL_DELTAS = "d AS (SELECT o.path, o.name, o.metric, o.value AS old, n.value AS new, n.value - o.value AS delta FROM o JOIN n ON n.path = o.path AND n.name = o.name AND n.metric = o.metric)"


@query(f"WITH {_SQL_SIDES}, {_SQL_DELTAS} SELECT path, name, metric, old, new, round(delta, 6) AS delta, CASE WHEN metric = 'maintainability_index' THEN delta < 0 ELSE delta > 0 END AS regressed FROM d WHERE abs(delta) > 0.01")
def q_snapshot_diff_metrics(spark, sf_dir):
    return snapshots.changed_values(*sides(spark, sf_dir), "path", "name").withColumn("delta", F.round("delta", 6))


@query(f"WITH {_SQL_SIDES}, a AS (SELECT DISTINCT path, metric, CASE WHEN value < 49 THEN name END AS name FROM o WHERE value > 40), b AS (SELECT DISTINCT path, metric, CASE WHEN value < 49 THEN name END AS name FROM n WHERE value > 40) SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def q_violation_diff(spark, sf_dir):
    old, new = (x.filter("value > 40").select("path", "metric", F.when(F.col("value") < 49, F.col("name")).alias("name")) for x in sides(spark, sf_dir))
    return snapshots.changed_violations(old, new, "path", "metric", "name")


@query(f"""WITH {_SQL_SIDES}, {_SQL_DELTAS}, s AS (SELECT path, max(delta) AS delta, bool_or(new > 45 AND old <= 45) AS newly FROM d WHERE metric = 'quantity' GROUP BY path)
SELECT path, delta, newly, CAST(row_number() OVER (ORDER BY newly DESC, delta DESC, path) AS INTEGER) AS rank FROM s WHERE newly OR delta > 0""")
def q_regressions(spark, sf_dir):
    d = snapshots.changed_values(*sides(spark, sf_dir), "path", "name", epsilon=-1.0).filter("metric = 'quantity'")
    scores = d.groupBy("path").agg(F.max("delta").alias("delta"), F.max((F.col("new") > 45) & (F.col("old") <= 45)).alias("newly")).withColumn("name", F.lit(""))
    return snapshots.regressions(scores).select("path", "delta", "newly", "rank")
