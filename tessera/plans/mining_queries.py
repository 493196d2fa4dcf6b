"""History, coverage, narrative and clones. Orders stand for commits that change parts by the quantities of their lines;
suppliers stand for tests that cover parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import clones, graph, history, narrative
from tessera.plans.registry import registry
from tessera.sources.cache import misses
from tessera.sources.numstat import parsed
from tessera.sources.tables import table
from tessera.streaming.churn import windowed

QUERIES, ORACLE_SQL, query = registry()


def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_orderkey").alias("seq"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"), F.col("l_partkey").alias("path"))


@query("SELECT l_partkey AS path, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS churn, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY l_partkey")
def q_churn(spark, sf_dir):
    return history.churn(numstat(spark, sf_dir)).select("path", "churn", "commits")


@query("SELECT l_partkey AS path, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS churn FROM lineitem GROUP BY l_partkey ORDER BY churn DESC, min(l_orderkey), path LIMIT 20")
def q_churn_topk(spark, sf_dir):
    return history.top_churn(numstat(spark, sf_dir)).select("path", "churn")


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS p FROM lineitem), n AS (SELECT p, count(*) AS n FROM t GROUP BY p),
s AS (SELECT a.p AS a, b.p AS b, count(*) AS support FROM t a JOIN t b ON a.c = b.c AND a.p < b.p GROUP BY a.p, b.p HAVING count(*) >= 2)
SELECT s.a, s.b, support, round(support / least(x.n, y.n), 6) AS confidence FROM s JOIN n x ON x.p = s.a JOIN n y ON y.p = s.b""")
def q_co_change(spark, sf_dir):
    return history.change_coupling(numstat(spark, sf_dir), 2).withColumn("confidence", F.round("confidence", 6))


@query("""WITH c AS (SELECT l_partkey AS path, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS churn FROM lineitem GROUP BY l_partkey)
SELECT path, churn, p_size AS complexity, churn * p_size AS hotspot FROM c JOIN part ON p_partkey = path""")
def q_hotspot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("complexity"))
    return history.hotspots(history.churn(numstat(spark, sf_dir)), p)


@query("""WITH l AS (SELECT l_orderkey, l_partkey, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS t, CAST(l_quantity AS BIGINT) + l_linenumber AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT l_orderkey, count(DISTINCT CASE WHEN t THEN l_partkey END) AS tests, bool_or(NOT t) AS other FROM l GROUP BY l_orderkey)
SELECT round(sum(CASE WHEN t THEN n ELSE 0 END) / sum(CASE WHEN t THEN 0 ELSE n END), 6) AS test_churn_ratio, (SELECT median(tests) FROM c WHERE other) AS multiplicity FROM l""")
def q_suite_health(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_brand")
    rows = numstat(spark, sf_dir).join(p, "path")
    return history.suite_health(rows, F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).withColumn("test_churn_ratio", F.round("test_churn_ratio", 6))


def coverage(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("test"), F.col("l_returnflag").alias("file"), F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line"))


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS test, l_returnflag AS file, l_partkey, l_linenumber FROM lineitem), a AS (SELECT *, count(*) OVER (PARTITION BY file, l_partkey, l_linenumber) AS n FROM c)
SELECT test, count(*) AS lines, count(CASE WHEN n = 1 THEN 1 END) AS unique_lines, round(count(CASE WHEN n = 1 THEN 1 END) / count(*), 6) AS ratio FROM a GROUP BY test""")
def q_unique_coverage(spark, sf_dir):
    return history.unique_coverage(coverage(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query("SELECT l_partkey AS file, count(DISTINCT l_suppkey) AS tests FROM lineitem GROUP BY l_partkey ORDER BY tests DESC, file LIMIT 15")
def q_blast_radius(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("file"))
    return history.blast_radius(c).orderBy(F.desc("tests"), "file").limit(15)


@query("""WITH RECURSIVE c AS (SELECT DISTINCT l_suppkey AS test, l_partkey AS item FROM lineitem),
r AS (SELECT 0 AS step, test AS pick, CAST(0 AS BIGINT) AS gain, test, item, false AS covered FROM c UNION ALL
 SELECT r.step + 1, b.pick, b.gain, r.test, r.item, r.covered OR r.item IN (SELECT x.item FROM r x JOIN (SELECT test AS pick, count(*) AS gain FROM r WHERE NOT covered GROUP BY test ORDER BY gain DESC, test LIMIT 1) y ON x.test = y.pick)
 FROM r, (SELECT test AS pick, count(*) AS gain FROM r WHERE NOT covered GROUP BY test ORDER BY gain DESC, test LIMIT 1) b)
SELECT DISTINCT pick AS test, step, gain FROM r WHERE step > 0""")
def q_set_cover(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("item"))
    return graph.greedy_cover(c)


@query("""WITH f AS (SELECT count(*) AS n FROM documents), w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-zà-ÿ]+')) AS name FROM documents)
SELECT name, count(*) AS callers FROM w WHERE name <> '' GROUP BY name HAVING count(*) >= greatest(5, floor(0.2 * (SELECT n FROM f)))""")
def q_ambient_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    calls = d.select(F.col("doc_id").alias("caller"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-zà-ÿ]+"))).alias("name")).filter("name <> ''")
    return narrative.ambient(calls, F.lit(d.count()))


@query("""WITH u AS (SELECT user_id, count(*) AS statements, count(CASE WHEN event_type = 'purchase' THEN 1 END) > 12 AS tells, count(CASE WHEN value > 20 THEN 1 END) AS weight, count(DISTINCT event_type) - 4 AS nesting FROM events GROUP BY user_id),
k AS (SELECT *, CASE WHEN statements < 3 THEN 'trivial' WHEN tells AND weight > 4 THEN 'mixed' WHEN tells THEN 'narrator' ELSE 'computer' END AS kind FROM u)
SELECT user_id, kind, CASE kind WHEN 'narrator' THEN statements > 9 WHEN 'computer' THEN statements > 8 OR nesting > 1 ELSE false END AS over FROM k""")
def q_classify(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("statements"), (F.count_if(F.col("event_type") == "purchase") > 12).alias("tells"), F.count_if(F.col("value") > 20).alias("weight"), (F.count_distinct("event_type") - 4).alias("nesting"))
    k = narrative.kind(F.col("statements"), F.col("tells"), F.col("weight"), 4)
    return e.select("user_id", k.alias("kind"), narrative.over_budget(k, F.col("statements"), F.col("nesting")).alias("over"))


@query("""WITH d AS (SELECT l_orderkey AS module, l_partkey AS name, max(l_linenumber) AS line FROM lineitem GROUP BY ALL),
c AS (SELECT a.l_orderkey AS module, d.line > a.l_linenumber AS down FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_quantity > a.l_quantity AND a.l_partkey <> b.l_partkey JOIN d ON d.module = b.l_orderkey AND d.name = b.l_partkey),
r AS (SELECT module, avg(CASE WHEN down THEN 1 ELSE 0 END) AS ratio FROM c GROUP BY module)
SELECT o.module, round(coalesce(ratio, 1), 6) AS ratio FROM (SELECT DISTINCT l_orderkey AS module FROM lineitem) o LEFT JOIN r ON r.module = o.module""")
def q_step_down(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("lineno"), "l_quantity")
    a, b = l.select("module", F.col("name").alias("caller"), F.col("lineno").alias("caller_line"), F.col("l_quantity").alias("q")), l.select("module", F.col("name").alias("callee"), "l_quantity")
    calls = a.join(b, "module").filter("l_quantity > q").select("module", "caller", "caller_line", "callee")
    return narrative.step_down(calls, l.select("module", "name", "lineno", F.col("lineno").alias("ord"))).withColumn("ratio", F.round("ratio", 6))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, md5(lower(regexp_replace(line, '[^A-Za-z]+', ' ', 'g'))) AS h FROM l WHERE length(line) > 20)
SELECT h AS group_hash, count(*) AS n, count(DISTINCT doc_id) AS docs FROM h GROUP BY h HAVING count(*) >= 2""")
def q_clone_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("length(line) > 20")
    units = lines.select("doc_id", F.md5(F.lower(F.regexp_replace("line", "[^A-Za-z]+", " "))).alias("group_hash"))
    return clones.clone_groups(units).groupBy("group_hash", "n").agg(F.count_distinct("doc_id").alias("docs"))


@query("""WITH l AS (SELECT doc_id, md5(lower(regexp_replace(line, '[^A-Za-z]+', ' ', 'g'))) AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20),
g AS (SELECT h FROM l GROUP BY h HAVING count(*) >= 2), s AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS sloc FROM documents),
c AS (SELECT doc_id, count(*) AS lines FROM l JOIN g ON g.h = l.h GROUP BY doc_id) SELECT c.doc_id AS path, lines, round(least(lines / sloc, 1), 6) AS ratio FROM c JOIN s ON s.doc_id = c.doc_id""")
def q_duplication(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("lineno", "line")).filter("length(line) > 20")
    units = lines.select("path", "lineno", F.col("lineno").alias("end_lineno"), F.md5(F.lower(F.regexp_replace("line", "[^A-Za-z]+", " "))).alias("group_hash"))
    sizes = d.select(F.col("doc_id").alias("path"), F.size(F.split("text", "\n")).alias("sloc"))
    return clones.duplication(clones.clone_groups(units), sizes).withColumn("ratio", F.round("ratio", 6))


@query("""SELECT o_custkey AS log, count(*) AS commits, CAST(sum(n) AS BIGINT) AS rows_kept, CAST(sum(churn) AS BIGINT) AS churn FROM (
 SELECT o_custkey, o_orderkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS churn FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY o_custkey, o_orderkey) GROUP BY o_custkey""")
def q_numstat_parse(spark, sf_dir):
    """A log by customer: a mark before each order, then a row for each line; those returned are binary."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    row = F.concat_ws("\t", F.when(F.col("l_returnflag") == "R", F.lit("-")).otherwise(F.col("l_quantity").cast("long").cast("string")), F.when(F.col("l_returnflag") == "R", F.lit("-")).otherwise(F.col("l_linenumber").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    commits = l.groupBy("o_custkey", "o_orderkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("body"))
    logs = commits.groupBy(F.col("o_custkey").alias("log")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "body"))), lambda c: F.concat(F.lit("@@commit@@\n"), c["body"])), "\n").alias("text"))
    rows = parsed(logs, "text", "@@commit@@", "log")
    return rows.groupBy("log").agg(F.count_distinct("commit").alias("commits"), F.count(F.lit(1)).alias("rows_kept"), F.sum(F.col("added") + F.col("deleted")).alias("churn"))


@query("""WITH c AS (SELECT DISTINCT sha256(chr(1) || 'v1' || chr(1) || 'text' || chr(1) || b.text) AS k FROM benchmark b), d AS (SELECT doc_id, sha256(chr(1) || 'v1' || chr(1) || 'text' || chr(1) || text) AS content_key FROM documents)
SELECT doc_id, content_key FROM d WHERE content_key NOT IN (SELECT k FROM c)""")
def q_cache_misses(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("text").alias("content"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return misses(d, b, "v1", "text").select("doc_id", "content_key")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def q_events_daily_churn(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events"), "1 day").select(F.col("start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))
