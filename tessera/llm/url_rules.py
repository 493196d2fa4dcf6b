"""Filtering of URLs by association rules.

A URL is a set of tokens: its host, the host's labels and their words, words of the path (numbers alike), names and pairs
of the query, and whether there is a fragment. FP-growth mines the token combinations of the pages labelled bad (quality
0 or toxic) that reach the least support; each combination is counted over all labelled pages, and those of enough
confidence become rules, without any that a shorter rule of no less confidence implies. Tokens that occur in the same
labelled pages are mined as one item, so that copies of a long URL don't multiply combinations; a URL has the item if it
has any of these tokens, since each of them alone makes a rule of the same pages. Such rules count as one. Rules are
matched by an inverted index: a rule is listed under its rarest item, and a URL's items look up the rules whose other
items it has too.

All rules are found, of any number of items and in URLs of any length. Patterns grow by FP-growth's conditional tables: the
rows of an item, bad and good, cut to the items that more pages have, go to one task, which adds items one by one (tables
of more than ``GROUP_ROWS`` distinct rows are split by the next item first). Combinations grow with the power of a URL's
items, so only what a shorter rule would imply anyway is left out: an item that only bad pages have, or a combination that
no good page has, isn't grown further, as its confidence is 1; nor is a combination that holds for the same good pages as a
part of it, as the part is as sure; nor one whose longer ones can't be surer than a rule found in it, counting those good
pages that have all that might be added. What is left is at worst still exponential, as the rules themselves may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.sources.tables import cut

#: Least share of the bad pages, and least number of them, that a rule must hold for; least share of bad among its pages.
SUPPORT, COUNT, CONFIDENCE = 0.001, 5, 0.6
#: Distinct rows of a conditional table that one task takes; larger ones are split by the next item.
GROUP_ROWS = 4096
#: Rules up to which their index is sent to all executors; beyond it the match shuffles.
SENT_RULES = 20_000


def tokens(url: Column) -> Column:
    """The tokens of a URL, sorted and distinct; none for null and for a URL without letters or digits."""
    rest = F.lower(F.regexp_replace(F.trim(F.coalesce(url.cast("string"), F.lit(""))), "^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*", 0), "^[^@]*@", ""), ":[0-9]*$", "")
    path, query = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1)
    named = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    labels, words = F.split(host, "\\."), F.split(host, "[.\\-_]")
    steps = F.transform(F.split(path, "[/.\\-_]+"), lambda x: F.regexp_replace(x, "^[0-9]+$", "#"))
    pairs = F.split(query, "[&;]")
    names = F.transform(pairs, lambda x: F.regexp_extract(x, "^[^=]*", 0))
    end = F.when(rest.contains("#"), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(named("host:", F.array(host)), named("h:", labels), named("h:", words), named("p:", steps), named("q:", names), named("q:", F.filter(pairs, lambda x: x.contains("="))), end)
    return F.array_sort(F.array_distinct(every))


def _key(x: Column) -> Column:
    return F.md5(F.concat_ws("\x00", x))


def matches(rules: DataFrame, sets: DataFrame, sent: bool) -> DataFrame:
    """(set_key, rule_key) of each rule (rule_key, rule, entry) all of whose tokens a set (set_key, tokens) has."""
    looked = sets.select("set_key", "tokens", F.explode("tokens").alias("entry"))
    index = F.broadcast(rules) if sent else rules.hint("merge")
    return looked.join(index, "entry").filter(F.size(F.array_except("rule", "tokens")) == 0).select("set_key", "rule_key")


def named(sets: DataFrame, member: DataFrame) -> DataFrame:
    """(set_key, tokens, least) of rows (set_key, tokens): the items that a set has, and by item the least of its tokens there."""
    own = sets.select("set_key", F.explode("tokens").alias("token")).join(member, "token").groupBy("set_key", "name").agg(F.min("token").alias("token"))
    return own.groupBy("set_key").agg(F.collect_list("name").alias("tokens"), F.map_from_entries(F.collect_list(F.struct("name", "token"))).alias("least"))


class Grower:
    """Rules that begin with some items, from the rows that have these: has tells which further items each row has, bad and
    good how often it occurs. single holds the confidence of each further item alone, 0 where it is no rule."""

    def __init__(self, has: np.ndarray, bad: np.ndarray, good: np.ndarray, single: np.ndarray, least: float, confidence: float):
        self.has, self.bad, self.good, self.single = has, bad.astype(np.float64), good.astype(np.float64), single
        self.least, self.confidence = least, confidence
        self.found: list[tuple[tuple[int, ...], int, int]] = []

    def grow(self, surest: float) -> list[tuple[tuple[int, ...], int, int]]:
        """(further items, bad, all) of the rules; surest is the confidence of the surest one of the first items."""
        stack = [self._longer((), np.arange(len(self.bad)), np.arange(self.has.shape[1]), [], surest)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            else:
                stack.append(self._longer(*child))
        return self.found

    def _longer(self, items: tuple[int, ...], rows: np.ndarray, more: np.ndarray, without: list[np.ndarray], surest: float) -> Iterator[tuple]:
        """Adds each of more to items, which rows have; gives those to be grown further. without: of each of items, the
        good rows that have all but it; where none of them has an added item, the rule without it is as sure or surer."""
        x = self.has[np.ix_(rows, more)]
        n_bad, n_good = self.bad[rows] @ x, self.good[rows] @ x
        keep = (n_bad >= self.least) & (n_good < self.good[rows].sum())
        for r in without:
            keep &= self.has[np.ix_(r, more)].any(0)
        more, x, n_bad, n_good = more[keep], x[:, keep], n_bad[keep], n_good[keep]
        if not len(more):
            return
        sure, top = n_bad / (n_bad + n_good), np.maximum(surest, self.single[more])
        rule = (sure >= self.confidence) & (sure > top)
        self.found += [((*items, int(more[j])), int(n_bad[j]), int(n_bad[j] + n_good[j])) for j in np.flatnonzero(rule)]
        top = np.where(rule, sure, top)
        # good rows that have an item and all after it stay, whatever is added
        stay = self.good[rows] @ np.logical_and.accumulate(x[:, ::-1], axis=1)[:, ::-1]
        bound = n_bad / (n_bad + stay)
        for j in np.flatnonzero((n_good > 0) & (bound > top) & (bound >= self.confidence)):
            if j + 1 < len(more):
                mine = x[:, j]
                yield (*items, int(more[j])), rows[mine], more[j + 1 :], [*(r[self.has[r, more[j]]] for r in without), rows[~mine & (self.good[rows] > 0)]], float(top[j])


_ITEM = "struct<df: bigint, name: string, bad_df: bigint>"


def _grown(least: float, confidence: float):
    """Rules of a conditional table, rows (prefix, items, bad, good) of one prefix."""

    def sure(bad: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
        c = np.asarray(bad) / np.asarray(n)
        return np.where(c >= confidence, c, 0.0)

    def run(rows: pa.Table) -> pa.Table:
        first = rows["prefix"][0].as_py()
        bad, good = (rows[c].to_numpy() for c in ("bad", "good"))
        lists = rows["items"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        of, flat = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
        df, bad_df = (flat.field(c).to_numpy() for c in ("df", "bad_df"))
        names, at, which = np.unique(flat.field("name").to_numpy(zero_copy_only=False).astype(object), return_index=True, return_inverse=True)
        often = np.flatnonzero(np.bincount(which, bad[of], len(names)) >= least)
        often = often[np.lexsort((names[often], df[at[often]]))]
        place = np.full(len(names), -1)
        place[often] = np.arange(len(often))
        has = np.zeros((len(lists), len(often)), bool)
        here = place[which] >= 0
        has[of[here], place[which[here]]] = True
        surest = max(float(sure(x["bad_df"], x["df"])) for x in first)
        found = []
        n_bad, n_good = int(bad.sum()), int(good.sum())
        if len(first) > 1 and (c := float(sure(n_bad, n_bad + n_good))) > surest:
            surest = c
            found.append(((), n_bad, n_bad + n_good))
        if n_good:
            found += Grower(has, bad, good, sure(bad_df[at[often]], df[at[often]]), least, confidence).grow(surest)
        names, mine = names[often], [x["name"] for x in first]
        return pa.table([pa.array([sorted([*mine, *(names[i] for i in t)]) for t, _, _ in found], pa.list_(pa.string())), pa.array([mine[0]] * len(found), pa.string()), pa.array([b for _, b, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())], ["rule", "entry", "n_bad", "n"])

    return run


def grown(sets: DataFrame, least: float, confidence: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rules (rule, entry, n_bad, n) of two or more items from rows (items, bad, good), the items of falling df; without
    those that a shorter rule implies, though not without all of them. entry is the rarest item."""
    level = sets.withColumn("prefix", F.array().cast(f"array<{_ITEM}>"))
    found = []
    while True:
        # the rows of each item, with the items before it
        level = level.select("prefix", "bad", "good", F.posexplode("items").alias("i", "x"), "items").select(F.concat("prefix", F.array("x")).alias("prefix"), F.slice("items", F.lit(1), F.col("i")).alias("items"), "bad", "good")
        level = cut(level.groupBy("prefix", "items").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
        sizes = cut(level.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"), F.sum("bad").alias("n_bad"), F.sum("good").alias("n_good")).filter(F.col("n_bad") >= least))
        big = sizes.filter((F.col("rows") > group_rows) & (F.col("n_good") > 0))
        more = not big.isEmpty()
        small = level.join(sizes.filter((F.col("rows") <= group_rows) | (F.col("n_good") == 0)).select("prefix"), "prefix", "left_semi") if more else level.join(sizes.select("prefix"), "prefix", "left_semi")
        found.append(cut(small.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "prefix").groupBy("prefix").applyInArrow(_grown(least, confidence), "rule array<string>, entry string, n_bad long, n long")))
        if not more:
            break
        whole = big.filter("size(prefix) > 1").select(F.array_sort("prefix.name").alias("rule"), F.col("prefix")[0]["name"].alias("entry"), "n_bad", (F.col("n_bad") + F.col("n_good")).alias("n"))
        found.append(whole.filter(F.col("n_bad") / F.col("n") >= confidence))
        level = level.join(big.select("prefix"), "prefix", "left_semi")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def mined(labelled: DataFrame, support: float = SUPPORT, count: int = COUNT, confidence: float = CONFIDENCE, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame, bool]:
    """Rules (rule_key, rule, entry, n_bad, n, confidence) of items from rows (tokens, bad), the tokens (token, name) of
    their items, and true if both are few enough to send."""
    rows = cut(labelled.groupBy("tokens", "bad").count().withColumn("set_key", _key(F.col("tokens"))))
    n_bad = int(rows.agg(F.sum(F.when(F.col("bad"), F.col("count")))).head()[0] or 0)
    least = max(support * n_bad, count)
    each = rows.select("set_key", "bad", "count", F.explode("tokens").alias("token"))
    mark = lambda seed: F.bit_xor(F.xxhash64("set_key", F.col("bad"), F.lit(seed)))
    by = each.groupBy("token").agg(F.sum("count").alias("df"), F.sum(F.when(F.col("bad"), F.col("count")).otherwise(0)).alias("bad_df"), mark(1).alias("x"), mark(2).alias("y"))
    by = by.filter(F.col("bad_df") >= least)
    classes = cut(by.groupBy("df", "x", "y").agg(F.max("bad_df").alias("bad_df"), F.array_sort(F.collect_list("token")).alias("members")).withColumn("name", F.col("members")[0]))
    member = classes.select("name", F.explode("members").alias("token"))
    # each set of frequent items, as often as it occurs among the bad and the good, the most frequent items first
    item = classes.filter("bad_df < df").select("name", F.struct("df", "name", "bad_df").alias("item"))
    sets = each.join(item, F.col("token") == F.col("name")).groupBy("set_key", "bad").agg(F.max("count").alias("count"), F.reverse(F.array_sort(F.collect_list("item"))).alias("items"))
    sets = sets.groupBy("items").agg(F.sum(F.when(F.col("bad"), F.col("count")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("count"))).alias("good"))
    singles = classes.select(F.array("name").alias("rule"), F.col("name").alias("entry"), F.col("bad_df").alias("n_bad"), F.col("df").alias("n"))
    found = singles.filter(F.col("n_bad") / F.col("n") >= confidence).unionByName(grown(sets, least, confidence, group_rows))
    sure = cut(found.withColumn("confidence", F.col("n_bad") / F.col("n")).withColumn("rule_key", _key(F.col("rule"))))
    few = sure.count() <= SENT_RULES
    inside = matches(sure.select("rule_key", "rule", "entry"), sure.select(F.col("rule_key").alias("set_key"), F.col("rule").alias("tokens")), few).filter("set_key <> rule_key")
    implied = inside.join(sure.select("rule_key", F.col("confidence").alias("theirs")), "rule_key").join(sure.select(F.col("rule_key").alias("set_key"), "confidence"), "set_key").filter("theirs >= confidence").select(F.col("set_key").alias("rule_key")).distinct()
    rules = cut(sure.join(implied, "rule_key", "left_anti"))
    member = cut(member.join(rules.select(F.explode("rule").alias("name")).distinct(), "name", "left_semi"))
    return rules, member, few and member.count() <= SENT_RULES


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of each page that has a label, bad if any of its labels is."""
    mine = labels.filter("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return pages.select("page_id", tokens(F.col("url")).alias("tokens")).join(mine.hint("merge"), F.col("page_id") == F.col("_id")).select("tokens", "bad")


def judged(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, count: int = COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, url, n_rules, confidence, rule, keep) of every page.

    confidence and rule (those of its tokens that the URL has, the least of each item, put together by " + ") are those of
    the surest rule that holds, then of the one of more bad pages, then of the least text; null where none holds. keep is true where none does. A page with several
    labels is bad if one of them is; labels without any value, and those of no page, count for nothing. Without bad pages
    there are no rules. A null or empty URL has no tokens and is kept. Repeated rows count as often as they occur and
    have equal results; null page_ids have no label. Other columns play no part.
    """
    rules, member, few = mined(labelled_pages(pages, labels), support, count, confidence)
    mine = pages.select("page_id", "url").withColumn("tokens", tokens(F.col("url"))).withColumn("set_key", _key(F.col("tokens")))
    sets = mine.select("set_key", "tokens").distinct()
    sets = named(sets, F.broadcast(member) if few else member.hint("merge"))
    of_rule = rules.select("rule_key", "rule", "confidence", (-F.col("confidence")).alias("a"), (-F.col("n_bad")).alias("b"))
    found = matches(rules.select("rule_key", "rule", "entry"), sets, few).join(F.broadcast(of_rule) if few else of_rule, "rule_key").join(sets.select("set_key", "least"), "set_key")
    found = found.withColumn("text", F.concat_ws(" + ", F.array_sort(F.transform("rule", lambda x: F.element_at("least", x)))))
    best = found.groupBy("set_key").agg(F.count(F.lit(1)).alias("n_rules"), F.min(F.struct("a", "b", "text", "confidence")).alias("best"))
    out = mine.select("page_id", "url", "set_key").join(best.hint("merge"), "set_key", "left")
    return out.select("page_id", "url", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.round("best.confidence", 9).alias("confidence"), F.col("best.text").alias("rule"), F.col("n_rules").isNull().alias("keep"))
