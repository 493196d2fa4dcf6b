"""Iterative graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.sources.tables import by_rows, cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge table; a component is named by its least node.

    Large-star and small-star steps alternate until the edges no longer change, a number of rounds that grows with the
    logarithm of the longest path. Loops count as nodes; edges with a null end are left out.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = cut(e.select("u", "v").distinct())
    e, before = nodes.filter("u <> v"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own, so that the join can split a node of many edges
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if now == before:
            break
        before = now
    every = nodes.select("u").union(nodes.select("v")).distinct()
    return every.join(e, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


#: Edges up to which strong components are found in one task; beyond, by rounds of joins.
TASK_EDGES = 1_000_000


def _strong(edges: list[tuple]) -> dict:
    """Node -> least node of its strong component, by two passes of depth-first search."""
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for start in [*out, *back]:
        if start in seen:
            continue
        seen.add(start)
        todo = [(start, iter(out.get(start, ())))]
        while todo:
            node, rest = todo[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                order.append(node)
                todo.pop()
            else:
                seen.add(nxt)
                todo.append((nxt, iter(out.get(nxt, ()))))
    of: dict = {}
    for start in reversed(order):
        if start in of:
            continue
        group, todo = [], [start]
        of[start] = start
        while todo:
            node = todo.pop()
            group.append(node)
            for x in back.get(node, ()):
                if x not in of:
                    of[x] = start
                    todo.append(x)
        least = min(group)
        for x in group:
            of[x] = least
    return of


def strong_components(edges: DataFrame, a: str = "source", b: str = "target", task_edges: int = TASK_EDGES) -> DataFrame:
    """(component, node) of every node on a cycle of two or more nodes; a component is named by its least node.

    Up to task_edges edges, one task runs a search. Beyond, nodes without a way in or out are trimmed, each node takes
    the greatest name that reaches it, and those nodes that reach their namesake backwards within the name are its
    component; that repeats on what is left.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    kind = e.schema["u"].dataType.simpleString()
    if e.count() <= task_edges:
        import pandas as pd

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            of = _strong(list(zip(rows["u"].tolist(), rows["v"].tolist())))
            out = pd.DataFrame({"component": list(of.values()), "node": list(of)})
            return out[out.groupby("component")["node"].transform("size") > 1]

        return e.groupBy(F.lit("all")).applyInPandas(solve, f"component {kind}, node {kind}")
    found = None
    while True:
        e = _trimmed(e)
        if e.isEmpty():
            break
        nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
        color = cut(nodes.withColumn("c", F.col("node")))
        while True:
            over = e.join(color.hint("merge"), e["u"] == color["node"]).groupBy("v").agg(F.max("c").alias("o"))
            now = cut(color.join(over.hint("merge"), color["node"] == over["v"], "left").select("node", F.greatest("c", "o").alias("n"), "c"))
            color, changed = now.select("node", F.col("n").alias("c")), not now.filter("n <> c").isEmpty()
            if not changed:
                break
        same = e.join(color.withColumnsRenamed({"node": "u", "c": "cu"}), "u").join(color.withColumnsRenamed({"node": "v", "c": "cv"}), "v").filter("cu = cv").select("u", "v", "cu")
        same = cut(same)
        front = color.filter("node = c")
        reached = cut(front)
        while not front.isEmpty():
            back = same.join(front.hint("merge"), (same["v"] == front["node"]) & (same["cu"] == front["c"])).select(F.col("u").alias("node"), F.col("cu").alias("c")).distinct()
            front = cut(back.join(reached.hint("merge"), ["node", "c"], "left_anti"))
            reached = cut(reached.unionByName(front))
        groups = reached.groupBy("c").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        part = cut(reached.join(groups, "c").select("component", "node"))
        found = part if found is None else found.unionByName(part)
        done = reached.select("node")
        e = cut(e.join(done.withColumnRenamed("node", "u"), "u", "left_anti").join(done.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"))
    return found if found is not None else edges.sparkSession.createDataFrame([], f"component {kind}, node {kind}")


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges without those at nodes that have no way in or no way out."""
    n = e.count()
    while n:
        both = e.select(F.col("v").alias("u")).distinct()
        e = cut(e.join(both.hint("merge"), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct().hint("merge"), "v", "left_semi").select("u", "v"))
        n, before = e.count(), n
        if n == before:
            break
    return e


def cycles(components: DataFrame) -> DataFrame:
    """(subject, size) of each component: its nodes in order, as "cycle: a <-> b"."""
    return components.groupBy("component").agg(F.concat(F.lit("cycle: "), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), " <-> ")).alias("subject"), F.count(F.lit(1)).alias("size")).select("subject", "size")


def depths(bases: DataFrame) -> DataFrame:
    """(node, depth, flagged) of each node of an inheritance table (node, base, known): 1 without bases, else one more
    than the deepest base. A base that isn't known counts as 1 and flags the node, as does one that is inherited from so;
    a node on a cycle of bases has depth 1 and a flag. Joins are by sorting, so that no round sends a table by way of the
    driver. There are as many rounds as the longest chain has nodes."""
    rows = cut(bases.select("node", "base", "known").distinct())
    up = rows.filter("known AND base IS NOT NULL").select(F.col("node").alias("below"), F.col("base").alias("above"))
    loops = strong_components(up, "below", "above").select("node").unionByName(up.filter("below = above").select(F.col("below").alias("node")))
    loops = cut(loops.distinct().withColumn("cyclic", F.lit(True)))
    outside = F.max(F.coalesce(~F.col("known") & F.col("base").isNotNull(), F.lit(False))).alias("outside")
    now = rows.groupBy("node").agg(outside).join(loops.hint("merge"), "node", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    now = cut(now.select("node", F.when(F.col("outside") & ~F.col("cyclic"), 2).otherwise(1).alias("depth"), (F.col("outside") | F.col("cyclic")).alias("flagged")))
    up = cut(up.join(loops.withColumnRenamed("node", "below").hint("merge"), "below", "left_anti").select("below", "above"))
    front = now
    while not front.isEmpty():
        more = up.join(front.hint("merge"), up["above"] == front["node"]).groupBy(F.col("below").alias("node")).agg((F.max("depth") + 1).alias("d"), F.max("flagged").alias("f"))
        both = cut(now.join(more.hint("merge"), "node", "left").select("node", "depth", "flagged", F.greatest("depth", "d").alias("d"), (F.col("flagged") | F.coalesce("f", F.lit(False))).alias("f")))
        front = both.filter("d <> depth OR f <> flagged").select("node", F.col("d").alias("depth"), F.col("f").alias("flagged"))
        now = both.select("node", F.col("d").alias("depth"), F.col("f").alias("flagged"))
    return now


#: Rows of whole groups that a task takes at once, and rows in which they come to it.
GROUP_ROWS = 200_000


def by_groups(solve: Callable[[pa.Table], pa.RecordBatch], group: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over rows sorted by group, which must not be null: solve gets many whole groups at once,
    as a call for each would outweigh the work on small ones."""
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch[group][batch.num_rows - 1]
            head = pc.sum(pc.not_equal(batch[group], last)).as_py()
            if n + head >= GROUP_ROWS and (head or have[-1][group][have[-1].num_rows - 1] != last):
                if head:
                    have.append(batch.slice(0, head))
                yield solve(pa.Table.from_batches(have))
                have, n, batch = [], 0, batch.slice(head)
            have.append(batch)
            n += batch.num_rows
        if have:
            yield solve(pa.Table.from_batches(have))

    return run


def cohesion(members: DataFrame, links: DataFrame) -> DataFrame:
    """(class, lcom): how many groups a class's methods fall into that share no field and don't call one another.

    members: class, method; links: class, method, kind and other: a field (kind f) or a method of the class (kind m) that
    the method uses. A class without methods has 0 where it has a row with a null method. A task holds many small classes
    at a time, or one large one.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    none = F.lit(None).cast("string")
    every = members.select("class", text("method"), none.alias("kind"), none.alias("other")).union(links.select("class", text("method"), "kind", text("other")))
    every = every.withColumn("_at", F.xxhash64("class")).repartition("_at").distinct().sortWithinPartitions("_at")
    return every.mapInArrow(by_groups(_cohesive, "_at"), f"class {members.schema['class'].dataType.simpleString()}, lcom long")


def _cohesive(rows: pa.Table) -> pa.RecordBatch:
    import pyarrow.compute as pc

    of: dict = {}

    def find(x):
        while of.setdefault(x, x) != x:
            of[x] = x = of[of[x]]
        return x

    coded = pc.dictionary_encode(rows["class"].combine_chunks(), null_encoding="encode")
    methods = set()
    for c, method, kind, other in zip(coded.indices.to_pylist(), *(rows[x].to_pylist() for x in ("method", "kind", "other"))):
        if method is None:
            continue
        methods.add((c, "m", method))
        if kind is not None and other is not None:
            a = find((c, "m", method))
            of[a] = find((c, kind, other))
    counts = [0] * len(coded.dictionary)
    for c, *_ in {find(m) for m in methods}:
        counts[c] += 1
    return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(counts, pa.int64())], ["class", "lcom"])


#: Cells up to which a greedy cover of tests that share items, by way of others too, is found in one task, and those up to
#: which nobody looks whether all do.
TASK_CELLS, FEW_CELLS = 40_000_000, 4_000_000


def _covers(cells: pa.Table) -> pa.RecordBatch:
    """test and gain of the greedy cover of some cells (test, item): the items of each test and the tests of each item
    are kept, gains fall as items are covered, and a heap holds what each test had when it was last looked at."""
    import heapq

    import numpy as np

    def coded(name: str) -> tuple[np.ndarray, pa.Array]:
        column = cells[name].combine_chunks().dictionary_encode()
        return column.indices.to_numpy(zero_copy_only=False).astype(np.int32), column.dictionary

    tests, values = coded("test")
    names = values.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int32)
    rank[order] = np.arange(len(names), dtype=np.int32)
    tests, (items, known) = rank[tests], coded("item")
    n_items = len(known)
    del known, cells
    by_test, by_item = items[np.argsort(tests, kind="stable")], tests[np.argsort(items, kind="stable")]
    gains = np.bincount(tests, minlength=len(names))
    begins, places = (np.concatenate(([0], np.cumsum(np.bincount(c, minlength=m)))) for c, m in ((tests, len(names)), (items, n_items)))
    del tests, items
    covered = np.zeros(n_items, bool)
    heap = [(-g, k) for k, g in enumerate(gains.tolist())]
    heapq.heapify(heap)
    picked: list[tuple[int, int]] = []
    while heap:
        gain, k = heapq.heappop(heap)
        now = int(gains[k])
        if now != -gain:
            if now:
                heapq.heappush(heap, (-now, k))
            continue
        picked.append((k, now))
        mine = by_test[begins[k] : begins[k + 1]]
        mine = mine[~covered[mine]]
        covered[mine] = True
        others = [by_item[a:b] for a, b in zip(places[mine].tolist(), places[mine + 1].tolist())]
        np.subtract.at(gains, np.concatenate(others), 1)
    chosen = pa.array([order[k] for k, _ in picked], pa.int64())
    return pa.RecordBatch.from_arrays([values.take(chosen), pa.array([g for _, g in picked], pa.int64())], ["test", "gain"])


def _sharing(cells: DataFrame) -> DataFrame:
    """cells (test, item, first: the least test of the item) with a part: tests that share items, by way of others too,
    have the same. Each test hooks onto the least test next to it; what joins hooks is little."""
    hooks = cut(cells.groupBy("test").agg(F.min("first").alias("hook")))
    near = cells.select("test", "item").join(hooks, "test").select("item", "hook").distinct()
    joins = near.withColumn("least", F.min("hook").over(Window.partitionBy("item"))).filter("hook <> least").select("least", "hook").distinct()
    parts = connected_components(hooks.select(F.col("test").alias("a"), F.col("hook").alias("b")).unionByName(joins.select(F.col("least").alias("a"), F.col("hook").alias("b"))))
    return cells.select("test", "item").join(parts.select(F.col("node").alias("test"), F.col("component").alias("part")), "test")


def greedy_cover(cells: DataFrame, task_cells: int = TASK_CELLS) -> DataFrame:
    """(test, step, gain): tests (test, item) in the order in which a greedy cover takes them, each the one of most items
    not yet covered, the least name first.

    What the cover takes of tests that share no items with others, by way of any, doesn't depend on those; so such parts
    are covered one by one, many in a task and all tasks at once, and the order of all is that of gain and name, as gains
    only fall. A part of more than task_cells cells goes by rounds of joins until so few are left (see _rounds).
    """
    from tessera.operators.gates import ranked

    plain = cells.select("test", "item").filter("test IS NOT NULL AND item IS NOT NULL")
    kind = plain.schema["test"].dataType.simpleString()
    left = by_rows(plain, "item").distinct()
    if plain.count() <= min(task_cells, FEW_CELLS):
        parts = left.withColumn("part", F.lit(0))
        every = parts.repartition(1).mapInArrow(by_groups(_covers, "part"), f"test {kind}, gain long")
    else:
        parts = cut(_sharing(cut(left.withColumn("first", F.min("test").over(Window.partitionBy("item"))))))
        large = cut(parts.groupBy("part").count().filter(F.col("count") > task_cells).select("part"))
        small = by_rows(parts.join(large, "part", "left_anti"), "part").sortWithinPartitions("part")
        every = small.mapInArrow(by_groups(_covers, "part"), f"test {kind}, gain long")
        if not large.isEmpty():
            every = every.unionByName(_rounds(cut(parts.join(large, "part").select("test", "item")), task_cells))
    return ranked(every, [F.desc("gain"), F.asc("test")]).select("test", F.col("rank").alias("step"), "gain")


def _rounds(left: DataFrame, task_cells: int) -> DataFrame:
    """(test, gain) of the greedy cover of cells (test, item). A test that comes before all others with which it shares
    an uncovered item, by gain and then by name, is taken with the gain that it has now, whatever is taken before: gains
    only fall, and only by tests that share items. So each round takes all such tests at once. The last task_cells cells
    are for one task."""
    kind, taken = left.schema["test"].dataType.simpleString(), []
    while (n := left.count()) > task_cells:
        gains = left.groupBy("test").agg(F.count(F.lit(1)).alias("gain"))
        of = cut(left.join(gains, "test"))
        least = of.groupBy("item").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("test").alias("t")))["t"].alias("best"))
        won = least.groupBy(F.col("best").alias("test")).agg(F.count(F.lit(1)).alias("wins"))
        picked = cut(won.join(gains, "test").filter("wins = gain").select("test", "gain"))
        taken.append(picked)
        gone = cut(left.join(picked.select("test"), "test").select("item").distinct())
        left = cut(left.join(gone, "item", "left_anti"))
    if n:
        taken.append(left.withColumn("part", F.lit(0)).repartition(1).mapInArrow(by_groups(_covers, "part"), f"test {kind}, gain long"))
    every = taken[0]
    for x in taken[1:]:
        every = every.unionByName(x)
    return every
