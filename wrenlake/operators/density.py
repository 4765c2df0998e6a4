"""Clusters by density: the minimum spanning tree of mutual reachability, its hierarchy, and the clusters that last longest.

Mutual reachability of two rows is the greatest of their distance and their core distances.  The tree grows by rounds: each
component finds its least edge to another one, by weight and then by ids.  Known edges to near neighbours and to a sample of rows
bound the edge from above, so only blocks within that bound are searched, and only for rows whose farthest known neighbour is within it:
what a row doesn't know is no nearer.  A component that holds most of the sample waits for the others to choose.  Components are contracted by pointers that
double their reach; nothing of the size of the data leaves the executors.

The hierarchy is read off the tree's edges in order of weight, a range of edges a task: the components that a range starts from
come from halving, the lower half of the edges contracted for the upper half.  Each task replays its own merges.  Merges of two
large sides split a cluster; smaller sides fall out of it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stash
from .neighbours import Index, core_of, distance, distinct, neighbours, numbers, record, squares, within

RANGE = 1 << 14  # edges of a range
PAIRS = 1 << 16  # pairs whose distances are taken at once
ROWS = 512  # rows of a block that are compared with another at once
NEAR = 1e-9  # distances below count as this
CLUSTERS = 1 << 18  # clusters of the condensed tree that are chosen among on the driver; more are by rounds of joins

EDGE = "a long, w double, lo long, hi long, b long"


def least(edges: DataFrame) -> DataFrame:
    """The least edge of each component."""
    return edges.groupBy("a").agg(F.min(F.struct("w", "lo", "hi", "b")).alias("e")).select("a", "e.*")


def roots(pointers: DataFrame) -> DataFrame:
    """(node, up) with every pointer at its end; a node without a pointer, or with one to itself, is an end."""
    while True:
        ahead = pointers.select(F.col("node").alias("up"), F.col("up").alias("next"))
        moved = pointers.join(ahead, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.coalesce("next", "up") != F.col("up")).alias("moved"))
        moved = stash(moved, "pointers")
        pointers = moved.select("node", "up")
        if not moved.where("moved").head(1):
            return pointers


def contract(chosen: DataFrame) -> DataFrame:
    """(node, up): the new component of each that chose an edge.  Two that chose the same edge point at the smaller."""
    back = chosen.select(F.col("a").alias("b"), F.col("b").alias("c"))
    up = F.when((F.col("c") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b"))
    return roots(chosen.select("a", "b").join(back, "b", "left").select(F.col("a").alias("node"), up.alias("up")))


def renamed(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.join(names.select(F.col("node").alias(c), F.col("up").alias("_up")), c, "left").withColumn(c, F.coalesce("_up", c)).drop("_up")
    return rows


def no_edges() -> list[np.ndarray]:
    return [np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, np.int64)]


def first_edges(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The least edge of each component of both."""
    keep = [np.concatenate(c) for c in zip(a, b)]
    order = np.lexsort((keep[3], keep[2], keep[1], keep[0]))
    keep = [c[order] for c in keep]
    first = np.diff(keep[0], prepend=keep[0][:1] - 1) != 0
    return [c[first] for c in keep]


def best_pairs(x: list[np.ndarray], y: list[np.ndarray], bound: np.ndarray) -> list[np.ndarray]:
    """Least edge (w, lo, hi) of each component of ``x`` to rows of ``y`` of other components, no longer than ``bound``.

    ``x`` and ``y``: ids, components, core distances, vectors.
    """
    d, off = squares(x[3], y[3])
    core = np.maximum(x[2][:, None], y[2][None])
    low = np.maximum(np.sqrt(np.maximum(d - off, 0)), core)
    high = np.maximum(np.sqrt(np.maximum(d, 0) + off), core)
    same = x[1][:, None] == y[1][None]
    low[same], high[same] = np.inf, np.inf
    names, group = np.unique(x[1], return_inverse=True)
    top = np.full(len(names), np.inf)
    np.minimum.at(top, group, np.minimum(high.min(1, initial=np.inf), bound * (1 + 1e-12)))
    i, j = np.nonzero(low <= top[group][:, None])
    keep = no_edges()
    for a in range(0, len(i), PAIRS):
        p, q = i[a : a + PAIRS], j[a : a + PAIRS]
        w = np.maximum(distance(x[3][p], y[3][q]), core[p, q])
        keep = first_edges(keep, [x[1][p], w, np.minimum(x[0][p], y[0][q]), np.maximum(x[0][p], y[0][q]), y[1][q]])
    return keep


def spanning_tree(index: Index, near: DataFrame, k: int) -> DataFrame:
    """(w, lo, hi): the edges of the minimum spanning tree of mutual reachability over the index's rows, by weight and ids.

    ``near`` is what ``neighbours`` gives for ``k`` or more.  All rows must have a core distance.
    """
    spark, width, p = index.blocks.sparkSession, index.width, index.p
    # ``rest``: what an edge to a row that isn't among the near ones can't be less than, rounding included
    rest = F.element_at("near", -1)["d"] * (1 - 1e-9) - 1e-9
    cores = stash(near.select("id", core_of(k).alias("core"), rest.alias("rest")), "cores")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = numbers(batch, "ids", i, kind=np.int64)
                yield record("block long, at int, id long", np.full(len(ids), batch.column("block")[i].as_py()), np.arange(len(ids), dtype=np.int32), ids)

    rows = index.blocks.select("block", "ids").mapInArrow(places, "block long, at int, id long").join(cores, "id")
    rows = stash(rows.withColumn("comp", F.col("id")), "components")
    cores = cores.select("id", "core")
    other = cores.select(F.col("id").alias("b"), F.col("core").alias("core_b"))
    edges = near.select(F.col("id").alias("a"), F.explode("near").alias("n")).select("a", F.col("n.id").alias("b"), "n.d").join(cores.withColumnRenamed("id", "a"), "a").join(other, "b")
    edges = stash(edges.select("a", F.greatest("d", "core", "core_b").alias("w"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b"), "edges")
    left, tree, some = index.n, [], index.some.tolist()
    while left > 1:
        # the sample's components and core distances: a bounded number of rows
        held = {r.id: (r.comp, r.core) for r in rows.where(F.col("id").isin(some)).select("id", "comp", "core").collect()}
        # a component that holds most of the sample leaves the choice to the others, which all have a bound by that sample
        often = Counter(c for c, _ in held.values()).most_common(1)
        waits = F.lit(often[0][0] if often and 2 * often[0][1] > len(some) else None).cast("long")
        sample = [index.some, np.array([held[i][0] for i in some]), np.array([held[i][1] for i in some]), index.sample]
        state = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "core", "comp"))).alias("s")).select("block", F.col("s.core").alias("core"), F.col("s.comp").alias("comp"))
        state = stash(state, "state")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    v, core, comp = numbers(batch, "v", i, width), np.asarray(batch.column("core")[i].values), np.asarray(batch.column("comp")[i].values)
                    d, off = squares(v, sample[3])
                    w = np.maximum(np.sqrt(np.maximum(d, 0) + off), np.maximum(core[:, None], sample[2][None]))
                    w[comp[:, None] == sample[1][None]] = np.inf
                    names, group = np.unique(comp, return_inverse=True)
                    top = np.full(len(names), np.inf)
                    np.minimum.at(top, group, w.min(1))
                    yield record("a long, w double", names, top)

        known = edges.select("a", "w").unionByName(index.blocks.select("block", "v").join(state, "block").mapInArrow(bound, "a long, w double"))
        # a component without a bound waits; those apart from the sample have one
        bounds = known.groupBy("a").agg(F.min("w").alias("w")).select(F.col("a").alias("comp"), F.when(F.col("w") < float("inf"), F.col("w")).otherwise(-1.0).alias("bound"))
        searched = (F.greatest("core", "rest") <= F.col("bound")) & ~F.col("comp").eqNullSafe(waits)
        own = rows.join(bounds, "comp", "left").withColumn("bound", F.when(searched, F.col("bound")).otherwise(-1.0))
        own = own.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "core", "comp", "bound"))).alias("s"))
        own = stash(own.select("block", *(F.col(f"s.{c}").alias(c) for c in ("core", "comp", "bound"))), "bounds")
        share = (own.agg(F.sum(F.size(F.filter("bound", lambda b: b >= 0)))).head()[0] or 0) / index.n
        one = F.when(F.array_min("comp") == F.array_max("comp"), F.array_min("comp"))
        reach = index.blocks.select("block", "low", "high").join(own.select("block", F.array_max("bound").alias("reach"), F.array_min("core").alias("floor"), one.alias("alone")), "block")

        def cells(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
            return [numbers(batch, "ids", i, kind=np.int64), np.asarray(batch.column("comp")[i].values), np.asarray(batch.column("core")[i].values), numbers(batch, "v", i, width)]

        def begin(batch: pa.RecordBatch, i: int) -> dict:
            bound = np.asarray(batch.column("bound")[i].values)
            on = bound >= 0
            return {"rows": [x[on] for x in cells(batch, i)], "far": numbers(batch, "far", i, p)[on], "bound": bound[on], "edges": no_edges()}

        def visit(state: dict, batch: pa.RecordBatch, i: int) -> None:
            there = cells(batch, i)
            low, high = numbers(batch, "low", i), numbers(batch, "high", i)
            apart = np.maximum(low - state["far"], state["far"] - high).max(1, initial=0)
            comp = state["rows"][1]
            other = there[1][0] if (there[1] == there[1][0]).all() else None
            on = np.flatnonzero((np.maximum(within(apart, there[2].min()), state["rows"][2]) <= state["bound"]) & (comp != other if other is not None else True))
            for a in range(0, len(on), ROWS):
                some = on[a : a + ROWS]
                state["edges"] = first_edges(state["edges"], best_pairs([x[some] for x in state["rows"]], there, state["bound"][some]))
            if len(on):  # what is found bounds what is still looked for
                at = np.searchsorted(state["edges"][0], comp)
                held = at < len(state["edges"][0])
                held[held] = state["edges"][0][at[held]] == comp[held]
                state["bound"][held] = np.minimum(state["bound"][held], state["edges"][1][at[held]])

        def finish(state: dict) -> Iterator[pa.RecordBatch]:
            yield record(EDGE, *state["edges"])

        known = edges.select("a", "w", "lo", "hi", "b").where(~F.col("a").eqNullSafe(waits))
        if share:
            known = known.unionByName(index.search(own, reach, begin, visit, finish, EDGE, share, ("c", "far", "bound")))
        chosen = stash(least(known), "chosen")
        new = stash(chosen.select("w", "lo", "hi").distinct(), "tree")
        tree.append(new)
        left -= new.count()
        names = contract(chosen)
        rows = stash(renamed(rows, names, "comp"), "components")
        edges = renamed(edges, names, "a", "b").where("a <> b").groupBy("a", "b").agg(F.min(F.struct("w", "lo", "hi")).alias("e"))
        edges = stash(edges.select("a", "e.w", "e.lo", "e.hi", "b"), "edges")
    out = spark.createDataFrame([], "w double, lo long, hi long")
    for part in tree:
        out = out.unionByName(part)
    return out


def forest_roots(edges: DataFrame) -> DataFrame:
    """(part, node, root): the least node of each component, part by part.  ``edges``: part, a, b."""
    both = edges.unionByName(edges.select("part", F.col("b").alias("a"), F.col("a").alias("b")))
    out = stash(both.select("part", F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while both.head(1):
        # each node points at its least neighbour if that is smaller; chains are followed to their ends
        low = both.groupBy("part", "a").agg(F.min("b").alias("m")).select(F.struct("part", F.col("a").alias("n")).alias("node"), F.struct("part", F.least("a", "m").alias("n")).alias("up"))
        ends = roots(stash(low, "low")).select(F.col("node.part").alias("part"), F.col("node.n").alias("x"), F.col("up.n").alias("y"))
        for c in ("a", "b"):
            both = both.join(ends.withColumnRenamed("x", c), ["part", c], "left").withColumn(c, F.coalesce("y", c)).drop("y")
        out = stash(out.join(ends.withColumnRenamed("x", "root"), ["part", "root"], "left").select("part", "node", F.coalesce("y", "root").alias("root")), "roots")
        both = stash(both.select("part", "a", "b").where("a <> b").distinct(), "links")
    return out


def starts(edges: DataFrame, ranges: int) -> DataFrame:
    """Edges whose ends are the components that their range starts from, with sizes and last merges.

    ``edges``: range, rank, w, and for both ends a and b: number, size and last merge (null: a single row).
    """
    half = 1
    while half < ranges:
        half *= 2
    while half > 1:
        half //= 2
        edges = edges.withColumn("part", F.expr(f"range div {2 * half}"))
        lower = edges.where(F.expr(f"range % {2 * half} < {half}"))
        where = stash(forest_roots(lower.select("part", "a", "b")), "forest")
        ends = lower.select("part", F.col("a").alias("node"), F.col("a_size").alias("size"), F.col("a_last").alias("last")).unionByName(lower.select("part", F.col("b").alias("node"), F.col("b_size").alias("size"), F.col("b_last").alias("last")))
        sizes = ends.groupBy("part", "node").agg(F.max("size").alias("size")).join(where, ["part", "node"]).groupBy("part", "root").agg(F.sum("size").alias("size"))
        merges = lower.select("part", F.col("a").alias("node"), "rank").join(where, ["part", "node"]).groupBy("part", "root").agg(F.max("rank").alias("last"))
        now = where.join(sizes.join(merges, ["part", "root"]), ["part", "root"])
        is_lower = F.expr(f"range % {2 * half} < {half}")
        for c in ("a", "b"):
            new = now.select("part", F.col("node").alias(c), F.col("root").alias("_r"), F.col("size").alias("_s"), F.col("last").alias("_l"))
            x = edges.join(new, ["part", c], "left")
            on = F.col("_r").isNotNull() & ~is_lower
            edges = x.select("range", "rank", "w", "part", *(F.when(on, F.col(n)).otherwise(F.col(o)).alias(o) for n, o in (("_r", c), ("_s", f"{c}_size"), ("_l", f"{c}_last"))), *(o for o in ("a", "a_size", "a_last", "b", "b_size", "b_last") if o[0] != c))
        edges = stash(edges.drop("part"), "starts")
    return edges


CHILD = "leaf long, rank long, size long, parent long, w double, head boolean, up long"


def merges(edges: DataFrame, smallest: int) -> DataFrame:
    """A row for each side of each merge: single row or merge, size, the merge it goes into and its weight, whether it is a
    cluster of its own (both sides have ``smallest`` rows), and the farthest merge within the range that is of the same cluster."""

    def replay(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rank")
        over: dict[int, int] = {}
        size: dict[int, int] = {}
        last: dict[int, int | None] = {}

        def find(x: int) -> int:
            while over[x] != x:
                over[x] = x = over[over[x]]
            return x

        for side in "ab":
            for x, s, t in zip(own[side].tolist(), own[f"{side}_size"].tolist(), own[f"{side}_last"].tolist()):
                over[x], size[x], last[x] = x, s, None if pd.isna(t) else int(t)
        out = []
        for rank, w, a, b in zip(own["rank"].tolist(), own["w"].tolist(), own["a"].tolist(), own["b"].tolist()):
            a, b = find(a), find(b)
            head = min(size[a], size[b]) >= smallest
            for x in (a, b):
                out.append([x if last[x] is None else None, last[x], size[x], rank, w, head, None])
            if size[a] < size[b]:
                a, b = b, a
            over[b], size[a], last[a] = a, size[a] + size[b], rank
        far: dict[int, int] = {}
        for row in reversed(out):
            row[6] = row[1] if row[5] else far.get(row[3], row[3])
            if row[1] is not None:
                far[row[1]] = row[6]
        found = pd.DataFrame(out, columns=["leaf", "rank", "size", "parent", "w", "head", "up"])
        return found.astype({c: "Int64" for c in ("leaf", "rank", "up")})

    return edges.groupBy("range").applyInPandas(replay, CHILD)


def pick(clusters: list[tuple[str, str | None, float]]) -> dict[str, str]:
    """The chosen cluster of each: the highest ancestor that lasts at least as long as all that is chosen below it; the top one never is."""
    below: dict[str | None, list[str]] = {}
    own = {}
    for key, parent, stability in clusters:
        below.setdefault(parent, []).append(key)
        own[key] = stability
    order = list(below.get(None, []))
    for key in order:
        order += below.get(key, [])
    best, wins = {}, {}
    for key in reversed(order):
        under = sum(best[c] for c in sorted(below.get(key, [])))
        wins[key] = own[key] >= under
        best[key] = max(own[key], under)
    out: dict[str, str] = {}
    parent_of = {key: parent for key, parent, _ in clusters}
    for key in order:
        parent = parent_of[key]
        if parent is not None and (parent in out or wins[key]):
            out[key] = out.get(parent, key)
    return out


def pick_by_rounds(clusters: DataFrame) -> DataFrame:
    """(key, chosen) as ``pick`` has it, a level of the tree a round."""
    best = None
    left = stash(clusters, "clusters")
    while left.head(1):
        # clusters below which all is settled
        inner = left.select(F.col("parent").alias("key")).distinct()
        ready = left.join(inner, "key", "left_anti")
        if best is not None:
            under = best.groupBy(F.col("parent").alias("key")).agg(F.sum("best").alias("under"))
            ready = ready.join(under, "key", "left")
        else:
            ready = ready.withColumn("under", F.lit(0.0))
        under = F.coalesce("under", F.lit(0.0))
        now = ready.select("key", "parent", F.greatest("stability", under).alias("best"), (F.col("stability") >= under).alias("wins"))
        best = stash(now if best is None else best.unionByName(now), "best")
        left = stash(left.join(best.select("key"), "key", "left_anti"), "clusters")
    level = best.where("parent is null").select("key", F.lit(None).cast("string").alias("chosen"))
    out = None
    while level.head(1):
        out = level if out is None else out.unionByName(level)
        above = level.select(F.col("key").alias("parent"), F.col("chosen").alias("over"))
        level = stash(best.where("parent is not null").join(above, "parent").select("key", F.coalesce("over", F.when(F.col("wins"), F.col("key"))).alias("chosen")), "level")
    return out.where("chosen is not null")


def lasting(w: Column) -> Column:
    return 1 / F.greatest(w, F.lit(NEAR))


def hierarchy(tree: DataFrame, leaves: DataFrame, smallest: int, most: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """The condensed tree: (leaf, key), the cluster that each row falls out of, and (key, parent, stability, size) of the clusters.

    ``tree``: w, lo, hi; ``leaves``: id, c (copies), core.  Copies of a row part at its core distance.
    """
    ranges = max(1, math.ceil(tree.count() / most))
    ordered = tree.repartitionByRange(ranges, "w", "lo", "hi").sortWithinPartitions("w", "lo", "hi").withColumn("rank", F.monotonically_increasing_id())
    edges = stash(ordered, "ranks").withColumn("range", F.shiftright("rank", 33))
    for c, end in (("a", "lo"), ("b", "hi")):
        size = leaves.select(F.col("id").alias(end), F.col("c").alias(f"{c}_size"))
        edges = edges.join(size, end).withColumnRenamed(end, c).withColumn(f"{c}_last", F.lit(None).cast("long"))
    sides = stash(merges(starts(edges, ranges), smallest), "sides")
    top = sides.agg(F.max("parent")).head()[0]
    pointers = sides.where("rank is not null").select(F.col("rank").alias("node"), "up")
    whole = roots(pointers.unionByName(sides.sparkSession.createDataFrame([(top, top)], "node long, up long"))).select(F.col("node").alias("parent"), F.col("up").alias("of"))
    name = F.when(F.col("leaf").isNotNull(), F.concat(F.lit("row "), F.col("leaf"))).otherwise(F.concat(F.lit("merge "), F.col("rank")))
    x = sides.join(whole, "parent").withColumn("above", F.concat(F.lit("merge "), F.col("of"))).withColumn("key", F.when(F.col("head"), name).otherwise(F.col("above")))
    x = stash(x.join(leaves.select(F.col("id").alias("leaf"), "core"), "leaf", "left"), "named")
    out = x.where(F.col("head") | (F.col("size") < smallest)).select(F.col("above").alias("key"), (F.col("size") * lasting(F.col("w"))).alias("s"))
    copies = x.where((F.col("size") >= smallest) & F.col("leaf").isNotNull()).select("key", (F.col("size") * lasting(F.col("core"))).alias("s"))
    born = x.where("head").select("key", F.col("above").alias("parent"), "size", lasting(F.col("w")).alias("birth"))
    total = x.where(F.col("parent") == top).agg(F.sum("size").alias("size"))
    born = born.unionByName(total.select(F.lit(f"merge {top}").alias("key"), F.lit(None).cast("string").alias("parent"), "size", F.lit(0.0).alias("birth")))
    ends = out.unionByName(copies).groupBy("key").agg(F.sum("s").alias("s"))
    clusters = born.join(ends, "key", "left").select("key", "parent", (F.coalesce("s", F.lit(0.0)) - F.col("size") * F.col("birth")).alias("stability"), "size")
    return x.where("leaf is not null").select("leaf", "key"), clusters


def density_clusters(rows: DataFrame, key: str, vector: str, smallest: int = 50, k: int = 10, block: int = 2048, most: int = RANGE) -> DataFrame:
    """(key, cluster): every row that has a vector, and its cluster, numbered from 0 by least key; -1 is noise.

    Clusters have ``smallest`` rows at least, core distances are to the ``k``-th other row; what stays apart longest over falling density
    is a cluster, and all rows together never are.  Rows without a key or a vector of finite numbers have no result; equal vectors are in one
    cluster; with no more than ``k`` rows, or one distinct vector, all is noise.
    """
    kept, few, width = distinct(rows, key, vector)
    few = stash(few, "distinct")
    index = Index(few, width, block)
    spark = rows.sparkSession
    noise = kept.select(F.col("id").alias(key), F.lit(-1).alias("cluster"))
    if index.n < 2 or kept.count() <= k:
        return noise
    near = stash(neighbours(index, k + 1), "near")  # one more, so that most rows know their least edge without a search
    leaves = near.select("id", "c", core_of(k).alias("core"))
    fell, clusters = hierarchy(spanning_tree(index, near, k), leaves, smallest, most)
    clusters = stash(clusters, "clusters")
    if clusters.count() <= CLUSTERS:
        chosen = spark.createDataFrame(list(pick([(r.key, r.parent, r.stability) for r in clusters.select("key", "parent", "stability").collect()]).items()), "key string, chosen string")
    else:
        chosen = pick_by_rounds(clusters)
    first = few.select(F.col("id").alias("leaf"), "v")
    own = stash(fell.join(chosen, "key", "left").join(first, "leaf").select("leaf", "v", "chosen"), "chosen")
    # clusters alone are numbered in one task
    number = own.where("chosen is not null").groupBy("chosen").agg(F.min("leaf").alias("first"))
    number = number.select("chosen", (F.expr("row_number() over (order by first)") - 1).alias("cluster"))
    return kept.join(own.join(number, "chosen", "left").select("v", "cluster"), "v").select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
