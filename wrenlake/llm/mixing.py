"""Mixing sources to target weights by a minimum-cost flow over membership patterns.

Documents that belong to the same set of sources are one node of a small network: it offers their words once for nothing,
once more at a higher cost, and so on up to the repeats allowed; it may send words to each of its sources, and a source takes as
many as its target.  Because costs only rise from pass to pass and lie on the way into the patterns, opening the passes one after
another and enlarging a maximum flow each time gives the cheapest of the largest flows.  The flow of a pattern is then laid
along its documents in a seeded order, pass after pass, source after source: a document is taken as often, and by the
sources, as its stretch of the line is covered.  The document at the end of a stretch is taken in part, so that targets are met
to the word.

The order is a checksum's, so prefix sums run over buckets of it: sums by bucket, then rows within a bucket; no pattern, however
large, comes to one task.

Defined results: a null text has size 0 and takes nothing; rows without a source (null) are a source of their own, last in order;
an empty list of sources gives no flow; repeated rows and null ids are rows of their own; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

import json
from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash

WEIGHTS = (5, 2, 1)
SHARE = 150  # per cent of all words that the mix has
MOST = 2  # times that a document may be taken
ROWS = 512  # of a bucket of the seeded order, about
#: Patterns that the flow tells apart, the largest ones; documents of others count for the first of their sources only.
PATTERNS = 1 << 17


def targets(sizes: dict[str, int], order: list[str], weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> dict[str, Fraction]:
    """Words for each source: ``share`` per cent of all by weight, none above ``most`` times its size, the excess dealt on by weight."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = Fraction(share * sum(sizes.values()), 100), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        out |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


class Flow:
    """A network with whole capacities; ``push`` enlarges the flow by shortest ways until none is left."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]  # numbers of arcs; arc and way back are neighbours
        self.head: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        for u, v, r in ((a, b, room), (b, a, 0)):
            self.arcs[u].append(len(self.head))
            self.head.append(v)
            self.room.append(r)
        return len(self.head) - 2

    def levels(self, start: int, end: int) -> list[int] | None:
        level = [-1] * len(self.arcs)
        level[start] = 0
        todo = deque([start])
        while todo:
            u = todo.popleft()
            for e in self.arcs[u]:
                v = self.head[e]
                if self.room[e] and level[v] < 0:
                    level[v] = level[u] + 1
                    todo.append(v)
        return level if level[end] >= 0 else None

    def push(self, start: int, end: int) -> None:
        while level := self.levels(start, end):
            at = [0] * len(self.arcs)
            way: list[int] = []
            while True:
                u = self.head[way[-1]] if way else start
                if u == end:
                    least = min(self.room[e] for e in way)
                    for e in way:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    way = way[: next(i for i, e in enumerate(way) if not self.room[e])]
                    continue
                while at[u] < len(self.arcs[u]):
                    e = self.arcs[u][at[u]]
                    if self.room[e] and level[self.head[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(self.arcs[u]):
                    way.append(self.arcs[u][at[u]])
                elif way:
                    at[self.head[way.pop() ^ 1]] += 1
                else:
                    break


def route(words: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], most: int = MOST) -> dict[str, dict[str, int]]:
    """Words that each pattern sends to each of its sources: the most that quotas take, at the least cost of repeats."""
    patterns, sources = list(words), list(quota)
    end = 1 + len(patterns) + len(sources)
    net = Flow(end + 1)
    number = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sent = {(p, s): net.add(1 + i, number[s], most * words[p]) for i, p in enumerate(patterns) for s in members[p]}
    for s in sources:
        net.add(number[s], end, quota[s])
    for _ in range(most):  # the passes from the cheapest on
        for i, p in enumerate(patterns):
            net.add(0, 1 + i, words[p])
        net.push(0, end)
    out: dict[str, dict[str, int]] = {p: {} for p in patterns}
    for (p, s), e in sent.items():
        if net.room[e ^ 1]:
            out[p][s] = net.room[e ^ 1]
    return out


def name_of(source: str | None) -> str:
    """A source as text that sorts by code points, null last."""
    return "1" if source is None else "0" + source


def size_of(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def before(rows: DataFrame, parts: int) -> DataFrame:
    """Add ``start``: the words of the pattern's rows that come before in the order of ``h``, ``id``, ``size``.

    Rows lie in buckets of ``h`` (two levels of about the square root of all), whose sums are few.
    """
    root = 1
    while root * root < parts:
        root *= 2
    h = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("fine", F.shiftright(h * root * root, 32)).withColumn("coarse", F.expr(f"fine div {root}"))
    sums = rows.groupBy("pattern", "coarse", "fine").agg(F.sum("size").alias("s"))

    def ahead(sum_: str, *by: str) -> Column:
        return F.coalesce(F.sum(sum_).over(Window.partitionBy("pattern", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    coarse = sums.groupBy("pattern", "coarse").agg(F.sum("s").alias("c")).select("pattern", "coarse", ahead("c", "coarse").alias("base"))
    fine = sums.join(coarse, ["pattern", "coarse"]).select("pattern", "fine", (F.col("base") + ahead("s", "coarse", "fine")).alias("base"))
    own = Window.partitionBy("pattern", "fine").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(fine, ["pattern", "fine"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(own), F.lit(0)))


def mix_sources(docs: DataFrame, members: Column, key: str = "doc_id", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: int = 42, patterns: int = PATTERNS) -> DataFrame:
    """(key, size, taken, shares): every document, the words taken and, for each of its sources in order, what that source has.

    ``members``: an array of the sources of a document.  ``shares``: array of (source, source_size, target, words); targets are what
    ``targets`` says, and words of a document are counted once for each of its sources.  ``taken`` is at most ``most`` times the size.
    Sources come to the driver, and patterns up to ``patterns``.
    """
    spark = docs.sparkSession
    known = F.array_distinct(F.coalesce(members.cast("array<string>"), F.array().cast("array<string>")))
    named = F.sort_array(F.transform(known, lambda s: F.when(s.isNull(), "1").otherwise(F.concat(F.lit("0"), s))))
    id_ = F.col(f"`{key}`")
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.concat(F.lit("null:"), F.xxhash64(F.col(f"`{text}`")).cast("string")))), 256)
    rows = stash(docs.select(id_.alias("id"), size_of(F.col(f"`{text}`")).alias("size"), F.substring(seeded, 1, 32).alias("h"), named.alias("sources"), F.to_json(named).alias("pattern")), "sizes")
    # one row a source
    sizes = {r.s: int(r.n) for r in rows.select("size", F.explode("sources").alias("s")).groupBy("s").agg(F.sum("size").alias("n")).collect()}
    order = sorted(sizes)
    aim = targets(sizes, order, weights, share, most)
    # the largest patterns; the rest count for their first source
    each = rows.where(F.size("sources") > 0).groupBy("pattern").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    words = {r.pattern: int(r.n) for r in each.orderBy(F.desc("n"), "pattern").limit(patterns).collect()}
    member = {p: json.loads(p) for p in words}
    alone = F.to_json(F.slice("sources", 1, 1))
    held = spark.createDataFrame([(p,) for p in words], "pattern string")
    if each.count() > len(words):
        first = rows.join(F.broadcast(held), "pattern", "left_anti").where(F.size("sources") > 0).groupBy(alone.alias("pattern")).agg(F.sum("size").alias("n"))
        for r in first.collect():  # at most one row a source
            words[r.pattern] = words.get(r.pattern, 0) + int(r.n)
            member[r.pattern] = json.loads(r.pattern)
        rows = rows.join(F.broadcast(held.withColumn("held", F.lit(True))), "pattern", "left").withColumn("pattern", F.when(F.col("held"), F.col("pattern")).otherwise(alone)).drop("held")
    sent = route(words, member, {s: int(aim[s]) for s in order}, most)
    # what each pattern sends, laid end to end: source, first and last word of its stretch
    lines = []
    for p in words:
        ends, at = [], 0
        for s in member[p]:
            n = sent[p].get(s, 0)
            ends.append((s, sizes[s], float(aim[s]), at, at + n))
            at += n
        lines.append((p, words[p], ends))
    table = spark.createDataFrame(lines, "pattern string, length long, line array<struct<source string, source_size long, target double, a long, b long>>")
    parts = max(1, rows.count() // ROWS)
    x = before(rows, parts).join(F.broadcast(table), "pattern", "left")

    def covered(piece: Column) -> Column:
        """Words of a document's stretches, one a pass, between two places of the line."""
        total = F.lit(0)
        for turn in range(most):
            start = F.col("start") + turn * F.col("length")
            total = total + F.greatest(F.lit(0), F.least(start + F.col("size"), piece["b"]) - F.greatest(start, piece["a"]))
        return total.cast("long")

    source = lambda c: F.when(c["source"].startswith("0"), F.substring(c["source"], 2, 1 << 30))
    shares = F.transform("line", lambda c: F.struct(source(c).alias("source"), c["source_size"].alias("source_size"), c["target"].alias("target"), covered(c).alias("words")))
    taken = F.coalesce(F.aggregate("shares", F.lit(0).cast("long"), lambda a, c: a + c["words"]), F.lit(0).cast("long"))
    return x.withColumn("shares", shares).select(F.col("id").alias(key), "size", taken.alias("taken"), "shares")
