"""N-gram Jaccard join with set relations: exact links between shingle sets, without all pairs.

1. Equal sets form a class; its least id stands for it.
2. An index from shingle to sets holds each representative's prefix, the ``(1 - t)`` part of its
   shingles in a common order in which shingles that many documents share come last (counts over
   all documents, in a sketch), with each shingle's position in that order.  Two sets that link share a prefix
   shingle.
3. Size and position bound which sizes an entry's partners can have: all it can still share is what comes from its
   position on.  Each list of the index is sorted by size and read in windows of two neighbouring size classes (partners
   are never further apart).  It is cut where no earlier entry reaches the next size, and entries whose own bound no
   earlier block reaches are skipped.  The sets of a block form a group under its first set; lists with the same first
   set fall together.
4. Profiles (counts of a set's shingles by hash cell) bound how much two sets differ.  Only sets with a
   partner in their group that this bound allows go on; whole sets are fetched for those alone.
5. In a group, the overlaps of a set with all others are taken from those of the set before it:
   only the shingles in which both differ are looked up.  Sets that a link has already joined aren't
   compared further, so a group gives a spanning forest, not its pairs.
6. Links are joined to components.

Groups over ``most_group`` sets are dealt out as pairs of slices, so that no task holds a whole one;
every pair of sets still meets.

Defined results: ids must cast to long; null or empty text has no shingles, links with nothing and is its own
component; a null id is one document with the id null and no links; repeated ids are the same document; other columns
are dropped, or kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, int_lists, join_hot, mix, quoted, shingle_sets, slices, stash
from .components import components

PART = 1 << 15  # counters of the sketch that are summed together
LEAST_PARTS, MOST_PARTS = 4, 256  # so many such parts, by the size of the corpus; 2^23 counters at most
CELLS = 128  # counters of a set's profile
BITS_EACH = 16  # of the filter of sets that are asked for, by their number,
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29  # within these bounds


def power_of_two(x: float, least: int, most: int) -> int:
    out = least
    while out < min(x, most):
        out *= 2
    return out


def classes(docs: DataFrame, id_column: str, text_column: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """Number of shingles and class of each document, and how many documents hold the shingles of each counter.

    Both come from one pass; counters are summed per task, in parts, before they are shuffled.
    """
    schema = "id long, n long, sig binary, part int, counts binary"
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    parts = power_of_two(size / 64 / PART, LEAST_PARTS, MOST_PARTS)
    sketch_size = parts * PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(sketch_size, np.int64)
        names = ["id", "n", "sig", "part", "counts"]
        for batch in slices(batches, text_column):
            sets = shingle_sets(bytes_of(batch.column(text_column)), k)
            if sets:
                np.add.at(sketch, (mix(np.concatenate(sets)) % np.uint64(sketch_size)).astype(np.int64), 1)
            m = len(sets)
            sig = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        full = [i for i, x in enumerate(sketch.reshape(parts, -1)) if x.any()]
        own = [zlib.compress(sketch[i * PART : (i + 1) * PART].tobytes(), 1) for i in full]
        m = len(full)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(full, pa.int32()), pa.array(own, pa.binary())], names=names)

    both = stash(docs.select(id_column, text_column).mapInArrow(run, schema), "jaccard-sets")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                x = np.frombuffer(zlib.decompress(counts.as_buffer()), np.int64)
                total[part] = total[part] + x if part in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(x, (1 << 31) - 1).astype(np.int32).tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "counts"])

    rows = both.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary").collect()  # 32 MB at most
    counts = np.zeros((parts, PART), np.int32)
    for r in rows:
        counts[r.part] = np.frombuffer(zlib.decompress(r.counts), np.int32)
    sets = both.where("part is null").select("id", "n", "sig")
    # sets without shingles have no signature, so they have no class either
    own = sets.where("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    rep = F.coalesce("least", F.when(F.col("n") > 0, F.col("id")))
    return stash(join_hot(sets, own, "sig").select("id", "n", F.when(F.col("id").isNotNull(), rep).alias("rep")), "jaccard-classes"), counts.ravel()


def signature(s: np.ndarray) -> bytes | None:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def prefix_size(n: int, t: int) -> int:
    """So many first shingles of a set of ``n`` that any set that links with it has one of them in its own."""
    return n - -(-n * t // 100) + 1


def prefixes(docs: DataFrame, reps: DataFrame, id_column: str, text_column: str, k: int, t: int, counts: np.ndarray) -> DataFrame:
    """(id, prefix, profile, n) of each representative: its first shingles in order, and the counts of all by hash cell."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 32 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in slices(batches, text_column):
            first, profile = [], []
            sets = shingle_sets(bytes_of(batch.column(text_column)), k)
            every = mix(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
            held = order[(every % np.uint64(len(order))).astype(np.int64)]
            cell = (every >> np.uint64(57)).astype(np.int64)
            at = 0
            for s in sets:
                own = slice(at, at + len(s))
                at += len(s)
                profile.append(np.bincount(cell[own], minlength=CELLS).astype("<u4").tobytes())
                p = prefix_size(len(s), t) if len(s) else 0
                first.append(s[np.lexsort((every[own], held[own]))[:p]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), int_lists(first, pa.int64()), pa.array(profile, pa.binary())], names=["id", "prefix", "profile"])

    found = docs.select(id_column, text_column).mapInArrow(run, "id long, prefix array<long>, profile binary").where(F.size("prefix") > 0)
    return found.join(reps, "id")


def size_classes(t: int, most: int = 1 << 40) -> np.ndarray:
    """Least sizes of classes such that sets that link are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(100 * out[-1] // t + 1)
    return np.array(out, np.int64)


def group_lists(s: np.ndarray, w: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leader of each entry's block (or -1 for the first and for skipped ones), reach of the blocks so far, and whether it opens a block.

    Entries are sorted by list ``s``, window ``w`` and size ``n``; partners' sizes are from ``low`` to ``high``.
    """
    m = len(s)
    head = np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])])[:m]
    seg = np.cumsum(head)
    wide = np.int64(1) << 41
    reach = np.maximum.accumulate(high + seg * wide) - seg * wide  # the greatest so far within the window
    opens = head.copy()
    opens[1:] |= reach[:-1] < n[1:]
    at = np.maximum.accumulate(np.where(opens, np.arange(m), 0))
    # a late position only allows smaller partners: skipped if none of those that it allows reaches this size
    key = seg * wide + n
    before = np.searchsorted(key, seg * wide + np.minimum(high, n), side="right") - 1
    before = np.where(high < n, before, np.arange(m) - 1)
    known = before >= at
    fits = known & (reach[np.maximum(before, 0)] >= n)
    return np.where(~opens & fits, i[at], -1), reach, opens


def groups(index: DataFrame, t: int) -> DataFrame:
    """(leader, id) for each block of two sets or more of ``index`` (shingle, pos, id, n); the leader itself isn't listed.

    Lists are read once, in order of size; of each window only its leader and reach are held from batch to batch.
    """
    least = size_classes(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(6)]  # open windows: list, window, size, bounds, leader
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            s, n, p, i = (batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "n", "pos", "id"))
            low, high = -(-n * t // 100), (n - p) * (100 + t) // t - n
            c = np.searchsorted(least, n, side="right") - 1
            follows = (c > 0) & (low < least[c])
            rows = [np.concatenate([h, x, x[follows]]) for h, x in zip(held[:1] + held[2:], (s, n, low, high, i))]
            w = np.concatenate([held[1], c, c[follows] - 1])
            old = np.concatenate([np.ones(len(held[0]), bool), np.zeros(len(w) - len(held[0]), bool)])
            order = np.lexsort((-rows[3], ~old, rows[1], w, rows[0]))  # of one size, early positions first
            s2, n2, low2, high2, i2 = (x[order] for x in rows)
            w2, old = w[order], old[order]
            leader, reach, opens = group_lists(s2, w2, n2, low2, high2, np.arange(len(w2)))
            main = least[np.minimum(w2 + 1, len(least) - 1)] > n2  # a block that a follower opens is grouped in its own window
            out = np.flatnonzero((leader >= 0) & ~old)
            out = out[main[leader[out]]]
            pairs = set(zip(i2[leader[out]].tolist(), i2[out].tolist())) - seen
            if len(seen) > 200_000:
                seen.clear()
            seen |= pairs
            # windows of the last list go on with the block that is open
            last = np.flatnonzero(s2 == s[-1])
            ends = last[np.concatenate([w2[last][1:] != w2[last][:-1], [True]])]
            at = np.maximum.accumulate(np.where(opens, np.arange(len(w2)), 0))[ends]
            held = [s2[ends], w2[ends], n2[at], low2[at], reach[ends], i2[at]]
            keep = held[1] >= c[-1] - 1
            held = [x[keep] for x in held]
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["leader", "id"])

    lists = index.repartition("shingle").sortWithinPartitions("shingle", "n", "pos", "id")
    return lists.mapInArrow(run, "leader long, id long").distinct()


def deal_out(grouped: DataFrame, most_group: int) -> DataFrame:
    """(leader, a, b, id): a group under two slice numbers. Groups of up to ``most_group`` are one slice; of larger ones each pair of slices meets once."""
    size = grouped.groupBy("leader").agg((F.count("*") + 1).alias("m")).withColumn("parts", F.ceil(F.col("m") / most_group).cast("int"))
    every = grouped.unionByName(size.select("leader", F.col("leader").alias("id")))
    large = size.where("parts > 1").select("leader", "parts")
    x = join_hot(stash(every, "jaccard-blocks"), large, "leader").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = x.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return x.select("leader", "id", "own", other).select("leader", "id", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()


def possible(dealt: DataFrame, profiles: DataFrame, t: int) -> DataFrame:
    """The rows of ``dealt`` whose set has a partner in its slices that profiles don't rule out.

    Sets that link differ in at most (1 - t) / (1 + t) of the sum of their sizes; profiles differ no more than sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, own = None, [], []

        def done() -> list[tuple]:
            if len(ids) < 2:
                return []
            x = np.frombuffer(b"".join(own), "<u4").reshape(len(ids), CELLS).astype(np.int32)
            n = x.sum(1)
            order = np.argsort(n, kind="stable")
            x, n = x[order], n[order]
            ok = np.zeros(len(ids), bool)
            for i in range(len(ids)):  # sorted by size: partners stand right after, up to a size
                last = np.searchsorted(n, n[i] * 100 // t, side="right")
                y = x[i + 1 : last]
                near = (100 + t) * np.abs(y - x[i]).sum(1) <= (100 - t) * (n[i + 1 : last] + n[i])
                if near.any():
                    ok[i] = True
                    ok[i + 1 : last] |= near
            return [(*key, ids[j]) for j in order[ok].tolist()]

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["leader", "a", "b", "id"])

        for batch in batches:
            found = []
            for k, doc, profile in zip(zip(*(batch.column(c).to_pylist() for c in ("leader", "a", "b"))), batch.column("id").to_pylist(), batch.column("profile").to_pylist()):
                if k != key:
                    found += done()
                    key, ids, own = k, [], []
                ids.append(doc)
                own.append(profile)
            yield out(found)
        yield out(done())

    rows = dealt.join(profiles, "id").repartition("leader", "a", "b").sortWithinPartitions("leader", "a", "b")
    return rows.mapInArrow(run, "leader long, a int, b int, id long")


def fetch_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, k: int) -> DataFrame:
    """(id, s): the shingle sets of wanted documents, found in place by a filter of bounded size; what it lets through besides is dropped by a join."""

    count = wanted.count()
    size = power_of_two(BITS_EACH * count, LEAST_BITS, MOST_BITS)

    def places(x: np.ndarray) -> list[np.ndarray]:
        h = mix(x.astype(np.int64).view(np.uint64))
        return [h % np.uint64(size), (h >> np.uint64(32)) % np.uint64(size)]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for h in places(batch.column("id").to_numpy()):
                np.bitwise_or.at(own, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["bits"])

    total = np.zeros(size // 8, np.uint8)
    for r in wanted.select("id").coalesce(min(64, 1 + count // 1_000_000)).mapInArrow(bits, "bits binary").toLocalIterator():
        total |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(total)  # 64 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text_column):
            batch = batch.filter(batch.column(id_column).is_valid())
            keep = np.ones(batch.num_rows, bool)
            for h in places(batch.column(id_column).cast(pa.int64()).to_numpy()):
                keep &= (own[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            batch = batch.filter(pa.array(keep))
            if batch.num_rows:
                sets = [x.view(np.int64) for x in shingle_sets(bytes_of(batch.column(text_column)), k)]
                yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), int_lists(sets, pa.int64())], names=["id", "s"])

    return docs.select(id_column, text_column).mapInArrow(run, "id long, s array<long>").join(wanted, "id", "left_semi")


def forest(ids: list[int], sets: list[np.ndarray], t: int) -> list[tuple[int, int]]:
    """Links that join all sets of a group that a chain of links joins."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][:1].tolist(), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    m, size = len(sets), np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    by = np.argsort(flat, kind="stable")
    posting = owner[by]
    at = np.concatenate([[0], np.cumsum(np.bincount(flat))])
    local = np.split(flat, np.cumsum(size)[:-1])
    root = np.arange(m)
    links = []

    def hits(shingle: np.ndarray) -> np.ndarray:
        n = at[shingle + 1] - at[shingle]
        if not n.sum():
            return np.zeros(m, np.int64)
        place = np.repeat(at[shingle] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(posting[place], minlength=m)

    overlap, last = None, None
    for i in range(m):
        own = local[i]
        if last is not None:
            new, old = np.setdiff1d(own, last, True), np.setdiff1d(last, own, True)
        if last is None or len(new) + len(old) >= len(own):
            overlap = hits(own)
        else:  # what the set before has, changed by the shingles in which both differ
            overlap = overlap + hits(new) - hits(old)
        last = own
        linked = 100 * overlap[:i] >= t * (size[:i] + size[i] - overlap[:i])
        for j in np.flatnonzero(linked & (root[:i] != root[i])).tolist():
            if root[j] != root[i]:
                links.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return links


def find_links(dealt: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """(a, b): a forest of exact links from every group; a task holds one group's slices at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, own = None, [], []

        def done() -> list[tuple[int, int]]:
            return forest(ids, own, t) if len(ids) > 1 else []

        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("leader", "a", "b"))))
            s = batch.column("s")
            flat, at = s.flatten().to_numpy().view(np.uint64), np.asarray(s.offsets)
            at = at - at[0]
            for i, (k, doc) in enumerate(zip(keys, batch.column("id").to_pylist())):
                if k != key:
                    found += done()
                    key, ids, own = k, [], []
                ids.append(doc)
                own.append(flat[at[i] : at[i + 1]].copy())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found = done()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    rows = dealt.join(sets, "id").repartition("leader", "a", "b").sortWithinPartitions("leader", "a", "b")
    return rows.mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 80, most_group: int = 4096) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id``, the least id that links of ``percent`` or more reach."""
    own, counts = classes(docs, id_column, text_column, k)
    reps = own.where("id = rep").select("id", "n").distinct()
    first = stash(prefixes(docs, reps, id_column, text_column, k, percent, counts), "jaccard-prefixes")
    lists = first.select(F.posexplode("prefix").alias("pos", "shingle"), "id", "n")
    dealt = deal_out(stash(groups(lists, percent), "jaccard-lists"), most_group)
    dealt = stash(possible(dealt, first.select("id", "profile"), percent), "jaccard-groups")
    wanted = stash(dealt.select("id").distinct(), "jaccard-wanted")
    sets = fetch_sets(docs, wanted, id_column, text_column, k)
    found = components(find_links(dealt, sets, percent))
    out = join_hot(own, found.select(F.col("a").alias("rep"), "b"), "rep")
    return out.select(F.col("id").cast(docs.schema[id_column].dataType).alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("b", "rep", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents less those that a document with a smaller id stands for; all columns as they are.

    Only the ids of documents to drop are joined.
    """
    found = jaccard_components(docs, id_column, text_column, k, percent)
    drop = found.where(F.col("component_id") < F.col(id_column)).select(id_column).distinct()
    return docs.join(drop, id_column, "left_anti").select(*quoted(docs.columns))
