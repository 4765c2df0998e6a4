"""Best-fit packing by a grouping genetic algorithm on islands.

Texts are tokenised; documents longer than a sequence are cut into full pieces and a rest.  Pieces
of one task are dealt into shards of bounded size.  On each shard several islands evolve packings from
first-fit packings of shuffled pieces and a best-fit one: a crossover puts whole well-filled bins of one parent into the other,
drops the bins that then hold something twice, and best-fits the displaced pieces, exchanging them first for smaller ones
where a bin is filled better so; after an epoch each island's best packing moves to the next island (a shuffle of shard
rows), and after the last the best of a shard is used.  An island stops at the least number of sequences that its tokens
need.  The pieces of each shard's badly filled sequences are then dealt into new shards across tasks and packed again in
the same way, so that many small inputs don't leave a rest each.

Defined results: null text is empty and one token long (the end id); repeated rows are pieces of
their own; ids may be null; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stash, tidy

LENGTH = 2048
END = 0  # the id after each document
SHARD = 4096  # pieces that are packed together
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
BORN = 12  # children per island and epoch
ROWS_A_TASK = 8  # shards and islands that a task evolves
MOST_TASKS = 1 << 14  # beyond, tasks evolve more
FULL = 0.995  # share from which a bin counts as well filled
LEFT = 1.0  # share under which a sequence is packed again
TEXT = 2 << 20  # bytes of text that are tokenised at once; their words and ids take many times that

#: Letters below U+0100, which stay as they are in NFC, with marks after them that no letter combines with.
WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,./:;<=>?@\[\]^_{|}~-]*)").fullmatch
LOWER_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch


class Words(dict):
    """Ids of words and marks, as places in one flat array; new ones are encoded together.

    Where the tokenizer's file shows that white space always ends a token and case is ignored, the stretches between
    spaces are encoded alone, and each distinct stretch of a batch once.  A stretch of Latin letters with marks after it
    is two parts, as the tokenizer splits it there; any other is one part.  Other tokenizers get whole texts.
    """

    most = 200_000  # some 40 MB; emptied after each task

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.whole = not splits_words(json.load(f))
        self.plain = Tokenizer(self.coder.model)  # for words that need no normalising and no cutting
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.coder.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat = np.empty(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.learn([""], np.empty(0, np.uint32), np.zeros(1, np.int64))

    def learn(self, new: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self)
        ends = self.at[n] + np.cumsum(size)
        while len(self.at) < n + len(new) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.flat) < (ends[-1] if len(ends) else 0):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.at[n] : self.at[n] + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(new)] = ends
        self.update(zip(new, range(n, n + len(new))))

    def learn_words(self, new: list[str]) -> None:
        """Lower-case letters only: a word is one run of tokens up to one that ends a word, so many go in one text."""
        lines = [" ".join(new[i : i + 256]) for i in range(0, len(new), 256)]
        found = [np.array(x.ids, np.uint32) for x in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) == len(new):
            self.learn(new, ids, np.diff(ends, prepend=0))
        else:  # a vocabulary without ends of words
            self.learn_any(new)

    def learn_any(self, new: list[str]) -> None:
        found = [x.ids for x in self.coder.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.learn(new, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum())), size)

    def parts_of(self, stretches: list[str]) -> np.ndarray:
        """Two places for each stretch: its letters and the marks after them, or all of it and nothing."""
        if len(self) > self.most:
            self.reset()
        found = map(WORD_AND_MARKS, stretches)
        parts = [x for s, m in zip(stretches, found) for x in ((m[1].lower(), m[2]) if m else (s, ""))]
        new = set(parts).difference(self)
        letters = list(filter(LOWER_LETTERS, new))
        self.learn_words(letters)
        self.learn_any(list(new.difference(letters)))
        return np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with END after it, and where each begins (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.whole:
            found = [np.array([*x.ids, END], np.uint32) for x in self.coder.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        count = pc.list_value_length(cut).to_numpy()
        coded = cut.flatten().dictionary_encode()
        parts = self.parts_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        part_ids, part_size = gather(self.flat, self.at, parts)
        at = np.concatenate([[0], np.cumsum(part_size.reshape(-1, 2).sum(1))])
        ids, size = gather(part_ids, at, coded.indices.to_numpy())
        text_end = np.concatenate([[0], np.cumsum(size)])[np.cumsum(count)]
        return np.insert(ids, text_end, END), np.concatenate([[0], text_end + np.arange(1, len(count) + 1)])


def splits_words(file: dict) -> bool:
    """Whether a tokenizer file ignores case, cuts words off white space and marks, and ends words by a suffix."""

    def steps(x: dict | None) -> list[dict]:
        inner = [y for s in ("normalizers", "pretokenizers") for z in (x or {}).get(s) or [] for y in steps(z)]
        return inner or ([x] if x else [])

    lowers = any(x.get("type") == "Lowercase" for x in steps(file.get("normalizer")))
    cuts = any(x.get("type") == "Split" for x in steps(file.get("pre_tokenizer")))
    return lowers and cuts and file.get("model", {}).get("end_of_word_suffix") == "</w>"


def gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``flat[at[i]:at[i + 1]]`` for all ``i`` of ``which`` end to end, and their sizes."""
    size = at[which + 1] - at[which]
    place = np.repeat(at[which] - np.cumsum(size) + size, size)
    place += np.arange(len(place))
    return flat[place], size


@lru_cache(1)
def words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, tokenizer: str, id_column: str, text_column: str, keep_ids: bool = False) -> DataFrame:
    """One row per shard with arrays of its pieces: document, piece, start, length, checksum (and ids)."""
    kind = dict(docs.dtypes)[id_column]
    schema = f"shard long, doc array<{kind}>, piece array<int>, start array<long>, length array<long>, crc array<long>" + ", ids array<binary>" * keep_ids
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = words(tokenizer)
        base, n, held, doc_kind = TaskContext.get().partitionId() << 24, 0, [], None

        def shard(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            out = [pa.array([list(columns[0])], pa.list_(doc_kind)), *(pa.array([list(c)], pa.list_(k)) for c, k in zip(columns[1:], kinds))]
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), *out], names=[x.split()[0] for x in schema.split(", ")])

        for batch in slices(batches, text_column, TEXT):
            doc_kind = batch.column(id_column).type
            ids, at = coder.encode(batch.column(text_column))
            ids = ids.astype("<u4", copy=False)
            for doc, a, b in zip(batch.column(id_column).to_pylist(), at.tolist(), at[1:].tolist()):
                for piece, start in enumerate(range(a, b, LENGTH)):
                    part = ids[start : min(b, start + LENGTH)].tobytes()
                    held.append((doc, piece, start - a, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
            while len(held) >= 2 * SHARD:
                yield shard(held[:SHARD])
                held, n = held[SHARD:], n + 1
        coder.reset()
        tidy()
        if held:
            yield shard(held)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], free: list[int]) -> None:
    """Put items, largest first, each where it leaves least room; open bins as needed."""
    room = sorted((f, i) for i, f in enumerate(free) if f)
    for x in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[x]
        k = bisect_left(room, (size, -1))
        if k < len(room):
            f, i = room.pop(k)
        else:
            f, i = LENGTH, len(bins)
            bins.append([])
            free.append(LENGTH)
        bins[i].append(x)
        free[i] = f - size
        if free[i]:
            insort(room, (free[i], i))


def fitted(sizes: list[int]) -> list[list[int]]:
    """A best-fit packing of all pieces, largest first."""
    bins: list[list[int]] = []
    best_fit(sizes, list(range(len(sizes))), bins, [])
    return bins


def first_fit(sizes: list[int], order: list[int]) -> list[list[int]]:
    """A weak packing to start from: pieces as they come, each into the first of a few open bins that has room."""
    bins: list[list[int]] = []
    opened: list[tuple[int, int]] = []  # room and bin
    for x in order:
        for k, (f, i) in enumerate(opened):
            if f >= sizes[x]:
                bins[i].append(x)
                opened[k] = (f - sizes[x], i)
                break
        else:
            bins.append([x])
            opened.append((LENGTH - sizes[x], len(bins) - 1))
            if len(opened) > 8:
                opened.remove(min(opened))
    return bins


def filled(sizes: list[int], items: list[int]) -> int:
    return sum(map(sizes.__getitem__, items))


def fitness(sizes: list[int], bins: list[list[int]]) -> tuple[int, int]:
    """Fewer bins, then fuller ones."""
    return -len(bins), sum(filled(sizes, b) ** 2 for b in bins)


def exchange(sizes: list[int], bins: list[list[int]], free: list[int], displaced: list[int]) -> list[int]:
    """Displaced pieces fill bins exactly, beside what is there or in place of a smaller piece, alone or as a pair; what is displaced then."""
    by: dict[int, list[int]] = {}
    for i in displaced:
        by.setdefault(sizes[i], []).append(i)

    def fill(room: int, tries: list[int]) -> list[int] | None:
        if by.get(room):
            return [by[room].pop()]
        for a in tries:
            b = room - a
            if b > 0 and by.get(a) and len(by.get(b, ())) > (a == b):
                return [by[a].pop(), by[b].pop()]
        return None

    have = sorted(by)
    for k, b in enumerate(bins):
        if not free[k]:
            continue
        tries = have[k % 7 :: max(1, len(have) // 24)]
        found = fill(free[k], tries)
        if found is None:
            for at, x in enumerate(b):
                found = fill(sizes[x] + free[k], tries)
                if found is not None:
                    by.setdefault(sizes[x], []).append(x)
                    del b[at]
                    break
        if found is not None:
            b += found
            free[k] = 0
    return list(chain.from_iterable(by.values()))


def crossover(sizes: list[int], giver: list[list[int]], taker: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
    """Well-filled bins of the giver go into the taker whole; bins with duplicates go, and some of the badly filled ones, and their other pieces are fitted again."""
    least = FULL * LENGTH
    full = [b for b in giver if filled(sizes, b) >= least] or sorted(giver, key=lambda b: -filled(sizes, b))[: max(1, len(giver) // 4)]
    lot = [b for b, x in zip(full, rng.random(len(full))) if x < 0.7]
    inside = set(chain.from_iterable(lot))
    bins, displaced = [list(b) for b in lot], []
    for b in taker:
        if not inside.isdisjoint(b):
            displaced += [i for i in b if i not in inside]
        elif filled(sizes, b) < least and rng.random() < 0.5:  # mutation: a poorly filled bin is taken apart
            displaced += b
        else:
            bins.append(list(b))
    free = [LENGTH - filled(sizes, b) for b in bins]
    displaced = exchange(sizes, bins, free, displaced)
    best_fit(sizes, displaced, bins, free)
    return bins


def evolve(sizes: list[int], island: int, epoch: int, shard: int, elites: list[list[list[int]]]) -> list[list[int]]:
    """An island's best packing after one epoch: its own and the immigrant elite breed with fresh first-fit packings.

    At first a best-fit packing is among them, so no island ends with more sequences than that has.
    """
    rng = np.random.default_rng([abs(shard) & (1 << 62) - 1, island, epoch])
    crowd = list(elites)
    if not crowd:
        crowd.append(fitted(sizes))
    while len(crowd) < POPULATION:
        crowd.append(first_fit(sizes, rng.permutation(len(sizes)).tolist()))
    crowd = sorted(((fitness(sizes, b), b) for b in crowd), key=itemgetter(0), reverse=True)
    bound = -(-sum(sizes) // LENGTH)
    for _ in range(BORN):
        if len(crowd[0][1]) <= bound:
            break
        i, j = rng.permutation(len(crowd))[:2]
        child = crossover(sizes, crowd[i][1], crowd[j][1], rng)
        crowd.append((fitness(sizes, child), child))
        crowd.sort(key=itemgetter(0), reverse=True)
        del crowd[POPULATION:]
    return crowd[0][1]


def to_places(bins: list[list[int]], n: int) -> np.ndarray:
    """Bin of each piece."""
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def to_bins(places: np.ndarray) -> list[list[int]]:
    order = np.argsort(places, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(places[order])) + 1)] if len(places) else []


def islands(shards: DataFrame, count: int) -> DataFrame:
    """(shard, places): the best packing of each of ``count`` shards (shard, length).  Only lengths and places are shuffled."""
    state = shards.select("shard", "length", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.array().cast("array<int>").alias("places"), F.array().cast("array<int>").alias("guest"))
    schema = "shard long, island int, length array<long>, places array<int>, score double, n int"
    # small rows, long work: so many tasks as the work needs, which a size in bytes doesn't show
    tasks = max(1, min(-(-count * ISLANDS // ROWS_A_TASK), MOST_TASKS))
    for epoch in range(EPOCHS):

        def run(frames: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    sizes = x.length.tolist()
                    best = evolve(sizes, x.island, epoch, x.shard, [to_bins(np.asarray(p)) for p in (x.places, x.guest) if len(p)])
                    n, fill = fitness(sizes, best)
                    out.append((x.shard, x.island, sizes, to_places(best, len(sizes)), fill, -n))
                if out:
                    yield pd.DataFrame(out, columns=["shard", "island", "length", "places", "score", "n"])

        now = stash(state.repartition(tasks, "shard", "island").mapInPandas(run, schema), "islands")
        if epoch + 1 < EPOCHS:  # each island's best moves to the next
            moved = now.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("places").alias("guest"))
            state = now.select("shard", "length", "island", "places").join(moved, ["shard", "island"])
    best = now.groupBy("shard").agg(F.min_by("island", F.struct("n", -F.col("score"), "island")).alias("island"))
    return now.join(best, ["shard", "island"]).select("shard", "places")


def leftovers(packed: DataFrame) -> DataFrame:
    """(shard, at, length): the pieces, by shard and number in it, of each shard's badly filled sequences."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples():
                size, places = np.asarray(x.length, np.int64), np.asarray(x.places)
                loose = np.bincount(places, size) < LEFT * LENGTH
                at = np.flatnonzero(loose[places])
                yield pd.DataFrame({"shard": np.full(len(at), x.shard), "at": at, "length": size[at]})

    return packed.mapInPandas(run, "shard long, at int, length long")


def pack_shards(shards: DataFrame) -> DataFrame:
    """(shard, sequences): the sequence of each piece of each shard (shard, length), by two rounds of islands."""
    count = shards.count()
    packed = stash(shards.join(islands(shards, count), "shard"), "packed")
    loose = stash(leftovers(packed), "loose")
    deal = max(1, -(-loose.count() // SHARD))
    # new shards of about one size, the same whenever a task runs again; their numbers are under zero
    dealt = loose.withColumn("again", -1 - F.pmod(F.xxhash64("shard", "at"), F.lit(deal)))
    again = dealt.groupBy("again").agg(F.sort_array(F.collect_list(F.struct("shard", "at", "length"))).alias("x"))
    again = stash(again.select(F.col("again").alias("shard"), F.col("x.length").alias("length"), F.col("x.shard").alias("own"), F.col("x.at").alias("at")), "again")
    second = again.join(islands(again.select("shard", "length"), deal), "shard")

    def number(shard: Column, place: Column) -> Column:
        return F.shiftleft(shard, 16) + place

    moved = second.select("shard", F.explode(F.arrays_zip("own", "at", "places")).alias("x"))
    moved = moved.groupBy(F.col("x.own").alias("own")).agg(F.map_from_entries(F.collect_list(F.struct("x.at", number(F.col("shard"), F.col("x.places"))))).alias("moved"))
    out = packed.join(moved.withColumnRenamed("own", "shard"), "shard", "left")
    return out.select("shard", F.transform("places", lambda p, i: F.coalesce(F.element_at("moved", i), number(F.col("shard"), p))).alias("sequences"))


def pack_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its place there; ``keep_ids`` adds its ids, 32-bit little-endian.

    ``tokenizer`` is a path that every executor can read.
    """
    shards = stash(pieces(docs, tokenizer, id_column, text_column, keep_ids), "pieces")
    names = ["doc", "piece", "start", "length", "crc", "sequences", *["ids"] * keep_ids]
    rows = shards.join(pack_shards(shards.select("shard", "length")), "shard")
    rows = rows.select(F.explode(F.arrays_zip(*names)).alias("x")).select("x.*")
    # a sequence of repacked pieces spans shards, so places are told by sequence
    before = F.sum("length").over(Window.partitionBy("sequences").orderBy("crc", "length", "piece", "start", "doc").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        F.col("doc").alias(id_column), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequences").alias("sequence_id"),
        F.coalesce(before, F.lit(0)).cast("long").alias("offset"), *["ids"] * keep_ids,
    )
