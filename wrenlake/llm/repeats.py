"""Suffix-array dedup by bucket-pointer refinement: strings that an earlier document holds are removed.

A byte is removed if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id.

1. Initial buckets are q-grams.  Only those suffixes are kept whose q-gram has the least hash of
   some string of ``LENGTH`` bytes (a minimiser), so equal strings keep equal suffixes, about one in
   fourteen.  Equal documents form a class and count once.
2. Buckets that hold suffixes of one class alone end here.  Of the others each suffix is kept
   with the bytes of those strings whose minimiser it is.
3. In each bucket suffixes are refined: the bucket of 16 bytes at a place is the pair of the buckets of
   8 bytes there and 8 further on, that of 32 the pair of two of 16, that of 50 of two of 32; each
   round sorts on bucket numbers only and uses those of the round before.  Suffixes that are still
   together are equal strings; the least document of a bucket keeps its own.
4. A hot bucket (``CROWD`` classes in one slice of text, or ``MOST`` in all) is never gathered.  Its suffixes go on as
   single strings, of which each slice sends one row under its least document; rows of one string are then read in the
   order of documents, and only the first is held.

Defined results: ids must cast to long; null text is empty; rows with a null id stay as they are and remove
nothing from others; rows with equal ids remove nothing from each other; equal rows get equal results; a text
shorter than ``LENGTH`` bytes stays; columns of any name are kept.  Classes and q-grams are compared by 64-bit
hashes to find candidates, strings byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, fresh, int_lists, join_hot, mix, quoted, slices, stash

LENGTH = 50
Q = 24
REACH = LENGTH - Q  # bytes on either side of a q-gram that strings over it can reach
WIDTH = Q + 2 * REACH
CROWD = 128  # classes in one slice from which a q-gram's bucket is hot
MOST = 16_384  # classes in all from which it is
MOST_TASKS = 20_000  # that buckets are dealt to; beyond, a task takes several, one after another
HELD = 2_000_000  # suffixes of one run of buckets that are held before hot ones go
CHUNK = 4096  # suffixes that are refined together, if their buckets allow it
SLICE = 2 << 20  # bytes of text that are searched together
BLOCK = 1 << 20  # bytes whose q-grams are hashed at once


def blocks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Numbers of texts, the place in its text at which each begins, and their bytes end to end, some ``BLOCK`` together.

    Longer texts come in parts that overlap so that each string is whole in exactly one; texts without a string are left out.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> tuple[list[int], list[int], bytes]:
        return [x[0] for x in held], [x[1] for x in held], b"".join(x[2] for x in held)

    for i, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, BLOCK):
            part = text[at : at + BLOCK + LENGTH - 1]
            if size + len(part) > BLOCK and held:
                yield out()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield out()


class Block:
    """Minimisers of the strings in a block of texts."""

    def __init__(self, owner: list[int], shift: list[int], data: bytes, begin: np.ndarray):
        self.data, self.begin = data, begin
        n = len(data)
        x = np.frombuffer(data + b"\0" * 8, np.uint8)
        word = np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n - Q + 17, 8), (1, 1))).view("<u8").ravel()
        m = n - Q + 1
        with np.errstate(over="ignore"):
            self.h = h = mix((word[:m] * np.uint64(0x9E3779B97F4A7C15) + word[8 : m + 8]) * np.uint64(0xC2B2AE3D27D4EB4F) + word[16 : m + 16])
        del word
        span = REACH + 1  # q-grams in a string
        low, width = h, 1
        while width < span:  # the least hash of each string
            by = min(width, span - width)
            low = np.minimum(low[: len(low) - by], low[by:])
            width += by
        low = low.copy()
        for end in begin[1:-1].tolist():  # no string crosses the end of a text
            low[max(0, end - LENGTH + 1) : end] = 0
        zeros = np.zeros(span - 1, np.uint64)
        top, width = np.concatenate([zeros, low, zeros]), 1
        while width < span:  # the greatest such, over the strings with a q-gram
            by = min(width, span - width)
            top = np.maximum(top[: len(top) - by], top[by:])
            width += by
        self.at = np.flatnonzero(top[:m] == h)
        self.text = np.searchsorted(begin, self.at, side="right") - 1
        self.owner = np.array(owner)[self.text]
        self.shift = np.array(shift)[self.text] - begin[self.text]

    def reach(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the strings whose leftmost minimiser each is; none where the last is before the first."""
        p, text = self.at[which], self.text[which]
        near = np.arange(1, REACH + 1)
        own = self.h[p][:, None]
        before = self.h[np.maximum(p[:, None] - near, 0)] <= own
        after = self.h[np.minimum(p[:, None] + near, len(self.h) - 1)] < own
        back = np.where(before.any(1), before.argmax(1), REACH)
        on = np.where(after.any(1), after.argmax(1), REACH)
        return np.maximum(p - back, self.begin[text]), np.minimum(p + on - REACH, np.minimum(p, self.begin[text + 1] - LENGTH))


def searched(texts: list[bytes]) -> Iterator[Block]:
    for owner, shift, data in blocks(texts):
        sizes = [min(len(texts[i]) - a, BLOCK + LENGTH - 1) for i, a in zip(owner, shift)]
        yield Block(owner, shift, data, np.cumsum([0, *sizes]))


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def by_class(cls: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each class and its hashes."""
    order = np.argsort(cls, kind="stable")
    found, at = np.unique(cls[order], return_index=True)
    return found, np.split(h[order].view(np.int64), at[1:]) if len(found) else []


def turned(h: np.ndarray) -> np.ndarray:
    """Low and high halves swapped: minimisers have small high halves, so buckets by those would be of very unequal size."""
    return h << np.uint64(32) | h >> np.uint64(32)


SHARED = "cls long, hashes array<long>, hot array<long>"


def shared_rows(cls: np.ndarray, h: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    a, cold = by_class(cls[~hot], h[~hot])
    b, warm = by_class(cls[hot], h[hot])
    none = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b]), pa.int64()), int_lists([*cold, *[none] * len(b)], pa.int64()), int_lists([*[none] * len(a), *warm], pa.int64())], names=["cls", "hashes", "hot"])


def shared_buckets(texts: DataFrame, buckets: int) -> DataFrame:
    """(cls, hashes, hot): for each class of ``texts`` (cls, text), those of its minimisers that another class has too, hot ones apart.

    Tasks send the hashes of a slice in sorted, packed runs.  A hash of many classes in one slice is
    hot for certain: its classes come out at once and only one goes on, with their number, so that a q-gram of a third
    of all documents doesn't fill a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in slices(batches, "text", SLICE):
            own, rows = np.unique(batch.column("cls").to_numpy(), return_index=True)  # one text a class
            texts = bytes_of(batch.column("text").take(pa.array(rows)))
            hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for block in searched(texts):
                hashes.append(turned(block.h[block.at]))
                owners.append(block.owner)
            h, d = np.concatenate(hashes), np.concatenate(owners)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
            h, d = h[new], own[d[new]]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
            count = np.diff(np.concatenate([start, [len(h)]]))
            crowd = np.repeat(count >= CROWD, count)
            direct = shared_rows(d[crowd], h[crowd], np.ones(int(crowd.sum()), bool))
            keep = ~crowd
            keep[start] = True
            weight = np.ones(len(h), np.uint32)
            weight[start] = np.where(count >= CROWD, count, 1)
            h, d, weight = h[keep], d[keep], weight[keep]
            bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            k, m = direct.num_rows, len(full)
            packed = [pa.array([*[None] * k, *(planes(x[cut[b] : cut[b + 1]]) for b in full)], pa.binary()) for x in (h, d, weight)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*[-1] * k, *full.tolist()], pa.int32()), pa.array([*direct.column("cls").to_pylist(), *[None] * m], pa.int64()), pa.concat_arrays([direct.column("hot"), int_lists([none] * m, pa.int64())]), *packed],
                names=["bucket", "cls", "hot", "h", "d", "weight"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None  # one bucket at a time

        def shared() -> pa.RecordBatch:
            h, d, w = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, d, w = h[order], d[order], w[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.concatenate([start, [len(h)]]))
            crowded = np.maximum.reduceat(w, start) > 1
            keep = np.repeat((np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)) | crowded, count)
            hot = np.repeat(crowded | (np.add.reduceat(w.astype(np.int64), start) > MOST), count)
            return shared_rows(d[keep], h[keep], hot[keep])

        def hot_ones() -> pa.RecordBatch:
            """Buckets that are hot already come out; one suffix of each stays, so that later ones are known."""
            h, d, w = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, d, w = h[order], d[order], w[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.concatenate([start, [len(h)]]))
            hot = np.add.reduceat(w.astype(np.int64), start) > MOST
            w[start[hot]] = MOST + 1
            out = np.repeat(hot, count)
            keep = ~out
            keep[start] = True
            held[:] = [(h[keep], d[keep], w[keep])]
            return shared_rows(d[out], h[out], np.ones(int(out.sum()), bool))

        size = 0
        for batch in batches:
            direct = batch.filter(batch.column("cls").is_valid())
            if direct.num_rows:
                yield pa.RecordBatch.from_arrays([direct.column("cls"), int_lists([np.empty(0, np.int64)] * direct.num_rows, pa.int64()), direct.column("hot")], names=["cls", "hashes", "hot"])
            batch = batch.filter(batch.column("cls").is_null())
            for bucket, h, d, w in zip(*(batch.column(c) for c in ("bucket", "h", "d", "weight"))):
                if bucket != key and held:
                    yield shared()
                    held.clear()
                    size = 0
                key = bucket
                held.append((from_planes(h.as_buffer(), np.uint64), from_planes(d.as_buffer(), np.int64), from_planes(w.as_buffer(), np.uint32)))
                size += len(held[-1][0])
                if size > HELD:
                    yield hot_ones()
                    size = HELD // 2 if len(held[0][0]) > HELD // 2 else len(held[0][0])
        if held:
            yield shared()

    sent = texts.mapInArrow(run, "bucket int, cls long, hot array<long>, h binary, d binary, weight binary")
    # set, so that tasks aren't merged: packed runs reach Python in one batch where there are few of them
    return sent.repartition(min(buckets, MOST_TASKS), F.coalesce("cls", "bucket")).sortWithinPartitions("bucket").mapInArrow(meet, SHARED)


SUFFIX = "key binary, seg binary, left int, id long, cls long, places array<int>, spans array<int>"
SUFFIX_TYPES = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
OUT_ROWS = 4_000  # rows of suffixes that go to the JVM together


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists, and the length of each."""
    return column.flatten().to_numpy(), np.diff(np.asarray(column.offsets))


def binaries(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The stretches of ``data`` from ``start``, ``size`` bytes each."""
    at = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=at[1:])
    place = np.repeat(start - at[:-1], size) + np.arange(int(at[-1]))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data[place])])


def edges(column: pa.Array) -> np.ndarray:
    """Where each value of a binary column begins in its data, and where the last one ends."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def numbers(column: pa.Array) -> np.ndarray:
    """The number of each value among the distinct ones."""
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def spans_batch(ids: np.ndarray, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """A row (id, cls, spans) for each document: starts and ends in turn of what its stretches cover."""
    order = np.lexsort((start, classes, ids))
    ids, classes, start, end = ids[order], classes[order], start[order], end[order]
    first = changes(ids, classes)
    shift = np.repeat(first, np.diff([*first, len(ids)])) << 32  # so that stretches of two documents never meet
    far = np.maximum.accumulate(end + shift)
    at = np.flatnonzero(np.concatenate([[True], start[1:] + shift[1:] > far[:-1]])[: len(ids)])
    last = np.concatenate([at[1:] - 1, [len(ids) - 1]])[: len(at)]
    flat = np.column_stack([start[at], far[last] - shift[last]]).ravel()
    cut = np.concatenate([np.searchsorted(at, first) * 2, [len(flat)]]).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(cut), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(ids[first], pa.int64()), pa.array(classes[first], pa.int64()), spans], names=["id", "cls", "spans"])


def tagged(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for a hash in a document; should two pairs share one, suffixes too many go on, which refinement tells apart."""
    return mix(h.astype(np.uint64, copy=False) ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def suffix_batch(key: pa.Array, seg: pa.Array | None, left: np.ndarray, ids: np.ndarray, classes: np.ndarray, places: pa.Array) -> pa.RecordBatch:
    n = len(key)
    columns = [key, pa.nulls(n, pa.binary()) if seg is None else seg, pa.array(left, pa.int32()), pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), places, pa.nulls(n, SUFFIX_TYPES[-1])]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SUFFIX.split(", ")])


def known_batch(spans: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of ``suffixes`` that carry spans only."""
    n = spans.num_rows
    nothing = [pa.nulls(n, k) for k in SUFFIX_TYPES]
    return pa.RecordBatch.from_arrays([*nothing[:3], spans.column("id"), spans.column("cls"), nothing[5], spans.column("spans")], names=[x.split()[0] for x in SUFFIX.split(", ")])


class Found:
    """Suffixes of a slice, or single strings of it: each is kept under its least document with all its places there.

    Documents are numbered by rising id.  What other documents hold of it is known to be removed.
    """

    def __init__(self):
        self.key, self.seg, self.number = [], [], []

    def add(self, key: pa.Array, seg: pa.Array, left: np.ndarray, place: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.key.append(key)
        self.seg.append(seg)
        self.number.append(np.stack([left, place, doc, start, end]).astype(np.int64))

    def batches(self, ids: np.ndarray, classes: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
        if not sum(map(len, self.seg)):
            return
        key, seg = pa.concat_arrays(self.key), pa.concat_arrays(self.seg)
        left, place, doc, start, end = np.concatenate(self.number, axis=1)
        code = numbers(seg) * (WIDTH + 1) + left
        order = np.lexsort((place, doc, code))
        code, place, doc = code[order], place[order], doc[order]
        first = changes(code, doc)
        count = np.diff([*first, len(code)])
        head = np.zeros(len(first), np.int64)  # the row's first group of its suffix, which has the least document
        head[changes(code[first])] = changes(code[first])
        least = doc[first][np.maximum.accumulate(head)]
        kept = ids[doc[first]] == ids[least]  # two rows may have one id
        rows = order[first[kept]]
        cut = np.concatenate([[0], np.cumsum(count[kept])]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(cut), pa.array(place[np.repeat(kept, count)], pa.int32()))
        held, taken = doc[first[kept]], pa.array(rows)
        out = suffix_batch(key.take(taken), None if hot else seg.take(taken), left[rows], ids[held], classes[held], places)
        for i in range(0, out.num_rows, OUT_ROWS):
            yield out.slice(i, OUT_ROWS)
        gone = order[~np.repeat(kept, count)]
        if len(gone):
            of = doc[~np.repeat(kept, count)]
            yield known_batch(spans_batch(ids[of], classes[of], start[gone], end[gone]))


def suffixes(keyed: DataFrame) -> DataFrame:
    """Suffixes of shared buckets: ``seg``, the bytes of their strings, with the q-gram (``key``) at ``left``; of hot ones single strings (``key``).

    ``keyed``: id, cls, text, hashes, hot; other columns aren't read.  Of documents in one slice with the same bytes, only the least goes on; strings
    of the others are known to be removed and come out as spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices((b.filter(b.column("hashes").is_valid()) for b in batches), "text", SLICE):
            batch = batch.sort_by([("id", "ascending"), ("cls", "ascending")])
            ids, classes = (batch.column(c).to_numpy() for c in ("id", "cls"))
            wanted = []
            for c in ("hashes", "hot"):
                h, count = flat_lists(batch.column(c))
                wanted.append(tagged(h, np.repeat(np.arange(len(count)), count)))
            cold, strings = Found(), Found()
            for block in searched(bytes_of(batch.column("text"))):
                data = np.frombuffer(block.data, np.uint8)
                tags = tagged(turned(block.h[block.at]), block.owner)
                for own, found in zip(wanted, (cold, strings)):
                    which = np.flatnonzero(np.isin(tags, own)) if len(own) else np.empty(0, np.int64)
                    first, last = block.reach(which)
                    ok = last >= first
                    which, first, last = which[ok], first[ok], last[ok]
                    p, doc, shift = block.at[which], block.owner[which], block.shift[which]
                    if found is cold:
                        grams = binaries(data, p, np.full(len(p), Q))
                        found.add(grams, binaries(data, first, last - first + LENGTH), p - first, p + shift, doc, first + shift, last + shift + LENGTH)
                        continue
                    size = last - first + 1
                    for i in range(0, len(p), CHUNK):  # each string of these suffixes
                        n = size[i : i + CHUNK]
                        s = np.repeat(first[i : i + CHUNK] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                        at, seg = s + np.repeat(shift[i : i + CHUNK], n), binaries(data, s, np.full(len(s), LENGTH))
                        found.add(seg, seg, np.zeros(len(s), np.int64), at, np.repeat(doc[i : i + CHUNK], n), at, at + LENGTH)
            yield from cold.batches(ids, classes, False)
            yield from strings.batches(ids, classes, True)

    return keyed.mapInArrow(run, SUFFIX)


def bucket_numbers(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1].reshape(pairs.shape).astype(np.int64)


def refine(segs: pa.Array, left: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix and each string over its q-gram: whether a smaller document has that string.

    Buckets of 8 bytes come first; each later round sorts pairs of numbers of the round before.
    """
    m = len(segs)
    at = edges(segs)
    size = np.diff(at)
    rows = np.zeros((m, WIDTH), np.uint8)
    begin = REACH - left
    end = begin + size
    place = np.repeat(np.arange(m) * WIDTH + begin - at[:-1] + at[0], size) + np.arange(int(size.sum()))
    rows.reshape(-1)[place] = np.frombuffer(segs.buffers()[2], np.uint8)[at[0] : at[-1]]
    word = np.lib.stride_tricks.sliding_window_view(rows, 8, axis=1)
    b8 = bucket_numbers(np.ascontiguousarray(word).view("<u8")[:, :, 0])
    n = m * WIDTH + 1
    b16 = bucket_numbers(b8[:, :-8] * n + b8[:, 8:])
    b32 = bucket_numbers(b16[:, :-16] * n + b16[:, 16:])
    b50 = bucket_numbers(b32[:, : REACH + 1] * n + b32[:, LENGTH - 32 : LENGTH - 32 + REACH + 1])
    start = np.arange(REACH + 1)[None, :]
    valid = (start >= begin[:, None]) & (start + LENGTH <= end[:, None])
    least = np.full(int(b50.max(initial=0)) + 1, np.iinfo(np.int64).max)
    owner = np.broadcast_to(docs[:, None], b50.shape)
    np.minimum.at(least, b50[valid], owner[valid])
    return valid & (least[b50] < owner)


def refined_spans(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Spans to remove from the suffixes of whole buckets; equal suffixes are refined once, under their least document.

    Strings that go from one suffix start within ``REACH`` bytes, so what they cover there is one stretch.
    """
    ids, left = batch.column("id").to_numpy(), batch.column("left").to_numpy().astype(np.int64)
    _, row, of = np.unique(numbers(batch.column("seg")) * (WIDTH + 1) + left, return_index=True, return_inverse=True)
    docs = np.full(len(row), np.iinfo(np.int64).max)
    np.minimum.at(docs, of, ids)
    bucket = numbers(batch.column("key"))[row]
    many = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    hit = np.zeros((len(row), REACH + 1), bool)
    if len(many):
        hit[many] = refine(batch.column("seg").take(pa.array(row[many])), left[row[many]], docs[many])
    whole = docs[of] < ids  # the same bytes in a smaller document: every string is there
    size = np.diff(edges(batch.column("seg")))
    low = np.where(whole, REACH - left, hit.argmax(1)[of])
    high = np.where(whole, REACH - left + size, REACH - hit[:, ::-1].argmax(1)[of] + LENGTH)
    places, count = flat_lists(batch.column("places"))
    at = np.repeat(np.arange(len(ids)), count)
    goes = (whole | hit.any(1)[of])[at]
    at, places = at[goes], places[goes].astype(np.int64) - REACH
    return spans_batch(ids[at], batch.column("cls").to_numpy()[at], places + low[at], places + high[at])


def removed_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from suffixes and strings sorted by key and document; whole buckets are gathered to chunks of bounded size."""
    held: list[pa.RecordBatch] = []
    string, least = None, 0  # the string that is read, and its least document
    for batch in batches:
        known = batch.filter(batch.column("key").is_null())
        if known.num_rows:
            yield known.select(["id", "cls", "spans"])
        batch = batch.filter(batch.column("key").is_valid())
        single = batch.filter(batch.column("seg").is_null())
        if single.num_rows:
            keys, ids = single.column("key"), single.column("id").to_numpy()
            first = changes(numbers(keys))
            own = ids[first]
            if keys[0].as_py() == string:
                own[0] = least
            string, least = keys[-1].as_py(), own[-1]
            places, count = flat_lists(single.column("places"))
            later = np.repeat(np.repeat(own, np.diff([*first, len(ids)])) < ids, count)
            at, places = np.repeat(np.arange(len(ids)), count)[later], places[later].astype(np.int64)
            if len(at):
                yield spans_batch(ids[at], single.column("cls").to_numpy()[at], places, places + LENGTH)
        batch = batch.filter(batch.column("seg").is_valid())
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 2 * CHUNK:
            continue
        rows = pa.concat_batches(held)
        ends = changes(numbers(rows.column("key")))
        a = 0
        for b in ends[1:].tolist():  # the last bucket may go on
            if b - a >= CHUNK or b == ends[-1]:
                yield refined_spans(rows.slice(a, b - a))
                a = b
        held = [rows.slice(a)]
    if held:
        yield refined_spans(pa.concat_batches(held))


def cut_out(text: bytes, spans: list[int]) -> tuple[bytes, int, int]:
    """What is left without the spans (starts and ends in turn), bytes removed, and maximal runs of them."""
    edge = np.zeros(len(text) + 1, np.int32)
    x = np.array(spans, np.int64)
    np.add.at(edge, x[0::2], 1)
    np.add.at(edge, x[1::2], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def with_keys(docs: DataFrame, id_column: str, text_column: str, keep: bool) -> DataFrame:
    """(id, cls, text) of each document, and ``row``, all its other columns, if they are to be kept."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    row = [F.struct(*quoted([c for c in docs.columns if c != text_column])).alias("row")] * keep
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("cls"), F.col(text_column).alias("text"), *row)


def find_spans(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, cls, n_bytes, digest, first) of all documents, and (id, cls, spans) of those of which something goes.

    ``first``: the least id with the same text.  Copies aren't searched; they go as a whole.
    ``keyed`` is dealt out by key for the search, with all its columns; a caller that joins the same rows with the spans
    reuses that exchange, so texts are shuffled once.
    """
    text = F.coalesce("text", F.lit(""))
    own = stash(keyed.select("id", "cls", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest")), "repeat-classes")
    first = own.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = join_hot(own, first, "digest").withColumn("first", F.coalesce("first", "id"))
    total = own.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(64, int(total // 4_000_000))  # some 300,000 minimisers each
    shared = shared_buckets(keyed.where("id is not null").select("cls", "text"), buckets)
    shared = shared.groupBy("cls").agg(F.flatten(F.collect_list("hashes")).alias("hashes"), F.flatten(F.collect_list("hot")).alias("hot"))
    reps = own.where(f"id = first and n_bytes >= {LENGTH}").select("id", "cls").distinct()
    wanted = stash(reps.join(shared, "cls"), "repeat-wanted")
    found = suffixes(keyed.join(wanted, ["id", "cls"], "left").select(*keyed.columns, "hashes", "hot"))
    # equal keys meet; rows that only carry known spans go anywhere
    dealt = found.repartition(F.coalesce("key", F.col("cls").cast("string").cast("binary"))).sortWithinPartitions("key", "id")
    spans = dealt.mapInArrow(removed_spans, "id long, cls long, spans array<int>")
    return own, spans.groupBy("id", "cls").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeat_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: bytes, bytes and runs removed, and the digest of what is left."""
    keyed = with_keys(docs, id_column, text_column, False)
    own, spans = find_spans(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices((b.filter(b.column("spans").is_valid()) for b in batches), "text"):
            found = [cut_out(t, s) for t, s in zip(bytes_of(batch.column("text")), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cls"), pa.array([n for _, n, _ in found], pa.int64()), pa.array([r for _, _, r in found], pa.int64()), pa.array([hashlib.sha256(x).digest() for x, _, _ in found], pa.binary())], names=["id", "cls", "gone", "runs", "kept"])

    cut = keyed.join(spans, ["id", "cls"], "left").mapInArrow(run, "id long, cls long, gone long, runs long, kept binary").dropDuplicates(["id", "cls"])
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    nothing = F.lit(hashlib.sha256(b"").digest())
    return own.join(cut, ["id", "cls"], "left").select(
        F.col("id").cast(docs.schema[id_column].dataType).alias(id_column), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(copy, nothing).otherwise(F.coalesce("kept", "digest")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size_column: str | None = "n_chars") -> DataFrame:
    """The documents less what an earlier one holds, all columns; bytes of characters that are cut in two go as well.

    A document of which nothing is left stays, with an empty text.  ``size_column``, if there is one, counts characters anew.
    """
    keyed = with_keys(docs, id_column, text_column, True)
    own, spans = find_spans(keyed)
    whole = own.where(f"n_bytes >= {LENGTH} and id > first").select("id", "cls", F.array(F.lit(0), F.col("n_bytes").cast("int")).alias("spans")).distinct()
    (left,) = fresh(docs.columns, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            cut = [t if s is None else cut_out((t or "").encode(), s)[0].decode(errors="ignore") for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cut, pa.string()), pa.array([s is not None for s in spans])], names=["row", left, "changed"])

    rows = keyed.schema["row"].dataType
    out = keyed.join(spans.unionByName(whole), ["id", "cls"], "left").mapInArrow(run, T.StructType([T.StructField("row", rows), T.StructField(left, T.StringType()), T.StructField("changed", T.BooleanType())]))

    def value(c: str):
        if c == text_column:
            return F.col(left).cast(docs.schema[c].dataType).alias(c)
        if c == size_column:
            return F.when(F.col("changed"), F.length(left).cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return out.select(*map(value, docs.columns))
