"""What several operators share: intermediate tables, byte views of text columns, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (tests, one machine) is a local folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stash(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    ``group``: bytes of a row group, for rows that are large; a task holds a group or two when it writes or reads.
    """
    path = new_dir(df.sparkSession, name)
    (df.write.option("parquet.block.size", group) if group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(names: list[str]) -> list[Column]:
    """The columns of these names as they are, dots and all."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with underscores after it until no column is called so (case ignored)."""
    held = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


#: Rows of one key from which a join treats it as hot; more for large tables, so that at most MOST_HOT keys are.
HOT_ROWS, MOST_HOT = 1_000, 200_000


def join_hot(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left join ``table`` (one row a key, narrow) for rows of which many may share a key.

    Keys of more than ``limit`` rows are at most ``rows / limit``, so at most MOST_HOT: their rows of ``table`` are
    broadcast and ``rows`` with them stay in place.  The others are joined by a shuffle.  Null keys match nothing and
    aren't shuffled.  ``rows`` is read several times: it should be stored.
    """
    limit = max(HOT_ROWS, rows.count() // MOST_HOT)
    hot = [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit).select(key).collect()]
    new = [c for c in table.columns if c != key]
    empty = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in new))
    if not hot:
        return rows.where(F.col(key).isNotNull()).join(table, key, "left").select(*rows.columns, *new).unionByName(empty)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in hot], rows.select(key).schema))
    many = rows.join(keys, key, "left_semi").join(F.broadcast(table.join(keys, key, "left_semi")), key, "left")
    few = rows.where(F.col(key).isNotNull()).join(keys, key, "left_anti").join(table, key, "left")
    return few.select(*rows.columns, *new).unionByName(many.select(*rows.columns, *new)).unionByName(empty)


def is_held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``most`` bytes (one longer text stays whole).

    A task's freed memory goes back to the system when its batches end.
    """
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0))
        group = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    tidy()


def tidy() -> None:
    """Give memory that a task has freed back to the system: workers are reused, and keep it otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


BLOCK = 1 << 20  # bytes of text that are hashed at once
FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse
UP, DOWN = powers(FACTOR, BLOCK), powers(pow(FACTOR, -1, 1 << 64), BLOCK)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte; white space counts as nothing.
CASED = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
CASED[SPACE] = 0
LOWER = CASED[np.frombuffer(bytes(range(256)).lower(), np.uint8)]


def cut_long(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of less than ``most`` bytes that end after white space; a word that is longer is a part of its own."""
    a = 0
    while len(text) - a >= most:
        end = max(text.rfind(c, a, a + most - 1) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) + 1
        if not end:
            found = GAP(text, a)
            end = found.start() if found else len(text)
        yield text[a:end]
        a = end
    yield text[a:]


GAP = re.compile(rb"[\x20\x09-\x0d]").search


class Words(NamedTuple):
    """Words in a block of text: bytes, starts and ends in it, number of each word's text, and its place there."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def word_blocks(texts: list[bytes]) -> Iterator[Words]:
    """The words of all texts in order, in blocks of up to ``BLOCK`` bytes; a word of ``BLOCK`` bytes or more is a block of its own."""

    def block(parts: list[tuple[int, int, bytes]]) -> Words:
        data = np.frombuffer(b" ".join(x for *_, x in parts), np.uint8)
        edge = np.flatnonzero(np.diff(SPACE[data], prepend=True, append=True))
        begin = np.cumsum([0, *(len(x) + 1 for *_, x in parts[:-1])])
        part = np.searchsorted(begin, edge[0::2], side="right") - 1
        return Words(data, edge[0::2], edge[1::2], np.array([i for i, *_ in parts])[part], edge[0::2] - begin[part] + np.array([a for _, a, _ in parts])[part])

    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        for part in cut_long(text, BLOCK) if len(text) >= BLOCK else (text,):
            if (size + len(part) + 1 > BLOCK) and held:
                yield block(held)
                held, size = [], 0
            if part:
                held.append((i, at, part))
                size += len(part) + 1
            at += len(part)
    if held:
        yield block(held)


def starts(owner: list[np.ndarray], n: int) -> np.ndarray:
    """Where the words of each of ``n`` texts begin (one more entry than texts)."""
    return np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(owner), minlength=n) if owner else np.zeros(n, np.int64))]).astype(np.int64)


def hash_stretches(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of a block from running sums of its bytes' numbers; equal bytes have equal hashes anywhere."""
    return mix((total[end] - total[start]) * DOWN[start] + (end - start).astype(np.uint64))


def running_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * UP[: len(data)], out=total[1:])
    return total


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts end to end, and where each text's begin (one more entry than texts).

    A word's hash is a polynomial in its bytes' random numbers, taken from running sums over a whole block of text,
    so that no dictionary of words is held.  ``lower`` takes A-Z as a-z.
    """
    hashes, owner = [], []
    for b in word_blocks(texts):
        if len(b.data) >= BLOCK:  # one word
            word = b.data.tobytes()
            hashes.append(np.array([xxhash.xxh3_64_intdigest(word.lower() if lower else word)], np.uint64))
        else:
            hashes.append(hash_stretches(running_sums(b.data, LOWER if lower else CASED), b.start, b.end))
        owner.append(b.owner)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), starts(owner, len(texts))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each ``k`` neighbouring ones."""
    out = h[: max(0, len(h) - k + 1)] + np.uint64(k)
    for i in range(1, k):
        out = mix(out) + h[i : len(h) - k + 1 + i]
    return mix(out)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of each text.

    A-Z are lower-cased; words are runs without ASCII white space.  A text of fewer words is
    one shingle (the whole sequence), one without words none.
    """
    h, at = word_hashes(texts, lower=True)
    every = windows(h, k)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        out.append(np.unique(every[a : b - k + 1]) if b - a >= k else windows(h[a:b], b - a) if b > a else h[:0])
    return out


def int_lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of integer arrays."""
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(x) for x in values], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))
