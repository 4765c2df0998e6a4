"""Importance resampling towards a target: hashed word runs, counted by sorting streams of bucket numbers.

Each task writes the buckets of its documents' features as packed 16-bit streams, with where each document begins.
Counts come from the stored streams: each is sorted and run-length encoded, and Spark adds up one count a bucket and task.
The logarithm of how much likelier a bucket is in the target is its gain; the streams are read once more, gains are gathered
by bucket and added up between the documents' offsets.  Random numbers by Gumbel's law turn weights into a draw
without replacement: the highest sums win.  Ranks come from one shuffle by range: place in a partition and rows before it.

The checksum of a run of words is put together from those of its words: appending n bytes is a linear map of the checksum
before, one table for each n.

Defined results: null and empty texts have no features and weight 0; repeated rows are rows of their own; null ids are
ordered last and drawn by the checksum of the seed alone; an empty target gives gains from the corpus alone; empty tables give an
empty result; other columns are dropped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, slices, stash, tidy

BUCKETS = 10_000
MOST_WORDS = 3  # words of a feature
LEAST_WORDS = 20  # of a document that may be drawn
SLICE = 1 << 20  # bytes of text of a stream; one longer text is a stream of its own
GROUP = 8 << 20  # bytes of a row group of streams
PART = 1 << 18  # words or bytes that are handled at once

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
SHORT = 64  # bytes of a word that are taken side by side with other words


def steps() -> np.ndarray:
    """The checksum's table for one more byte, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


STEP = steps()
Map = np.ndarray  # (4, 256): what each byte of a checksum becomes


def apply(table: Map, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def zero_maps() -> tuple[np.ndarray, list[Map]]:
    """The maps for appending 0 to SHORT + 1 bytes, flat, and for 1, 2, 4, 8... bytes."""
    x = (np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    few = [x]
    for _ in range(SHORT + 1):
        few.append(STEP[few[-1] & 255] ^ few[-1] >> 8)
    double = [few[1]]
    for _ in range(40):
        double.append(apply(double[-1], double[-1]))
    return np.stack(few).ravel(), double


FEW, DOUBLE = zero_maps()


def append(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What checksums ``x`` bring to those of longer strings: ``x`` before ``n`` more bytes."""
    at = np.minimum(n, SHORT + 1) << 10
    out = FEW[at + (x & 255)] ^ FEW[at + 256 + (x >> 8 & 255)] ^ FEW[at + 512 + (x >> 16 & 255)] ^ FEW[at + 768 + (x >> 24)]
    long = np.flatnonzero(n > SHORT + 1)
    if len(long):
        y, left = out[long], n[long] - SHORT - 1
        for bit in range(int(left.max()).bit_length()):
            own = (left >> bit & 1).astype(bool)
            y[own] = apply(DOUBLE[bit], y[own])
        out[long] = y
    return out


def word_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of bytes."""
    n = end - start
    out = np.empty(len(n), np.uint32)
    order = np.argsort(-n, kind="stable")
    long = order[: np.searchsorted(-n[order], -SHORT)]  # more than SHORT bytes
    for i in long.tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]])
    order = order[len(long) :]
    at, x, size = start[order], np.full(len(order), 0xFFFFFFFF, np.uint32), n[order]
    for j in range(int(size[0]) if len(size) else 0):
        m = np.searchsorted(-size, -j)  # words of more than j bytes
        x[:m] = STEP[(x[:m] ^ data[at[:m] + j]) & 255] ^ x[:m] >> 8
    out[order] = ~x
    return out


def words_of(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Checksums, sizes and starts of the words of a text, in parts; a word across two parts is put together."""
    held = (0, 0, 0)  # checksum, size and start of a word that goes on
    for a in range(0, len(text), PART):
        data = LOWER[np.frombuffer(text, np.uint8, min(PART, len(text) - a), a)]
        edge = np.flatnonzero(np.diff(WORD[data], prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        x, n, begin = word_sums(data, start, end), end - start, start + a
        if held[1]:
            if len(start) and start[0] == 0:
                x[0] ^= append(np.array([held[0]], np.uint32), n[:1])[0]
                n[0] += held[1]
                begin[0] = held[2]
            else:
                x, n, begin = (np.concatenate([np.array([v], u.dtype), u]) for v, u in zip(held, (x, n, begin)))
            held = (0, 0, 0)
        if len(end) and end[-1] == len(data) and a + len(data) < len(text):
            held = int(x[-1]), int(n[-1]), int(begin[-1])
            x, n, begin = x[:-1], n[:-1], begin[:-1]
        yield x, n, begin


SPACE = np.uint32(zlib.crc32(b" "))


def buckets(x: np.ndarray, n: np.ndarray, first: np.ndarray, most: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and last word of each run of 1 to ``most`` words, by number of words; ``first``: the first word of each word's document."""
    place = np.arange(len(x))
    out, ends, run = [(x % count).astype(np.uint16)], [place], x
    after = append(np.full(len(x), SPACE), n) ^ x  # of a space and the word
    for k in range(1, most):
        run = append(run[:-1], n[k:] + 1) ^ after[k:]
        inside = place[k:] - k >= first[k:]
        out.append((run[inside] % count).astype(np.uint16))
        ends.append(place[k:][inside])
    return np.concatenate(out), np.concatenate(ends)


def stream_of(texts: list[bytes], most: int = MOST_WORDS, count: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text by text, where each text's begin (one more than texts), and words by text."""
    joined = b"\0".join(texts)
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size) - size
    parts = list(words_of(joined))
    x, n, at = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    words = np.diff(np.searchsorted(at, np.append(begin, len(joined) + 1)))
    edge = np.concatenate([[0], np.cumsum(words)])
    first = np.repeat(edge[:-1], words)
    features = sum(np.maximum(words - k, 0) for k in range(most))
    found, last = [], []
    for a in range(0, len(x), PART):  # runs that end in this part
        b = max(0, a - most + 1)
        y, ends = buckets(x[b : a + PART], n[b : a + PART], np.maximum(first[b : a + PART] - b, 0), most, count)
        own = ends >= a - b
        found.append(y[own])
        last.append(ends[own] + b)
    y, ends = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((found, np.uint16), (last, np.int64)))
    order = np.argsort(np.searchsorted(edge, ends, side="right"), kind="stable") if len(found) else ends
    return y[order], np.concatenate([[0], np.cumsum(features)]).astype(np.int64), words


def write_streams(rows: DataFrame, key: str, text: str, most: int = MOST_WORDS, count: int = BUCKETS) -> DataFrame:
    """(ids, words, offsets, stream): the packed buckets of a slice of documents, and where each document's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE):
            stream, offsets, words = stream_of(bytes_of(batch.column("t")), most, count)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([words.tolist()], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([stream.tobytes()], pa.binary())], names=["ids", "words", "offsets", "stream"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema[key].dataType)), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("stream", T.BinaryType())])
    return stash(rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema), "streams", GROUP)


def sort_count(streams: DataFrame) -> DataFrame:
    """(bucket, n): each stream sorted and run-length encoded; a task adds up its own, Spark the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                ordered = np.sort(np.frombuffer(batch.column("stream")[i].as_buffer(), np.uint16), kind="stable")
                if len(ordered):
                    begin = np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ 1))
                    total[ordered[begin]] += np.diff(begin, append=len(ordered))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])
        tidy()

    return streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], count: int) -> np.ndarray:
    """Thousandths of the logarithm of target over corpus share of each bucket, counts one higher, floors taken."""
    s_all, t_all = float(sum(corpus.values()) + count), float(sum(target.values()) + count)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((corpus.get(b, 0) + 1) * t_all))) for b in range(count)], np.int64)


def weigh(streams: DataFrame, gain: np.ndarray, least: int) -> DataFrame:
    """(id, n_features, weight, fit): the gains of each document's features added up; whether it may be drawn."""
    kind = streams.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, offsets = (batch.column(c)[i].values for c in ("ids", "words", "offsets"))
                at = np.asarray(offsets)
                n = np.diff(at)
                weight = np.zeros(len(n), np.int64)
                if n.any():
                    own = gain[np.frombuffer(batch.column("stream")[i].as_buffer(), np.uint16)]
                    weight[n > 0] = np.add.reduceat(own, at[:-1][n > 0])
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight), pa.array(np.asarray(words) >= least)], names=["id", "n_features", "weight", "fit"])
        tidy()

    schema = T.StructType([T.StructField("id", kind), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("fit", T.BooleanType())])
    return streams.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", percent: int = 5, seed: int = 42, least: int = LEAST_WORDS, most: int = MOST_WORDS, count: int = BUCKETS) -> DataFrame:
    """(key, n_features, weight, score, rank): every document; ``rank`` (1, 2, ...) of the ``percent`` drawn, else null.

    ``count`` is the number of buckets, 65,536 at most.  Of the documents with ``least`` words, the highest scores are drawn, ties by key.
    """
    if not 0 < count <= 1 << 16:
        raise ValueError("bucket numbers must fit 16 bits")
    streams = write_streams(docs, key, text, most, count)
    # one number a bucket, at most 65,536
    corpus = {r.bucket: r.n for r in sort_count(streams).collect()}
    aim = {r.bucket: r.n for r in sort_count(write_streams(target, target_key, text, most, count)).collect()}
    rows = weigh(streams, gains(corpus, aim, count), least)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))
    # the last key only spreads rows that are equal in all others
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), F.asc("tie")]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the upper bits of the number are the partition's, the lower 33 count its rows in order
    ordered = stash(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    # two counts a partition
    per = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fit")).orderBy("part").collect()
    drawn = percent * sum(r.fit for r in per) // 100
    before = np.cumsum([0, *(r.n for r in per)]).tolist()
    table = rows.sparkSession.createDataFrame([(r.part, b) for r, b in zip(per, before)], "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    out = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(table), "part")
    return out.select(F.col("id").alias(key), "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
