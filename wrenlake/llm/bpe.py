"""Byte-level BPE encoding and decoding by merge replay over a corpus of words.

Texts are cut into pieces by the tokenizer's pattern.  The distinct pieces of a task's share of
the corpus, less those that the worker has met before, are laid end to end as one array of
tokens.  An inverted index from rank to positions then applies each merge in rank order to all
words at once; after a merge only the pairs with the two neighbours are looked up again.  Words
are independent, so shares of the corpus may be replayed apart with equal results, and no
dictionary that grows with the corpus is shuffled or broadcast.

Defined results: null text is empty and has no tokens; equal texts give equal rows; repeated rows
are repeated; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

NONE = np.int64(1) << 40  # no merge
# Code points that the pattern's \s stands for.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Ranks:
    """A rank file: tokens by id, and which neighbouring ids merge into which."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {v: k for k, v in self.ids.items()}
        self.pattern = regex.compile(pattern.replace("[^\\s", "[^" + SPACE).replace("\\S", "[^" + SPACE + "]").replace("\\s", "[" + SPACE + "]"))
        self.text_tokens = {str(v): k for k, v in self.ids.items()}
        self.bytes = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        self.n = max(self.tokens) + 1
        merges = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    merges[a * self.n + b] = rank
        self.keys = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[k] for k in self.keys.tolist()], np.int64)
        self.merges = merges

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into, or NONE; a negative id marks a word's end."""
        key = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def one_word(self, word: bytes) -> list[int]:
        """The same merges for a single word, one at a time: always the lowest rank, leftmost first, from a heap of pairs."""
        part = [self.ids[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def enter(i: int) -> None:
            if i >= 0 and after[i] < len(part):
                rank = self.merges.get(part[i] * self.n + part[after[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, part[i], part[after[i]]))

        for i in range(len(part)):
            enter(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue  # one of the two has merged since
            part[i], part[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            enter(before[i])
            enter(i)
        return [x for x in part if x >= 0]


@lru_cache(4)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def replay(words: list[bytes], book: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words end to end, and where each word's ids begin (one more entry than words)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum()) + len(words)
    start = np.cumsum(sizes + 1) - sizes - 1
    sym = np.full(n + 1, -1, np.int64)  # a place after each word stays -1, so no pair spans words
    place = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(words)), sizes)
    sym[place] = book.bytes[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    rank = np.full(n + 1, NONE)
    rank[:n] = book.rank_of(sym[:n], sym[1 : n + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    again = np.zeros(len(words), bool)  # words in which a merge made a lower rank possible

    def enter(places: np.ndarray) -> None:
        r = rank[places]
        known = r < NONE
        places, r = places[known], r[known]
        order = np.argsort(r, kind="stable")
        places, r = places[order], r[order]
        cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                key = int(r[a])
                if key not in index:
                    index[key] = []
                    heapq.heappush(heap, key)
                index[key].append(places[a:b])

    enter(np.arange(n))
    mark = np.zeros(n + 1, bool)
    while heap:
        now = heapq.heappop(heap)
        places = index.pop(now)
        at = np.concatenate(places) if len(places) > 1 else places[0]
        at = at[rank[at] == now]
        if not len(at):
            continue
        mark[at] = True
        clash = mark[after[at]].any()
        mark[at] = False
        if clash:  # runs such as aaa: take every other place from the left
            keep, taken = [], -1
            for p in np.sort(at).tolist():
                if p != taken:
                    keep.append(p)
                    taken = int(after[p])
            at = np.array(keep)
        gone = after[at]
        sym[at] = now
        sym[gone] = -1
        rank[gone] = NONE
        after[at] = after[gone]
        before[after[at]] = at
        left = before[at]
        mark[at] = True
        touched = np.concatenate([at, left[(left >= 0) & ~mark[left]]])
        mark[at] = False
        rank[touched] = book.rank_of(sym[touched], sym[after[touched]])
        lower = touched[rank[touched] < now]
        if len(lower):
            again[np.searchsorted(start, lower, side="right") - 1] = True
        enter(touched)
    flat = sym[:n]
    live = flat >= 0
    counts = np.add.reduceat(live.astype(np.int64), start) if len(words) else np.empty(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = flat[live]
    if again.any():
        parts = [out[a:b] for a, b in zip(bounds, bounds[1:])]
        for w in np.flatnonzero(again):
            parts[w] = np.array(book.one_word(words[w]), np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        out = np.concatenate(parts)
    return out, bounds


class Encoder:
    """Encodes texts; keeps each distinct piece with its ids as text."""

    most = 150_000  # some 30 MB

    def __init__(self, path: str, pattern: str):
        self.book = ranks(path, pattern)
        self.known: dict[str, str] = {}

    def learn(self, new: list[str]) -> None:
        """Encode pieces not met before, all at once; a piece that is itself a token isn't merged."""
        rest = []
        for piece, word in zip(new, [x.encode() for x in new]):
            if (i := self.book.ids.get(word)) is None:
                rest.append((piece, word))
            else:
                self.known[piece] = str(i)
        flat, bounds = replay([w for _, w in rest], self.book)
        text, edges = list(map(str, flat.tolist())), bounds.tolist()
        self.known.update((p, ",".join(text[a:b])) for (p, _), a, b in zip(rest, edges, edges[1:]))

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text, in decimal, joined by commas."""
        cut = [self.book.pattern.findall(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [",".join(map(get, x)) for x in cut]

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.book.text_tokens.__getitem__, ids))


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every text, decode its ids again, and return counts and digests; ``keep_ids`` adds the ids.

    ``rank_file`` is a path that every executor can read.  One pass, no shuffle.
    """
    kind = dict(docs.dtypes)[id_column]
    schema = f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_file, pattern)
        for batch in slices(batches, text_column):
            rows = []
            for text in coder.encode([t or "" for t in batch.column(text_column).to_pylist()]):
                ids = text.split(",") if text else []
                row = [len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()]
                rows.append(row + [list(map(int, ids))] * keep_ids)
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * keep_ids]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *(pa.array(list(x), k) for x, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(id_column, text_column).mapInArrow(run, schema)
