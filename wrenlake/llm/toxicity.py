"""Toxicity: a linear-chain conditional random field over words, summed up per document.

Labels are given per document, so the tags of tokens are latent: a toxic document has at least one toxic token, a clean one
none.  The field has two states, weights for a word, its first letters, its shape and the words on either side (all by
hash, so that their number is fixed), and transitions.  It is fitted on a bounded sample by gradients summed per
partition: tags expected given the label, less tags expected without it.  A word is pushed only by documents that
nothing else explains, so words that merely stand beside toxic ones aren't learnt.

``score_texts`` runs forward-backward over every whole text: marginals give the spans and, through a logistic fit on
sampled documents that the field didn't learn from, the document's score.

Defined results: null text is empty and has the score of a text without words; repeated rows are repeated; labels other
than 0 and 1 and labels of a null id are left out; of several labels of an id the highest counts; without toxic labels every score is 0; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK, LOWER, SPACE, bytes_of, hash_stretches, is_held_out, running_sums, slices, starts, stash, word_blocks

#: The bound on labelled documents per class that the model is fitted on; above it, those with the least hash.
MOST_LABELLED = 4_000
FOLDS = 5  # of the sample, one calibrates the score
WORD_BITS, STEM_BITS, SHAPES = 16, 14, 8
STEMS = (5, 8)  # bytes at a word's beginning
STEPS = 24
RIDGE, MOVE_RIDGE = 0.3, 50.0  # against the sum over all documents: what one document alone can teach stays small
NOISE = 0.05  # share of documents that may be labelled wrongly
BIAS, START, MOST_START = -8.0, 1.5, 8.0  # the field starts from this bias, and from so much of the features' log odds
LEAST = 1e-4  # of -log P(no token is toxic) that tells texts apart
CUT = 0.5
SLICE = 1 << 20  # bytes of text that are tagged together
SIDE = 256  # tokens that are scanned one after another
MARKS = np.zeros(256, bool)
MARKS[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


@dataclass
class Tokens:
    """Features of the words of texts end to end; ``bounds`` tells where each text begins (one more entry than texts)."""

    word: np.ndarray
    stem: np.ndarray
    root: np.ndarray
    shape: np.ndarray
    bounds: np.ndarray

    @property
    def first(self) -> np.ndarray:
        out = np.zeros(len(self.word), bool)
        out[self.bounds[:-1][self.bounds[:-1] < len(out)]] = True
        return out

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def tokens(texts: list[bytes]) -> Tokens:
    """Words without marks around them, A-Z as a-z; a word of marks only, or of over a block, has the word number 0."""
    found: list[tuple] = []
    owner = []
    for b in word_blocks(texts):
        owner.append(b.owner)
        if len(b.data) >= BLOCK:
            found.append((np.zeros(1, np.int64),) * 4)
            continue
        inside = ~(MARKS[b.data] | SPACE[b.data])
        n = len(b.data)
        place = np.arange(n)
        after = np.minimum.accumulate(np.where(inside, place, n)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(inside, place, -1))
        start, end = after[b.start], before[b.end - 1] + 1
        some = start < b.end
        start, end = np.where(some, start, b.start), np.where(some, end, b.start)
        total = running_sums(b.data, LOWER)
        word = (hash_stretches(total, start, end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        stems = [(hash_stretches(total, start, np.minimum(start + k, end)) >> np.uint64(64 - STEM_BITS)).astype(np.int64) for k in STEMS]
        capital = UPPER[b.data]
        shape = capital[b.start] + 2 * capital[b.end - 1] + 4 * (b.data[b.end - 1] == ord("!"))
        found.append((np.where(some, word, 0), *(np.where(some, x, 0) for x in stems), shape))
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*found)] or [np.empty(0, np.int64)] * 4
    return Tokens(*columns, starts(owner, len(texts)))


def scan(e: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward and backward shares of state 1 at each token, the logs of the forward scales, and the four factors into each token.

    ``e``: weight of state 1 against 0; ``move``: weights between states.  The chain is cut into stretches of ``SIDE``
    tokens that are scanned side by side: 2x2 products first, then the states at the cuts, then the messages.
    A text's first token resets the chain.
    """
    n = len(e)
    wide = -(-n // SIDE)
    size = wide * SIDE

    def laid(x: np.ndarray, pad: float) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate([x, np.full(size - n, pad)]).reshape(wide, SIDE).T)

    odds = np.exp(np.clip(e, -30, 30))
    m = np.exp(move)
    t00, t10 = laid(np.where(first, 1, m[0, 0]), 1), laid(np.where(first, 1, m[1, 0]), 0)
    t01, t11 = laid(np.where(first, 1, m[0, 1]) * odds, 0), laid(np.where(first, 1, m[1, 1]) * odds, 1)
    one, none = np.ones(wide), np.zeros(wide)
    a, b, c, d = one, none, none, one
    for k in range(SIDE):
        a, b, c, d = a * t00[k] + b * t10[k], a * t01[k] + b * t11[k], c * t00[k] + d * t10[k], c * t01[k] + d * t11[k]
        s = a + b + c + d
        a, b, c, d = a / s, b / s, c / s, d / s
    begin, end = np.empty(wide), np.empty(wide)
    x = 0.5
    products = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()))
    for k, (p, q, r, u) in enumerate(products):
        begin[k] = x
        low, high = (1 - x) * p + x * r, (1 - x) * q + x * u
        x = high / (low + high)
    x = 0.5
    for k in range(wide - 1, -1, -1):
        end[k] = x
        p, q, r, u = products[k]
        low, high = (1 - x) * p + x * q, (1 - x) * r + x * u
        x = high / (low + high)
    ahead, behind, scale = (np.empty((SIDE, wide)) for _ in range(3))
    x = begin
    for k in range(SIDE):
        low, high = (1 - x) * t00[k] + x * t10[k], (1 - x) * t01[k] + x * t11[k]
        scale[k] = low + high
        ahead[k] = x = high / scale[k]
    x = end
    for k in range(SIDE - 1, -1, -1):
        behind[k] = x
        low, high = (1 - x) * t00[k] + x * t01[k], (1 - x) * t10[k] + x * t11[k]
        x = high / (low + high)
    return tuple(x.T.ravel()[:n] for x in (ahead, behind, np.log(scale), t00, t01, t10, t11))


@dataclass
class Field:
    """Weights of state 1 against state 0: by word, first letters, shape and neighbouring words; and between states."""

    word: np.ndarray
    stem: np.ndarray
    root: np.ndarray
    shape: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: np.ndarray
    move: np.ndarray
    fit: np.ndarray = field(default_factory=lambda: np.zeros(4))

    NAMES = ("word", "stem", "root", "shape", "before", "after", "bias", "move")

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def set(self, v: np.ndarray) -> None:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, v[at : at + old.size].reshape(old.shape))
            at += old.size

    def emissions(self, x: Tokens) -> np.ndarray:
        e = self.word[x.word] + self.stem[x.stem] + self.root[x.root] + self.shape[x.shape] + self.bias[0]
        inner = ~x.first[1:]
        e[1:] += np.where(inner, self.before[x.word[:-1]], 0)
        e[:-1] += np.where(inner, self.after[x.word[1:]], 0)
        return e

    def marginals(self, x: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(toxic) of each token, P of each pair of states at it and the token before (00, 01, 10, 11), and the log of P(no token is toxic) of each text."""
        first = x.first
        if not len(first):
            return np.empty(0), np.empty((4, 0)), np.zeros(len(x.bounds) - 1)
        ahead, behind, scale, *factors = scan(self.emissions(x), first, self.move)
        low, high = (1 - ahead) * (1 - behind), ahead * behind
        p = high / (low + high)
        old = np.concatenate([[0.5], ahead[:-1]])
        both = np.array([(1 - old) * factors[0] * (1 - behind), (1 - old) * factors[1] * behind, old * factors[2] * (1 - behind), old * factors[3] * behind])
        both /= both.sum(0)
        both[:, first] = 0
        clean = np.where(first, 0, self.move[0, 0]) - scale
        return p, both, np.minimum(np.bincount(x.owner, clean, len(x.bounds) - 1), 0)

    def gradient(self, x: Tokens, y: np.ndarray) -> np.ndarray:
        """Of the log likelihood of the documents' labels, by ``vector``, and the log likelihood itself.

        With P0 = P(no token is toxic), a document is labelled toxic with probability 1 - (1 - NOISE) P0 and clean with
        probability NOISE + (1 - NOISE) P0: a wrong label teaches little.
        """
        p, both, log0 = self.marginals(x)
        p0 = (1 - NOISE) * np.exp(log0)
        r = np.where(y == 1, p0 / (1 - p0), -p0 / (p0 + NOISE))
        mine = r[x.owner]
        first = x.first
        inner = ~first[1:]
        d = mine * p
        pairs = np.where(first, 0, mine) * np.array([both[0] - 1, *both[1:]])
        parts = [np.bincount(x.word, d, len(self.word)), np.bincount(x.stem, d, len(self.stem)), np.bincount(x.root, d, len(self.root)), np.bincount(x.shape, d, len(self.shape))]
        parts += [np.bincount(x.word[:-1][inner], d[1:][inner], len(self.before)), np.bincount(x.word[1:][inner], d[:-1][inner], len(self.after))]
        return np.concatenate([*parts, [d.sum()], pairs.sum(1), [np.log(np.where(y == 1, 1 - p0, p0 + NOISE)).sum()]])


def summary(p: np.ndarray, bounds: np.ndarray, log0: np.ndarray) -> np.ndarray:
    """Per text: the highest marginal, the log of the sum of those over 0.1, the log of -log P(no token is toxic), and a constant."""
    k = len(bounds) - 1
    owner = np.repeat(np.arange(k), np.diff(bounds))
    top = np.zeros(k)
    np.maximum.at(top, owner[p > 0.01], p[p > 0.01])
    mass = np.bincount(owner, np.where(p > 0.1, p, 0), k) if len(p) else np.zeros(k)
    return np.column_stack([top, np.log1p(mass), np.log(np.clip(-log0, LEAST, 10)), np.ones(k)])


def labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label: str, most: int) -> DataFrame:
    """A bounded sample of labelled documents of each class; the list of their ids is broadcast, texts stay in place."""
    truth = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).where(~is_held_out(F.col(id_column)))
    truth = truth.groupBy(id_column).agg(F.max(label).alias("y"))
    order = F.xxhash64(id_column)
    picked = truth.where("y = 1").orderBy(order, id_column).limit(most).unionByName(truth.where("y = 0").orderBy(order, id_column).limit(most))
    picked = picked.select(F.col(id_column).alias("key"), "y")
    return docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")).join(F.broadcast(picked), "key")


SAMPLE = "y int, fold int, word binary, stem binary, root binary, shape binary"


def featured(sample: DataFrame) -> DataFrame:
    """The sample's documents as features; of documents with equal texts and labels only the one with the least id stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            x = tokens(bytes_of(batch.column("text")))
            packed = [pa.array([v[a:b].astype(kind).tobytes() for a, b in zip(x.bounds, x.bounds[1:])], pa.binary()) for v, kind in ((x.word, "<i4"), (x.stem, "<i4"), (x.root, "<i4"), (x.shape, "u1"))]
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), batch.column("fold").cast(pa.int32()), *packed], names=[c.split()[0] for c in SAMPLE.split(", ")])

    fold = F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int")
    text = F.coalesce("text", F.lit(""))
    first = Window.partitionBy("y", F.sha2(text, 256)).orderBy("key")
    one = sample.withColumn("fold", fold).withColumn("place", F.row_number().over(first)).where("place = 1")
    return one.select("y", "fold", "text").mapInArrow(run, SAMPLE)


def unpacked(batch: pa.RecordBatch) -> tuple[Tokens, np.ndarray]:
    columns = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).astype(np.int64) for c, kind in (("word", "<i4"), ("stem", "<i4"), ("root", "<i4"), ("shape", "u1")))
    sizes = [len(x) // 4 for x in batch.column("word").to_pylist()]
    return Tokens(*columns, np.cumsum([0, *sizes])), batch.column("y").to_numpy(zero_copy_only=False)


def sample_sums(sample: DataFrame, size: int, add) -> np.ndarray:
    """The sum over the sample of ``add(tokens, y)``: one partial sum per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in slices(batches, "word", 2 * SLICE):
            total += add(*unpacked(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    return sum((np.frombuffer(r.g) for r in sample.mapInArrow(run, "g binary").collect()), np.zeros(size))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", most: int = MOST_LABELLED) -> Field | None:
    """The field and its logistic document score; None without toxic labels."""
    sample = stash(featured(labelled(docs, labels, id_column, text_column, label, most)).repartition(6), "toxic-train")
    share = {r.y: r.n for r in labels.where(F.col(id_column).isNotNull()).where(~is_held_out(F.col(id_column))).groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    learnt = sample.where(f"fold < {FOLDS - 1}")
    if not share.get(1) or not learnt.where("y = 1").take(1):
        return None
    wide = np.cumsum([0, 1 << WORD_BITS, 1 << STEM_BITS, 1 << STEM_BITS])
    k = int(wide[-1])

    def held(x: Tokens, y: np.ndarray) -> np.ndarray:
        """Documents of each class that hold each word, stem and root, and documents of each class."""
        pair = np.unique(np.concatenate([x.owner * k + at + v for at, v in zip(wide, (x.word, x.stem, x.root))]))
        toxic = y[pair // k] == 1
        return np.concatenate([np.bincount(pair[toxic] % k, minlength=k), np.bincount(pair[~toxic] % k, minlength=k), [(y == 1).sum(), (y == 0).sum()]])

    sums = sample_sums(learnt, 2 * k + 2, held)
    bad, good = sums[:k], sums[k : 2 * k]
    # log odds, less twice their standard error: what is seen in few documents starts low
    odds = np.log((bad + 0.5) / (sums[-2] + 1)) - np.log((good + 0.5) / (sums[-1] + 1)) - 2 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    begin = np.split(np.clip(START * odds, 0, MOST_START), wide[1:-1])
    zero = np.zeros(1 << WORD_BITS)
    model = Field(*begin, np.zeros(SHAPES), zero, zero.copy(), np.array([BIAS]), np.zeros((2, 2)))
    size = len(model.vector())
    ridge = np.concatenate([np.full(size - 5, RIDGE), [0], np.full(4, MOVE_RIDGE)])
    step, last, begin = np.full(size, 0.2), np.zeros(size), model.vector()
    for _ in range(STEPS):  # each weight has a step of its own, longer while its slope keeps its sign
        v = model.vector()
        g = sample_sums(learnt, size + 1, model.gradient)[:-1] - ridge * (v - begin)
        same = np.sign(g) * np.sign(last)
        step = np.clip(np.where(same > 0, step * 1.3, np.where(same < 0, step * 0.5, step)), 1e-4, 2)
        last = np.where(same < 0, 0, g)
        model.set(v + step * np.sign(last))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word", 2 * SLICE):
            x, y = unpacked(batch)
            p, _, log0 = model.marginals(x)
            s = summary(p, x.bounds, log0)
            yield pa.RecordBatch.from_arrays([*map(pa.array, s.T[:3]), pa.array(y, pa.int32())], names=["a", "b", "c", "y"])

    rows = sample.where(f"fold = {FOLDS - 1}").mapInArrow(summaries, "a double, b double, c double, y int").collect()  # bounded by 2 * most
    x = np.array([[r.a, r.b, r.c, 1.0] for r in rows] + [[0, 0, np.log(LEAST), 1], [1, np.log(2), np.log(10), 1]])  # and what holds by definition
    y = np.array([r.y for r in rows] + [0, 1], float)
    part = {1: y.sum(), 0: (1 - y).sum()}
    weight = np.where(y == 1, share[1] / part[1], share.get(0, 1) / part[0])
    weight *= len(y) / weight.sum()
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.01 * w
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(4), slope)
    model.fit = w
    return model


def word_spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Character offsets of the words whose marginal is over one half; ``p`` has one entry a word."""
    place = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # characters before each byte
    begin, long = (np.concatenate(x) for x in zip(*((b.place, b.end - b.start) for b in word_blocks([text]))))
    return [{"start": int(place[begin[i]]), "end": int(place[begin[i] + long[i]]), "p": float(p[i])} for i in np.flatnonzero(p > 0.5)]


def score_texts(docs: DataFrame, model: Field | None, id_column: str = "doc_id", text_column: str = "text", keep_spans: bool = True) -> DataFrame:
    """Score of every whole text, number of toxic words, and (``keep_spans``) the character offsets of those: words with a marginal over one half.

    One pass, no shuffle.
    """
    schema = f"{id_column} {dict(docs.dtypes)[id_column]}, score double, n_toxic long, spans array<struct<start:int,end:int,p:double>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, SLICE):
            texts = bytes_of(batch.column(text_column))
            if model is None:
                p, bounds, scores = np.empty(0), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts))
            else:
                x = tokens(texts)
                bounds = x.bounds
                p, _, log0 = model.marginals(x)
                scores = 1 / (1 + np.exp(-np.clip(summary(p, bounds, log0) @ model.fit, -30, 30)))
            n = np.diff(np.concatenate([[0], np.cumsum(p > 0.5)])[bounds])
            spans = [word_spans(t, p[a:b]) if k else [] for t, a, b, k in zip(texts, bounds, bounds[1:], n)]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(scores, pa.float64()), pa.array(n, pa.int64()), pa.array(spans, span)], names=[id_column, "score", "n_toxic", "spans"])

    out = docs.select(id_column, text_column).mapInArrow(run, schema)
    return out if keep_spans else out.drop("spans")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: float = CUT) -> DataFrame:
    """Held-out flag, score, prediction, and number and places (``start:end``, comma-joined) of toxic words of every document."""
    scored = score_texts(docs, fit(docs, labels, id_column, text_column), id_column, text_column)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scored.select(id_column, is_held_out(F.col(id_column)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_toxic", spans.alias("spans"))
