"""Awkward rows: clashing names, long texts, hot keys, dense sizes, many small inputs; and the pipeline's stages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from wrenlake.llm import bpe, common, jaccard, packing, quality, repeats, secrets, telephony, toxicity, warc  # noqa: E402

RNG = random.Random(9)
VOCAB = ["".join(RNG.choice("abcdefghé") for _ in range(RNG.randrange(2, 9))) for _ in range(300)]
CLASH = ["id", "cls", "text_", "key", "examples", "row", "left", "spans", "hashes", "_id", "_cls", "_spans", "_key", "_examples", "rep", "component_id", "y", "h", "a.b", "c d", "c0", "t`k"]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    base = prose(80)
    texts = [base, base, prose(60) + " " + base[:120], None, "", "password=abcdef123 " + prose(20), "x" * 10, prose(70)]
    rows = [(i, t, "en", "s0", None if t is None else len(t), *["c"] * len(CLASH)) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASH)
    return spark.createDataFrame([*rows, rows[0]], names).repartition(3)


def test_stages_keep_columns(spark, clashing):
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    for out in (repeats.without_repeats(clashing), secrets.redact(clashing, owner=F.col("source")), jaccard.one_of_each(clashing), quality.keep_quality(clashing, labels)):
        assert out.columns == clashing.columns
        rows = out.collect()
        assert rows and all(r[c] == "c" for r in rows for c in CLASH)
    masked = {r.doc_id: r.text for r in secrets.redact(clashing, owner=F.col("source")).collect()}
    assert masked[5].startswith("[SECRET] ") and masked[3] is None and masked[4] == ""
    left = {r.doc_id: r for r in repeats.without_repeats(clashing).collect()}
    assert left[1].text == "" and left[1].n_chars == 0 and left[0].n_chars == len(left[0].text)


def test_scores_ignore_other_columns(clashing, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(clashing, labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert len({(r.score, r.spans) for r in got if r.doc_id == 0}) == 1


def test_words_by_block():
    texts = [b"", b" ", b"A b", b"b a", b"x " * 700_000, b"y" * 1_500_000 + b" z", prose(500).encode()]
    for lower in (False, True):
        h, at = common.word_hashes(texts, lower)
        words = [w for t in texts for w in (t.lower() if lower else t).split()]
        assert len(h) == len(words) and len(set(words)) == len(set(h.tolist())) == len(set(zip(words, h.tolist())))
        assert np.diff(at).tolist() == [len(t.split()) for t in texts]


def test_join_hot(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(i, "a" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "i int, k string")
    table = spark.createDataFrame([("a", 1), ("k3", 2), ("z", 3)], "k string, v int")
    got = {r.i: r.v for r in common.join_hot(rows, table, "k").collect()}
    assert got == {i: 1 if i % 3 else 2 if i == 3 else None for i in range(60)} | {99: None}


def test_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 3)
    passage = prose(30)
    rows = [(i, prose(4) + passage[i % 7 :] + prose(6)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    seen: dict = {}
    for i, t in rows:
        for j in range(len(t.encode()) - 49):
            seen.setdefault(t.encode()[j : j + 50], i)
    for r in repeats.repeat_report(df).collect():
        data = rows[r.doc_id][1].encode()
        gone = np.zeros(len(data), bool)
        for j in range(len(data) - 49):
            if seen[data[j : j + 50]] < r.doc_id:
                gone[j : j + 50] = True
        assert r.n_removed == gone.sum()


def test_dense_sizes(spark):
    words = prose(200).split()
    rows = [(i, " ".join(words[: 10 + i])) for i in range(150)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90).collect()}
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            a, b = len({tuple(words[q : q + 3]) for q in range(8 + i)}), len({tuple(words[q : q + 3]) for q in range(8 + j)})
            if 100 * b >= 90 * a:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert [got[i] for i in range(150)] == root


def test_positions_skip():
    # one list, one window: the third entry's position only allows smaller sets than there are
    one = np.array([5, 5, 5])
    n, high, low = np.array([100, 101, 102]), np.array([111, 112, 95]), np.array([90, 91, 92])
    leader, *_ = jaccard.group_lists(one, one, n, low, high, np.arange(3))
    assert leader.tolist() == [-1, 0, -1]


def test_crossover_saves_bins():
    rng = np.random.default_rng(4)
    half = rng.integers(300, 1700, 300).tolist()
    sizes = half + [packing.LENGTH - x for x in half]  # fills 300 bins exactly
    start = len(packing.first_fit(sizes, rng.permutation(600).tolist()))
    best = packing.evolve(sizes, 0, 0, 1, [])
    best = packing.evolve(sizes, 0, 1, 1, [best, packing.evolve(sizes, 1, 0, 1, [])])
    assert 300 <= len(best) < start and sorted(i for b in best for i in b) == list(range(600))
    assert all(packing.filled(sizes, b) <= packing.LENGTH for b in best)


def test_many_small_inputs(spark):
    rows = [(i, prose(RNG.randrange(5, 400))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = packing.pack_documents(df, P.path("word_bpe_49k.json")).collect()
    bound = -(-sum(r.length for r in got) // packing.LENGTH)
    assert len({r.sequence_id for r in got}) <= bound + 2


def test_other_tokenizers_get_whole_texts():
    assert not packing.splits_words({"model": {"end_of_word_suffix": None}, "normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}})


def test_long_piece():
    book = bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    flat, _ = bpe.replay([b"ab" * 50_000], book)
    assert b"".join(book.tokens[i] for i in flat.tolist()) == b"ab" * 50_000


def test_calibration_pools_first():
    value = quality.calibrated(np.array([1.0, 300, 1, 300]), np.array([0.0, 0, 1, 300]), 0.85)
    assert (np.diff(value) >= 0).all() and value[0] < 0.01 and value[-1] > 0.99


def test_ridge_against_a_plain_solve(spark):
    rows = [(i, prose(20 + i % 30) + "#" * (i % 3), int(i % 3 > 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    stats = quality.statistics(df)
    model = quality.fit(stats, df)
    used = [r for r in stats.join(df, "doc_id").withColumn("out", common.is_held_out(F.col("doc_id"))).collect() if not r.out]
    z, y = model.features(np.array([r.x for r in used])), np.array([r.quality for r in used])
    want = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ want, z @ model.weights, atol=1e-4)


def test_adpcm_and_resampler():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (3, telephony.BLOCK), dtype=np.uint8)
    got = telephony.decode_adpcm(rows)
    for row, samples in zip(rows.tolist(), got.tolist()):
        level = int.from_bytes(bytes(row[:2]), "little", signed=True)
        index, want = min(row[2], 88), [level]
        for code in (c for b in row[4:] for c in (b & 15, b >> 4)):
            step = int(telephony.STEPS[index])
            change = step * (2 * (code & 7) + 1) >> 3
            level = max(-32768, min(32767, level - change if code & 8 else level + change))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[code & 7])))
            want.append(level)
        assert samples == want
    x = rng.integers(-30000, 30000, 50).astype(np.int16)
    wide = telephony.resample_2x(x)
    p = [int(v) for v in (x[0], x[0], *x, x[-1], x[-1], x[-1])]
    between = [(3 * (p[i] + p[i + 5]) - 25 * (p[i + 1] + p[i + 4]) + 150 * (p[i + 2] + p[i + 3]) + 128) >> 8 for i in range(50)]
    assert wide[0::2].tolist() == x.tolist() and wide[1::2].tolist() == [max(-32768, min(32767, v)) for v in between]
    assert telephony.read_audio(telephony.store_audio(wide.tobytes(), telephony.PCM, 16_000)) == (telephony.PCM, wide.tobytes())


def test_pages_with_clashing_columns(spark):
    rows = [(i, f"u{i}", "<p>same</p>" if i % 3 else f"<p>{i}</p>", "c", "c") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect()}
    assert got == {i: ("revisit", 29) if i % 3 and i < 29 else ("response", None) for i in range(30)}


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stash(stage(spark, docs, folder), "test-stage")
        assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and (len(now) == len(ids) or name in ("quality classifier", "n-gram Jaccard join"))
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs, ids = out, now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == ids
    assert sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.piece, r.length) for r in packed)


def test_spans_of_documents():
    out = repeats.spans_batch(np.array([2, 1, 2, 1, 2]), np.array([7, 5, 7, 6, 7]), np.array([100, 3, 0, 0, 40]), np.array([150, 60, 76, 50, 100]))
    assert out.to_pylist() == [{"id": 1, "cls": 5, "spans": [3, 60]}, {"id": 1, "cls": 6, "spans": [0, 50]}, {"id": 2, "cls": 7, "spans": [0, 150]}]
    none = np.empty(0, np.int64)
    assert repeats.spans_batch(none, none, none, none).num_rows == 0


def test_buckets_over_batches(monkeypatch):
    """Buckets and single strings that go on in the next batch, against brute force."""
    monkeypatch.setattr(repeats, "CHUNK", 4)
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(97, 100, 76, np.uint8))
    texts = [bytes(rng.integers(97, 123, 26, np.uint8))[i % 5 :] + shared[i % 3 : 76 - i % 4] + b"%d" % (i % 2) for i in range(40)]
    gram = shared[26:50]
    rows = []
    for i, t in enumerate(texts):
        p = t.index(gram)
        a, b = max(0, p - 26), min(len(t), p + 50)
        rows.append((gram, t[a:b], p - a, i, i, [p], None))
        rows += [(t[s : s + 50], None, 0, 100 + i, i, [s], None) for s in range(len(t) - 49)]
    rows.sort(key=lambda r: (r[0], r[3]))
    names = [x.split()[0] for x in repeats.SUFFIX.split(", ")]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[i : i + 7]), repeats.SUFFIX_TYPES)], names=names) for i in range(0, len(rows), 7)]
    got: dict = {}
    for out in repeats.removed_spans(iter(batches)):
        for r in out.to_pylist():
            got.setdefault(r["id"], set()).update(x for a, b in zip(r["spans"][::2], r["spans"][1::2]) for x in range(a, b))
    for i, t in enumerate(texts):
        p = t.index(gram)
        before = {u[s : s + 50] for u in texts[:i] for s in range(len(u) - 49)}
        starts = [s for s in range(len(t) - 49) if t[s : s + 50] in before]
        assert got.get(100 + i, set()) == {x for s in starts for x in range(s, s + 50)}
        assert got.get(i, set()) == {x for s in starts if p - 26 <= s <= p for x in range(s, s + 50)}
