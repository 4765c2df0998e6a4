"""Media columns: telephony audio in 8-bit companded form, expanded, decoded and resampled.

``store_audio`` keeps each payload byte as one G.711 code in a WAV container, so storage is
lossless.  ``expand`` turns codes into linear samples by a lookup table, ``decode_adpcm`` decodes
all blocks of a payload side by side (one numpy step per sample place, over every block), and
``resample_2x`` doubles the rate with a half-band filter; the result is stored as 16-bit PCM in a second container and read
back.  The companding tables come from their rules.

Defined results: null text is empty; an empty payload is padded to one block of 192 spaces; equal
texts give equal rows; repeated rows are repeated; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_of, slices

BLOCK = 192  # bytes of an ADPCM block, and what payloads are padded to a multiple of
RATE = 8000  # samples a second of the stored form
PCM, ALAW, MULAW = 1, 6, 7  # fixed values: WAVE format tags

# Index changes of the IMA ADPCM format, by the low three bits of a code.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# The 89 step sizes of the IMA ADPCM format.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """16-bit samples by mu-law code: sign, 3 bits of exponent and 4 of mantissa, all inverted."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples by A-law code: even bits inverted, exponent 0 is linear."""
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def store_audio(payload: bytes, law: int = MULAW, rate: int = RATE) -> bytes:
    """A WAV file with one channel of 8-bit codes, or of 16-bit samples (PCM)."""
    width = 2 if law == PCM else 1
    form = struct.pack("<HHIIHHH", law, 1, rate, rate * width, width, 8 * width, 0)
    fact = struct.pack("<I", len(payload) // width)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<I", 4) + fact
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_audio(stored: bytes) -> tuple[int, bytes]:
    """Format tag and codes of a WAV file, found by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, law, codes = 12, 0, b""
    while at + 8 <= len(stored):
        size = struct.unpack_from("<I", stored, at + 4)[0]
        if stored[at : at + 4] == b"fmt ":
            law = struct.unpack_from("<H", stored, at + 8)[0]
        elif stored[at : at + 4] == b"data":
            codes = stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return law, codes


def expand(codes: bytes, law: int = MULAW) -> np.ndarray:
    """Linear 16-bit samples of companded codes."""
    return TABLES[law][np.frombuffer(codes, np.uint8)]


def decode_adpcm(rows: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks, one row of bytes a block: a first sample and step index, then 4-bit codes, low half first.

    The loop runs over the places within a block; each step works on every block at once.
    """
    block = rows.shape[1]
    level = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2].astype(np.int32), 88)
    codes = np.empty((2 * (block - 4), len(rows)), np.uint8)
    codes[0::2] = (rows[:, 4:] & 15).T
    codes[1::2] = (rows[:, 4:] >> 4).T
    out = np.empty((1 + len(codes), len(rows)), np.int16)
    out[0] = level
    for i, code in enumerate(codes):
        size = code & 7
        step = STEPS[index]
        change = (step * (2 * size.astype(np.int32) + 1)) >> 3
        level = np.clip(np.where(code & 8, level - change, level + change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[size], 0, 88)
        out[i + 1] = level
    return out.T


def resample_2x(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, those between come from a symmetric six-tap half-band filter; edges repeat."""
    x = np.pad(samples.astype(np.int32), (2, 3), mode="edge")
    n = len(samples)
    between = (3 * (x[:n] + x[5 : n + 5]) - 25 * (x[1 : n + 1] + x[4 : n + 4]) + 150 * (x[2 : n + 2] + x[3 : n + 3]) + 128) >> 8
    out = np.empty(2 * n, np.int16)
    out[0::2] = samples
    out[1::2] = np.clip(between, -32768, 32767)
    return out


def adpcm_power(codes: np.ndarray, most: int = 8192) -> np.ndarray:
    """Sum of squared samples of each ADPCM block; so many blocks are decoded at once."""
    rows = codes.reshape(-1, BLOCK)
    parts = [decode_adpcm(rows[i : i + most]).astype(np.float32) for i in range(0, len(rows), most)]
    return np.concatenate([np.einsum("ij,ij->i", x, x) for x in parts])


def features(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """Of each payload: level, peak and sign changes of the expanded audio, level of its A-law and ADPCM readings, and its resampled form's checksum.

    All payloads (of whole blocks) are expanded and decoded together.
    """
    codes = np.frombuffer(b"".join(payloads), np.uint8)
    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
    start = np.cumsum(size) - size
    linear = TABLES[MULAW][codes]
    negative = linear < 0
    flips = np.concatenate([[False], negative[1:] != negative[:-1]])
    flips[start] = False
    changes = np.add.reduceat(flips.astype(np.int64), start)
    peak = np.maximum.reduceat(np.abs(linear.astype(np.int32)), start)
    power = [np.add.reduceat(np.square(TABLES[law][codes], dtype=np.float64), start) for law in (MULAW, ALAW)]
    adpcm = np.add.reduceat(adpcm_power(codes).astype(np.float64), start // BLOCK)
    out = []
    for i, (at, n) in enumerate(zip(start.tolist(), size.tolist())):
        wide = zlib.crc32(pcm[i])
        samples = n // BLOCK * (2 * (BLOCK - 4) + 1)
        out.append(f"n={n},peak={peak[i]},zc={changes[i]},mu={(power[0][i] / n) ** 0.5:.1f},a={(power[1][i] / n) ** 0.5:.1f},adpcm={(adpcm[i] / samples) ** 0.5:.1f},pcm16k_crc32={wide}")
    return out


def audio_column(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_media: bool = False, keep_pcm: bool = False) -> DataFrame:
    """Store each text's bytes as telephony audio, read the stored bytes back, and describe them.

    ``keep_media`` adds the stored WAV, ``keep_pcm`` the WAV of the expanded audio at 16 kHz (16-bit, little-endian); the
    size and digest of its samples, as read back, are always there.
    One pass, no shuffle.
    """
    kind = dict(docs.dtypes)[id_column]
    schema = f"{id_column} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    schema += ", media binary" * keep_media + ", pcm binary" * keep_pcm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, 1 << 20):
            texts = bytes_of(batch.column(text_column))
            media = [store_audio(t + b" " * (BLOCK - len(t) if len(t) < BLOCK else -len(t) % BLOCK)) for t in texts]
            read = [read_audio(x)[1] for x in media]
            wide = [store_audio(resample_2x(expand(codes)).astype("<i2").tobytes(), PCM, 2 * RATE) for codes in read]
            samples = [read_audio(x)[1] for x in wide]
            rows = []
            for text, stored, codes, feature, pcm, file in zip(texts, media, read, features(read, samples), samples, wide):
                row = [len(text), len(codes), hashlib.sha256(codes).hexdigest(), zlib.crc32(codes[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(pcm), hashlib.sha256(pcm).hexdigest()]
                rows.append(row + [stored] * keep_media + [file] * keep_pcm)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * (keep_media + keep_pcm)]
            columns = [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *columns], names=names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)
