"""Secret scans with corpus-wide ownership frequency.

``scan`` finds candidates in every whole text: the three fixed kinds (assign, access, hex) and
``token``, long mixed strings that no pattern names.  ``ownership`` counts, for each candidate's
hash, how many repositories and owners hold it anywhere in the corpus.  A value that several
owners copy is an example; one that a single owner holds looks live.  Base spans always stay; a
``token`` span is added only where it looks live.

Defined results: null text is empty; a null owner or repository is one of its own; repeated rows
with one id get one row each; other columns are dropped or, by ``redact``, kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_hot, quoted, slices, stash

# The base kinds, in order, with the least length that counts.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a maximal run, so the least length may stand in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "token")
HINTS = ("passw", "secret", "token", "api")
#: Holds for every text with a candidate, so that Spark can leave the others where they are.
SUSPECT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20}"""

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
TOKEN_BITS = 3.5  # least entropy per character of an unnamed token
SPAN = "array<struct<start:int,end:int,kind:int,h:long>>"


def entropy(value: str) -> float:
    p = np.unique(np.frombuffer(value.encode(), np.uint8), return_counts=True)[1] / len(value)
    return float(-(p * np.log2(p)).sum())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """Spans (start, end, kind, value) of a text; the value of an assignment is what is assigned."""
    low = text.lower()
    found = [(m.start(), m.end(), 0, m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6] if any(x in low for x in HINTS) else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    base = list(found)
    for m in TOKEN.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= TOKEN_BITS and not any(a < m.end() and m.start() < b for a, b, *_ in base):
            found.append((m.start(), m.end(), 3, value))
    return found


def digest(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in sorted(found, key=lambda x: (x[0], x[2])))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row per document: counts, digest of the base spans, and ``found``, every candidate with its value's hash."""
    kind = dict(docs.dtypes)[id_column]
    schema = f"{id_column} {kind}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found {SPAN}"
    inner = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("h", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column("_text").to_pylist():
                found = candidates(text or "")
                for i in range(3):
                    counts[i].append(sum(x[2] == i for x in found))
                digests.append(hashlib.sha256(digest([x for x in found if x[2] < 3]).encode()).hexdigest())
                spans.append([{"start": a, "end": b, "kind": k, "h": int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "little", signed=True)} for a, b, k, v in found])
            yield pa.RecordBatch.from_arrays([batch.column(id_column), batch.column("_owner").cast(pa.string()), batch.column("_repository").cast(pa.string()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, inner)], names=[id_column, "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    text = docs.select(F.col(id_column), F.col(text_column).alias("_text"), (F.lit("") if owner is None else owner).cast("string").alias("_owner"), (F.lit("") if repository is None else repository).cast("string").alias("_repository"))
    return text.mapInArrow(run, schema)


def ownership(scanned: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each candidate hash.

    Both distincts are partly made before each shuffle, so a value in a third of all rows costs one
    row per task and owner.
    """
    held = scanned.select("owner", "repository", F.explode("found.h").alias("h")).distinct()
    return held.groupBy("h", "owner").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: Column | None = None, repository: Column | None = None, most_owners: int = 1) -> DataFrame:
    """All spans per document with the corpus-wide verdict.

    Columns: id, n_assign, n_access, n_hex, base_sha256, spans (text), n_live, n_examples, and
    ``detail``, an array of (start, end, kind, live).
    """
    scanned = stash(scan(docs, id_column, text_column, owner, repository).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    verdict = ownership(scanned).select("h", (F.col("n_owners") <= most_owners).alias("live"))
    each = join_hot(scanned.select("_row", F.explode("found").alias("x")).select("_row", "x.*"), verdict, "h")
    each = each.where("kind < 3 or live")
    each = each.withColumn("d", F.struct("start", "kind", "end", "live"))
    per_doc = each.groupBy("_row").agg(F.sort_array(F.collect_list("d")).alias("detail"))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("detail", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    live = F.coalesce(F.size(F.filter("detail", lambda x: x["live"])).cast("long"), F.lit(0))
    every = F.coalesce(F.size("detail").cast("long"), F.lit(0))
    joined = scanned.drop("found", "owner", "repository").join(per_doc, "_row", "left")
    return joined.select(id_column, "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, F.lit("")).alias("spans"), live.alias("n_live"), (every - live).alias("n_examples"), F.coalesce("detail", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")).alias("detail"))


def redact(docs: DataFrame, text_column: str = "text", owner: Column | None = None, repository: Column | None = None, most_owners: int = 1, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every live-looking span replaced by ``mask``; copied examples and other text stay.

    A native pattern sets suspicious texts apart in place; only those are scanned, shuffled and joined
    with the hashes of their examples.
    """
    names = docs.columns
    key, known = fresh(names, "key", "examples")
    suspect = F.coalesce(F.col(text_column).rlike(SUSPECT), F.lit(False))
    keyed = docs.where(suspect).withColumn(key, F.xxhash64(F.col(text_column)))
    scanned = stash(scan(keyed, key, text_column, owner, repository), "secrets")
    copied = ownership(scanned).where(F.col("n_owners") > most_owners).select("h", F.lit(True).alias("copied"))
    examples = join_hot(scanned.select(key, F.explode("found.h").alias("h")), copied, "h").where("copied")
    examples = examples.groupBy(key).agg(F.collect_set("h").alias(known))
    out_kind = dict(docs.dtypes)[text_column]

    @F.pandas_udf("string")
    def mask_spans(text, examples):
        out = []
        for t, skip in zip(text, examples):
            skip = set() if skip is None else {int(x) for x in skip}
            at, parts = 0, []
            for a, b, _, v in sorted(candidates(t)):
                if a >= at and int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "little", signed=True) not in skip:
                    parts += [t[at:a], mask]
                    at = b
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    masked = keyed.join(examples, key, "left").withColumn(text_column, mask_spans(F.col(text_column), F.col(known)).cast(out_kind))
    return docs.where(~suspect).unionByName(masked.select(*quoted(names)))
