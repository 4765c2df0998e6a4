"""WARC archives, index first: write records and their index, then read selected records by coalesced ranges.

``write_archives`` writes one gzip member per record into files of bounded size in a folder that all
executors share, and returns the index: file, offset, length, URL, digest.  ``read_records`` takes
any rows of the index, sorts them by place, reads neighbouring ones with one range read, and parses
them.  Pages with equal payloads are stored once: the one with the largest id is the response, the
others are revisits that refer to it.

Defined results: null html is an empty payload; a null url is empty; rows that repeat one id and
payload are all of the same type; null ids come before all others; other columns are dropped.
A lost task writes its file again under a new name; the index only names files of finished tasks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, new_dir, slices, stash

FILE_BYTES = 64 << 20  # a file is closed beyond this
RANGE_BYTES = 8 << 20  # the most that one range read spans, unless one record is longer
TASK_BYTES = 2 << 20  # of records that a task reads, about
GAP_BYTES = 64 << 10  # unselected bytes that are read along rather than cut a range
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long"
# What the archive format prescribes.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(x: str | None) -> str:
    return " ".join((x or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit that keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": one_line(url),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items())]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record header, HTTP header and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.decode().split(": ", 1) if b": " in x else (x.decode().rstrip(":"), "") for x in head.split(b"\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.decode().split(": ", 1) for x in http.split(b"\r\n")[1:]), payload


def page_number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "None" else int(text)


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """For each id that isn't the largest of its payload: the largest.

    The largest id per digest is partly found before the shuffle; digests, not pages, are joined.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    each = stash(pages.where(F.length(body) >= least_bytes).select("page_id", F.unhex(F.sha2(body, 256)).alias("digest")), "warc-digests")
    top = each.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = join_hot(each, top, "digest").where("refers_to is not null and (page_id is null or page_id < refers_to)")
    return found.select("page_id", "refers_to", "digest").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all pages into archives under ``folder`` and return the index, which is stored first."""
    revisits = plan_revisits(pages.select("page_id", "html"), least_bytes).withColumn("revisit", F.lit(True))
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha2(body, 256)).alias("digest"))
    same = rows["page_id"].eqNullSafe(revisits["page_id"]) & (rows["digest"] == revisits["digest"])
    rows = rows.join(revisits, same, "left").select(rows["page_id"], "url", "html", "refers_to", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out = name = None
        at = 0
        try:
            for batch in slices(batches, "html"):
                found = []
                for page_id, url, html, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit"))):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        store.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (html or "").encode()
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(record(page_id, url, payload, refers_to, bool(revisit))) + pack.flush()
                    out.write(member)
                    found.append((name, at, len(member), page_id, one_line(url), payload_digest(payload), "revisit" if revisit else "response", refers_to))
                    at += len(member)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*found), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return stash(rows.mapInArrow(run, INDEX), "warc-index")


def ranges(places: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Coalesced reads (first row, last row + 1, offset, length) of records sorted by offset."""
    out, first = [], 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i][0] - sum(places[i - 1]) > GAP_BYTES or sum(places[i]) - places[first][0] > RANGE_BYTES:
            out.append((first, i, places[first][0], sum(places[i - 1]) - places[first][0]))
            first = i
    return out


def read_records(index: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """The records that ``index`` selects, parsed from the archives; payloads are digested again and must agree.

    Rows are dealt by file and block of ``TASK_BYTES`` and sorted by offset, so each task reads forward in few ranges;
    the number of tasks goes by the records' bytes.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            start, found = 0, []
            for end in range(1, batch.num_rows + 1):
                if end < batch.num_rows and names[end] == names[start]:
                    continue
                with store.open_input_file(f"{root}/{names[start]}") as f:
                    places = list(zip(offsets[start:end], lengths[start:end]))
                    for a, b, offset, length in ranges(places):
                        data = f.read_at(length, offset)
                        for at, size in places[a:b]:
                            head, http, payload = parse(zlib.decompress(data[at - offset : at - offset + size], 31))
                            revisit = head["WARC-Type"] == "revisit"
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            if not revisit and (payload_digest(payload) != digest or len(payload) != int(http["Content-Length"])):
                                raise ValueError(f"{names[start]}, offset {at}: the payload is damaged")
                            found.append([page_number(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(http["Content-Length"]), digest, head["WARC-Type"], page_number(head["WARC-Refers-To"]) if revisit else None, *[payload] * keep_payload])
                start = end
            if found:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * keep_payload]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*found), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    total = index.agg(F.sum("length")).first()[0] or 0
    block = F.floor(F.col("offset") / TASK_BYTES)
    placed = index.select("file", "offset", "length").repartition(1 + int(total // TASK_BYTES), "file", block).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to new archives in the shared folder and read every record back."""
    folder = new_dir(pages.sparkSession, "warc")
    index = write_archives(pages, folder, least_bytes)
    return read_records(index, folder)
