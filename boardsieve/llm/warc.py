"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: every page is a record.  Records of equal payloads (by SHA-1) refer to the one with
the largest page_id, which is a response with the payload; the others are revisits with its
length and digest in their headers.  Tasks write archives of bounded size under names that no
other attempt uses and return a manifest; the stored manifest names the archives of exactly
one attempt of each task, so a lost executor or a repeated task leaves at most files that
nobody reads.

Reading: an archive's dictionary is loaded from its first frame, each following frame is one
record, and version line, header fields, lengths, end marks and payload digests are validated.
An archive that fails raises ``ValueError`` with its name and offset.

Defined cases: null html is an empty payload; a null url leaves out the target; a null page_id
counts as the smallest and is read back as null; rows that repeat a page_id and a payload are
all responses or all revisits; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import fresh_path, small_batches, stored, table, text_or_empty

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"

ARCHIVE_BYTES = 16 << 20
#: Bounds of the sample an archive's dictionary is trained on.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 128, 4096, 16 << 10
LEVEL = 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, is_response: bool, response_id: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    name = lambda x: f"<{ID_PREFIX}{'' if x is None else x}>"
    fields = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if not is_response:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(response_id))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n"
    return head + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on a bounded sample, or the first record's start where there is too little to train on."""
    sample = [r[:SAMPLE_BYTES] for r in records[:SAMPLE_RECORDS]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return sample[0]


def pack(records: list[bytes]) -> bytes:
    """An archive of the given records."""
    raw = _dictionary(records)
    engine = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
    held = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(held)), held, *[engine.compress(r) for r in records]])


def _frame_end(data: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, by its header and block sizes."""
    end = at + zstandard.frame_header_size(data[at:at + 18])
    checked = data[at + 4] & 4
    last = False
    while not last:
        if end + 3 > len(data):
            raise ValueError(f"frame at {at} is cut off")
        header = int.from_bytes(data[end:end + 3], "little")
        last, kind, size = bool(header & 1), header >> 1 & 3, header >> 3
        if kind == 3:
            raise ValueError(f"frame at {at} has a reserved block")
        end += 3 + (1 if kind == 1 else size)
    end += 4 if checked else 0
    if end > len(data):
        raise ValueError(f"frame at {at} is cut off")
    return end


def _fields(lines: list[bytes], at: int) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"record at {at} has a malformed header line")
        found[name.strip().decode("utf-8", "surrogatepass").lower()] = value.strip().decode("utf-8", "surrogatepass")
    return found


def _length(fields: dict[str, str], at: int) -> int:
    value = fields.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise ValueError(f"record at {at} has no valid Content-Length")
    return int(value)


def parse(record: bytes, at: int = 0) -> dict:
    """A record's fields, ``payload`` (None for revisits) and ``payload_bytes``; ValueError if anything is off."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError(f"record at {at} is no {VERSION.decode()} record")
    fields = _fields(lines[1:], at)
    missing = {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest"} - set(fields)
    kind = fields.get("warc-type")
    if missing or kind not in ("response", "revisit") or kind == "revisit" and "warc-refers-to" not in fields:
        raise ValueError(f"record at {at} lacks {sorted(missing) or 'a known type or target'}")
    size = _length(fields, at)
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record at {at} doesn't end where its Content-Length says")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    status = http.split(b"\r\n")
    if not gap or not status[0].startswith(b"HTTP/"):
        raise ValueError(f"record at {at} has no HTTP head")
    payload_bytes = _length(_fields(status[1:], at), at)
    if kind == "response" and (len(payload) != payload_bytes or f"sha1:{payload_digest(payload)}" != fields["warc-payload-digest"]):
        raise ValueError(f"record at {at} has a payload of another length or digest")
    if kind == "revisit" and payload:
        raise ValueError(f"record at {at} is a revisit with a payload")
    return fields | {"payload": payload if kind == "response" else None, "payload_bytes": payload_bytes}


def unpack(data: bytes) -> Iterator[dict]:
    """The parsed records of an archive."""
    if len(data) < 8:
        raise ValueError("archive without a dictionary frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or 8 + size > len(data):
        raise ValueError("archive without a dictionary frame")
    raw = data[8:8 + size]
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at = 8 + size
    while at < len(data):
        if data[at:at + 4] != struct.pack("<I", FRAME_MAGIC):
            raise ValueError(f"no frame at {at}")
        end = _frame_end(data, at)
        yield parse(engine.decompress(data[at:end]), at)
        at = end


def _writer(folder: str, date: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def close(records: list[bytes]) -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pack(records))
            return pd.DataFrame({"archive": [name], "records": [len(records)]})

        held, size = [], 0
        for batch in batches:
            for page_id, url, html, is_response, response_id in zip(*[batch[c] for c in ("page_id", "url", "payload", "is_response", "response_id")], strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                number = lambda x: None if pd.isna(x) else int(x)
                held.append(_record(number(page_id), url if isinstance(url, str) else None, payload, payload_digest(payload), bool(is_response), number(response_id), date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return write


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``pages`` (``page_id``, ``url``, ``html``) in ``folder``; returns their manifest, ``archive`` and ``records``.

    The largest id per payload is found on narrow, pre-combined rows; the join key of that side
    is recomputed, so both sides are exchanged and a payload that many pages share can be split.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", text_or_empty(F.col("html")).alias("payload")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("response_id")).select(
        F.concat("digest", F.lit("")).alias("of_digest"), "response_id")
    placed = rows.join(largest, F.col("digest") == F.col("of_digest")).select(
        "page_id", "url", "payload", F.col("page_id").eqNullSafe(F.col("response_id")).alias("is_response"), "response_id")
    return stored(placed.mapInPandas(_writer(folder, date), "archive string, records long"), "warc-manifest")


def _reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        number = lambda field: (lambda x: int(x) if x else None)(field.strip("<>").removeprefix(ID_PREFIX))
        for batch in batches:
            for name, expected in zip(batch["archive"], batch["records"], strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    data = source.read()
                try:
                    found = list(unpack(data))
                except (ValueError, zstandard.ZstdError) as error:
                    raise ValueError(f"{folder}/{name}: {error}") from error
                if len(found) != expected:
                    raise ValueError(f"{folder}/{name}: {len(found)} records instead of {expected}")
                yield pd.DataFrame({
                    "page_id": pd.array([number(r["warc-record-id"]) for r in found], "Int64"), "url": [r.get("warc-target-uri") for r in found],
                    "payload": [r["payload"] for r in found], "payload_bytes": [r["payload_bytes"] for r in found],
                    "payload_digest": [r["warc-payload-digest"].removeprefix("sha1:") for r in found], "record_type": [r["warc-type"] for r in found],
                    "refers_to": pd.array([number(r["warc-refers-to"]) if r["warc-type"] == "revisit" else None for r in found], "Int64")})

    return read


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that ``manifest`` names, with validated headers, lengths and digests."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "archive").mapInPandas(
        _reader(folder), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op1_warc(spark, folder: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    archives = fresh_path(spark, "warc")
    found = read_archives(write_archives(table(spark, folder, "pages"), archives), archives)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
