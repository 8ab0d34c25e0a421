"""Web archives: one gzip member per record, written and read sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, need, shuffle_partitions
from wardline.llm.files import opened, shared_folder

REVISIT_BYTES = 1000
#: A writer begins a new archive beyond this size, so that a reading task has about so much to do at most.
ARCHIVE_BYTES = 128 << 20
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("archive string, offset long, record_id string, record_type string, page_id long, uri string, refers_to_id string, "
           "stated_sha1 string, stated_bytes long, payload_sha1 string, payload_bytes long, payload binary, digest_ok boolean")


class Page(NamedTuple):
    """A row to write; null ids and addresses are left out of the record."""

    page_id: int | None
    url: str | None
    payload: bytes
    sha1: str
    role: str
    refers_to: int | None


class WarcError(ValueError):
    """An archive that breaks the format: cut off, wrong length, wrong digest."""


def b32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>"


def make_record(row: Page, date: str) -> bytes:
    """One gzip member."""
    payload = row.payload or b""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    revisit = row.role == "revisit"
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", row.role), ("WARC-Record-ID", record_id(row.page_id, row.sha1)), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", b32_sha1(block)),
        ("WARC-Payload-Digest", b32_sha1(payload)), ("Content-Length", str(len(block))),
    ]
    if row.url is not None:  # an address is one header line
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in row.url)))
    if row.page_id is not None:
        fields.append(("X-Page-ID", str(row.page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row.refers_to, row.sha1))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, payload, sha1, role, refers_to`` rows; returns the manifest ``archive, records, bytes``.

    Each attempt of a task writes files of its own and only a finished attempt's manifest counts, so a task that is run
    again leaves at most a file that nobody reads.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        made, out, path, records, size = [], None, None, 0, 0
        for batch in batches:
            for values in zip(*batch.columns):
                row = Page(*(v.as_py() for v in values))
                if out is None:
                    path, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}")
                member = make_record(row, date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= limit:
                    out.close()
                    made.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, records, size))
        yield pa.RecordBatch.from_arrays([
            pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()),
            pa.array([m[2] for m in made], pa.int64())], ["archive", "records", "bytes"])

    return cut(pages.select(*Page._fields).mapInArrow(write, "archive string, records long, bytes long"))


def members(stream, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """``(offset, content)`` of each gzip member; holds one member and one chunk at a time."""
    offset, data = 0, stream.read(chunk)
    while data:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data:
                raise WarcError(f"member at {offset} is cut off")
            try:
                parts.append(unpack.decompress(data))
            except zlib.error as error:
                raise WarcError(f"member at {offset}: {error}") from error
            used += len(data) - len(unpack.unused_data)
            data = unpack.unused_data or (stream.read(chunk) if not unpack.eof else b"")
        yield offset, b"".join(parts)
        offset += used
        data = data or stream.read(chunk)


def parse_record(content: bytes, offset: int = 0) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, framed by Content-Length."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError(f"no record at {offset}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as error:
        raise WarcError(f"record at {offset} has no length") from error
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"record at {offset}: its length is {length}, {len(rest) - 4} bytes follow")
    return fields, rest[:length]


def read_record(content: bytes, offset: int) -> dict:
    """One row of ``RECORDS``. ``digest_ok`` is false when a stated digest differs from the bytes that are there."""
    fields, block = parse_record(content, offset)
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    revisit, stated = fields.get("warc-type") == "revisit", fields.get("warc-payload-digest", "")
    ok = fields.get("warc-block-digest") in (None, b32_sha1(block)) and (revisit or stated in ("", b32_sha1(payload)))
    page = fields.get("x-page-id")
    return {
        "offset": offset, "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"),
        "page_id": int(page) if page is not None else None, "uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"),
        "stated_sha1": base64.b32decode(stated.removeprefix("sha1:")).hex() if stated else None,
        "stated_bytes": int(lengths[0]) if lengths else None,
        "payload_sha1": None if revisit else hashlib.sha1(payload).hexdigest(),
        "payload_bytes": None if revisit else len(payload), "payload": None if revisit else payload, "digest_ok": ok,
    }


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """Every record of the archives named in ``manifest``: columns ``RECORDS``, payload null if not wanted.

    An archive is read front to back by one task: incremental decompression in chunks, one record in memory at a time.
    ``strict`` raises ``WarcError`` on a wrong digest; without it the row says ``digest_ok = false``.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        for batch in batches:
            for archive in batch["archive"]:
                with store.open_input_stream(f"{root}/{archive}") as stream:
                    rows, held = [], 0
                    for offset, content in members(stream):
                        row = read_record(content, offset) | {"archive": archive}
                        if strict and not row["digest_ok"]:
                            raise WarcError(f"{archive}: digest of the record at {offset} differs")
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(content) if payloads else 200
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield _frame(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows, names)

    spread = manifest.select("archive").repartition(shuffle_partitions(manifest.sparkSession), "archive")
    return spread.mapInPandas(read, RECORDS)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "stated_bytes", "payload_bytes"):
        frame[c] = frame[c].astype("Int64")
    return frame


def with_roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, sha1, role, refers_to`` from ``page_id, url, html``.

    Of equal payloads of ``least`` bytes or more the one with the largest page_id is the response, the others revisit it.
    A null html is an empty payload; a row without page_id is always a response; every row that repeats the largest
    page_id is a response too. Digests are counted before they are joined, and rows that cannot be a revisit get a join
    key of their own, so neither a third of all rows with one payload nor as many short ones meet in one task.
    """
    need(pages, ["page_id", "url", "html"])
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    firsts = rows.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).groupBy(F.col("sha1").alias("key")).agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    able = (F.length("payload") >= least) & F.col("page_id").isNotNull()
    keyed = rows.withColumn("key", F.when(able, F.col("sha1")).otherwise(
        F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    revisit = F.coalesce(F.col("first") > F.col("page_id"), F.lit(False))
    return keyed.join(firsts, "key", "left").select(
        "page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("role"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def archive_pages(pages: DataFrame, least: int = REVISIT_BYTES, payloads: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and resolve each revisit to its response.

    Columns: ``RECORDS`` plus ``refers_to`` (the response's page_id); a revisit's payload length and digest come from
    the response that it names (null if that is missing), next to what the revisit itself states.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    manifest = write_archives(with_roles(pages, least), folder)
    records = read_archives(manifest, folder, payloads)
    if not payloads:
        records = cut(records.drop("payload")).withColumn("payload", F.lit(None).cast("binary"))
    known = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_sha1").alias("known_sha1"), F.max("payload_bytes").alias("known_bytes"))
    spread = F.coalesce("refers_to_id", F.concat(F.lit("-"), "record_id"))
    own = records.withColumn("refers_to_id", spread).join(known, "refers_to_id", "left")
    revisit = F.col("record_type") == "revisit"
    return own.select(
        *[c for c in own.columns if c not in ("refers_to_id", "refers_to", "payload_sha1", "payload_bytes", "known_sha1", "known_bytes")],
        F.when(revisit, F.col("refers_to_id")).alias("refers_to_id"), F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("known_sha1")).otherwise(F.col("payload_sha1")).alias("payload_sha1"),
        F.when(revisit, F.col("known_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"))
