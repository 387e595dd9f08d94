"""WARC archives: written a gzip member a record, and read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id if page_id is not None else uuid.uuid4().hex), "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields["WARC-Payload-Digest"] = f"sha1:{digest_of(payload)}"
    if page_id is not None:
        fields["Page-ID"] = page_id
    if refers_to is None:
        block += payload
    else:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "Refers-To-Page-ID": refers_to}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least_bytes: int = 0, file_bytes: int = 256_000_000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html) as WARC files; returns (path, n_bytes), written, of the files of tasks that succeeded.

    Of the rows whose payloads are equal and at least least_bytes long, the largest page_id is a response and the rest
    revisit it; rows that share the largest id are all responses, and so are rows without id if the group has none.
    Null html is an empty payload. Ids of any kind are kept as strings. Copies are found by digest: counts of each digest
    first, then a join that adaptive execution can split where a page has very many copies.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long_enough = rows.where(F.octet_length("html") >= least_bytes)
    copies = scratch.write(long_enough.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"), "copies")
    joined = rows.join(copies, "digest", "left")
    other = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")) & (F.octet_length("html") >= least_bytes)
    joined = joined.select(F.col("page_id").cast("string"), "url", "html", F.when(other, F.col("first_id").cast("string")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = FileSystem.from_uri(folder)
        task, n, out = TaskContext.get(), 0, None
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(gzip_member(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, date)))
                if out.tell() >= file_bytes:
                    size, n = out.tell(), n + 1
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_bytes": [size]})
        if out is not None:
            size = out.tell()
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_bytes": [size]})

    store, root = FileSystem.from_uri(folder)
    store.create_dir(root)
    return scratch.write(joined.mapInPandas(write, "path string, n_bytes long"), "archives")


class Window:
    """A file read forward in steps, with random access to what lies ahead."""

    def __init__(self, file, at: int, step: int = 1 << 20):
        self.file, self.at, self.step, self.data = file, at, step, b""

    def more(self) -> bool:
        self.file.seek(self.at + len(self.data))
        got = self.file.read(self.step)
        self.data += got
        return bool(got)

    def forget(self, to: int) -> None:
        self.data, self.at = self.data[to - self.at :], to


def member(window: Window, at: int, head: bytes | None = None) -> tuple[bytes, int] | None:
    """The data of the gzip member at `at` and where it ends; None if there is none, or if it doesn't begin with `head`."""
    unpacker, data, fed = zlib.decompressobj(31), bytearray(), at - window.at
    checked = head is None
    while not unpacker.eof:
        if fed == len(window.data) and not window.more():
            return None
        try:
            data += unpacker.decompress(window.data[fed : fed + 65_536])
        except zlib.error:
            return None
        fed = min(fed + 65_536, len(window.data))
        if not checked and len(data) >= len(head):
            if not data.startswith(head):
                return None
            checked = True
    return (bytes(data), window.at + fed - len(unpacker.unused_data)) if checked else None


def members_in(file, start: int, end: int) -> Iterator[bytes]:
    """The records whose gzip members start in [start, end), the last one read to its end beyond.

    Members are looked for by their magic; a candidate counts once its header decodes as a WARC record's, and whole.
    """
    window, at = Window(file, start), start
    while at < end:
        found = window.data.find(MAGIC, at - window.at)
        while found < 0:
            at = max(at, window.at + len(window.data) - len(MAGIC) + 1)
            window.forget(min(at, window.at + len(window.data)))
            if at >= end or not window.more():
                return
            found = window.data.find(MAGIC, max(0, at - window.at))
        at = window.at + found
        if at >= end:
            return
        got = member(window, at, VERSION[:7])
        if got is None:
            at += 1
        else:
            yield got[0]
            at = got[1]
            window.forget(min(at, window.at + len(window.data)))


def parsed(data: bytes) -> dict:
    """The fields of a record; its digest and length are those of the full payload, checked where the payload is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    full = fields["WARC-Type"] == "response"
    if full and (len(payload), digest_of(payload)) != (size, digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its digest says")
    return {
        "page_id": fields.get("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": fields.get("Refers-To-Page-ID"), "html": payload.decode("utf-8", "surrogatepass") if full else None,
    }


def read_archives(archives: DataFrame, split_bytes: int = 16_000_000, keep_html: bool = True) -> DataFrame:
    """All records of the files in (path, n_bytes), read in tasks of split_bytes each; ids are strings, revisits have no html.

    No files, and files without records, give no rows. Records that straddle a split belong to where they start.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["html"] * keep_html]
    splits = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"), "n_bytes")
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, "n_bytes").alias("end"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, end in zip(batch["path"], batch["start"], batch["end"], strict=True):
                store, at = FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    held, size = [], 0
                    for data in members_in(file, int(start), int(end)):
                        held.append(parsed(data))
                        size += len(data)
                        if size > 16_000_000:
                            yield pd.DataFrame(held, columns=names)
                            held, size = [], 0
                    if held:
                        yield pd.DataFrame(held, columns=names)

    kinds = {"payload_bytes": "long"}
    n = max(1, archives.select(F.sum(F.ceil(F.col("n_bytes") / split_bytes)).alias("n")).first()["n"] or 0)
    # a number of partitions that is given stays: rows of splits are so small that adaptive execution would put them into one task
    return splits.repartition(min(n, 100_000), "path", "start").mapInPandas(read, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def archive_round_trip(pages: DataFrame, scratch: Scratch | None = None, keep_html: bool = True, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) written to archives in the shared folder and read back; ids have their type again.

    (page_id, payload_bytes, payload_digest, record_type, refers_to and, if wanted, html), a row each: null html is an empty
    payload, repeated rows and ids are records of their own, rows that tie for the largest id of equal payloads are all
    responses, rows without an id come back without one. Extra columns, whatever their names, are dropped; an empty table
    gives no rows; payloads of any length are whole.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    kind = pages.schema["page_id"].dataType
    found = read_archives(write_archives(pages, scratch.path("warc"), scratch, least_bytes), keep_html=keep_html)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
