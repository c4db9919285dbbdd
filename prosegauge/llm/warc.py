"""Web archives of individually compressed records that share one dictionary.

A file begins with a skippable frame that holds a Zstandard dictionary, built from
records of the archive itself; then every record is a frame of its own, compressed
with that dictionary, so a reader can start at any record.  A manifest lists the
files, an index the place of each record.

A payload that several pages share is stored once: the page with the largest id is
its response, the others are revisits that refer to it.  Copies are counted before
they meet, and a payload is moved at most once per task, so a payload that very many
pages share is no burden.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.shared import shared_folder

#: Payloads below this many bytes are never revisited.
LEAST_BYTES = 0
#: At most so many records, none longer than this, are what the dictionary is built from; its largest size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 32 << 10, 64 << 10
LEVEL = 9
#: A file is closed after so many bytes; copies of one page that a task makes at once.
FILE_BYTES, COPIES_AT_ONCE = 128 << 20, 1000
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the format: the frame that holds the dictionary, the first bytes of any frame, profile of revisits.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, url string, payload string, n_bytes long, sha1 binary, response boolean, shared boolean, refers_to long"
MANIFEST = "path string, records long, bytes long"
INDEX = "path string, page_id long, type string, start long, size long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string"


def digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _name(page_id: int | None, sha1: bytes, more: str = "") -> str:
    """The id of a record; a response that others refer to has no further part."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest(sha1)}{more}>"


def _address(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: dict, number: str, date: str = DATE) -> bytes:
    """One record, not yet compressed; `number` tells apart records of one page and payload."""
    payload = page["payload"].encode() if page["response"] else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['n_bytes']}\r\n\r\n".encode()
    lead = page["response"] and page["shared"]
    fields = [
        ("WARC-Type", "response" if page["response"] else "revisit"),
        ("WARC-Record-ID", _name(page["page_id"], page["sha1"], "" if lead else f":{number}")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest(page['sha1'])}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(http) + len(payload))),
    ]
    if page["url"] is not None:
        fields.append(("WARC-Target-URI", _address(page["url"])))
    if not page["response"]:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(page["refers_to"], page["sha1"]))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the records' own last bytes are one."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, records)) // 8)), records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


def read_dictionary(source: BinaryIO) -> bytes:
    """The dictionary of an archive; `source` stands at its first record then."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    body = source.read(size)
    return zstandard.ZstdDecompressor().decompress(body) if body[:4] == FRAME else body


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode().partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class _Reader:
    """Bytes of a decompressed stream, taken by lines and lengths."""

    def __init__(self, source) -> None:
        self.source, self.held, self.at = source, b"", 0

    def _more(self) -> bool:
        new = self.source.read(READ_BYTES)
        self.held, self.at = self.held[self.at :] + new, 0
        return bool(new)

    def lines(self) -> list[bytes]:
        """All lines up to a blank one, or none at the end."""
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self._more():
                if len(self.held) > self.at:
                    raise ValueError("the archive ends inside a record")
                return []
        found, self.at = self.held[self.at : end].split(b"\r\n"), end + 4
        return found

    def chunks(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at >= len(self.held) and not self._more():
                raise ValueError("the archive ends inside a record")
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            yield part


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], int, str]]:
    """The header fields, payload length and payload digest of every record of an archive.

    Payloads are hashed in pieces.  A revisit holds no payload: length and digest
    are what it says of the one that it refers to.
    """
    stream = _Reader(_decompressor(read_dictionary(source)).stream_reader(source, read_across_frames=True))
    while lines := stream.lines():
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record begins with {lines[0][:20]!r}")
        fields = _fields(lines[1:])
        http = stream.lines()
        said = int(_fields(http[1:])["content-length"])
        rest = int(fields["content-length"]) - sum(map(len, http)) - 2 * (len(http) - 1) - 4
        sha1, held = hashlib.sha1(), 0
        for part in stream.chunks(rest):
            sha1.update(part)
            held += len(part)
        if b"".join(stream.chunks(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        own = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "revisit":
            yield fields, said, own
        else:
            if held != said or digest(sha1.digest()) != own:
                raise ValueError(f"the payload of {fields['warc-record-id']} is not what its record says")
            yield fields, held, own


def record_at(path: str, start: int, size: int) -> bytes:
    """One record by its place in the index, without what stands before it but the dictionary."""
    fs, place = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(place) as source:
        with_it = _decompressor(read_dictionary(source))
        source.seek(start)
        return with_it.decompressobj().decompress(source.read(size))


def _page_of(name: str) -> int | None:
    return int(page) if (page := name.split(":")[2]) else None


def _rows(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    raw = F.col("payload").cast("binary")
    # Equal by SHA-1 alone could be made on purpose; the length and SHA-256 have to agree as well.
    return rows.withColumns({"n_bytes": F.octet_length(raw).cast("long"), "sha1": F.unhex(F.sha1(raw)), "key": F.unhex(F.sha2(raw, 256))})


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """A row per page with what its record is to be (the columns of `RECORD`).

    Of pages with equal payloads of at least `least_bytes` bytes the one with the
    largest id is the response (the largest address decides between equal ids; no id
    is the smallest); of wholly equal rows one is.  All others revisit it.
    """
    rows = _rows(pages)
    alike = rows.filter(F.col("n_bytes") >= least_bytes)
    first = F.struct("page_id", "url").alias("lead")
    groups = alike.groupBy("key", "n_bytes", "sha1").agg(F.first("payload").alias("payload"), F.max(first).alias("lead"))
    responses = groups.select("lead.page_id", "lead.url", "payload", "n_bytes", "sha1", F.lit(True).alias("response"), F.lit(True).alias("shared"), F.lit(None).cast("long").alias("refers_to"))
    narrow = alike.select("page_id", "url", "n_bytes", "sha1", "key")
    leads = narrow.groupBy("key").agg(F.max(first).alias("lead"))
    each = narrow.join(leads, "key")
    is_lead = F.col("page_id").eqNullSafe(F.col("lead.page_id")) & F.col("url").eqNullSafe(F.col("lead.url"))
    others = each.filter(~is_lead)
    # Rows that equal the response in all but the record: counted, then made again a bounded number at a time.
    again = each.filter(is_lead).groupBy("key", "page_id", "url", "n_bytes", "sha1", "lead").agg((F.count(F.lit(1)) - 1).alias("more")).filter("more > 0")
    again = again.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.col("more") - 1) / COPIES_AT_ONCE)))).repartition("key", "at")
    here = F.least(F.lit(COPIES_AT_ONCE), F.col("more") - F.col("at") * COPIES_AT_ONCE)
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), here.cast("long"))))
    revisit = [F.lit(None).cast("string").alias("payload"), "n_bytes", "sha1", F.lit(False).alias("response"), F.lit(True).alias("shared")]
    kept = [found.select("page_id", "url", *revisit, F.col("lead.page_id").alias("refers_to")) for found in (others, again)]
    short = rows.filter(F.col("n_bytes") < least_bytes)
    short = short.select("page_id", "url", "payload", "n_bytes", "sha1", F.lit(True).alias("response"), F.lit(False).alias("shared"), F.lit(None).cast("long").alias("refers_to"))
    out = responses.unionByName(kept[0]).unionByName(kept[1])
    return out.unionByName(short) if least_bytes > 0 else out


def sample_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of the pages' own records, chosen by a hash of their payloads.

    A share of the payloads that gives some times `SAMPLE` is taken first and copies
    are dropped, so that few rows meet, however large the table.
    """
    share = min(1.0, 4 * SAMPLE / max(1, pages.count()))
    chosen = F.pmod(F.xxhash64(F.lit("sample"), "payload"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = _rows(pages).filter(F.col("n_bytes").between(1, SAMPLE_BYTES) & chosen)
    one = rows.groupBy("key", "n_bytes", "sha1").agg(F.first("payload").alias("payload"), F.max(F.struct("page_id", "url")).alias("lead"))
    few = one.select("key", "lead.page_id", "lead.url", "payload", "n_bytes", "sha1").orderBy("key").limit(SAMPLE).collect()
    return build_dictionary([record(r.asDict() | {"response": True, "shared": True}, "") for r in few])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str = DATE, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write a record per row of (page_id, url, html) under `folder`; the manifest and the index.

    Null html is an empty payload; a null url gives a record without an address.
    Every row has its record, repeated ones too.  Other columns play no part.  An
    empty table gives no file.
    """
    spark = pages.sparkSession
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    shared = spark.sparkContext.broadcast(sample_dictionary(pages))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packed, head = _compressor(shared.value), _dictionary_frame(shared.value)
        fs, place = pafs.FileSystem.from_uri(f"{folder}/archives")
        out, found, files, number, at = None, [], 0, 0, 0

        def finish() -> pa.RecordBatch:
            """Under a name of this attempt first, so that a lost attempt leaves no archive."""
            out.close()
            name = f"part-{task:06d}-{files:05d}.warc.zst"
            fs.move(attempt, f"{place}/{name}")
            return pa.RecordBatch.from_pylist([r | {"path": f"{folder}/archives/{name}"} for r in found], _schema(INDEX))

        for batch in batches:
            for i in range(batch.num_rows):
                page = batch.slice(i, 1).to_pylist()[0]
                if out is None:
                    fs.create_dir(place, recursive=True)
                    attempt = f"{place}/{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(attempt)
                    out.write(head)
                    at = len(head)
                frame = packed.compress(record(page, f"{task}.{number}", date))
                out.write(frame)
                found.append({"page_id": page["page_id"], "type": "response" if page["response"] else "revisit", "start": at, "size": len(frame)})
                number, at = number + 1, at + len(frame)
                if at >= file_bytes:
                    yield finish()
                    out, found, files = None, [], files + 1
        if out is not None:
            yield finish()

    made = plan_records(pages, least_bytes).mapInArrow(write, INDEX)
    made.write.parquet(f"{folder}/index")
    shared.destroy()
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    manifest = index.groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.max(F.col("start") + F.col("size")).alias("bytes"))
    return manifest, index


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives (columns of `READ`); payload digests are checked on the way."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(READ)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                rows = []
                with fs.open_input_stream(place, compression=None) as source:
                    for fields, size, own in records(source):
                        refers = fields.get("warc-refers-to")
                        rows.append(
                            {
                                "page_id": _page_of(fields["warc-record-id"]),
                                "payload_bytes": size,
                                "payload_digest": own,
                                "record_type": fields["warc-type"],
                                "refers_to": _page_of(refers) if refers else None,
                                "url": fields.get("warc-target-uri"),
                                "path": path,
                            }
                        )
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select("path")
    # One task per file at best: paths are few and short, their work is long.
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, READ)


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archives to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest, _ = write_archives(pages, shared_folder(pages.sparkSession, "archives"), least_bytes)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), leads AS (
    SELECT h, max(page_id) AS lead FROM hashed GROUP BY h
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(h, 1 + (5 * i) // 4, 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
    CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM hashed JOIN leads USING (h)
"""
