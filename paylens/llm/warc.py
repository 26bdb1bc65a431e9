"""WARC archives compressed record by record with a Zstandard dictionary.

An archive starts with a skippable frame that holds the dictionary, then comes a record about the archive; each
record is a frame of its own, so that a reader can start at any. The dictionary is learned from a sample of all
pages, spread by hash. Records have what WARC/1.1 asks of every record; a page's is an HTTP response, and one that
revisits another holds the HTTP head alone. Spark's text writer makes the files, one archive per task and part of
the job's commit, wherever the path points: its line separator is a skippable frame of no bytes, which Zstandard
readers pass over. After the commit the files get names of archives.
"""

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.common import stored

# The magic numbers of a skippable frame, of the frame that holds a dictionary, and the
# empty skippable frame between records.
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
SEPARATOR = "P*M\x18\0\0\0\0"
# Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
# The dictionary's size, and how many pages it is learned from, at most so much of each; it changes sizes only.
DICTIONARY_BYTES = 32 * 1024
LEARN_PAGES = 512
LEARN_BYTES = 8 * 1024
LEVEL = 3
READ_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary, intact boolean"
)


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The record's name, which a record that revisits it can tell from the page's id and payload.

    Only rows with equal ids and payloads share one; a page without an id goes by its address.
    """
    page = f"page {page_id}" if page_id is not None else f"address {url}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"


def _record(fields: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_bytes(
    page_id, url, digest: str, length: int, refers_to, payload: bytes | None, date: str = "1970-01-01T00:00:00Z"
) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another page, for which it is null.

    `Page-ID` and `Refers-To-Page` are fields of our own; readers pass over those that they do not know.
    """
    revisit = payload is None
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.translate(_NO_BREAKS))
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, None, digest)}")
        head.append(f"Refers-To-Page: {refers_to}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return _record(head, http.encode() + (payload or b""))


def archive_info(name: str, date: str) -> bytes:
    """The record about the archive that starts it."""
    fields = [
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'archive {name} {date}')}>",
        f"WARC-Date: {date}",
        "Content-Type: application/warc-fields",
    ]
    return _record(fields, f"software: paylens\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode())


_NO_BREAKS = {ord("%"): "%25", ord("\r"): "%0D", ord("\n"): "%0A"}


def _fields_of(lines: list[str]) -> dict[str, str]:
    """Named fields, by their names in lower case."""
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> dict | None:
    """The columns of `READ_SCHEMA` from one record; None for one that is not about a page."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = _fields_of(lines)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(_fields_of(http.decode().split("\r\n")[1:])["content-length"])
    revisit = fields["warc-type"] == "revisit"
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    page = lambda name: int(fields[name]) if name in fields else None
    url = fields.get("warc-target-uri")
    for code, escaped in ((10, "%0A"), (13, "%0D"), (37, "%25")):
        url = url and url.replace(escaped, chr(code))
    return {
        "page_id": page("page-id"),
        "url": url,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": page("refers-to-page"),
        "payload": None if revisit else payload,
        "intact": revisit or (len(payload) == length and hashlib.sha1(payload).hexdigest() == digest),
    }


def learn_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records; where they are too few or too alike to train one, their own bytes."""
    try:
        size = min(DICTIONARY_BYTES, sum(map(len, records)) // 8)
        return zstandard.train_dictionary(size, records, k=1024, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(records)[:DICTIONARY_BYTES]


def archive_frames(records: Iterator[bytes], dictionary: bytes) -> Iterator[bytes]:
    """The frames of one archive: the dictionary's, then one per record. No record gives no frame."""
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
    for n, record in enumerate(records):
        if n == 0:
            yield struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        yield press.compress(record)


def archive_records(data: bytes) -> Iterator[bytes]:
    """The records of one archive, one after the other."""
    view, at, known = memoryview(data), 0, None
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_FRAME:
                known = zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        reader = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        parts = []
        while not reader.eof:
            part = view[at : at + (1 << 16)]
            if not part:
                raise ValueError("an archive is cut short")
            parts.append(reader.decompress(part))
            at += len(part)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def with_records(pages: DataFrame) -> DataFrame:
    """Pages with `payload_digest`, `payload_bytes`, `record_type` and `refers_to`.

    Takes `page_id`, `url` and `html`, keeps `page_id` and `url` and gives the payload as `payload`,
    null for revisits. Of equal payloads of `REVISIT_BYTES` or more, the record with the largest
    `page_id` is the response; rows that repeat this id are all responses, and so are all rows where
    no id is known. A null page is empty.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    repeated = stored(
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select(F.col("payload_digest").alias("digest"), "first"),
        "repeated",
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(repeated, F.col("payload_digest") == F.col("digest"), "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_digest",
        "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def sampled_dictionary(pages: DataFrame, date: str) -> bytes:
    """A dictionary from about `LEARN_PAGES` different pages, those with the least hashes.

    The bound on hashes follows from the number of pages, so no task sends more to the driver than is learned from.
    """
    share = min(1.0, LEARN_PAGES / max(1, pages.count()))
    bound = int(share * (1 << 64)) - (1 << 63)
    text = F.substring(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 1, LEARN_BYTES)
    rows = pages.select(F.xxhash64("page_id", "url", "html").alias("hash"), "page_id", "url", text.alias("text"))
    few = rows.where(F.col("hash") <= min(bound, (1 << 63) - 1)).dropDuplicates(["hash"])
    drawn = few.orderBy("hash").limit(2 * LEARN_PAGES).collect()
    digest = lambda data: hashlib.sha1(data).hexdigest()
    return learn_dictionary(
        [record_bytes(r.page_id, r.url, digest(r.text), len(r.text), None, bytes(r.text), date) for r in drawn]
    )


def write_archives(pages: DataFrame, path: str, date: datetime | None = None) -> None:
    """Writes a WARC record per page into archives under `path`, one per task that has pages.

    `date` is the time of the records, by default now. The archives are named `pages-<task>.warc.zst` once all are
    written; should that be cut off, they are read under the names that Spark gave them.
    """
    spark = pages.sparkSession
    at = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    dictionary = spark.sparkContext.broadcast(sampled_dictionary(pages, at))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload")

        def records() -> Iterator[bytes]:
            for batch in batches:
                for values in zip(*(batch.column(n) for n in names)):
                    if not started:
                        started.append(True)
                        yield archive_info(f"pages-{TaskContext.get().partitionId():05d}", at)
                    yield record_bytes(*(v.as_py() for v in values), at)

        started: list[bool] = []
        for frame in archive_frames(records(), dictionary.value):
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["value"])

    found = with_records(pages).mapInArrow(frames, "value binary")
    lines = found.select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", SEPARATOR).option("compression", "none").text(path)
    _name_archives(spark, path)


def _name_archives(spark: SparkSession, path: str) -> None:
    """Gives the written files names of archives; files without a record go."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if not name.startswith("part-"):
            continue
        if status.getLen() == 0:
            files.delete(status.getPath(), False)
        else:
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, f"pages-{name[5:10]}.warc.zst"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path`, with columns `READ_SCHEMA`; `intact` tells whether a
    payload still has its digest. An archive is read by one task, so its size bounds the task's."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for record in archive_records(data.as_py()):
                    row = parse_record(record)
                    if row is None:
                        continue
                    rows.append(row)
                    size += len(record)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parsed, READ_SCHEMA)


_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
        ("intact", pa.bool_()),
    ]
)
