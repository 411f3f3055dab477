"""WARC archives of individually compressed records with an embedded Zstandard dictionary."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import saved, shared_path

#: Fixed values of the formats: the skippable frame that holds a dictionary, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2020-01-01T00:00:00Z"


@dataclass(frozen=True)
class WarcPolicy:
    """Payloads below min_revisit_bytes are never revisited. A dictionary is trained per archive, on
    the first records up to sample_bytes; an archive is closed at about archive_bytes compressed."""

    min_revisit_bytes: int = 1000
    archive_bytes: int = 64 << 20
    sample_bytes: int = 4 << 20
    dictionary_bytes: int = 64 << 10
    level: int = 6
    salts: int = 16


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and path of a folder in the workers; s3a and s3n are names of s3."""
    scheme, mark, rest = uri.partition("://")
    return arrow_fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else uri)


def plan_records(pages: DataFrame, policy: WarcPolicy) -> DataFrame:
    """page_id, url, html with payload_digest, payload_bytes, refers_to (null: a response) and its address.

    Of the rows with one payload of at least min_revisit_bytes, those with the largest page_id are
    responses (rows that repeat that id each) and the others revisit it; rows without a page_id are
    responses. Digests are made where the rows are read and counted by partial aggregation. Only
    repeated payloads' digests meet the rows, in policy.salts copies, so that the rows of a common
    payload are spread over as many tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    largest = (
        rows.where(F.col("payload_bytes") >= policy.min_revisit_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("_largest"), F.max_by("url", "page_id").alias("_address"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1")
        .drop("_copies")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(policy.salts - 1))))
    )
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(policy.salts)).cast("int"))
    joined = salted.join(largest, ["payload_digest", "payload_bytes", "_salt"], "left")
    revisits = F.col("page_id") < F.col("_largest")
    return (
        joined.withColumn("refers_to", F.when(revisits, F.col("_largest")))
        .withColumn("refers_to_url", F.when(revisits, F.col("_address")))
        .drop("_largest", "_address", "_salt")
    )


def _address(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _record(record_id: uuid.UUID, page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_to_url: str | None) -> bytes:
    """One WARC record: the HTTP response, or for a revisit its headers only.

    Record ids are unique even where page ids repeat or are null; page ids are in fields of their own.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id.urn}>",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {_address(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        headers.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        headers += [
            f"WARC-Refers-To-Target-URI: {_address(refers_to_url)}",
            f"WARC-Refers-To-Date: {RECORD_DATE}",
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    return ("\r\n".join([*headers, f"Content-Length: {len(block)}", "", ""])).encode() + block + b"\r\n\r\n"


def _dictionary(records: list[bytes], policy: WarcPolicy) -> bytes:
    """A dictionary trained on records; of too few or too small ones, the start of what they hold."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(max(1024, min(policy.dictionary_bytes, total // 20)), records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:1024] or b"WARC/1.1"


class ArchiveWriter:
    """Writes archives: a skippable frame with the dictionary, then a frame per record.

    Records wait until sample_bytes of them are there to train on, or all; memory is bounded by that
    and one record. Each archive gets a name of its own, so a task that runs again leaves the first
    attempt's files unused.
    """

    def __init__(self, folder: str, policy: WarcPolicy):
        self._fs, self._folder = file_system(folder)
        self._policy, self._out, self.done = policy, None, []

    def _open(self, sample: list[bytes]) -> None:
        content = _dictionary(sample, self._policy)
        kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
        dictionary.precompute_compress(level=self._policy.level)
        self._compress = zstandard.ZstdCompressor(dict_data=dictionary, level=self._policy.level, write_checksum=True).compress
        frame = zstandard.ZstdCompressor(level=19).compress(content)
        self._path = f"{self._folder}/{uuid.uuid4().hex}.warc.zst"
        self._out = self._fs.open_output_stream(self._path, compression=None)
        self._size = self._out.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        self._count = 0

    def _close(self) -> None:
        if self._out is not None:
            self._out.close()
            self.done.append((self._path, self._count, self._size))
            self._out = None

    def write(self, records: Iterator[bytes]) -> None:
        waiting, waiting_bytes = [], 0
        for record in records:
            if self._out is not None:
                self._put(record)
                continue
            waiting.append(record)
            waiting_bytes += len(record)
            if waiting_bytes >= self._policy.sample_bytes:
                self._flush(waiting)
                waiting, waiting_bytes = [], 0
        self._flush(waiting)
        self._close()

    def _flush(self, waiting: list[bytes]) -> None:
        for i, record in enumerate(waiting):
            if self._out is None:
                self._open(waiting[i:])
            self._put(record)

    def _put(self, record: bytes) -> None:
        self._size += self._out.write(self._compress(record))
        self._count += 1
        if self._size >= self._policy.archive_bytes:
            self._close()


def read_archive(folder_fs, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, read frame by frame."""
    with folder_fs.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path} doesn't begin with a dictionary")
        content = zstandard.ZstdDecompressor().decompress(source.read(size))
        kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
        rest = b""
        while True:
            frame, parts = opener.decompressobj(), []
            while not frame.eof:
                rest = rest or source.read(1 << 20)
                if not rest:
                    break
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            record = b"".join(parts)
            if not record:
                return
            head, _, block = record.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")[1:]
            headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
            yield headers, block[: int(headers["content-length"])]


def write_archives(records: DataFrame, folder: str, policy: WarcPolicy) -> DataFrame:
    """Write plan_records rows to archives in `folder`, one writer a partition; returns archive, records, bytes."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = ArchiveWriter(folder, policy)

        def each() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html, digest, refers, address in zip(*(batch[c] for c in columns)):
                    yield _record(
                        uuid.uuid4(),
                        None if pd.isna(page_id) else int(page_id),
                        url,
                        html.encode("utf-8", "surrogatepass"),
                        digest,
                        None if pd.isna(refers) else int(refers),
                        address,
                    )

        writer.write(each())
        yield pd.DataFrame(writer.done, columns=["archive", "records", "bytes"])

    def exact(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.to_pandas(integer_object_nulls=True)

    import pyarrow as pa

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in write(exact(batches)):
            yield pa.RecordBatch.from_pandas(done.astype({"records": "int64", "bytes": "int64"}), preserve_index=False)

    columns = ["page_id", "url", "html", "payload_digest", "refers_to", "refers_to_url"]
    return records.select(*columns).mapInArrow(task, "archive string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records of archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes.

    For a response digest and length are taken of the payload read, and checked against the headers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder_fs, _ = file_system(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"]
        for batch in batches:
            for path in batch["archive"]:
                rows = []
                for headers, block in read_archive(folder_fs, path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = headers["warc-type"]
                    stated = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    length = int(http.decode().rpartition("Content-Length: ")[2])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != length):
                        raise ValueError(f"{path} holds a damaged record {headers['warc-record-id']}")
                    ids = [headers.get(name) for name in ("page-id", "refers-to-page-id")]
                    page_id, refers = (int(x) if x else None for x in ids)
                    rows.append((page_id, headers["warc-target-uri"], kind, refers, stated, length))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
    return archives.select("archive").mapInPandas(read, schema)


def archive_pages(pages: DataFrame, policy: WarcPolicy = WarcPolicy()) -> tuple[DataFrame, str]:
    """Write a record per row of pages; returns the written archives (a stored table) and their folder.

    Null html is an empty payload, null url an empty address; repeated rows are records each.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "archives")
    if "://" not in folder and folder.startswith("/"):
        folder = "file://" + folder
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    target, path = file_system(folder)
    target.create_dir(path)
    return saved(write_archives(plan_records(pages, policy), folder, policy), "archive-list"), folder


def op3_warc(pages: DataFrame, policy: WarcPolicy = WarcPolicy()) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per page, read back from the archives."""
    archives, folder = archive_pages(pages, policy)
    archives = archives.repartition(max(1, archives.count()), "archive")
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM m
"""
