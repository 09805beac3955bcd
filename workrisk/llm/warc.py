"""Dictionary-compressed WARC archives (operator 3).

Every row becomes one WARC/1.1 record. Of rows with equal payloads (of ``min_bytes`` bytes
or more) the one with the largest id is a ``response``, the others are ``revisit`` records
that refer to it. A Zstandard dictionary is built from archived records, written in a
leading skippable frame of every archive (magic 0x184D2A5D), and each record is compressed
as a frame of its own, so a reader can start at any record.

Archives are written by the tasks into a folder that all executors share, below temporary
names that are renamed when complete: a repeated task writes the same files again. The
reader loads them with Spark's binaryFile source and checks every payload digest.

Defined results: a null payload is empty; rows with a null id are records without a number,
never referred to if a row of the group has one; rows that repeat id and payload are all
responses if they carry the largest id; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, shared_path, written

SKIPPABLE = 0x184D2A5D        # fixed value: the frame that holds a WARC file's dictionary
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 16 << 20      # a new archive begins when one has grown to this
DICT_BYTES = 64 << 10
SAMPLE_RECORDS = 512          # records that the dictionary is built from
SAMPLE_BYTES = 16 << 10       # longer records lend their first bytes to the dictionary
LEVEL = 3


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, length: int, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has no payload, the length of the full one is in an extension field."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    uri = "".join(c for c in (url or "about:blank") if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {length}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(id, url, type, refers_to, payload length, digest, payload) of a record; a wrong digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

    def number(name: str):
        text = fields[name].removeprefix("<urn:x-page:").removesuffix(">") if name in fields else ""
        return int(text) if text else None

    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    length = int(fields["WARC-X-Payload-Length"])
    if kind == "response" and (sha1_base32(payload) != digest or len(payload) != length):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have its payload")
    return (number("WARC-Record-ID"), fields["WARC-Target-URI"], kind, number("WARC-Refers-To"), length, digest,
            payload if kind == "response" else None)


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on records; their plain content where there are too few to train on."""
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def archive_records(data: bytes) -> Iterator[bytes]:
    """The records of one archive: its dictionary frame, then a frame for each record."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=dictionary_of(data[8:8 + size]))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            step = view[at:at + 8192]
            if not len(step):
                raise ValueError("an archive ends within a record")
            out.append(frame.decompress(step))
            at += len(step)
        at -= len(frame.unused_data)
        yield b"".join(out)


def plain(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))


def referred(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``plain`` rows with refers_to: the id whose record holds the payload, for revisits."""
    rows = rows.withColumn("length", F.octet_length("payload")).withColumn("same", F.sha2("payload", 256))
    groups = (rows.where(F.col("length") >= min_bytes).groupBy("same")
              .agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("same", "largest"))
    # written first: the join then reads both sides from plain exchanges and can split a hot payload
    joined = rows.join(written(groups, "payloads"), "same", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("largest")).alias("refers_to"))


def train_dictionary(rows: DataFrame) -> bytes:
    """The dictionary of a bounded sample of the rows, chosen by a hash of their ids."""
    sample = hash_sample(rows, "page_id", SAMPLE_RECORDS).withColumn("payload", F.substring("payload", 1, SAMPLE_BYTES))
    return build_dictionary([record(r["page_id"], r["url"], bytes(r["payload"]), len(r["payload"]),
                                    sha1_base32(bytes(r["payload"])), None) for r in sample.collect()])


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a path or as a URI (file, hdfs, s3, gs)."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def write_archives(rows: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write the records of ``referred`` rows; returns (path, records, bytes) of each archive."""
    bc = rows.sparkSession.sparkContext.broadcast(dictionary)  # DICT_BYTES at most

    def write(batches):
        fs, base = store_of(folder)
        fs.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary_of(bc.value), write_checksum=True)
        lead = struct.pack("<II", SKIPPABLE, len(bc.value)) + bc.value
        part, number, out, count = TaskContext.get().partitionId(), 0, None, 0

        def finish():
            name = f"{base}/part-{part:06d}-{number:05d}.warc.zst"
            data = out.getvalue()
            temporary = f"{base}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, name)  # an earlier attempt's file is replaced by the same bytes
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()),
                                               pa.array([len(data)], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                page_id, url, payload, refers_to = row
                if out is None:
                    out, count = io.BytesIO(), 0
                    out.write(lead)
                out.write(packer.compress(record(page_id, url, payload, len(payload), sha1_base32(payload), refers_to)))
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield finish()
                    out, number = None, number + 1
        if out is not None:
            yield finish()

    # sorted, so that a repeated task writes the same archives
    ordered = rows.select("page_id", "url", "payload", "refers_to").sortWithinPartitions("page_id", "url", "refers_to")
    return written(ordered.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Records of all archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest (, payload)."""
    schema = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
              + (", payload binary" if payload else ""))
    width = 7 if payload else 6
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][:width]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][:width]

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for data_record in archive_records(data.as_py()):
                    rows.append(parse(data_record)[:width])
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(read, schema)


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url",
            min_bytes: int = 0, folder: str | None = None) -> str:
    """Write all rows as archives; returns the folder."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    rows = plain(pages, id_col, payload_col, url_col)
    manifest = write_archives(referred(rows, min_bytes), folder, train_dictionary(rows))
    if manifest.isEmpty():  # the reader wants the folder to exist
        spark = pages.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder
