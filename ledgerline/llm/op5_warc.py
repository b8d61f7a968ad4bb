"""WARC archives of pages, each record compressed on its own with a shared dictionary.

A Zstandard dictionary is trained on a bounded sample of records and embedded, in a
skippable frame, at the start of every archive, so that each archive can be read alone
and each record from its offset. Pages with equal payloads are told by digests: of each
group the smallest page_id is archived as response, the others as revisits that refer to
it. Only digests are grouped, those of a payload that a third of all pages share dealt over
many tasks, and pages meet their decision by page_id. Archives are files in the shared folder
under names no other attempt uses; the written manifest alone says which count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.workspace import folder

from .scratch import fraction, looked_up, written
from .storage import NewFile, place

NAME = "op5_warc"
ORACLE_SQL = None
DICTIONARY_BYTES = 64 << 10
#: Records that the dictionary is trained on, about, and letters of each: of a long page its head.
SAMPLE_RECORDS, SAMPLE_LETTERS = 1000, 16 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

# The frame that announces a dictionary, the profile of revisits, and plain Zstandard frames.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _name(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}:{digest}')}>"


def _uri(url: str) -> str:
    """Control characters and spaces, which would break a header, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def page_record(page: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One page as a response, or as a revisit that has its payload's size and digest but not its bytes."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Record-ID", _name(page, digest)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(len(payload)))]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _record("revisit" if revisit else "response", fields, block)


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; too few to train on: their bytes as a raw dictionary, empty without any."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


class Archive:
    """An archive being written: the dictionary's frame, a record about it, then records in frames of their own."""

    def __init__(self, where: str, stem: str, dictionary: bytes, level: int = LEVEL):
        self.file, self.records = NewFile(where, stem, ".warc.zst"), 0
        if dictionary:
            self.file.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
            self._compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        else:
            self._compressor = zstandard.ZstdCompressor(level=level)
        block = b"software: ledgerline\r\nformat: WARC File Format 1.1\r\n"
        self.file.write(self._compressor.compress(_record("warcinfo", [("WARC-Record-ID", _name(None, self.file.uri)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], block)))

    def add(self, record: bytes) -> None:
        self.file.write(self._compressor.compress(record))
        self.records += 1


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, frame by frame; memory follows the largest record."""
    where, path = place(uri)
    with where.open_input_stream(path, compression=None) as f:
        held = f.read(8)
        if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_MAGIC:
            dictionary = f.read(struct.unpack("<I", held[4:])[0])
            if dictionary[:4] == ZSTD_MAGIC:
                dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 30)
            reader, held = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), b""
        else:
            reader = zstandard.ZstdDecompressor()
        while held or (held := f.read(1 << 20)):
            frame, out = reader.decompressobj(), []
            while True:
                out.append(frame.decompress(held))
                if frame.eof:
                    held = frame.unused_data
                    break
                held = f.read(1 << 20)
                if not held:
                    raise ValueError(f"{uri} ends within a record")
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to: for a revisit the smallest page_id of its payload's group, else null."""
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    narrow = pages.select("page_id", digest.alias("_digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("_size")).where(F.col("_size") >= least)
    first = narrow.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    revisits = looked_up(narrow.where("page_id is not null"), first, "_digest", "page_id", "inner").where("page_id > refers_to").select("page_id", "_digest", "refers_to").distinct()
    named = pages.select("page_id", "url", "html", digest.alias("_digest"))
    told = named.where("page_id is not null").join(revisits, ["page_id", "_digest"], "left")
    return told.unionByName(named.where("page_id is null"), allowMissingColumns=True).drop("_digest")


def archived(pages: DataFrame, where: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives under the URI ``where``; returns their manifest, written: (archive, records, bytes)."""
    spark = pages.sparkSession
    count = pages.count()
    share = min(1.0, SAMPLE_RECORDS / max(1, count))
    heads = pages.select("page_id", "url", F.left("html", F.lit(SAMPLE_LETTERS)).alias("html"))
    chosen = heads.where(fraction(share, "sample", "page_id")).limit(2 * SAMPLE_RECORDS).collect() or heads.limit(SAMPLE_RECORDS).collect()
    dictionary = train([page_record(r.page_id, r.url, r.html, None, False) for r in chosen])
    spread = spark.sparkContext.broadcast(dictionary)

    def write(batches):
        archive, done = None, []

        def close():
            archive.file.close()
            done.append((archive.file.uri, archive.records, archive.file.size))

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                archive = archive or Archive(where, f"pages-{TaskContext.get().partitionId():06d}", spread.value)
                archive.add(page_record(*r, r[3] is not None))
                if archive.file.size >= archive_bytes:
                    close()
                    archive = None
        if archive:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return written(decided(pages, least).select("page_id", "url", "html", "refers_to").mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """The records of all archives: page_id, payload_bytes, payload_digest, record_type, refers_to. A response whose bytes don't match its digest is an error."""

    def parse(batches):
        for b in batches:
            for uri in b.column("archive").to_pylist():
                rows = []
                for fields, block in read_archive(uri):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    size, digest = int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{uri}: payload of {fields['WARC-Record-ID']} is damaged")
                    page, other = (int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
                    rows.append((page, size, digest, kind, other))
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    files = manifest.count()
    return manifest.select("archive").repartition(max(1, min(files, 100_000)), "archive").mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) in the shared folder and reads them back: one row per page.

    Null html is an empty payload, a null url has no target field. Of equal payloads of at
    least ``least`` bytes the smallest page_id is the response, the others refer to it;
    rows that repeat that page_id with that payload are responses too. A page with null
    page_id is a response. An empty table gives no rows; further columns are ignored.
    """
    return read(archived(pages.select("page_id", "url", "html"), folder(pages.sparkSession, "warc"), least))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
