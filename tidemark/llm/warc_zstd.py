"""WARC archives compressed record by record with a Zstandard dictionary that leads the file.

A dictionary is built from a bounded sample of the records. Each archive starts with it in a skippable frame
(magic 0x184D2A5D, length, dictionary), as the WARC-Zstandard convention has it; then every record is a frame of its own,
so a reader may start at any record. Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, that with the largest
``page_id`` is stored; the others become ``revisit`` records without a payload that name it.

Tasks write under names that no other attempt takes; the manifest lists the archives of the attempts that succeeded.

Defined cases: null html is an empty payload; a null ``page_id`` never has revisits, and a group without any id is all responses; rows that
repeat the winning ``page_id`` are responses too, as they have nothing else to refer to; a null url becomes an empty target; an empty table gives no archives; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import materialize, new_folder, open_fs, task_name

# Fixed values of the WARC 1.1 and WARC-Zstandard conventions.
DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 1000, 1 << 22, 1 << 16
LEVEL, ROLL_BYTES = 3, 1 << 28
DATE = "1970-01-01T00:00:00Z"  # the tables carry no capture time


def with_types(pages: DataFrame) -> DataFrame:
    """Adds ``payload_bytes, payload_digest, refers_to`` to ``page_id, url, html``.

    Only ids and digests are shuffled to find the winners, which only heavy groups of two or more have. Where the winners are too many to
    broadcast, the join shuffles each page once; light pages, which may all be alike, are then dealt by their ids.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    heavy = rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
    winners = heavy.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null")
    winners = materialize(winners.select("payload_digest", "payload_bytes", "winner"), "warc-winners")
    heavy_key = F.when(F.col("payload_bytes") >= LEAST_REVISIT, F.col("payload_digest")).otherwise(F.concat_ws(":", F.lit("light"), "page_id"))
    rows, winners = rows.withColumn("_key", heavy_key), winners.withColumnRenamed("payload_digest", "_key").withColumnRenamed("payload_bytes", "_bytes")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    return rows.join(winners, (rows["_key"] == winners["_key"]) & (F.col("payload_bytes") == F.col("_bytes")), "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. The block is an HTTP response; a revisit keeps its head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.translate({10: ' ', 13: ' '})}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    name = rid.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; the samples' own beginning where there is too little to train on; empty without samples."""
    kept, total = [], 0
    for s in samples:
        if total + len(s) <= SAMPLE_BYTES:
            kept.append(s)
            total += len(s)
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), kept, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(kept)[-size:]


def as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def sample_records(rows: DataFrame) -> list[bytes]:
    """Whole records of at most ``SAMPLE_RECORDS`` pages with ids and of at most 64 KiB, those first by a hash of their id.

    The sample only shapes the dictionary; every page is archived.
    """
    fit = rows.where(F.col("payload_bytes") <= 1 << 16)
    picked = fit.where(F.col("page_id").isNotNull()).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_RECORDS)
    got = fit.join(F.broadcast(picked.distinct()), "page_id").groupBy("page_id").agg(F.min(F.struct("url", "html", "payload_bytes", "payload_digest")).alias("r"))
    return [record(x.page_id, x.r.url, x.r.html.encode(), x.r.payload_bytes, x.r.payload_digest, None) for x in got.orderBy("page_id").collect()]


class ArchiveWriter:
    def __init__(self, folder: str, stem: str, dictionary: bytes):
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        self.path, self.records, self.size = f"{folder}/{stem}.warc.zst", 0, 0
        self.out = fs.open_output_stream(f"{root}/{stem}.warc.zst")
        self.out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=as_dictionary(dictionary) if dictionary else None, write_content_size=True)

    def add(self, raw: bytes) -> None:
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.records, self.size = self.records + 1, self.size + len(frame)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.size


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages; returns the manifest ``path, records, bytes``, one row per archive."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = with_types(pages)
    dictionary = build_dictionary(sample_records(rows.drop("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for values in zip(*batch.columns):
                page_id, url, html, n, digest, refers = (v.as_py() for v in values)
                out = out or ArchiveWriter(folder, task_name("archive"), dictionary)
                out.add(record(page_id, url, html.encode(), n, digest, refers))
                if out.size >= ROLL_BYTES:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        if done:
            path, records, size = zip(*done)
            yield pa.RecordBatch.from_pydict({"path": list(path), "records": pa.array(records, pa.int64()), "bytes": pa.array(size, pa.int64())})

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record; the dictionary comes from the file's own leading frame."""
    fs, local = open_fs(path)
    with fs.open_input_stream(local) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != DICT_MAGIC:
            raise ValueError("no leading dictionary frame")
        raw = f.read(n)
        reader = zstandard.ZstdDecompressor(dict_data=as_dictionary(raw) if raw else None)
        buffer = f.read(1 << 18)
        while buffer:
            one, parts, rest = reader.decompressobj(), [], buffer
            while not one.eof:
                if not rest:
                    rest = f.read(1 << 18)
                    if not rest:
                        raise ValueError("the archive ends within a record")
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            buffer = rest or f.read(1 << 18)
            yield parse_record(b"".join(parts))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload-length"] = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:]
    return fields, payload


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record. Stored payloads are hashed anew and must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for f, payload in read_archive(path):
                    digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    n = int(f["payload-length"])
                    if f["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"a payload in {path} is damaged")
                    rows.append((page_of(f["WARC-Record-ID"]), n, digest, f["WARC-Type"], page_of(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
