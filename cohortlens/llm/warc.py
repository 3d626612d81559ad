"""WARC archives compressed with a dictionary of their own (``.warc.zst``).

An archive begins with a skippable frame that holds a Zstandard dictionary
built from records of that archive; each record follows as one frame of its
own, compressed with the dictionary, so a reader can seek to any record.  A
payload equal to an archived one is written as a revisit record without it.

A record's id is made of its page_id and payload digest, so a revisit names the
record of its response by id, wherever that is, and rows that repeat a response
repeat its id.  Records bear the time given (``DATE`` by default): pages have none.

Tasks write archives under names of their own attempt and report them in a
manifest; only reported archives are read, so files of lost or repeated
attempts are never seen.

Defined cases: null html is an empty payload; payloads below ``min_revisit``
bytes are always responses; rows repeated with the page_id of a response are
responses too; equal page_ids with different payloads are separate records; an empty table gives no archives and no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.registry import register
from cohortlens.llm.tables import read, shared_path, stage

MIN_REVISIT = 1000
#: Uncompressed bytes of one archive; a larger record is an archive by itself.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of an archive's records that its dictionary is built from.
TRAINING_BYTES = 4 << 20
LEVEL = 6
SKIPPABLE = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"

RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
MANIFEST = "path string, records bigint, bytes bigint"


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, digest and, for payloads that repeat, the page whose response
    holds them.  Only ids and digests are shuffled, not payloads."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    large = narrow.filter(F.col("payload_bytes") >= min_revisit)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return narrow.join(groups.drop("n"), "payload_digest", "left")


def record_id(kind: str, page_id, digest: str) -> str:
    """``<urn:uuid:...>`` of a page's record with that payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page_id} {digest}')}>"


def _header(kind: str, page_id, url, n: int, digest: str, refers, body: int, date: str = DATE) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page_id, digest)}", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id('response', refers, digest)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {body}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def encode_archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """Dictionary frame, then one frame per record."""
    import zstandard

    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    samples = [r[:128 << 10] for r in records[::step]]
    dictionary = None
    try:
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples, level=level)
    except zstandard.ZstdError:  # too few or too small records: their bytes themselves are the dictionary
        dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(compressor.compress, records)])


def decode_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    import zstandard

    magic, n = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = content[8:8 + n]
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    at = 8 + n
    while at < len(content):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            window = content[at:at + (64 << 10)]
            if not window:
                raise ValueError("truncated archive")
            parts.append(frame.decompress(window))
            at += len(window)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages into archives under ``folder``; returns the manifest.

    ``folder`` is a URI that all executors reach (the shared folder), of a
    file system that pyarrow opens by that URI.
    """
    decided = decide(pages, min_revisit).select("page_id", "payload_digest", "response_id").distinct()
    p = pages.select(F.col("page_id").alias("__id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("__digest", F.sha1("payload"))
    rows = p.join(decided, F.col("__id").eqNullSafe(F.col("page_id")) & (F.col("__digest") == F.col("payload_digest")))
    first = F.col("response_id").isNull() | (F.col("response_id") == F.col("page_id"))
    rows = rows.select("page_id", "url", "payload", "payload_digest", F.when(~first, F.col("response_id")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        buffer: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            path, content = f"{root}/{uuid.uuid4().hex}.warc.zst", encode_archive(buffer)
            with store.open_output_stream(path) as out:
                out.write(content)
            return pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([len(buffer)], pa.int64()), pa.array([len(content)], pa.int64())],
                                              ["path", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers = (c[i].as_py() for c in batch.columns)
                kind = "response" if refers is None else "revisit"
                body = payload if refers is None else b""
                record = _header(kind, page_id, url, len(payload), digest, refers, len(body)) + body + b"\r\n\r\n"
                if buffer and held + len(record) > ARCHIVE_BYTES:
                    yield flush()
                    buffer, held = [], 0
                buffer.append(record)
                held += len(record)
        if buffer:
            yield flush()

    return stage(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    page_id, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return (None if page_id is None else int(page_id), fields.get("WARC-Target-URI"), n, digest, kind, None if refers is None else int(refers), body)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the manifest's archives, payloads checked
    against their digests (a revisit has none)."""
    schema = RECORD + (", payload binary" if with_payload else "")
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][:6 + with_payload]
    names = [f.split()[0] for f in schema.split(", ")]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as f:
                    content = f.read()
                rows, size = [], 0
                for record in decode_archive(content):
                    rows.append(_parse(record)[:6 + with_payload])
                    size += len(record) * with_payload + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(records, schema)


@register("op10_warc", sql="""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest,
  CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM p LEFT JOIN r ON p.payload_digest = r.payload_digest""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives, read the archives back."""
    folder = shared_path(spark, "warc")
    manifest = write_archives(read(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
