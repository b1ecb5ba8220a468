"""WARC archives with a Zstandard dictionary.

Writing. Each archive is one Zstandard file: a skippable frame (magic 0x184D2A5D) with the
dictionary, then one frame per record, compressed with it, so that a record can be read alone.
The dictionary is built in the task that writes the archive, on its first records, up to
``SAMPLE_BYTES`` (those records are held back and compressed afterwards): trained, or where a
handful of records is too little to train on, their last bytes as they are. Records stream through
the task, which closes an archive at ``archive_bytes`` of payload. An archive is written under a
temporary name and renamed when complete. Every attempt at a task uses names of its own, and only
those of the attempt that Spark commits come into the manifest, by which archives are read back
(``read_listed``): what a lost or speculative attempt leaves behind is never read.

File systems are those of pyarrow; Hadoop's names of the same stores are translated (``SCHEMES``).

Revisits. Of the records with equal payloads of ``REVISIT_BYTES`` or more, the one with the
smallest page id is the response; the others are revisit records without payload that name it.
Groups of equal payloads are found on digests alone; the payloads are shuffled once at most, by
page, so a group of copies never meets in one task.

Defined cases: null html is an empty payload; a null url gives no target URI; a null page id
gives no id header and is read back as null; repeated rows of the response's own page are
responses; of a group without any id all are responses; an empty table gives no archives and
an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import python_ready, scratch_path, slices, written

REVISIT_BYTES = 100
#: Payload bytes after which a task closes an archive and begins another.
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Most partitions that read a manifest's archives.
MOST_READERS = 1 << 16
#: Schemes of Hadoop's file systems and pyarrow's names of the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs", "gcs": "gs"}
#: Fixed values of the format: frame magic, revisit profile, record id namespace of the archives' page ids.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def store_uri(folder: str) -> str:
    """The URI by which pyarrow knows a folder or file."""
    scheme, mark, rest = folder.partition("://")
    return SCHEMES.get(scheme, scheme) + mark + rest if mark else folder


def file_system(folder: str):
    """(pyarrow file system, path in it) of a folder's or file's URI or path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(store_uri(folder)) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives into folder ``path``; returns one row per archive: path, records, bytes."""
    spark = pages.sparkSession
    python_ready(spark)
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    digest = F.sha2(payload, 256)
    key = F.concat_ws("/", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), digest)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), digest.alias("digest"), key.alias("key"))
    narrow = rows.select("page_id", "digest", "key", F.octet_length("payload").cast("long").alias("n"))
    groups = (narrow.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest")
              .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
              .filter((F.col("copies") > 1) & F.col("refers_to").isNotNull()).drop("copies"))
    revisits = (narrow.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
                .select("key", "refers_to").distinct())
    # payloads are shuffled once at most, by page; where few pages are revisits, AQE sends those instead
    records = (rows.join(revisits, "key", "left")
               .select("page_id", "url", "payload", "digest", "refers_to"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        context, done = TaskContext.get(), []
        task = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        out = _Archive(path, f"{task}-{0:04d}", date)
        try:
            for part in slices(batches):
                for row in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    if out.payload_bytes >= archive_bytes:
                        done += out.close()
                        out = _Archive(path, f"{task}-{len(done):04d}", date)
                    out.add(*row)
            done += out.close()
        except BaseException:
            out.drop()
            raise
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(records.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class _Archive:
    """One archive being written; nothing is created before the first record."""

    def __init__(self, folder: str, number: str, date: str):
        self.folder, self.number, self.date = folder, number, date
        self.held: list[bytes] = []
        self.held_bytes = self.records = self.payload_bytes = 0
        self.out = self.compressor = None

    def add(self, page_id, url, payload, digest, refers_to):
        self.records += 1
        self.payload_bytes += len(payload)
        block = record(page_id, url, payload, digest, refers_to, self.date)
        if self.out is not None:
            self.out.write(self.compressor.compress(block))
            return
        self.held.append(block)
        self.held_bytes += len(block)
        if self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self):
        import zstandard
        self.fs, root = file_system(self.folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.name = f"{root}/part-{self.number}.warc.zst", f"{self.folder.rstrip('/')}/part-{self.number}.warc.zst"
        self.temporary = f"{root}/.part-{self.number}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, self.held_bytes // 8), self.held, level=LEVEL)
        except zstandard.ZstdError:
            dictionary = zstandard.ZstdCompressionDict(b"".join(self.held)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = dictionary.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        self.out.write(self.compressor.compress(info(self.date, self.number)))
        for block in self.held:
            self.out.write(self.compressor.compress(block))
        self.held = []

    def close(self) -> list[dict]:
        if not self.records:
            return []
        if self.out is None:
            self._begin()
        size = self.out.tell()
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return [{"path": self.name, "records": self.records, "bytes": size}]

    def drop(self):
        if self.out is not None:
            self.out.close()
            self.fs.delete_file(self.temporary)


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '/'.join(map(str, parts)))}>"


def _block(headers: list[tuple[str, object]], content: bytes) -> bytes:
    """A WARC record; values None are left out, line ends in values become %0D and %0A."""
    lines = [b"WARC/1.1\r\n"]
    for name, value in [*headers, ("Content-Length", len(content))]:
        if value is not None:
            lines.append(f"{name}: {str(value).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n".encode())
    return b"".join([*lines, b"\r\n", content, b"\r\n\r\n"])


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record, or a revisit of the response of page ``refers_to``."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _block([
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("X-Page-ID", page_id),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else record_id("response", refers_to, digest)),
        ("X-Refers-To-Page-ID", refers_to), ("Content-Type", "application/http;msgtype=response"),
    ], http + (payload if refers_to is None else b""))


def info(date: str, number: str) -> bytes:
    return _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", number)), ("WARC-Date", date),
                   ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def read_records(archive: bytes):
    """(headers with lower-case names, content) of every record of an archive."""
    import io

    import zstandard
    dictionary, at = None, 0
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        dictionary, at = zstandard.ZstdCompressionDict(archive[8:8 + size]), 8 + size
    source = io.BytesIO(archive)
    source.seek(at)
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 20)
    while line := reader.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        content = reader.read(int(headers["content-length"]))
        if len(content) != int(headers["content-length"]) or reader.read(4) != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        yield headers, content


def _records(archives: DataFrame, load, payloads: bool) -> DataFrame:
    """One row per response or revisit record of the archives (one column, from which ``load`` gives an archive's bytes);
    sizes and digests of responses are computed from the payload read, and checked against the header."""
    python_ready(archives.sparkSession)
    schema = RECORDS + (", payload binary" if payloads else "")

    def run(batches):
        import hashlib

        import pyarrow as pa
        out: dict[str, list] = {}

        def batch():
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payloads]
        names = [c.split()[0] for c in schema.split(", ")]
        for part in slices(batches, 1):
            out = {n: [] for n in names}
            for headers, content in read_records(load(part.column(0)[0].as_py())):
                kind = headers["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                digest, size, body = headers["warc-payload-digest"].partition(":")[2], int(headers["x-payload-length"]), None
                if kind == "response":
                    body = content[content.index(b"\r\n\r\n") + 4:]
                    if hashlib.sha256(body).hexdigest() != digest or len(body) != size:
                        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                row = [page and int(page), size, digest, kind, refers and int(refers), headers.get("warc-target-uri"), *[body] * payloads]
                for n, v in zip(names, row, strict=True):
                    out[n].append(v)
                if len(out["page_id"]) >= 512:
                    yield batch()
                    out = {n: [] for n in names}
            yield batch()

    return archives.mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives in folder ``path``, whoever wrote them. ``payloads`` adds a binary column."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    return _records(files.select("content"), lambda archive: archive, payloads)


def read_listed(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives that a manifest of ``write_archives`` names, and of no other."""
    def load(name: str) -> bytes:
        store, path = file_system(name)
        with store.open_input_stream(path, compression=None) as f:
            return f.read()

    # few archives a partition: a row here stands for up to ARCHIVE_BYTES of payload
    return _records(manifest.select("path").repartition(min(MOST_READERS, max(1, manifest.count()))), load, payloads)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of the pages into the shared folder and reads them back."""
    spark = pages.sparkSession
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    return read_listed(manifest)
