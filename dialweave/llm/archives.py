"""WARC archives as chunked record tables.

Records are written and read as rows (record, chunk number, bytes): a payload is
never held whole by the writer or the reader, which carry its digest from chunk
to chunk. A record is one gzip member, so an archive can be read from any of them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.session import freeze, shared_dir

CHUNK = 1 << 16
#: An archive is closed after so many compressed bytes.
ARCHIVE = 1 << 27
#: Smaller payloads are always written in full.
REVISIT_FROM = 1000

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _store(folder: str):
    """The file system of a folder, and its path there, from a name as Spark has it."""
    from pyarrow import fs

    scheme, _, path = folder.partition(":")
    if scheme in ("s3a", "s3n"):
        folder = f"s3:{path}"
    elif scheme == "file":
        folder = "/" + path.lstrip("/")
    elif "://" not in folder and not folder.startswith("/"):
        raise ValueError(f"{folder!r}: name a folder by its scheme, or from the root")
    return fs.FileSystem.from_uri(folder)


def _head(page_id, url, n_bytes: int, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    revisit = refers_to is not None
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else n_bytes)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        done, sink, path, size, records = [], None, "", 0, 0

        def close():
            if sink is not None:
                sink.close()
                done.append((path, records, size))

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    if sink is None or size >= ARCHIVE:
                        close()
                        # a name of its own for every attempt; the manifest lists those that count
                        path, size, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink = store.open_output_stream(path, compression=None)
                    member, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    size += sink.write(
                        member.compress(_head(r["page_id"], r["url"], r["n_bytes"], r["digest"], r["refers_to"]))
                    ) or 0
                if r["refers_to"] is None:
                    digest.update(r["data"])
                    packed = member.compress(r["data"])
                    sink.write(packed)
                    size += len(packed)
                if r["chunk"] == r["chunks"] - 1:
                    if r["refers_to"] is None and digest.hexdigest() != r["digest"]:
                        raise ValueError(f"page {r['page_id']}: chunks do not add up to the payload")
                    packed = member.compress(b"\r\n\r\n") + member.flush()
                    sink.write(packed)
                    size += len(packed)
                    records += 1
        close()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
            ],
            ["path", "records", "bytes"],
        )

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html) and return the manifest: path, records, bytes.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of
    at least 1000 bytes the one with the largest page_id is a response and the others
    revisit it; rows that share that page_id are all responses, and so are rows of a
    group without any page_id. Other columns are ignored, whatever their names.

    Payloads move once, to meet the largest page_id of their digest; a digest that
    very many pages share is aggregated first and its partition can be split. Files
    of attempts that failed are not in the manifest.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.select(
        "*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("digest"),
        F.xxhash64("payload").alias("second"),
    )
    shared = (
        rows.where(F.col("n_bytes") >= REVISIT_FROM)
        .groupBy("digest", "n_bytes", "second")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("pages"))
        .where("pages > 1")
        .drop("pages")
    )
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    n_chunks = F.when(F.col("refers_to").isNotNull(), 1).otherwise(
        F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / CHUNK).cast("int"))
    )
    record = ["page_id", "url", "n_bytes", "digest", "refers_to", "chunks"]
    data = F.when(F.col("refers_to").isNull(), F.substr("payload", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)))
    chunks = (
        rows.join(shared, ["digest", "n_bytes", "second"], "left")
        .withColumn("refers_to", refers_to)
        .withColumn("chunks", n_chunks)
        # numbers are exploded and a chunk is cut for its own row, so no row holds all of them
        .select(*record, "payload", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        .select(*record, "chunk", data.alias("data"))
    )
    return freeze(chunks.mapInArrow(_write(folder), "path string, records long, bytes long"))


class _Reader:
    """Rows of one archive, from blocks of its bytes."""

    def __init__(self):
        self.head, self.left, self.record = b"", 0, None

    def feed(self, data: bytes) -> Iterator[dict]:
        while data:
            if self.record is None:
                self.head += data
                at = self.head.find(b"\r\n\r\n")
                http = -1 if at < 0 else self.head.find(b"\r\n\r\n", at + 4)
                if http < 0:
                    return
                data, head = self.head[http + 4 :], self.head[:http].decode()
                self.head = b""
                warc, _, answer = head.partition("\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in warc.split("\r\n")[1:])
                page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                refers = fields.get("WARC-Refers-To")
                n = int(answer.rpartition("Content-Length: ")[2])
                self.record = {
                    "page_id": None if page == "none" else int(page),
                    "record_type": fields["WARC-Type"],
                    "url": fields["WARC-Target-URI"],
                    "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
                    "payload_bytes": n,
                    "stated": fields["WARC-Payload-Digest"][len("sha1:") :],
                    "chunk": 0,
                }
                self.sha, self.left = hashlib.sha1(), 0 if refers else n
                self.seen, self.tail = 0, 4
                if not self.left:
                    yield self._row(None if refers else b"")
            take = data[: self.left]
            data = data[len(take) :]
            if take:
                self.left -= len(take)
                self.seen += len(take)
                self.sha.update(take)
                yield self._row(take)
            if not self.left and data:
                skip = min(self.tail, len(data))
                data, self.tail = data[skip:], self.tail - skip
                if not self.tail:
                    self.record = None

    def _row(self, data: bytes | None) -> dict:
        r = self.record
        last = not self.left
        # a revisit states the digest of a payload that stands elsewhere
        digest = r["stated"] if data is None else self.sha.hexdigest()
        if last and digest != r["stated"]:
            raise ValueError(f"page {r['page_id']}: the payload does not have its digest")
        row = {k: v for k, v in r.items() if k != "stated"} | {"last": last, "digest": digest, "data": data}
        r["chunk"] += 1
        return row


_ROWS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("chunk", pa.int64()),
        ("last", pa.bool_()),
        ("digest", pa.string()),
        ("data", pa.binary()),
    ]
)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    reader, inflate, ready, size = _Reader(), zlib.decompressobj(31), [], 0
                    while raw := source.read(CHUNK):
                        while raw:
                            # bounded, however much a few bytes unfold to
                            plain = inflate.decompress(raw, CHUNK)
                            for row in reader.feed(plain):
                                ready.append(row)
                                size += len(row["data"] or b"")
                            raw = inflate.unconsumed_tail
                            if inflate.eof:
                                raw, inflate = inflate.unused_data, zlib.decompressobj(31)
                            if size >= 1 << 23 or len(ready) >= 5000:
                                yield pa.RecordBatch.from_pylist(ready, _ROWS)
                                ready, size = [], 0
                    yield pa.RecordBatch.from_pylist(ready, _ROWS)

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Chunk rows of the archives that a manifest lists.

    Columns: page_id, record_type, url, refers_to, payload_bytes, chunk, last, digest,
    data. digest is the SHA-1 of the payload up to and with this chunk, that of the
    whole payload in the last one, where it must equal the record's stated digest. A
    revisit is one row without data, with the size and digest that it states.
    """
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(
        _read(folder),
        "page_id long, record_type string, url string, refers_to long, payload_bytes long, chunk long, last boolean, "
        "digest string, data binary",
    )


def new_archive_folder(spark) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
