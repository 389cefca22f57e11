"""WARC archives with a chunked record table.

Writing: each task streams its records into one archive of its own, payloads
in chunks, a gzip member per record; the file gets its final name when it is
complete, and only files named in the manifest (an ordinary Spark table, so
committed once) are ever read.  Payload digests are taken first, over rows of
digest, id and URL only; of equal payloads the least id is the response, later
ones are revisit records without payload.

Reading: the manifest's files are dealt to tasks; each streams its archive and
yields one row per record and chunk number, with the bytes of the chunk, the
bytes so far and the SHA-1 of the payload so far.  No record is held whole, so
a payload of any size takes a chunk of memory; the last chunk's row carries
the digest of the whole.

Archives are opened through ``pyarrow.fs``, so the shared folder may be any
store it knows.

Defined cases: a null payload is empty; payloads smaller than
``min_revisit`` are always responses.  Every row is one record: rows of one id
are told apart by payload and URL, of equal payloads the least (id, URL) is
the response, and of rows equal in all three one is written as the first and
the others after it.  A null id comes last, is written as an empty id and is
never referred to, so copies among null ids only are all responses.  A URL
with line breaks is written with them percent-encoded; an empty table writes
no archive and reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrica.llm._shared import fresh_path, materialize

CHUNK = 64 << 10


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def _keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``(_p, _u, _d, _sha, _n, _key)``: ``_key`` is one for rows equal in id, URL and payload."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("_p"), F.col(url_col).cast("string").alias("_u"), F.col(payload_col).alias("_d"), F.sha1(payload).alias("_sha"), F.octet_length(payload).alias("_n"))
    return rows.withColumn("_key", F.sha1(F.concat_ws("|", F.coalesce(F.col("_p").cast("string"), F.lit("-")), "_sha", F.col("_u").isNull().cast("string"), "_u")))


def record_plan(keyed: DataFrame, min_revisit: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(_k, refers_to)`` of the rows that revisit a smaller one, and ``(_k, copies)`` of rows that are there several times."""
    keys = materialize(keyed.select("_key", "_p", "_u", "_sha", "_n"), "payload-keys")
    each = keys.groupBy("_key", "_p", "_u", "_sha", "_n").agg(F.count(F.lit(1)).alias("copies"))
    each = materialize(each, "payload-rows")
    least = F.min(F.struct(F.col("_p").isNull().alias("z"), "_p", F.col("_u").isNull().alias("y"), "_u", "_key")).alias("f")
    first = each.where(F.col("_n") >= min_revisit).groupBy("_sha", "_n").agg(least, F.count(F.lit(1)).alias("rows"))
    first = first.where("rows > 1 and f._p is not null").select("_sha", "_n", F.col("f._p").alias("refers_to"), F.col("f._key").alias("_first"))
    again = each.join(first, ["_sha", "_n"]).where(F.col("_key") != F.col("_first")).select(F.col("_key").alias("_k"), "refers_to")
    return again, each.where("copies > 1").select(F.col("_key").alias("_k"), "copies")


def _head(kind: str, page: int | None, url: str | None, sha: str, size: int, refers: int | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Bytes: {size}"]
    return ("\r\n".join([*lines, f"Content-Length: {0 if refers is not None else size}"]) + "\r\n\r\n").encode()


def _digest(h) -> str:
    return base64.b32encode(h.digest()).decode()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write all rows; returns the manifest ``(path, records, bytes)``."""
    spark = pages.sparkSession
    keyed = _keyed(pages, id_col, url_col, payload_col)
    again, twins = record_plan(keyed, min_revisit)
    twins = materialize(twins, "payload-twins")
    if twins.limit(1).count():
        # Rows equal in id, URL and payload: one is carried, with how many there are, and written so often.
        one = keyed.join(twins, keyed["_key"] == twins["_k"], "left_semi").dropDuplicates(["_key"])
        one = one.join(twins, one["_key"] == twins["_k"]).select(*keyed.columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_turn"))
        keyed = keyed.join(twins, keyed["_key"] == twins["_k"], "left_anti").withColumn("_turn", F.lit(1).cast("long")).union(one)
        later = (F.col("_turn") > 1) & F.col("_p").isNotNull() & (F.col("_n") >= min_revisit)
    else:
        later = F.lit(False)
    rows = keyed.join(again, keyed["_key"] == again["_k"], "left").select("_p", "_u", "_d", F.coalesce("refers_to", F.when(later, F.col("_p"))).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out, records, name = None, 0, f"{root}/{uuid.uuid4().hex}"
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b = batch.slice(k, 64)
                for page, url, text, refers in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(name + ".part", compression=None)
                    data = memoryview((text or "").encode())
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(z.compress(_head("response" if refers is None else "revisit", page, url, _digest(hashlib.sha1(data)), len(data), refers)))
                    if refers is None:
                        for at in range(0, len(data), chunk):
                            out.write(z.compress(data[at : at + chunk]))
                    out.write(z.compress(b"\r\n\r\n") + z.flush())
                    records += 1
        if out is not None:
            size = out.tell()
            out.close()
            store.move(name + ".part", name + ".warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([name + ".warc.gz"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return materialize(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


class _Members:
    """Bytes of a gzip file, member after member, a bounded piece at a time."""

    def __init__(self, stream, piece: int = CHUNK):
        self.stream, self.piece, self.z, self.left, self.held = stream, piece, zlib.decompressobj(31), b"", b""

    def more(self) -> bytes:
        while True:
            if self.z.eof:
                self.left, self.z = self.z.unused_data, zlib.decompressobj(31)
            raw = self.left or self.stream.read(self.piece)
            self.left = b""
            if not raw:
                return b""
            got = self.z.decompress(raw, self.piece)
            self.left = self.z.unconsumed_tail
            if got:
                return got

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end."""
        while mark not in self.held:
            got = self.more()
            if not got:
                return None
            self.held += got
        at = self.held.index(mark) + len(mark)
        out, self.held = self.held[:at], self.held[at:]
        return out

    def take(self, n: int) -> bytes:
        """At most ``n`` bytes, at least one unless the data ends."""
        if not self.held:
            self.held = self.more()
        out, self.held = self.held[:n], self.held[n:]
        return out


def records(stream, chunk: int = CHUNK, with_data: bool = True) -> Iterator[tuple]:
    """``(page, type, refers_to, chunk_no, last, bytes_so_far, digest, data)`` of one archive."""
    src = _Members(stream)
    while (head := src.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().strip().split("\r\n")[1:])
        left = int(fields["Content-Length"])
        number = lambda s: int(s[10:-1]) if s and s[10:-1] else None  # noqa: E731  <urn:page:N>
        page, kind, refers = number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To"))
        if kind == "revisit":
            yield page, kind, refers, 0, True, int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"][5:], b""
        else:
            h, so_far, no = hashlib.sha1(), 0, 0
            while True:
                parts, n = [], 0
                while left and n < chunk:
                    got = src.take(min(left, chunk - n))
                    if not got:
                        raise ValueError("the archive ends inside a record")
                    h.update(got)
                    left -= len(got)
                    n += len(got)
                    if with_data:
                        parts.append(got)
                so_far += n
                yield page, kind, refers, no, not left, so_far, _digest(h), b"".join(parts)
                no += 1
                if not left:
                    break
        end = src.until(b"\r\n\r\n")
        if end != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")


def chunk_table(spark: SparkSession, manifest: DataFrame, scheme: str = "file://", chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest, files dealt to tasks.

    ``with_data`` False leaves the chunks' bytes null, for readers that need digests only.
    """
    tasks = max(1, min(4096, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]
            data = pa.array(c[7] if with_data else [None] * len(rows), pa.binary())
            return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(c, kinds)), data], ["record_id", "record_type", "refers_to", "chunk_no", "is_last", "bytes_so_far", "digest_so_far", "data"])

        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = _store(scheme + path)
                with store.open_input_stream(at, compression=None, buffer_size=CHUNK) as f:
                    rows, held = [], 0
                    for r in records(f, chunk, with_data):
                        rows.append(r)
                        held += len(r[7])
                        if len(rows) >= 4096 or held >= (4 << 20):
                            yield flush(rows)
                            rows, held = [], 0
                    if rows:
                        yield flush(rows)

    files = manifest.select("path").repartition(tasks, "path") if tasks > 1 else manifest.select("path")
    return files.mapInArrow(run, "record_id bigint, record_type string, refers_to bigint, chunk_no int, is_last boolean, bytes_so_far bigint, digest_so_far string, data binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Write archives to the shared folder and describe every record read back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    scheme = folder.split("://")[0] + "://" if "://" in folder else "file://"
    manifest = write_archives(pages, folder, id_col, url_col, payload_col, min_revisit)
    last = chunk_table(spark, manifest, scheme, with_data=False).where("is_last")
    return last.select(F.col("record_id").alias(id_col), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
