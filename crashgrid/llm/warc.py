"""WARC archives: a distributed writer and a splittable reader.

Archives are sequences of gzip members, one record each. A reader task owns a
byte range of a file: it looks for the gzip magic, accepts a member if its
header decodes to a WARC record, and reads every record that starts inside
its range to its end, past the range if need be. In an archive with a manifest
records lie one behind the other, so other bytes between them are damage;
damage at a range's edge shows in the number of records.
"""

from __future__ import annotations

import datetime
import uuid
import zlib
from hashlib import sha256
from typing import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_PIECE = 1 << 20

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that the cluster's default file system gives it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target))


#: Names that Hadoop's connectors have and the Arrow file systems do not (fixed values).
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a ``qualified`` folder or file."""
    scheme, mark, rest = uri.partition(":")
    if not mark or "/" in scheme:
        raise ValueError(f"{uri} has no scheme: hosts would read it on different file systems")
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None,
                 refers_url: str | None = None) -> bytes:
    """One gzip member. A revisit has no block; its headers keep the payload's digest and length, the id and address
    of the response's record, and its page id."""
    revisit = refers_to is not None
    block = b"" if revisit else html
    headers = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
               f"WARC-Record-ID: {record_id(page_id, digest)}", "Content-Type: text/html",
               f"WARC-Date: {datetime.datetime(2024, 1, 1).isoformat()}Z",
               f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(html)}"]
    if url is not None:
        headers.append("WARC-Target-URI: " + url.encode("unicode_escape").decode())
    if page_id is not None:
        headers.append(f"X-Page-Id: {page_id}")
    if revisit:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
        if refers_url is not None:
            headers.append("WARC-Refers-To-Target-URI: " + refers_url.encode("unicode_escape").decode())
    headers.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to, refers_url): of equal payloads of ``least_bytes`` and more, all
    but those with the smallest page_id refer to that page_id (and, of several rows with it, to the smallest url).

    A payload's digest stands for it (SHA-256). The pages meet their group's
    smallest id by a join of two stored tables, so adaptive execution can
    split a payload that a third of all pages share.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"),
        F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    first = materialize(first, "first-pages")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(other, F.col("first.page_id")).alias("refers_to"),
        F.when(other, F.col("first.url")).alias("refers_url"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least_bytes: int = 100) -> DataFrame:
    """Write one archive per task under ``path`` (a shared folder); returns (file, n_records, n_bytes).

    A task writes to a name of its own and the manifest lists the files of
    the tasks that succeeded, so leftovers of failed attempts are never read.
    """
    marked = mark_revisits(pages, id_col, url_col, html_col, least_bytes)
    path = qualified(pages.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        out, size, count, name = None, 0, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for i in range(batch.num_rows):  # one payload at a time
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = record_bytes(*(batch.column(j)[i].as_py() for j in range(6)))
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "n_records": [count], "n_bytes": [size]})

    written = marked.mapInArrow(write, "file string, n_records long, n_bytes long")
    return materialize(written, "warc-manifest")


def parse_headers(data: bytes) -> dict[str, str]:
    lines = data.split(b"\r\n")[1:]
    return {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines)}


class _Window:
    """A file seen through one growing buffer, read piece by piece from ``start``."""

    def __init__(self, source, start: int):
        self.source, self.at, self.data, self.ended = source, start, b"", False
        source.seek(start)

    def more(self) -> bool:
        piece = b"" if self.ended else self.source.read(_PIECE)
        self.ended = not piece
        self.data += piece
        return bool(piece)

    def drop(self, count: int) -> None:
        self.at, self.data = self.at + count, self.data[count:]


def read_member(window: _Window) -> tuple[bytes, bytes, int] | None:
    """(header, block, member length) of the record at the window's start; None if there is none.

    A false magic fails soon: its bytes do not inflate, or not to a WARC
    version line.
    """
    packer, plain, used, fed = zlib.decompressobj(31), b"", 0, 0
    parts: list[bytes] = []
    while not packer.eof:
        if fed == len(window.data) and not window.more():
            return None
        try:
            parts.append(packer.decompress(window.data[fed:]))
        except zlib.error:
            return None
        fed = len(window.data)
        if len(plain) < len(VERSION):
            plain += parts[-1][:len(VERSION)]
            if not VERSION.startswith(plain[:len(VERSION)]) and not plain.startswith(VERSION):
                return None
    used = fed - len(packer.unused_data)
    whole = b"".join(parts)
    head, mark, rest = whole.partition(b"\r\n\r\n")
    if not mark or not head.startswith(VERSION):
        return None
    return head, rest, used


def records_in(source, start: int, end: int, strict: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record whose first byte lies in [start, end).

    Bytes between records that are none are passed over; ``strict`` raises
    ``ValueError`` there, where each record should start behind the last.
    """
    window, expected = _Window(source, start), None
    while window.at < end:
        if strict and expected is not None and not window.data and not window.more():
            return
        found = window.data.find(MAGIC)
        if found < 0:
            keep = min(len(MAGIC) - 1, len(window.data))
            window.drop(len(window.data) - keep)
            if not window.more():
                return
            continue
        window.drop(found)
        if strict and expected is not None and window.at != expected:
            raise ValueError(f"no record where one should start, at byte {expected}")
        if window.at >= end:
            return
        member = read_member(window)
        if member is None:
            if strict and expected is not None:
                raise ValueError(f"damaged record at byte {window.at}")
            window.drop(1)
            continue
        head, rest, used = member
        headers = parse_headers(head)
        yield headers, rest[:int(headers["content-length"])]
        window.drop(used)
        expected = window.at


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = 8 << 20,
              with_payload: bool = False) -> DataFrame:
    """Records of the archives listed in ``manifest(file, n_bytes)``, read in byte ranges.

    Columns of ``RECORD``, plus ``payload`` (binary; null for revisits) on
    request. Payload length and digest of responses are taken from the bytes
    read; a response whose digest does not fit its header raises. If the manifest
    has ``n_records``, bytes between two records raise as well, and the records
    are stored and counted: a file that gave another number raises
    ``ValueError``. Revisits state length and digest of the payload they refer
    to. Each task reads one range of ``split_bytes``; the split size does not
    change the result.
    """
    counted = "n_records" in manifest.columns
    rows = _read_ranges(manifest, split_bytes, with_payload, strict=counted)
    if counted:
        rows = materialize(rows, "warc-records")
        read = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_read"))
        short = manifest.select("file", "n_records").join(read, "file", "left").where(
            F.coalesce("n_read", F.lit(0)) != F.col("n_records"))
        bad = short.orderBy("file").limit(3).collect()
        if bad:
            raise ValueError("damaged archives: " + "; ".join(
                f"{r['file']} has {r['n_records']} records, {r['n_read'] or 0} were read" for r in bad))
    return rows.drop("file")


def _read_ranges(manifest: DataFrame, split_bytes: int, with_payload: bool, strict: bool) -> DataFrame:
    """``file`` and the columns of ``read_warc``."""
    ranges = manifest.select("file", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0).cast("long")),
        F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1)
    ranges = ranges.repartition(int(tasks), "file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file"] + [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * with_payload
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            for file, start in zip(*(batch.column(j).to_pylist() for j in (0, 1)), strict=True):
                store, name = open_store(file)
                with store.open_input_file(name) as source:
                    rows, size = [], 0
                    for headers, block in records_in(source, start, start + split_bytes, strict):
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        kind = headers["warc-type"]
                        if kind == "response" and sha256(block).hexdigest() != digest:
                            raise ValueError(f"{file}: payload of {headers['warc-record-id']} is damaged")
                        url, refers = headers.get("warc-target-uri"), headers.get("x-refers-to-page-id")
                        page = headers.get("x-page-id")
                        length = len(block) if kind == "response" else int(headers["x-payload-length"])
                        rows.append((file, page and int(page), url if url is None else url.encode().decode("unicode_escape"),
                                     kind, refers and int(refers), length, digest)
                                    + ((block if kind == "response" else None,) if with_payload else ()))
                        size += len(block) * with_payload + 300
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                                zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                            zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.mapInArrow(read, "file string, " + RECORD + ", payload binary" * with_payload)


def archive_roundtrip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html", split_bytes: int = 8 << 20) -> DataFrame:
    """Write ``pages`` as archives under ``path``, read them back: one row of ``RECORD`` per page.

    A null html is an empty payload. Rows that share the smallest page_id of
    their payload (repeated rows) are all responses; a null page_id refers to
    the smallest other one, and if a payload has only null ids, its records
    are responses. Payloads of under 100 bytes are responses. Other columns
    are not archived; an empty table writes no file and gives no rows.
    """
    return read_warc(pages.sparkSession, write_warc(pages, path, id_col, url_col, html_col), split_bytes)
