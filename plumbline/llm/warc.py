"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, so a frame can be read alone. A
skippable frame at the end holds the seek table of the public seekable format: the
compressed and raw size of each frame. The index maps each record to its bundle, frame
and offset inside the raw frame. Tasks write bundles of their own straight into the given
folder under fresh names; only bundles that the index names count, so what a lost or
repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh_path, join_counted, stage

#: Raw bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME, BUNDLE = 1 << 20, 256 << 20
#: Raw bytes that a task reads back.
READ = 128 << 20
#: Payloads below this are never revisits.
LEAST = 1000
#: Payloads with copies that are told to all tasks at once (a hundred bytes each).
COPIES = 100_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI that driver and executors share."""
    return pyarrow.fs.FileSystem.from_uri(path)


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One response record, or, with refers_to or a payload left out, one revisit record."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {uri}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        *([f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of a raw frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        heads = dict(x.split(": ", 1) for x in lines[1:])
        begin = end + 4
        size = int(heads["Content-Length"])
        yield at, heads, frame[begin : begin + size]
        at = begin + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with the compressed and raw size of each frame."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(f: pa.NativeFile) -> list[tuple[int, int]]:
    """Where each frame of a bundle begins and its compressed size, from the footer alone."""
    end = f.size()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE or flags:
        raise ValueError("no seek table")
    f.seek(end - 9 - 8 * n)
    sizes = [s for s, _ in struct.iter_unpack("<II", f.read(8 * n))]
    out, at = [], 0
    for s in sizes:
        out.append((at, s))
        at += s
    return out


INDEX = "page_id long, bundle string, frame int, offset int, length int"


def _writer(folder: str, date: str, level: int):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True)
        out, name, frames, raw, held, entries = None, "", [], bytearray(), 0, []

        def close_frame() -> None:
            nonlocal held, raw
            if raw:
                data = squeeze.compress(bytes(raw))
                out.write(data)
                frames.append((len(data), len(raw)))
                held += len(data)
                raw = bytearray()

        def close_bundle() -> pa.RecordBatch | None:
            nonlocal out, frames, held, entries
            if out is None:
                return None
            close_frame()
            out.write(seek_table(frames))
            out.close()
            ids, nth, at, size = zip(*entries, strict=True)
            done = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(nth, pa.int32()), pa.array(at, pa.int32()), pa.array(size, pa.int32())],
                names=["page_id", "bundle", "frame", "offset", "length"],
            )
            out, frames, held, entries = None, [], 0, []
            return done

        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), sha1, refers_to, date)
                entries.append((page_id, len(frames), len(raw), len(data)))
                raw += data
                if len(raw) >= FRAME:
                    close_frame()
                if held >= BUNDLE:
                    yield close_bundle()
        if (last := close_bundle()) is not None:
            yield last

    return written


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write a record for every row of pages(page_id, url, html) and return the staged index (schema INDEX).

    The payload is html in UTF-8, empty for null. Of records with equal payloads of LEAST
    bytes or more, those with the largest page_id are responses and the others revisits of
    it; a row with a null page_id, and any row of a group without ids, is a response. Equal
    means an equal SHA-1 digest and length. A null url is left out of the record, control
    characters and spaces in it are percent-encoded. Repeated rows are records of their own.
    Other columns are ignored; an empty table writes no bundle.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha1"))
    size = F.octet_length("html")
    # what is too small to be a copy has a key of its own, so that no key is common by being empty
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id())
    rows = rows.withColumn("key", F.when(size >= LEAST, F.concat_ws(":", "sha1", size)).otherwise(alone))
    twice = rows.where(size >= LEAST).groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    twice = stage(twice.where("n > 1 AND last IS NOT NULL"), "copies")
    # beyond what is broadcast, pages are shuffled by their digests, but for those with very many copies
    rows = rows.join(F.broadcast(twice), "key", "left") if twice.count() <= COPIES else join_counted(rows, twice, "key", how="left")
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    rows = rows.select("page_id", "url", "html", "sha1", refers.alias("refers_to"))
    return stage(rows.mapInArrow(_writer(folder, date, level), INDEX), "warc-index")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Read every frame that the index names and describe its records (schema RECORDS).

    Frames are dealt to tasks one by one, READ bytes or a core's share to each, and found
    through their bundle's seek table; the list of frames is tiny beside what they hold, so
    its own size must not decide on the number of tasks. The
    digest of a response is taken anew from its payload and must agree with its header; a
    revisit has the digest and size of its full payload in its headers.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        name, f, table = None, None, []
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for bundle, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    name, f = bundle, fs.open_input_file(f"{base}/{bundle}")
                    table = read_seek_table(f)
                f.seek(table[frame][0])
                for _, heads, block in parse_records(plain.decompress(f.read(table[frame][1]))):
                    out.append(describe(heads, block))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    frames = index.groupBy("bundle", "frame").agg(F.count(F.lit(1)).alias("n"))
    raw = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = min(raw // FRAME + 1, max(raw // READ + 1, index.sparkSession.sparkContext.defaultParallelism))
    frames = frames.select("bundle", "frame").repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return frames.mapInArrow(described, RECORDS)


def describe(heads: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    def page(uri: str | None) -> int | None:
        return int(x) if uri and (x := uri.removeprefix("<urn:page:").removesuffix(">")) else None

    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(heads["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if heads["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {heads['WARC-Record-ID']}")
    return page(heads["WARC-Record-ID"]), size, digest, heads["WARC-Type"], page(heads.get("WARC-Refers-To"))


def read_record(folder: str, bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry, reading no frame but its own."""
    fs, base = open_fs(folder)
    with fs.open_input_file(f"{base}/{bundle}") as f:
        begin, size = read_seek_table(f)[frame]
        f.seek(begin)
        raw = zstandard.ZstdDecompressor().decompress(f.read(size))
    return next((heads, block) for _, heads, block in parse_records(raw[offset : offset + length]))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives for pages into a fresh shared folder and describe all records as read back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {LEAST} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST} AND page_id < last THEN last END AS refers_to
FROM q
"""
