"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive (.warc.zst) begins with a skippable frame that holds the dictionary, itself a Zstandard frame or not;
each record after it is one frame compressed with that dictionary. The reader loads the
dictionary, decodes a frame at a time, and checks the version line, the named fields, the block's
length and digest, the payload's digest and the blank lines at the end; anything else is an error that
names the archive and the place.

Records with equal payloads: that with the largest page id is the response and the others are revisits that
refer to it and hold no payload. The response of each payload comes from a grouped maximum (combined
before the shuffle) and a join on the digest that deals the copies of a common payload to several tasks.

Each task writes archives of about `archive_bytes` into the shared folder under a name with the task's
attempt and moves them into place whole; only archives named in the manifest, which comes from
tasks that succeeded, are read.

Bytes of a url that aren't UTF-8 count as U+FFFD; payloads keep theirs. A null html is an empty payload; a null url has no target field; a null page id has no id field, never becomes
the response where others are, and revisits like others. Of repeated rows with the largest id each is a response.
Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_row, join_one, materialise, own_folder, release, ship, texts_of, utf8

#: Fixed values of the format: the dictionary's skippable frame, a Zstandard frame, a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 32 << 20
#: Bytes of the first records that a dictionary is trained on, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
MAX_DICTIONARY = 64 << 20
#: Bytes that the decoder gets at once: what is left of them after a record is copied.
SLICE = 4 << 10


class WarcError(ValueError):
    """An archive that isn't as the format asks."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page that it refers to."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, payload_digest)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{payload_digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, payload_digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, where: str) -> dict[str, object]:
    """The fields of one record, by name in lower case, with `block` and `payload`; raises WarcError."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not blank or first not in (b"WARC/1.0", VERSION):
        raise WarcError(f"{where}: no version line")
    fields: dict[str, object] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip() or (key := name.decode("ascii", "replace").lower()) in fields:
            raise WarcError(f"{where}: bad field {line[:60]!r}")
        fields[key] = value.strip().decode("utf-8", "replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{where}: no {name}")
    if not str(fields["content-length"]).isdecimal():
        raise WarcError(f"{where}: bad content-length")
    n = int(str(fields["content-length"]))
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"{where}: content-length {n}, block and end {len(rest)}")
    if (own := fields.get("warc-block-digest")) and own != f"sha1:{digest(block)}":
        raise WarcError(f"{where}: block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if str(fields.get("content-type", "")).startswith("application/http"):
        lengths = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        fields["payload_bytes"] = int(lengths[0]) if lengths and lengths[0].isdigit() else len(payload)
    else:
        payload = block
        fields["payload_bytes"] = len(payload)
    if fields["warc-type"] == "response":
        if fields["payload_bytes"] != len(payload):
            raise WarcError(f"{where}: payload length")
        if (own := fields.get("warc-payload-digest")) and own != f"sha1:{digest(payload)}":
            raise WarcError(f"{where}: payload digest")
    return fields | {"block": block, "payload": payload}


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for records like these; of few or short samples, the samples themselves."""
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY_BYTES] or b"\r\n\r\n"


def write_archive(out: BinaryIO, records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES) -> tuple[int, bool]:
    """Write records until the archive has this size; the number of records, and whether some may be left."""
    samples, size = [], 0
    for x in records:
        samples.append(x)
        size += len(x)
        if size >= SAMPLE_BYTES:
            break
    if not samples:
        return 0, False
    data = trained_dictionary([x[: 64 << 10] for x in samples])
    packed = zstandard.ZstdCompressor(level=9).compress(data)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)
    n, written = 0, 8 + len(packed)

    def put(x: bytes) -> None:
        nonlocal n, written
        frame = compressor.compress(x)
        out.write(frame)
        n += 1
        written += len(frame)

    for x in samples:
        put(x)
    for x in records:
        put(x)
        if written >= archive_bytes:
            return n, True
    return n, False


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it; Spark's names for object stores are known."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", root))


class _Feed:
    """A stream with a place to go on from, and back to."""

    def __init__(self, source: BinaryIO, chunk: int) -> None:
        self.source, self.chunk = source, chunk
        self.data, self.at, self.base = b"", 0, 0  # base: where data begins in the stream

    @property
    def place(self) -> int:
        return self.base + self.at

    def look(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.data) - self.at < n:
            new = self.source.read(self.chunk)
            if not new:
                break
            self.base += self.at
            self.data, self.at = self.data[self.at :] + new, 0
        return self.data[self.at : self.at + n]

    def skip(self, n: int) -> None:
        self.at += n


def read_archive(source: BinaryIO, name: str = "archive", chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, a frame at a time."""
    feed, dictionary = _Feed(source, chunk), None
    head = feed.look(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        n = struct.unpack("<I", head[4:])[0]
        if n > MAX_DICTIONARY:
            raise WarcError(f"{name}: a dictionary of {n} bytes")
        feed.skip(8)
        own = feed.look(n)
        if len(own) < n:
            raise WarcError(f"{name}: the dictionary's frame is cut off")
        feed.skip(n)
        if own[:4] == FRAME_MAGIC:
            try:
                own = zstandard.ZstdDecompressor().decompressobj().decompress(own)
            except zstandard.ZstdError as e:
                raise WarcError(f"{name}: the dictionary: {e}") from e
        dictionary = zstandard.ZstdCompressionDict(own)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while head := feed.look(8):
        place = feed.place
        if len(head) == 8 and 0x184D2A50 <= struct.unpack("<I", head[:4])[0] <= 0x184D2A5F:  # another skippable frame
            n = 8 + struct.unpack("<I", head[4:])[0]
            while n:
                own = len(feed.look(min(n, chunk)))
                if not own:
                    raise WarcError(f"{name}, byte {place}: a skippable frame is cut off")
                feed.skip(own)
                n -= own
            continue
        if head[:4] != FRAME_MAGIC:
            raise WarcError(f"{name}, byte {place}: no frame begins here")
        frame, out = decompressor.decompressobj(), []
        try:
            while not frame.eof:
                own = feed.look(SLICE)
                if not own:
                    raise WarcError(f"{name}, byte {place}: a frame is cut off")
                out.append(frame.decompress(own))
                feed.skip(len(own) - len(frame.unused_data))
        except zstandard.ZstdError as e:
            raise WarcError(f"{name}, byte {place}: {e}") from e
        yield b"".join(out)


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])
DIGESTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_digest", pa.string())])


def write_pages(pages: DataFrame, root: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of pages into archives under root; the manifest: path and number of records.

    Payloads of fewer than least_bytes are never revisited.
    """
    ship(pages.sparkSession)
    own = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))

    def digests(columns: dict[str, pa.Array]) -> dict[str, object]:
        return {n: columns[n] for n in ("page_id", "url", "html")} | {"payload_digest": [digest(x) for x in utf8(columns["html"])]}

    digested = own.mapInArrow(by_row(digests, DIGESTS), "page_id long, url string, html string, payload_digest string")
    shared = F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes
    chosen = digested.where(shared).groupBy("payload_digest").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1")
    chosen = materialise(chosen, "payloads")
    joined = join_one(digested, chosen.select("payload_digest", "chosen"), "payload_digest", "left", chosen, F.xxhash64("page_id", "url"))
    refers = F.when(shared & F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen")), F.col("chosen"))
    ready = joined.select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        context = TaskContext.get()
        name = f"{base}/pages-{context.partitionId():06d}-{context.taskAttemptId()}"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html, payload_digest, refers_to in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), utf8(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    yield record(page_id, url, html, payload_digest, refers_to)

        left, number, own = True, 0, records()
        store.create_dir(base, recursive=True)
        while left:
            path = f"{name}-{number:04d}.warc.zst"
            with store.open_output_stream(path + ".part", compression=None) as out:
                n, left = write_archive(out, own, archive_bytes)
            if n:
                store.move(path + ".part", path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], schema=MANIFEST)
            else:
                store.delete_file(path + ".part")
            number += 1

    manifest = materialise(ready.mapInArrow(write, "path string, records long"), "manifest")
    release(chosen)
    return manifest


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary())])
RECORDS_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, payload binary"


def _rows(data: Iterator[bytes], name: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORDS, strict=True)], schema=RECORDS)

    for i, x in enumerate(data):
        r = parsed(x, f"{name}, record {i}")
        own, refers = r.get("x-page-id"), r.get("x-refers-to-page-id")
        payload_digest = str(r.get("warc-payload-digest", "")).removeprefix("sha1:") or digest(r["payload"])
        rows.append((int(own) if own is not None else None, r.get("warc-target-uri"), r["warc-type"], r["payload_bytes"], payload_digest, int(refers) if refers is not None else None, r["warc-record-id"], r["payload"] if payloads else None))
        size += len(x)
        if len(rows) >= 1000 or size > 8 << 20:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def read(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that a table of paths in root's file system names, a task for each few archives; every record is checked."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    yield from _rows(read_archive(source, path), path, payloads)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n, "path").mapInArrow(run, RECORDS_SCHEMA)


def round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages into archives in the shared folder and read them back, without the payloads."""
    root = own_folder(pages.sparkSession, "warc")
    return read(write_pages(pages, root, least_bytes=least_bytes, archive_bytes=archive_bytes), root, payloads=False).drop("payload")
