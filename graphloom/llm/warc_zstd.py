"""WARC archives under Zstandard: a skippable frame with the dictionary, then one frame for each record.

The writer turns page rows into archives in the shared folder; only archives that a finished task has listed are read, so
a retried task leaves no second copy. The reader walks the frames by their headers, checks each record's headers, lengths
and digest, and gives back one row for each record.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.id_bits import flag_listed
from graphloom.storage import fresh_path, materialize

#: Format constants: the skippable frame that holds a WARC dictionary, any Zstandard frame, and a compressed dictionary.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Compressed bytes after which a task begins a new archive; records sampled for a dictionary; its size.
ARCHIVE_BYTES, SAMPLE, DICTIONARY_BYTES = 32 << 20, 256, 32 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at a place, from its header and block headers alone."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise WarcError("no Zstandard frame where a record begins")
    flags, p = data[at + 4], at + 5
    single = flags >> 5 & 1
    p += (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if p + 3 > len(data):
            raise WarcError("frame ends within a block header")
        head = data[p] | data[p + 1] << 8 | data[p + 2] << 16
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("reserved block type")
        p += 3 + (1 if kind == 1 else size)
    p += 4 * (flags >> 2 & 1)
    if p > len(data):
        raise WarcError("frame ends early")
    return p - at


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP head alone."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one whole record; WarcError where headers, lengths or the payload's digest do not agree."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"malformed header {line!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields):
        raise WarcError(f"headers missing: {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError("record length differs from Content-Length")
    out = {"type": fields["warc-type"], "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "digest": fields.get("warc-payload-digest", ""), "payload": b""}
    if out["type"] in ("response", "revisit"):
        http, gap, body = rest[:length].partition(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        if not gap or not http.startswith(b"HTTP/") or not size:
            raise WarcError("no HTTP head in the block")
        out |= {"payload": body, "payload_bytes": int(size[1])}
        if out["type"] == "response":
            if len(body) != out["payload_bytes"]:
                raise WarcError("payload length differs from the HTTP head's")
            if out["digest"] != "sha256:" + hashlib.sha256(body).hexdigest():
                raise WarcError("payload digest differs")
        elif fields.get("warc-profile") != REVISIT or not out["refers_to"] or body:
            raise WarcError("malformed revisit record")
    return out


def make_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or where the records are too few for training their own bytes as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY_BYTES].ljust(8, b" ")


def write_archive(records: Iterator[bytes], limit: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Bytes of one archive, piece by piece, until limit; each has a dictionary from its first records."""
    import zstandard

    sample, weight = [], 0
    for record in records:
        sample.append(record)
        weight += len(record)
        if len(sample) >= SAMPLE or weight > 64 * DICTIONARY_BYTES:
            break
    if not sample:
        return
    dictionary = make_dictionary(sample)
    packed = zstandard.ZstdCompressor(level=9, write_checksum=True).compress(dictionary)
    yield struct.pack("<II", SKIPPABLE, len(packed)) + packed
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    size = 0
    for record in sample:
        frame = coder.compress(record)
        size += len(frame)
        yield frame
    while size < limit:
        record = next(records, None)
        if record is None:
            return
        frame = coder.compress(record)
        size += len(frame)
        yield frame


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of an archive held in memory (archives are bounded by the writer's limit plus one record)."""
    import zstandard

    view = memoryview(data)
    if len(view) < 8:
        raise WarcError("archive ends within its first frame")
    magic, size = struct.unpack_from("<II", view, 0)
    at, dictionary = 0, None
    if magic == SKIPPABLE:
        raw = bytes(view[8 : 8 + size])
        if len(raw) != size:
            raise WarcError("archive ends within its dictionary")
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        if 0x184D2A50 <= struct.unpack_from("<I", view, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        size = frame_size(view, at)
        try:
            record = decoder.decompress(view[at : at + size])
        except zstandard.ZstdError as cause:
            raise WarcError(f"frame cannot be decoded: {cause}") from cause
        yield parse_record(record)
        at += size


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the smallest page_id with an equal payload of at least
    min_bytes, null for that page itself and for smaller payloads. Rows with a null page_id are always responses and rows
    that repeat a page_id and payload are alike. Null html is empty. Other columns are ignored, so no name can clash; an empty table
    gives an empty result. Payloads stay where they are, but for pages that may be revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    keys = rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to <> last").drop("last")
    revisits = materialize(keys.join(firsts, "digest").where("page_id <> refers_to").distinct(), "warc-revisits")
    flagged = flag_listed(rows, revisits, "page_id", "listed")
    names = ("page_id", "url", "html", "digest", "refers_to")
    moved = flagged.where("listed").join(revisits, ["page_id", "digest"], "left").select(*names)
    return flagged.where("not listed").withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(moved)


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write rows of mark_revisits() as archives into folder (any file system that pyarrow reaches); returns (path, records)."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        count = 0

        def records():
            nonlocal count
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    count += 1
                    yield write_record(page_id, url, html.encode(), digest, refers_to)

        source, paths, counts, done = records(), [], [], False
        while not done:
            before, pieces = count, write_archive(source)
            first = next(pieces, None)
            if first is None:
                break
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as file:
                file.write(first)
                for piece in pieces:
                    file.write(piece)
            paths.append(name)
            counts.append(count - before)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return materialize(marked.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the listed archives: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and payload (null for revisits). A record that breaks the format, or a wrong count, fails the read."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)

        def number(name):
            found = re.fullmatch(r"<urn:page:(-?\d+|null)>", name or "")
            return None if not found or found[1] == "null" else int(found[1])

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{path}") as file:
                    data = file.read()
                rows, weight, count = [], 0, 0
                for r in read_archive(data):
                    rows.append((number(r["id"]), r["uri"], r["payload_bytes"], r["digest"].removeprefix("sha256:"), r["type"], number(r["refers_to"]), r["payload"] if r["type"] == "response" else None))
                    count += 1
                    weight += len(r["payload"])
                    if weight > 4 << 20 or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, weight = [], 0
                if rows:
                    yield batch_of(rows)
                if count != expected:
                    raise WarcError(f"{path} has {count} records, not {expected}")

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks, "path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def warc_roundtrip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages, min_bytes=min_bytes), folder), folder)
