"""WARC archives with Zstandard dictionaries: writer and reader (operator 9).

An archive is a skippable frame that holds the dictionary, then one Zstandard frame for each
record. Archives are .warc.zst files in a folder that every executor can reach (`write_files`,
`read_files`, over any file system that pyarrow knows), or rows (name, content) as Spark's
binaryFile source gives them (`write_archives`, `read_archives`, `open_files`).

The reader takes the dictionary from the leading skippable frame and goes from frame to frame:
a frame's length is known from its block headers before anything is decompressed, so an archive
is read once, front to back, with memory for one record. It checks of each record: version line,
required headers, Content-Length against the block, the closing blank lines, the HTTP head's
length and the payload digest. What is broken becomes a row with its offset and `error`; behind
a broken frame reading goes on at the next frame that starts with the magic number.

Files are named by the task that writes them. Only files that a finished task has listed are
read, so what a lost executor left behind, or a repeated task wrote again, does not count.

Of records with equal payloads of at least `revisit_from` bytes the one with the largest id is
a response and the others are revisits of it, which store no payload.

Defined cases: a null payload counts as empty; rows that repeat the largest id and payload are
all responses; rows without an id revisit one that has it, and are responses if none has. An
empty archive has no records.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import bounded, cut, join_counted, pick, read

REVISIT_FROM = 1000
ARCHIVE_BYTES = 256 << 20
#: A file's dictionary is learnt from its first records, of so many bytes together.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_FRAME = 0x184D2A5D
_MAGIC = b"\x28\xb5\x2f\xfd"
MAX_RECORD, MAX_DICTIONARY = 1 << 31, 64 << 20
_READ = 1 << 18
LEVEL = 3
_REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_RECORDS = "name string, number long, record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, offset long, error string"


class BadRecord(ValueError):
    pass


def sha1_hex(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def write_record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: a response holds an HTTP head and the payload, a revisit only the head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    clean = "".join(c for c in uri if c not in "\r\n")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record, or BadRecord."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[: max(0, end)].split(b"\r\n")
    if end < 0 or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord("no WARC version line or no end of headers")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord(f"header without a colon: {line[:60]!r}")
        fields[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if missing := [k for k in _REQUIRED if k.lower() not in fields]:
        raise BadRecord(f"missing headers: {', '.join(missing)}")
    if not fields["content-length"].isdigit():
        raise BadRecord("Content-Length is no number")
    size = int(fields["content-length"])
    block, tail = raw[end + 4 : end + 4 + size], raw[end + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise BadRecord(f"Content-Length is {size}, the record has {len(raw) - end - 4} bytes after its headers")
    kind = fields["warc-type"]
    out = {"record_type": kind, "record_id": fields["warc-record-id"].strip("<>"), "uri": fields.get("warc-target-uri"), "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
    payload, length = block, size
    if fields.get("content-type", "").startswith("application/http"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        lengths = [x.partition(b":")[2].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        if not blank or not head.startswith(b"HTTP/") or len(lengths) != 1 or not lengths[0].isdigit():
            raise BadRecord("broken HTTP head")
        length = int(lengths[0])
    if kind == "revisit":
        if payload:
            raise BadRecord("a revisit with a payload")
        if not out["refers_to"] or not digest:
            raise BadRecord("a revisit without WARC-Refers-To or a digest")
        payload = None
    else:
        if length != len(payload):
            raise BadRecord(f"the HTTP length is {length}, the payload has {len(payload)} bytes")
        if digest and sha1_hex(payload) != digest:
            raise BadRecord("the payload doesn't match its digest")
        digest = digest or sha1_hex(payload)
    return out | {"payload": payload, "payload_bytes": length, "payload_digest": digest}


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or b"" where there is too little to learn from."""
    if len(samples) < 16 or sum(map(len, samples)) < 4 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _coder(records: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressor]:
    """An archive's leading frame, and its compressor: the dictionary is learnt from records spread evenly over those given."""
    step = max(1, len(records) // 400)
    trained = train([r[:16384] for r in records[::step]])
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True) if trained else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(trained) if trained else b""
    return struct.pack("<II", DICTIONARY_FRAME, len(stored)) + stored, coder


def pack(records: list[bytes]) -> bytes:
    """One archive, in memory."""
    head, coder = _coder(records)
    return b"".join([head, *map(coder.compress, records)])


class _Frames:
    """Frames of a file that is read once, front to back."""

    def __init__(self, file, most: int):
        self.file, self.most = file, most
        self.held, self.at = bytearray(), 0  # what has been read and not been passed; its offset
        self.known = None

    def _has(self, n: int) -> bool:
        while len(self.held) < n and (got := self.file.read(max(_READ, n - len(self.held)))):
            self.held += got
        return len(self.held) >= n

    def _pass(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.at += len(self.held)
            self.held.clear()
            if not self._has(1):
                return
        del self.held[:n]
        self.at += n

    def _length(self) -> int:
        """Length of the frame that starts here, from its block headers."""
        if not self._has(5):
            raise BadRecord("the frame is cut short")
        flags = self.held[4]
        single = flags >> 5 & 1
        size = 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if not self._has(size + 3):
                raise BadRecord("the frame is cut short")
            block = int.from_bytes(self.held[size : size + 3], "little")
            last, kind = bool(block & 1), block >> 1 & 3
            if kind == 3:
                raise BadRecord("a block of no known kind")
            size += 3 + (1 if kind == 1 else block >> 3)
            if size > self.most:
                raise BadRecord(f"a record of more than {self.most} bytes")
        size += 4 * (flags >> 2 & 1)
        if not self._has(size):
            raise BadRecord("the frame is cut short")
        return size

    def _content(self, frame: bytes) -> bytes:
        coder = zstandard.ZstdDecompressor(dict_data=self.known) if self.known else zstandard.ZstdDecompressor()
        try:
            size = zstandard.frame_content_size(frame)
            if size > self.most:
                raise BadRecord(f"a record of {size} bytes")
            if size >= 0:
                return coder.decompress(frame)
            raw = coder.stream_reader(frame).read(self.most + 1)
        except zstandard.ZstdError as e:
            raise BadRecord(str(e)) from e
        if len(raw) > self.most:
            raise BadRecord(f"a record of more than {self.most} bytes")
        return raw

    def _dictionary(self) -> None:
        size = struct.unpack_from("<I", self.held, 4)[0]
        if size > MAX_DICTIONARY or not self._has(8 + size):
            raise BadRecord("the dictionary frame is cut short or too large")
        stored = bytes(self.held[8 : 8 + size])
        if stored[:4] == _MAGIC:
            try:
                stored = zstandard.ZstdDecompressor().decompress(stored, max_output_size=MAX_DICTIONARY)
            except zstandard.ZstdError as e:
                raise BadRecord(f"the dictionary: {e}") from e
        self.known = zstandard.ZstdCompressionDict(stored) if stored else None
        self._pass(8 + size)

    def _next_magic(self) -> None:
        """Go on to the next place that looks like a frame, or to the end."""
        self._pass(1)
        while self._has(4):
            place = self.held.find(_MAGIC)
            if place >= 0:
                self._pass(place)
                return
            self._pass(len(self.held) - 3)
        self._pass(len(self.held))

    def records(self):
        """(offset, bytes, None), or (offset, None, error), of every frame."""
        if self._has(8) and struct.unpack_from("<I", self.held)[0] == DICTIONARY_FRAME:
            try:
                self._dictionary()
            except BadRecord as e:
                yield 0, None, str(e)
                return
        while self._has(1):
            at = self.at
            if self._has(8) and struct.unpack_from("<I", self.held)[0] & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
                self._pass(8 + struct.unpack_from("<I", self.held, 4)[0])
                continue
            try:
                if not self._has(4) or bytes(self.held[:4]) != _MAGIC:
                    raise BadRecord("no frame starts here")
                size = self._length()
            except BadRecord as e:
                yield at, None, str(e)
                self._next_magic()
                continue
            frame = bytes(memoryview(self.held)[:size])
            self._pass(size)
            try:
                yield at, self._content(frame), None
            except BadRecord as e:
                yield at, None, str(e)


def unpack(content: bytes, most: int = MAX_RECORD):
    """Yield the bytes of every record of an archive in memory; BadRecord at the first broken one."""
    for at, raw, error in _Frames(io.BytesIO(content), most).records():
        if error:
            raise BadRecord(f"byte {at}: {error}")
        yield raw


def revisits(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(id, uri, payload, bytes, digest, response_id): response_id is null for responses."""
    base = pick(pages, id=id_col, uri=uri_col, payload=payload_col).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    base = base.select("id", "uri", "payload", F.length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"))
    same = base.where(F.col("bytes") >= revisit_from).groupBy("digest", "bytes").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null")
    found = join_counted(base, cut(same.select("digest", "bytes", "best")), ["digest", "bytes"])
    return found.select("id", "uri", "payload", "bytes", "digest", F.when(~F.col("id").eqNullSafe(F.col("best")), F.col("best")).alias("response_id"))


def _record(row: dict) -> bytes:
    kind = "revisit" if row["response_id"] is not None else "response"
    return write_record(kind, f"urn:page:{'' if row['id'] is None else row['id']}", row["uri"] or "", row["payload"], row["digest"], row["bytes"], f"urn:page:{row['response_id']}")


def write_archives(records: DataFrame, archive_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(name, content) of archives of about archive_bytes uncompressed bytes, from the rows of `revisits`."""

    def run(batches):
        held, size = [], 0

        def archive():
            name = hashlib.sha1(b"".join(hashlib.sha1(r).digest() for r in held)).hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.zst"]), pa.array([pack(held)], pa.binary())], names=["name", "content"])

        for b in bounded(batches):
            for row in b.to_pylist():
                held.append(_record(row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return records.mapInArrow(run, "name string, content binary")


def _file_system(folder: str):
    """pyarrow's file system and path of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def write_files(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of `revisits` to .warc.zst files of about archive_bytes uncompressed bytes; (name, records) of the files.

    Each file is written record by record; only the first SAMPLE_BYTES are held, to learn its
    dictionary from. The result is cut: its files are complete and listed once."""

    def run(batches):
        system, path = _file_system(folder)
        system.create_dir(path)
        records = (_record(row) for b in bounded(batches) for row in b.to_pylist())
        while True:
            held, size = [], 0
            for r in records:
                held.append(r)
                size += len(r)
                if size >= min(SAMPLE_BYTES, archive_bytes):
                    break
            if not held:
                return
            name = f"{uuid.uuid4().hex}.warc.zst"
            head, coder = _coder(held)
            with system.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(head)
                for r in held:
                    out.write(coder.compress(r))
                number, held = len(held), []
                while size < archive_bytes and (r := next(records, None)) is not None:
                    out.write(coder.compress(r))
                    number, size = number + 1, size + len(r)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64())], names=["name", "records"])

    return cut(records.mapInArrow(run, "name string, records long"))


_NAMES = ["name", "number", "record_id", "record_type", "uri", "refers_to", "payload_bytes", "payload_digest", "payload", "offset", "error"]
_KINDS = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]


def _rows(name: str, file, keep_payload: bool, most: int):
    """Arrow batches of the records of one archive."""
    rows, size = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(_NAMES, _KINDS)], names=_NAMES)
    for number, (at, raw, error) in enumerate(_Frames(file, most).records()):
        row = {"name": name, "number": number, "offset": at, "error": error}
        if raw is not None:
            try:
                row |= parse_record(raw)
            except BadRecord as e:
                row["error"] = str(e)
            if not keep_payload:
                row["payload"] = None
            size += len(row.get("payload") or b"")
        rows.append(row)
        if size > 4 << 20 or len(rows) >= 4096:
            yield out()
            rows, size = [], 0
    if rows:
        yield out()


def read_archives(archives: DataFrame, name_col: str = "name", content_col: str = "content", keep_payload: bool = True, most: int = MAX_RECORD) -> DataFrame:
    """A row for every record of archives held in rows; `error` is null where all checks passed."""

    def run(batches):
        for b in bounded(batches):
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _rows(name, io.BytesIO(content or b""), keep_payload, most)

    return pick(archives, name=name_col, content=content_col).mapInArrow(run, _RECORDS)


def read_files(files: DataFrame, folder: str, name_col: str = "name", keep_payload: bool = True, most: int = MAX_RECORD) -> DataFrame:
    """The same of the files of a folder that `files` names, each read as a stream; partitions are those of `files`."""

    def run(batches):
        system, path = _file_system(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with system.open_input_stream(f"{path}/{name}", compression=None) as file:
                    yield from _rows(name, file, keep_payload, most)

    return pick(files, name=name_col).mapInArrow(run, _RECORDS)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives from .warc.zst files, whole, for `read_archives`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("name"), "content")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    files = write_files(revisits(read(spark, sf_dir, "pages")), folder)
    got = read_files(files, folder, keep_payload=False)
    whole = lambda c: F.when(F.col("error").isNull(), F.col(c)).otherwise(F.raise_error(F.concat_ws(" ", "name", "offset", "error")))
    number = lambda c: F.expr(f"try_cast(nullif(replace({c}, 'urn:page:', ''), '') as bigint)")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", whole("payload_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT payload_digest, max(page_id) AS best FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM q LEFT JOIN w USING (payload_digest)
"""
