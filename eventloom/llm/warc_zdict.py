"""WARC archives of individually compressed records under a dictionary embedded in each file."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import dictionary_of, new_folder, open_fs, stored, text_batches

#: Magic number of the skippable frame that holds the dictionary (fixed value of the file format).
DICT_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, size: int, refers: tuple | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP headers only."""
    line = lambda s: "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in s)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {line(url)}")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers:
        head += [f"WARC-Refers-To: <{ID}{refers[0]}>", f"WARC-Profile: {PROFILE}"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {line(refers[1])}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return fields, rest[:size]


class ArchiveWriter:
    """Holds the first records back to build the dictionary from them, then streams."""

    def __init__(self, fs, path: str, level: int, train_bytes: int, dictionary_size: int):
        self.out, self.path, self.level = fs.open_output_stream(path), path, level
        self.train_bytes, self.dictionary_size = train_bytes, dictionary_size
        self.held: list[bytes] | None = []
        self.size = self.records = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.held is None:
            self._put(self.press.compress(data))
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.train_bytes:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        import zstandard

        dictionary = zstandard.ZstdCompressionDict(dictionary_of(self.held, self.dictionary_size))
        packed = zstandard.ZstdCompressor(level=self.level).compress(dictionary.as_bytes())
        self.size = 0
        self._put(struct.pack("<II", DICT_FRAME, len(packed)) + packed)
        self.press = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary)
        held, self.held = self.held, None
        for x in held:
            self._put(self.press.compress(x))

    def close(self) -> None:
        if self.held is not None:
            self._begin()
        self.out.close()


def read_records(stream, piece: int = 1 << 20):
    """Decompressed records of an archive, one after another, with the dictionary of its first frame."""
    import zstandard

    dictionary, rest, first = None, b"", True
    while True:
        while len(rest) < 8 and (more := stream.read(piece)):
            rest += more
        if not rest:
            return
        if first and len(rest) >= 8 and struct.unpack("<I", rest[:4])[0] == DICT_FRAME:
            size = struct.unpack("<I", rest[4:8])[0]
            while len(rest) < 8 + size and (more := stream.read(piece)):
                rest += more
            raw, rest = rest[8 : 8 + size], rest[8 + size :]
            raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw
            dictionary, first = zstandard.ZstdCompressionDict(raw), False
            continue
        first = False
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out = []
        while not frame.eof:
            if not rest and not (rest := stream.read(piece)):
                raise ValueError("an archive is cut off")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    least: int = 1000,
    level: int = 3,
    dictionary_size: int = 65536,
    train_bytes: int = 2_000_000,
    file_bytes: int = 256 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per page and return the archives' manifest (path, n_records).

    Of the records whose payloads are equal (SHA-1 and length) and of at least ``least`` bytes,
    the one with the largest page_id is a response and the others revisit it; smaller payloads
    are all responses. Only digests are grouped, with partial sums before the shuffle; the join
    back to the pages has two plain exchanges, so that a digest of a third of all pages can be
    split. Rows that repeat the largest page_id are responses all; a null page_id is the smallest.
    Null html is empty, a null url leaves the header out. Each file's dictionary is trained on
    its own first ``train_bytes`` of records (this bounds memory and decides the ratio only).
    An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    groups = (
        rows.filter(F.col("size") >= least)
        .groupBy("sha1", F.col("size").alias("payload"))
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("kept"))
        .filter("n > 1 and kept.page_id is not null")
        .select("sha1", "payload", F.col("kept.page_id").alias("to_id"), F.col("kept.url").alias("to_url"))
    )
    groups = stored(groups, "warc-groups", kept=True).withColumnsRenamed({"sha1": "to_sha1"})
    joined = rows.join(groups, (rows["sha1"] == groups["to_sha1"]) & (rows["size"] == groups["payload"]), "left")
    again = F.col("to_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to_id"))
    joined = joined.select("page_id", "url", F.when(again, "").otherwise(F.col("html")).alias("html"), "size", "sha1", F.when(again, F.col("to_id")).alias("to_id"), F.when(again, F.col("to_url")).alias("to_url"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = open_fs(folder)
        part, done, writer = TaskContext.get().partitionId(), [], None
        for ids, urls, texts, sizes, digests, to_ids, to_urls in text_batches(batches, 2):
            lists = (c.to_pylist() for c in (ids, urls, sizes, digests, to_ids, to_urls))
            for page_id, url, size, sha1, to_id, to_url, text in zip(*lists, texts):
                if writer is None:
                    writer = ArchiveWriter(fs, f"{base}/part-{part:06d}-{uuid.uuid4().hex}.warc.zst", level, train_bytes, dictionary_size)
                kind = "response" if to_id is None else "revisit"
                writer.add(record(kind, page_id, url, text.encode(), sha1, size, None if to_id is None else (to_id, to_url), date))
                if writer.size >= file_bytes:
                    writer.close()
                    done.append((f"{folder}/{writer.path.rsplit('/', 1)[1]}", writer.records))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((f"{folder}/{writer.path.rsplit('/', 1)[1]}", writer.records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "n_records"])

    return stored(joined.mapInArrow(run, "path string, n_records long"), "warc-manifest", kept=True)


def read_archives(manifest: DataFrame, most_tasks: int = 10_000) -> DataFrame:
    """Records of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit).

    Length and digest of a response are taken from its payload and checked against its headers.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        number = lambda s: None if s is None or s.endswith(":null>") else int(s[len(ID) + 1 : -1])
        out, held = [], 0
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                with fs.open_input_stream(at) as stream:
                    for data in read_records(stream):
                        fields, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b": ")[2])
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"a payload of {path} is damaged")
                        out.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, number(fields.get("WARC-Refers-To")), payload if kind == "response" else None))
                        held += len(payload)
                        if held > 4_000_000 or len(out) >= 5000:
                            yield emit()
                            out.clear()
                            held = 0
        if out:
            yield emit()

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    files = manifest.select("path")
    return files.repartition(max(1, min(files.count(), most_tasks))).mapInArrow(run, schema)


def op8_warc_zdict(spark, sf_dir: str) -> DataFrame:
    """Per page, read back from the archives: its payload's length and digest, its record type and what it refers to."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT n, h, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY n, h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
  CASE WHEN g.keep IS NULL OR g.keep = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.keep <> p.page_id THEN g.keep END AS refers_to
FROM p LEFT JOIN g ON g.n = p.n AND g.h = p.h
"""
