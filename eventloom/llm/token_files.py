"""Token-id files: one Zstandard frame per document under a shared trained dictionary.

A file holds, in ascending document order: an 8-byte mark, the SHA-256 of the dictionary, the
width of an id in bytes (2 or 4, u32); the frames; the index (per document its id i64, a null
flag u8, offset u64, frame size u32, number of ids u64, each field as one array); and a footer
of index offset u64, number of documents u64 and the mark again. One short document is read
with the footer, the index and its own frame. The dictionary lies beside the files as
``dictionary-<hash>.zdict``.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from eventloom.llm.bpe_words import default_vocabulary, encoder
from eventloom.llm.common import dictionary_of, new_folder, open_fs, stored, text_batches

MARK = b"EVTOKID1"
FIELDS = (("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("count", "<u8"))


def train_dictionary(docs: DataFrame, vocabulary: str, width: int, end_id: int, sample: int, size: int, most_bytes: int = 16384) -> bytes:
    """A dictionary from the serialised ids of about ``sample`` documents, picked by a hash of their id, ``most_bytes`` of each.

    Only the compression ratio depends on it. Of a longer document a run of ids at a place given by
    its length is taken, so the driver gets at most 4 * ``sample`` * ``most_bytes`` bytes.
    """
    every = max(1, docs.count() // sample)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def run(batches):
        import pyarrow as pa

        coder = encoder(vocabulary)
        for _, texts in text_batches(batches):
            ids, count = coder.encode(texts)
            at = np.concatenate([[0], np.cumsum(count)])
            out = [serialise(ids[a:b], end_id, width) for a, b in zip(at, at[1:])]
            first = [len(x) * 7919 % (len(x) - most_bytes) // width * width if len(x) > most_bytes else 0 for x in out]
            yield pa.RecordBatch.from_arrays([pa.array([x[k : k + most_bytes] for x, k in zip(out, first)], pa.binary())], ["data"])

    blobs = [bytes(r.data) for r in picked.mapInArrow(run, "data binary").limit(4 * sample).collect()]
    return dictionary_of(blobs, size) if blobs else b""


def serialise(ids: np.ndarray, end_id: int, width: int) -> bytes:
    return np.append(ids, end_id).astype(f"<u{width}").tobytes()


class FileWriter:
    """Streams frames to a file under a name of its own; ``close`` writes the index."""

    def __init__(self, fs, path: str, dictionary: bytes, width: int, level: int):
        import zstandard

        self.fs, self.path = fs, path
        self.out = fs.open_output_stream(path)
        self.width = width
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.press = zstandard.ZstdCompressor(level=level, dict_data=data)
        head = MARK + hashlib.sha256(dictionary).digest() + struct.pack("<I", width)
        self.out.write(head)
        self.at = len(head)
        self.index: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        frame = self.press.compress(data)
        self.out.write(frame)
        n = len(data) // self.width
        self.index.append((doc_id or 0, doc_id is None, self.at, len(frame), n))
        self.at += len(frame)
        self.tokens += n

    def close(self) -> None:
        for column, (_, kind) in zip(zip(*self.index), FIELDS):
            self.out.write(np.array(column, dtype=kind).tobytes())
        self.out.write(struct.pack("<QQ", self.at, len(self.index)) + MARK)
        self.out.close()


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, fs, path: str, dictionary: bytes):
        import zstandard

        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, n = struct.unpack("<QQ", self._part(size - 24, 16))
        if self._part(size - 8, 8) != MARK or self._part(0, 8) != MARK:
            raise ValueError(f"not a token file: {path}")
        if self._part(8, 32) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"written with another dictionary: {path}")
        self.width = struct.unpack("<I", self._part(40, 4))[0]
        buffer = io.BytesIO(self._part(at, size - 24 - at))
        self.index = {f: np.frombuffer(buffer.read(n * np.dtype(kind).itemsize), dtype=kind) for f, kind in FIELDS}
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.press = zstandard.ZstdDecompressor(dict_data=data)

    def _part(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, k: int) -> np.ndarray:
        frame = self._part(int(self.index["offset"][k]), int(self.index["size"][k]))
        return np.frombuffer(self.press.decompress(frame), dtype=f"<u{self.width}").astype("<u4")

    def blocks(self, most: int = 4_000_000):
        """(documents a to b, their ids one after another), in runs of at most ``most`` ids or a single document."""
        offset, size = self.index["offset"].astype(np.int64), self.index["size"].astype(np.int64)
        ids = np.cumsum(self.index["count"].astype(np.int64))  # a frame of few bytes can hold many
        a = 0
        while a < len(offset):
            b = max(a + 1, int(np.searchsorted(ids, (ids[a - 1] if a else 0) + most, side="right")))
            raw = self._part(int(offset[a]), int(offset[b - 1] + size[b - 1] - offset[a]))
            cut = [raw[o : o + s] for o, s in zip((offset[a:b] - offset[a]).tolist(), size[a:b].tolist())]
            data = b"".join(map(self.press.decompress, cut))
            yield a, b, np.frombuffer(data, dtype=f"<u{self.width}").astype("<u4")
            a = b


def write_files(
    docs: DataFrame,
    vocabulary: str | None = None,
    folder: str | None = None,
    end_id: int = 1,
    dictionary_size: int = 65536,
    sample: int = 1000,
    level: int = 3,
    file_bytes: int = 64 << 20,
) -> DataFrame:
    """Write the ids of every whole text, ``end_id`` after each, and return the manifest.

    Manifest, one row per file: path, dictionary (its path), part, piece, n_docs, n_tokens and start (ids in all files before it). Documents lie in ascending order of doc_id,
    null ids first, equal ids in the order of their texts. Null texts count as empty. The one
    shuffle deals the texts out by ranges of doc_id; files are written under names of their own
    and named by the stored manifest only once complete, so a repeated task leaves at most a
    file that nothing refers to. An empty table gives an empty manifest; other columns are not read.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    folder = folder or new_folder(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if len(encoder(vocabulary).tokens) <= 65536 and end_id < 65536 else 4
    dictionary = train_dictionary(rows, vocabulary, width, end_id, sample, dictionary_size)
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    beside = f"{folder}/dictionary-{hashlib.sha256(dictionary).hexdigest()}.zdict" if dictionary else None
    if beside:
        with open_fs(beside)[0].open_output_stream(open_fs(beside)[1]) as out:
            out.write(dictionary)
    given = spark.sparkContext.broadcast(dictionary)  # at most dictionary_size bytes

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        done, writer = [], None

        def close(w):
            w.close()
            done.append((f"{folder}/{w.path.rsplit('/', 1)[1]}", beside, part, len(done), len(w.index), w.tokens))

        for keys, texts in text_batches(batches):
            ids, count = coder.encode(texts)
            at = np.concatenate([[0], np.cumsum(count)])
            for key, a, b in zip(keys.to_pylist(), at.tolist(), at[1:].tolist()):
                if writer is None:
                    writer = FileWriter(fs, f"{base}/part-{part:06d}-{uuid.uuid4().hex}.tokens", given.value, width, level)
                writer.add(key, serialise(ids[a:b], end_id, width))
                if writer.at >= file_bytes:
                    close(writer)
                    writer = None
        if writer is not None:
            close(writer)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i != 1 else pa.array(c, pa.string()) for i, c in enumerate(zip(*done))], ["path", "dictionary", "part", "piece", "n_docs", "n_tokens"])

    schema = "path string, dictionary string, part long, piece long, n_docs long, n_tokens long"
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(ordered.mapInArrow(run, schema), "token-manifest", kept=True)
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_files(manifest: DataFrame, most_tasks: int = 10_000) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens, ids (little-endian u32, binary)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, beside, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, at = open_fs(path)
                dictionary = b""
                if beside:
                    with fs.open_input_file(open_fs(beside)[1]) as f:
                        dictionary = f.read()
                file = FileReader(fs, at, dictionary)
                for a, b, ids in file.blocks():
                    count = file.index["count"][a:b].astype(np.int64)
                    ends = np.cumsum(count)
                    cells = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                    keys = pa.array(file.index["doc_id"][a:b], pa.int64(), mask=file.index["null"][a:b].astype(bool))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start + ends - count), pa.array(count), cells], ["doc_id", "start", "n_tokens", "ids"])
                    start += int(ends[-1])

    files = manifest.select("path", "dictionary", "start")
    files = files.repartition(max(1, min(files.count(), most_tasks)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Per document, read back from the files: place of its first id, number of ids and their CRC-32."""
    manifest = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), end_id=1)
    back = read_files(manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
