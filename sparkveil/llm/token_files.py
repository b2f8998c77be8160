"""Token-id output: independent zstandard frames, a document index and a trailing seek table.

File layout (all integers little-endian)::

    frame*            zstandard frames, each with its content checksum, of token ids
    skippable frame   magic 0x184D2A50: zstandard-compressed index of the documents
    skippable frame   magic 0x184D2A5E: the seek table of the public seekable format:
                      (compressed size u32, decompressed size u32, XXH64 low 32 bits u32)
                      per frame (the index counts as a frame of size 0), then the number
                      of frames u32, a descriptor byte 0x80 and the magic 0x8F92EAB1

A reader fetches the table from the end of the file, then only the frames that hold the
documents it wants, each verified on its own.

Defined cases: null text is an empty one (its document is the end id alone); null ids come
first; equal ids are ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, materialise, shared_dir, text_rows
from .word_tokens import encoder

INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20

MANIFEST = "part int, path string, width int, documents long, tokens long, first_doc long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(uri: str):
    """The store and the path in it; any store pyarrow knows serves."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file; documents may span frames."""

    def __init__(self, sink, width: int) -> None:
        import xxhash
        import zstandard

        self.sink, self.width, self.table = sink, width, []
        self.zstd, self.digest = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True), xxhash.xxh64_intdigest
        self.buffer, self.held = [], 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(data) // self.width)
        self.buffer.append(data)
        self.held += len(data)
        if self.held >= FRAME_BYTES:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.buffer)
        stop = len(data) if last else len(data) - len(data) % FRAME_BYTES
        for k in range(0, stop, FRAME_BYTES):
            piece = data[k : min(k + FRAME_BYTES, stop)]
            packed = self.zstd.compress(piece)
            self.sink.write(packed)
            self.table.append((len(packed), len(piece), self.digest(piece) & 0xFFFFFFFF))
        self.buffer, self.held = [data[stop:]], len(data) - stop

    def close(self) -> None:
        if self.held:
            self._flush(last=True)
        null = np.array([x is None for x in self.ids], np.uint8).tobytes()
        ids = np.array([x or 0 for x in self.ids], "<i8").tobytes()
        raw = struct.pack("<BQ", self.width, len(self.ids)) + ids + np.array(self.lengths, "<u8").tobytes() + null
        packed = self.zstd.compress(raw)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        self.table.append((len(packed) + 8, 0, 0))
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Reads documents of one file by number, decompressing only the frames that hold them."""

    def __init__(self, source, size: int) -> None:
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        rows = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3)
        self.table = rows[:-1]
        self.places = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 1], dtype=np.int64)])
        raw = self.zstd.decompress(self._at(int(self.places[-1]), int(rows[-1, 0]))[8:])
        self.width, n = struct.unpack_from("<BQ", raw)
        self.doc_ids = np.frombuffer(raw, "<i8", n, 9)
        self.lengths = np.frombuffer(raw, "<u8", n, 9 + 8 * n).astype(np.int64)
        self.nulls = np.frombuffer(raw, np.uint8, n, 9 + 16 * n).astype(bool)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def _frame(self, k: int) -> bytes:
        import xxhash

        if self.last[0] != k:
            data = self.zstd.decompress(self._at(int(self.places[k]), int(self.table[k, 0])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last = (k, data)
        return self.last[1]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        start, end = (int(self.offsets[k + i]) * self.width for i in (0, 1))
        out, f = [], int(np.searchsorted(self.starts, start, "right")) - 1
        while start < end:
            stop = min(end, int(self.starts[f + 1]))
            out.append(self._frame(f)[start - int(self.starts[f]) : stop - int(self.starts[f])])
            start, f = stop, f + 1
        return np.frombuffer(b"".join(out), f"<u{self.width}")


def write_token_files(docs: DataFrame, tokenizer_path: str, directory: str, end_id: int, parts: int | None = None, keeps_spaces: bool = True) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the manifest, a row for each file.

    A task writes under a name of its own and then renames, so a lost or repeated task leaves
    one whole file.  The texts are dealt by range of doc_id, so no task gets more than its share
    whatever the sources or groups of copies are.
    """
    spark = docs.sparkSession
    rows = text_rows(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64()), ("first_doc", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = filesystem(directory)
        enc, made, sink, tokens, n, first = encoder(tokenizer_path, keeps_spaces), None, None, 0, 0, None
        width = 2 if enc.code == "H" and end_id < 1 << 16 else 4
        end = int(end_id).to_bytes(width, "little")
        final, own = f"{base}/part-{part:06d}.zst", f"{base}/.part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for k in range(0, len(ids), 2000):
                coded = enc.encode(texts.slice(k, 2000).to_pylist())
                for doc_id, data in zip(ids[k : k + 2000], coded, strict=True):
                    if made is None:
                        store.create_dir(base, recursive=True)
                        sink = store.open_output_stream(own)
                        made, first = FrameWriter(sink, width), doc_id
                    if width == 4 and enc.code == "H":
                        data = np.frombuffer(data, "<u2").astype("<u4").tobytes()
                    made.add(doc_id, data + end)
                    tokens += len(data) // width + 1
                    n += 1
        if made is not None:
            made.close()
            sink.close()
            store.move(own, final)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, final, width, n, tokens, first), schema, strict=True)], schema=schema)

    return materialise(map_batches(ordered, write, MANIFEST))


def read_token_files(manifest: DataFrame, directory: str) -> DataFrame:
    """A row for each document of the files: (doc_id, start, n_tokens, ids_crc32), verified frame by frame.

    start adds the tokens of the files before: a running sum over the manifest, which has a
    row for each file, not for each document.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("part", "path", F.coalesce(before, F.lit(0)).alias("base")).repartition(parts, "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(directory)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    reader = FrameReader(source, source.size())
                    n = len(reader.lengths)
                    for k in range(0, n, 10_000):
                        m = min(n, k + 10_000)
                        crc = [zlib.crc32(reader.document(j).astype("<u4").tobytes()) for j in range(k, m)]
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[k:m], mask=reader.nulls[k:m]), pa.array(base + reader.offsets[k:m]), pa.array(reader.lengths[k:m]), pa.array(crc, pa.int64())], schema=schema)

    return map_batches(files, read, ROWS)


def token_documents(docs: DataFrame, tokenizer_path: str, end_id: int, directory: str | None = None) -> DataFrame:
    """Write the files, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    directory = directory or f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, tokenizer_path, directory, end_id), directory)
