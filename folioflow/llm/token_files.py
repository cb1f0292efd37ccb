"""Token ids in binary files of independent zstandard frames with a trailing seek table.

File format (the public zstd seekable format): data frames, each with whole documents' ids as little-endian unsigned
integers of 2 or 4 bytes; then a skippable frame with one entry for each data frame (compressed size, size, checksum: the
low 32 bits of the XXH64 of the frame's content), the number of frames, a descriptor and a magic number. A reader takes
the table from the file's end and decompresses only the frames with documents asked for. A table of documents (file,
frame, place in the frame, length) is kept as Parquet.

Files go to a folder that all executors share, under names of their own for each task attempt. The table of documents
names the files of the attempts that counted, so repeated and speculative attempts do no harm.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_automaton import encoder_of
from .common import id_and_text, read_bytes, shared_dir, stored, text_batches

FRAME_BYTES, LEVEL = 1 << 18, 1
# Fixed values of the seekable format: magic of the skippable frame that holds the table, and of its end.
TABLE_MAGIC, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX = "doc_id long, part int, file string, frame int, place long, n_tokens long, before long, width int"


class FrameWriter:
    """Writes frames and the seek table to an open file."""

    def __init__(self, out):
        self.out, self.entries = out, []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        body = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
        self.out.close()


class FrameReader:
    """Reads single frames of a file and checks their checksums."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"no seek table at the end of {path}")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), dtype="<u4").reshape(n, 3)
        self.table, self.starts = table, np.cumsum(table[:, 0], dtype=np.int64) - table[:, 0]

    def frame(self, i: int) -> bytes:
        packed, size, checksum = map(int, self.table[i])
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, int(self.starts[i])), max_output_size=max(size, 1))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return data


def highest_id(definition: bytes) -> int:
    """Of a tokenizer's vocabulary and its added tokens."""
    d = json.loads(definition)
    return max([*d["model"]["vocab"].values(), *(t["id"] for t in d.get("added_tokens") or [])], default=0)


def id_bytes(definition: bytes, texts: list[str], width: int) -> list[bytes]:
    """Each text's ids as little-endian unsigned integers of `width` bytes."""
    return [ids.astype(f"<u{width}").tobytes() for ids in encoder_of(definition).encode(texts)]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, width: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id and write the files in ascending doc_id order; the table of documents.

    Rows are dealt by ranges of doc_id, one file for each range; equal ids stay together, null ids come first, a null text
    gives end_id alone. `part` numbers the files in order and `before` counts a file's ids before the document. An empty
    table gives no file with documents. An id takes `width` bytes: 2 or 4, by the vocabulary's highest id, unless given; a
    width that can't hold every id is refused.
    """
    spark = docs.sparkSession
    content = read_bytes(tokenizer_path)
    highest = max(end_id, highest_id(content))
    width = width or (2 if highest < 1 << 16 else 4)
    if highest >= 1 << 8 * width:
        raise ValueError(f"id {highest} takes more than {width} bytes")
    definition = spark.sparkContext.broadcast(content)
    end = np.asarray([end_id], dtype=f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, name = task.partitionId(), f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        writer = None
        buffer, size, frame, before = [], 0, 0, 0
        for batch, texts in text_batches(batches):
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = FrameWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), id_bytes(definition.value, texts, width), strict=True):
                n = len(ids) // width + 1
                rows.append((doc, part, name, frame, size // width, n, before, width))
                buffer += (ids, end)
                size += n * width
                before += n
                if size >= FRAME_BYTES:
                    writer.frame(b"".join(buffer))
                    buffer, size, frame = [], 0, frame + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX_TYPES, strict=True)], _INDEX_NAMES)
        if writer is not None:
            if buffer:
                writer.frame(b"".join(buffer))
            writer.close()

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, INDEX)


_INDEX_NAMES = [c.split(" ")[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split(" ")[1]] for c in INDEX.split(", ")]


def starts(index: DataFrame) -> DataFrame:
    """The table of documents with `start`: the ids of all documents before it, over all files."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    base = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return index.join(base, "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_crc(index: DataFrame, folder: str) -> DataFrame:
    """Read the listed documents back: the rows' doc_id, start, n_tokens and the crc32 of their ids as 32-bit integers.

    Each frame asked for is read, checked and decompressed once as long as a file's documents come in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        name, number, reader, data = None, None, None, b""
        for batch in batches:
            crc = []
            for file, frame, place, n, width in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "place", "n_tokens", "width")), strict=True):
                if file != name:
                    name, number, reader = file, None, FrameReader(fs, f"{root}/{file}")
                if frame != number:
                    number, data = frame, reader.frame(frame)
                ids = np.frombuffer(data, dtype=f"<u{width}", count=n, offset=place * width)
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.sortWithinPartitions("file", "frame", "place").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write all documents' ids and return what the files hold: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or f"{shared_dir(spark)}"
    index = stored(write_tokens(docs, tokenizer_path, end_id, folder))
    return read_crc(starts(index), folder)
