"""Token ids as files of independent zstandard frames with a trailing seek table.

Layout of a shard, all integers little-endian:

* one zstandard frame for each run of at most ``FRAME_IDS`` ids of a document; a document has at least one frame of its
  own, so a reader decompresses nothing but the documents it asks for;
* a skippable frame with the document index: count (u4), document ids (i8 each), flags (u1 each, 1: null id), number of
  frames (u4 each), id width in bytes (u4);
* the seek table of the zstandard seekable format, as a skippable frame: for every frame before it, the document index
  included, its size, its size when decompressed (0 for the index) and the low half of the XXH64 of its content; then the
  number of frames, a descriptor byte and the closing magic number.

Shards are written under a name of the attempt and then renamed, so a task that is repeated or runs twice leaves one
whole file. Shards and the documents in them are in ascending document order; null ids come first. Rows of one id are dealt
to shards by the hash of their text, and ordered by their text within a shard. An empty table gives no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.llm.common import documents, id_and_text, new_folder, tuned
from answerlens.llm.encoder import encoder, in_blocks, public_tokenizer

FRAME_IDS = 1 << 16
# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_MANIFEST = "shard int, n_docs long, n_tokens long, n_bytes long"


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def shard_name(shard: int) -> str:
    return f"tokens-{shard:06d}.zst"


class ShardWriter:
    """Streams documents into one shard; holds one frame and the indexes."""

    def __init__(self, folder: str, shard: int, width: int, level: int = 3):
        self.fs, path = _filesystem(folder)
        self.final = f"{path}/{shard_name(shard)}"
        self.partial = f"{path}/_{shard_name(shard)}-{uuid.uuid4().hex}"
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(self.partial)
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.width, self.size = width, 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.frame_counts: list[int] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        step = FRAME_IDS * self.width
        parts = [raw[i : i + step] for i in range(0, len(raw), step)] or [b""]
        for part in parts:
            packed = self.compressor.compress(part)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
            self._write(packed)
        self.ids.append(doc_id)
        self.frame_counts.append(len(parts))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        n = len(self.ids)
        index = struct.pack("<I", n)
        index += np.array([0 if i is None else i for i in self.ids], "<i8").tobytes()
        index += np.array([i is None for i in self.ids], "u1").tobytes()
        index += np.array(self.frame_counts, "<u4").tobytes() + struct.pack("<I", self.width)
        framed = struct.pack("<II", SKIPPABLE_MAGIC, len(index)) + index
        self.frames.append((len(framed), 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        self._write(framed)
        table = np.array(self.frames, "<u4").tobytes()
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()
        self.fs.move(self.partial, self.final)


class ShardReader:
    """Random access to the documents of one shard. Raises ``ValueError`` on a wrong magic number or checksum."""

    def __init__(self, folder: str, shard: int):
        fs, path = _filesystem(folder)
        self.file = fs.open_input_file(f"{path}/{shard_name(shard)}")
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a token shard")
        self.table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], self.table[:, 0].astype(np.int64).cumsum()])
        index = self.file.read_at(int(self.table[-1, 0]) - 8, int(self.at[-2]) + 8)
        if xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != int(self.table[-1, 2]):
            raise ValueError("the document index does not match its checksum")
        (n,) = struct.unpack("<I", index[:4])
        self.ids = np.frombuffer(index, "<i8", n, 4)
        self.null = np.frombuffer(index, "u1", n, 4 + 8 * n).astype(bool)
        frames = np.frombuffer(index, "<u4", n, 4 + 9 * n).astype(np.int64)
        (self.width,) = struct.unpack("<I", index[4 + 13 * n :])
        self.first_frame = np.concatenate([[0], frames.cumsum()])
        sizes = np.concatenate([[0], self.table[:-1, 1].astype(np.int64).cumsum()]) // self.width
        self.starts = sizes[self.first_frame]
        self.decompressor = zstandard.ZstdDecompressor()

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; reads its frames only."""
        first, last = int(self.first_frame[k]), int(self.first_frame[k + 1])
        data = memoryview(self.file.read_at(int(self.at[last] - self.at[first]), int(self.at[first])))
        parts, at = [], 0
        for packed, plain, checksum in self.table[first:last].tolist():
            part = self.decompressor.decompress(data[at : at + packed], max_output_size=max(1, plain)) if plain else b""
            if len(part) != plain or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame of document {k} does not match its checksum")
            parts.append(part)
            at += packed
        return np.frombuffer(b"".join(parts), "<u4" if self.width == 4 else "<u2")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the shards, and a Parquet manifest of them in ``folder/manifest``.

    A null text is an empty one: its document holds the end id alone. Rows are dealt by ranges of the id and a hash of
    the text, so many rows of one id still spread.
    """

    def write(batches):
        shard, writer, docs_, tokens = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))
            tool = encoder(tokenizer, end_id)
            for start, block in in_blocks(texts):
                for doc_id, raw in zip(ids[start : start + len(block)], tool.encode_raw(block), strict=True):
                    writer = writer or ShardWriter(folder, shard, tool.dtype.itemsize)
                    writer.add(doc_id, raw)
                    docs_ += 1
                    tokens += len(raw) // tool.dtype.itemsize
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "n_docs": [docs_], "n_tokens": [tokens], "n_bytes": [writer.size]}
            )

    rows = id_and_text(docs, id_col, text_col)
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    dealt.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, docs_per_split: int = 1000) -> DataFrame:
    """Documents of the shards with ids: doc_id, start (ids of all documents before), ids (array), shard.

    One row per written row: repeated rows come as often as they were written, a null id stays null, and an empty text is its
    end id alone. A folder without shards gives no row.
    """
    schema = "doc_id long, start long, ids array<long>, shard int"

    def read(frames):
        for frame in frames:
            for shard, base, first, last in frame.itertuples(index=False):
                reader = ShardReader(folder, shard)
                for at in range(first, last, 100):
                    k = range(at, min(at + 100, last))
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array([None if reader.null[i] else int(reader.ids[i]) for i in k], "Int64"),
                            "start": [base + int(reader.starts[i]) for i in k],
                            "ids": [reader.document(i).astype("i8") for i in k],
                            "shard": shard,
                        }
                    )

    return _splits(spark, folder, docs_per_split).mapInPandas(read, schema)


def token_digests(spark: SparkSession, folder: str, docs_per_split: int = 1000) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32 (over 32-bit ids), shard, n_frames."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, n_frames int"

    def read(frames):
        for frame in frames:
            for shard, base, first, last in frame.itertuples(index=False):
                reader = ShardReader(folder, shard)
                k = np.arange(first, last)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(reader.ids[k].astype("i8"), "Int64").copy() if not reader.null[k].any() else pd.array([None if reader.null[i] else int(reader.ids[i]) for i in k], "Int64"),
                        "start": base + reader.starts[k],
                        "n_tokens": reader.starts[k + 1] - reader.starts[k],
                        "ids_crc32": [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in k],
                        "shard": np.int32(shard),
                        "n_frames": (reader.first_frame[k + 1] - reader.first_frame[k]).astype("i4"),
                    }
                )

    return _splits(spark, folder, docs_per_split).mapInPandas(read, schema)


def _splits(spark: SparkSession, folder: str, docs_per_split: int) -> DataFrame:
    """Runs of documents to read, with the ids before their shard. The window orders one small row per shard."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(docs_per_split).cast("long")))
    return (
        runs.select("shard", "base", "n_docs", first.alias("first"))
        .select("shard", "base", "first", F.least("n_docs", F.col("first") + docs_per_split).alias("last"))
        .repartition(_tasks(spark), F.col("shard"), F.col("first"))
    )


def _tasks(spark: SparkSession) -> int:
    """Said outright: rows that only name what to read are too small to be dealt by their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fetch_documents(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """The ids of the documents whose ``doc_id`` is in ``doc_ids``; other frames are never decompressed.

    An id asked for more than once counts once; all documents of an id are returned. Null ids, and those that no document
    has, find nothing.
    """
    schema = "doc_id long, ids array<long>"

    def index(frames):
        for frame in frames:
            for shard in frame["shard"]:
                reader = ShardReader(folder, shard)
                keep = np.flatnonzero(~reader.null)
                yield pd.DataFrame({"doc_id": reader.ids[keep], "shard": np.int32(shard), "k": keep})

    def read(frames):
        for frame in frames:
            for shard, rows in frame.groupby("shard"):
                reader = ShardReader(folder, int(shard))
                for doc_id, k in zip(rows["doc_id"], rows["k"], strict=True):
                    yield pd.DataFrame({"doc_id": [doc_id], "ids": [reader.document(k).astype("i8")]})

    shards = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("shard").repartition(_tasks(spark), "shard")
    places = shards.mapInPandas(index, "doc_id long, shard int, k long")
    wanted = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return places.join(wanted, "doc_id").repartition(_tasks(spark), F.col("shard"), F.floor(F.col("k") / 1000)).mapInPandas(read, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids in seekable files, read back from them."""
    folder = new_folder(tuned(spark), "token-files")
    write_token_files(documents(spark, sf_dir), folder, public_tokenizer())
    return token_digests(spark, folder)
