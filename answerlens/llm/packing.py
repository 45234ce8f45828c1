"""Packing of documents into fixed-length sequences by shortest-pack-first over the length histogram.

Every document is cut at multiples of the capacity. Full pieces are sequences of their own. For the rest, only the
histogram of lengths (at most ``capacity`` rows) reaches the driver: lengths are placed longest first, each into the
packs with most room, by counts of packing patterns. A piece then finds its slot by its rank among pieces of its length,
counted within the task that made it and shifted by the counts of the tasks before it.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.llm.common import documents, id_and_text, settled
from answerlens.llm.encoder import CACHE_WORDS, encoder, in_blocks, public_tokenizer

CAPACITY = 2048
_MEASURED = "doc_id long, part int, doc_tokens long, rest int, rest_rank long, full_rank long, crcs array<long>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns for a histogram: (number of packs, [(length, pieces of it), ...]).

    Lengths go longest first, each piece into the pack with most room; a pack is opened when none has room. The packs of
    one pattern are handled together, so the work depends on the number of lengths, not of pieces.
    """
    room: dict[int, list[list]] = {}
    heap: list[int] = []

    def put(space: int, count: int, items: tuple) -> None:
        if space not in room:
            room[space] = []
            heapq.heappush(heap, -space)
        room[space].append([count, items])

    def with_more(items: tuple, length: int, n: int) -> tuple:
        if items and items[-1][0] == length:
            return (*items[:-1], (length, items[-1][1] + n))
        return (*items, (length, n))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left = histogram[length]
        while left:
            while heap and not room[-heap[0]]:
                del room[-heapq.heappop(heap)]
            space = -heap[0] if heap else 0
            if space < length:
                each = capacity // length
                packs, odd = divmod(left, each)
                if packs:
                    put(capacity - each * length, packs, ((length, each),))
                if odd:
                    put(capacity - odd * length, 1, ((length, odd),))
                break
            count, items = room[space].pop()
            if left < count:
                put(space, count - left, items)
                count = left
            put(space - length, count, with_more(items, length, 1))
            left -= count
    return [(count, list(items)) for packs in room.values() for count, items in packs]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int = CAPACITY) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length, runs of ranks and their places: first rank, pieces in a pack, first sequence, offset, padding."""
    runs: dict[int, list[tuple[int, ...]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for count, items in patterns:
        used = sum(length * n for length, n in items)
        padding, offset = (0 if used & (used - 1) == 0 else capacity - used), 0
        for length, n in items:
            runs.setdefault(length, []).append((seen.get(length, 0), n, sequence, offset, padding))
            seen[length] = seen.get(length, 0) + n * count
            offset += length * n
        sequence += count
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in runs.items()}, sequence


def measure(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Per document: number of ids, what is left after the full pieces, checksums of its pieces, ranks within its task."""

    def run(batches):
        part, ranks, full = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            tool = encoder(tokenizer, end_id, cache_words)
            for start, block in in_blocks(t.as_py() for t in batch.column(1)):
                for doc_id, found in zip(ids[start : start + len(block)], tool.encode(block), strict=True):
                    whole = found.astype("<u4")
                    crcs = [zlib.crc32(whole[i : i + capacity].tobytes()) for i in range(0, len(whole), capacity)]
                    n_full, rest = divmod(len(whole), capacity)
                    rank = ranks.get(rest, 0)
                    rows.append((doc_id, part, len(whole), rest, rank, full, crcs))
                    ranks[rest] = rank + 1
                    full += n_full
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())
            names = [c.split()[0] for c in _MEASURED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(run, _MEASURED)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents with their sequence, offset and the padding of that sequence.

    ``cache_words`` bounds the words a worker remembers ids of: memory against time, without effect on results.
    A null text is an empty document (the end id alone). Repeated rows and rows without an id are documents of their
    own. A sequence whose length is a power of two needs no padding. An empty table gives no piece.
    """
    measured = settled(measure(id_and_text(docs, id_col, text_col), tokenizer, end_id, capacity, cache_words), "packing")
    # One row per task and length; no group is larger than a task's rows.
    counts = measured.groupBy("part", "rest").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    full = measured.groupBy("part").agg(F.sum(F.expr(f"doc_tokens div {capacity}")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fulls = full.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("full_shift"))
    # At most ``capacity`` rows.
    histogram = {r["rest"]: r["n"] for r in measured.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    places, n_packed = slots(shortest_pack_first(histogram, capacity), capacity)
    sent = docs.sparkSession.sparkContext.broadcast(places)

    def cut(frames):
        runs = sent.value
        for frame in frames:
            out = []
            for doc_id, tokens, rest, rank, first_full, crcs in frame.itertuples(index=False):
                n_full = tokens // capacity
                for k in range(n_full):
                    out.append((doc_id, k * capacity, capacity, crcs[k], tokens, n_packed + first_full + k, 0, 0))
                if rest:
                    firsts, pieces, sequences, offsets, padding = runs[rest]
                    i = int(np.searchsorted(firsts, rank, "right")) - 1
                    pack_, at = divmod(rank - int(firsts[i]), int(pieces[i]))
                    out.append((doc_id, n_full * capacity, rest, crcs[-1], tokens, int(sequences[i]) + pack_, int(offsets[i]) + at * rest, int(padding[i])))
            result = pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")])
            yield result.astype({"doc_id": "Int64"})

    placed = measured.join(shifts, ["part", "rest"]).join(fulls, "part")
    return placed.select(
        "doc_id", "doc_tokens", "rest", (F.col("rest_rank") + F.col("shift")).alias("rank"), (F.col("full_rank") + F.col("full_shift")).alias("first_full"), "crcs"
    ).mapInPandas(cut, _PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack(documents(spark, sf_dir), public_tokenizer())
