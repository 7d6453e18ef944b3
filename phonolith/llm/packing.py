"""Operator 5, packing: best-fit decreasing into windows of fixed length.

Documents longer than a window are first cut into full windows. What remains of
each document is packed by best-fit decreasing: remainders in order of length,
each into the open window with the least room that still holds it. A segment
tree indexed by remaining capacity finds that window.

Remainders are dealt to tasks of about ``PER_TASK``; each packs its own, holding
only lengths and ids. They are dealt in turn from the written table of pieces, so
rows that repeat an id or have none meet no single task, and a task that runs
again reads the same part files and packs the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .shared import pieces_of, small_batches, written

PER_TASK = 50_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        if len(self.at[room]) == 1:
            self._mark(room, 1)

    def _mark(self, room: int, change: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += change
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with at least ``need`` room."""
        tree, i = self.tree, need + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.at[room].pop()
        if not self.at[room]:
            self._mark(room, -1)
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each length, which must be in descending order and at most ``capacity``."""
    open_windows, placed, windows = OpenWindows(capacity), [], 0
    for n in lengths:
        found = open_windows.take(n)
        if found is None:
            found = capacity, windows
            windows += 1
        room, window = found
        placed.append((window, capacity - room))
        if room > n:
            open_windows.add(room - n, window)
    return placed


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def cut(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of each document's ids; full windows have a ``place``, unique in the table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"]
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_bpe(tokenizer)
        place = TaskContext.get().partitionId() << 32
        for batch in pieces_of(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = own.encode(text) + end
                tokens = len(ids) // 4
                for start in range(0, tokens, window):
                    part = memoryview(ids)[4 * start : 4 * (start + window)]
                    n = len(part) // 4
                    out.append((doc_id, start, n, zlib.crc32(part), tokens, place if n == window else None))
                    place += n == window
            yield _batch(out, names)

    return rows.mapInArrow(pieces, _PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_task: int = PER_TASK,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and ``end_id``; null text is the end id alone.
    Repeated rows are packed each; null ids stay null; other columns are
    ignored; an empty table gives no rows. Sequence ids are unique, not dense.
    """
    small_batches(docs.sparkSession)
    pieces = written(cut(docs, tokenizer, window, end_id, id_col, text_col), "packing-pieces")
    full = pieces.where("place is not null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where("place is null").drop("place")
    tasks = max(1, -(-rest.count() // per_task))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[3]))
        first = (1 << 62) + (TaskContext.get().partitionId() << 32)
        placed = best_fit_decreasing([r[2] for r in rows], window)
        for at in range(0, len(rows), 10_000):
            yield _batch([(*r, first + w, o) for r, (w, o) in zip(rows[at : at + 10_000], placed[at : at + 10_000])], names)

    # The number of a row in its task of the written table: fixed, and unlike a hash of the row different in equal rows.
    dealt = rest.withColumn("turn", F.xxhash64(F.monotonically_increasing_id())).repartition(tasks, "turn").drop("turn")
    return full.unionByName(dealt.mapInArrow(packed, _PACKED))


def op5_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """``documents`` packed into sequences of at most 1024 ids of byte_bpe_50k.json."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
