"""Operator 10, token-id files of patched frame-of-reference blocks.

Ids are written in ascending document order in blocks of ``BLOCK`` ids. A block
stores the differences to its least id, packed at the width that holds the
``PERCENTILE`` of them; the others stand in an exception list of positions and
whole differences. The file ends with the documents' ids and lengths, the index
of block starts and a footer, so that any block can be read alone.

Tasks of a range partitioning write the files through the file system of the
shared folder, each attempt under a name of its own; only the names in the
committed table of files count. Memory is bounded by a block, a document and
the index of one file, which is closed at ``FILE_IDS`` ids.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .ranges import Ranges
from .shared import new_folder, pieces_of, small_batches, written

BLOCK, PERCENTILE, FILE_IDS = 8192, 98.0, 1 << 25
#: Blocks that are gathered before they are packed.
GATHER = 16
#: A task's memo of ids. Little else is held beside it, and one that turns over before words come again costs a quarter more.
MEMO_BYTES = 224 << 20
_MAGIC = b"PFORIDS2"
#: Stands for a null id in the files.
_NO_ID = -(2**63)
_HEAD = struct.Struct("<IIBI")  # ids, least id, width, exceptions
#: Widths of whole bytes, as types.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
_FOOT = struct.Struct("<QQQ8s")  # documents, blocks, where the index starts


def _to_words(rest: np.ndarray, width: int) -> np.ndarray:
    """The values' low ``width`` bits, one after another in little-endian 64-bit words; 64 values fill ``width`` words."""
    if width in _WHOLE:  # the same bytes, without shifting
        low = np.zeros(-(-len(rest) // 64) * 64, _WHOLE[width])
        low[: len(rest)] = rest & np.uint32((1 << width) - 1)
        return low.view("<u8").astype(np.uint64).reshape(-1, width)
    rows = -(-len(rest) // 64)
    low = np.zeros((rows, 64), np.uint64)
    low.reshape(-1)[: len(rest)] = rest & np.uint32((1 << width) - 1)
    low = np.ascontiguousarray(low.T)
    words = np.zeros((width, rows), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= low[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= low[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def _from_words(words: np.ndarray, n: int, width: int) -> np.ndarray:
    if width in _WHOLE:
        return words.reshape(-1).astype("<u8").view(_WHOLE[width])[:n].astype(np.uint32)
    words = np.ascontiguousarray(words.reshape(-1, width).T)
    low = np.empty((64, words.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        low[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            low[i] |= words[word + 1] << np.uint64(64 - shift)
    return (np.ascontiguousarray(low.T).reshape(-1)[:n] & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A block of unsigned 32-bit ids."""
    least = int(ids.min()) if len(ids) else 0
    rest = ids.astype(np.uint32) - np.uint32(least)
    place = math.ceil(percentile / 100 * (len(ids) - 1)) if len(ids) else 0
    width = int(np.partition(rest, place)[place]).bit_length() if len(ids) else 0
    wide = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    packed = _to_words(rest, width).astype("<u8").tobytes()[: (len(ids) * width + 7) // 8] if width else b""
    return _HEAD.pack(len(ids), least, width, len(wide)) + packed + wide.astype("<u4").tobytes() + rest[wide].astype("<u4").tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    n, least, width, wide = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = (n * width + 7) // 8
    if width:
        words = np.zeros(-(-n // 64) * width, "<u8")
        words.view(np.uint8)[:size] = np.frombuffer(data, np.uint8, size, at)
        rest = _from_words(words.astype(np.uint64), n, width)
    else:
        rest = np.zeros(n, np.uint32)
    at += size
    rest[np.frombuffer(data, "<u4", wide, at)] = np.frombuffer(data, "<u4", wide, at + 4 * wide)
    return rest + np.uint32(least)


class FileWriter:
    def __init__(self, out):
        self.out, self.size = out, 0
        self.blocks: list[int] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.held = self.ids = 0
        self._write(_MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(_NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        self.ids += len(ids) // 4
        if self.held >= GATHER * BLOCK:
            ids = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(ids) // BLOCK * BLOCK
            self._blocks(ids[:whole])
            self.waiting, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def _blocks(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), BLOCK):
            self.blocks.append(self.size)
            self._write(pack_block(ids[at : at + BLOCK]))

    def close(self) -> None:
        if self.held:
            self._blocks(np.frombuffer(b"".join(self.waiting), "<u4"))
        start = self.size
        self.blocks.append(start)
        for column in (self.docs, self.lengths, self.blocks):
            self._write(np.array(column, "<i8").tobytes())
        self._write(_FOOT.pack(len(self.docs), len(self.blocks) - 1, start, _MAGIC))
        self.out.close()


def read_documents(file, size: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, ids), one block in memory besides the document."""

    def part(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    docs, blocks, start, magic = _FOOT.unpack(part(size - _FOOT.size, _FOOT.size))
    if magic != _MAGIC:
        raise ValueError("not a file of token ids")
    index = np.frombuffer(part(start, 8 * (2 * docs + blocks + 1)), "<i8")
    ids, lengths, starts = index[:docs], index[docs : 2 * docs], index[2 * docs :]
    block, held, before = 0, np.empty(0, np.uint32), 0
    for doc_id, n in zip(ids.tolist(), lengths.tolist()):
        parts = [held]
        have = len(held)
        while have < n:
            parts.append(unpack_block(part(int(starts[block]), int(starts[block + 1] - starts[block]))))
            have += len(parts[-1])
            block += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield None if doc_id == _NO_ID else doc_id, before, held[:n]
        held, before = held[n:], before + n


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """Writes the files; returns the table of files in order: path, part, number, n_docs, n_ids, start.

    Null text counts as empty; a very long text is held whole, one at a time.
    Repeated rows are written each, in an order of their own; rows with a null
    id come last. Other columns are ignored. An empty table gives no files.
    ``parts``: ranges of ids, as many as shuffle partitions unless given.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = Ranges.of(rows, parts)
    dealt = ranges.dealt(rows).repartitionById(ranges.count, "part")
    ordered = dealt.sortWithinPartitions(F.asc_nulls_last("doc_id"), "text").select("doc_id", "text")
    small_batches(docs.sparkSession)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_bpe(tokenizer, MEMO_BYTES)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, files = TaskContext.get().partitionId(), []
        writer = None
        for batch in pieces_of(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if writer is None:
                    name = f"ids-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.pfor"
                    writer = FileWriter(store.open_output_stream(f"{base}/{name}"))
                writer.add(doc_id, own.encode(text) + end)
                if writer.ids >= FILE_IDS:
                    writer.close()
                    files.append((name, len(writer.docs), writer.ids))
                    writer = None
        if writer is not None:
            writer.close()
            files.append((name, len(writer.docs), writer.ids))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{f[0]}" for f in files], pa.string()),
                pa.array([part] * len(files), pa.int64()),
                pa.array(range(len(files)), pa.int64()),
                pa.array([f[1] for f in files], pa.int64()),
                pa.array([f[2] for f in files], pa.int64()),
            ],
            names=["path", "part", "number", "n_docs", "n_ids"],
        )

    files = written(ordered.mapInArrow(write, "path string, part long, number long, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; no files give no rows."""
    # A file is one row and much work: as many partitions as files.
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, path = fs.FileSystem.from_uri(uri)
                out = []
                with store.open_input_file(path) as file:
                    for doc_id, before, ids in read_documents(file, file.size()):
                        out.append((doc_id, start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                yield _rows(out)

    return files.select("path", "start").repartitionByRange(n, "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op10_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """``documents`` as ids of byte_bpe_50k.json, each with end id 2, written to files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "ids")
    return read_token_files(write_token_files(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2))
