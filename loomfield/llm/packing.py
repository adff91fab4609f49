"""Token-ID packing: best-fit-decreasing with a segment tree, written as id matrices.

Documents become token ids; one longer than a row is split losslessly into pieces that carry
their place. Pieces are packed by decreasing length into rows of `length` ids, each into the
fullest row that still has room. Free space is kept in a segment tree over the values
0..`length`: a node knows whether any row has that much room, so a search takes log2(length)
steps. Each packed row has its ids (uint16 or int32, little endian, padded), cumulative segment
lengths, and position ids that restart at every segment (uint16, or int32 for rows longer than that).

Packing works on blocks of `block_tokens` ids within an input partition: no shuffle, memory is
bounded by a block and one document, and a lost task repeats its own split. A block's rows
don't depend on other blocks; only its last rows can be loosely filled.

Null and empty texts have no ids and no segment; `null` keys stay null in `doc_ids`. Ties in
length go by input order, ties in room to the row that came to that room last. Repeated rows are packed as
often as they occur. An empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.bpe import VOCABULARY, codec
from loomfield.llm.common import released, tokenizer_path, unused

LENGTH = 2048
BLOCK_TOKENS = 1 << 21


class CapacityTree:
    """Which amounts of free room are there? A complete binary tree over 0..length; leaves hold the rows with that room."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The least room >= need and a row that has it, which is taken out; None if no row has."""
        i = need + self.size
        if not self.any[i]:
            while i & 1 or not self.any[i + 1]:  # up to the first right neighbour with something in it
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        while i and not (self.rows[room] if i >= self.size else self.any[2 * i] or self.any[2 * i + 1]):
            self.any[i] = 0
            i >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of indices into `lengths` (each 1..length); every index once."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        room, row = found or (length, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


def split(ids: list[int], length: int) -> list[tuple[int, list[int]]]:
    """(offset, piece) of at most `length` ids, in order, nothing lost."""
    return [(i, ids[i : i + length]) for i in range(0, len(ids), length)]


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, vocabulary: str = VOCABULARY, pad_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of packed ids: n_tokens, input_ids, position_ids (binary), cu_seqlens, doc_ids, doc_offsets (one per segment)."""
    path, kind = tokenizer_path(vocabulary), dict(df.dtypes)[key]
    schema = f"n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{kind}>, doc_offsets array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        dtype = "<u2" if max(c.bytes_of) < 65536 else "<i4"
        place = "<u2" if length <= 65536 else "<i4"
        steps = np.arange(length, dtype=place)
        pieces: list[tuple[object, int, np.ndarray]] = []
        held = 0

        def flush(arrow_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
            for start in range(0, len(rows), 256):
                out: list[list] = [[] for _ in range(6)]
                for row in rows[start : start + 256]:
                    ids, at = np.full(length, pad_id, dtype), 0
                    positions, ends = np.zeros(length, place), [0]
                    for i in row:
                        piece = pieces[i][2]
                        ids[at : at + len(piece)] = piece
                        positions[at : at + len(piece)] = steps[: len(piece)]
                        at += len(piece)
                        ends.append(at)
                    for o, v in zip(out, (at, ids.tobytes(), positions.tobytes(), ends, [pieces[i][0] for i in row], [pieces[i][1] for i in row])):
                        o.append(v)
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(arrow_kind), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets"])
            pieces.clear()

        arrow_kind = pa.int64()
        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for offset, ids in split(c.encode(t.as_py() or ""), length):
                    pieces.append((k, offset, np.array(ids, dtype)))
                    held += len(ids)
                if held >= block_tokens:
                    yield from flush(arrow_kind)
                    held = 0
        yield from flush(arrow_kind)

    return df.select(key, F.col(text).cast("string").alias(unused("text", [key]))).mapInArrow(released(run), schema)
