"""Token-id matrices: best-fit-decreasing packing whose capacity search is a segment tree.

Documents are tokenized, closed by an end token and split losslessly: full rows of ``tokens`` ids first, then the rest. The pieces
of a window are placed in decreasing order, each into the open row with the least room that suffices; the segment tree over
room (0 to ``tokens``) finds it in logarithmic time. A row is written as fixed-width binary ids, padded at its end, with
cumulative segment lengths and positions that restart at each segment.

Each task packs its own documents in windows of ``window_tokens``: no shuffle, bounded memory.

Defined results: a null or empty text is its end token alone; repeated rows and null doc_ids are packed like any other; an empty
table gives no row; other columns are ignored. ``unpacked`` gives every document's ids back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.tokens import default_path, tokenizer


@dataclass(frozen=True)
class BinaryConfig:
    tokens: int = 1024
    window_tokens: int = 1 << 20
    end_id: int = 50256
    pad_id: int = 50256
    tokenizer_path: str | None = None


class RoomTree:
    """How many open rows have each room; finds the least room of at least ``n`` that some row has."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def least(self, n: int) -> int | None:
        at = n + self.leaves
        if self.tree[at]:
            return n
        while at > 1:  # up, until a right sibling has a row
            if not at & 1 and self.tree[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.leaves:  # down to its leftmost
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(lengths: list[int], tokens: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each at most ``tokens``)."""
    rows: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    tree = RoomTree(tokens)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room is None:
            row, room = len(rows), tokens
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.change(room, -1)
        rows[row].append(i)
        left = room - lengths[i]
        if left:
            by_room.setdefault(left, []).append(row)
            tree.change(left, 1)
    return rows


ROWS = "row_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>, id_bytes int"


def packed_rows(docs: DataFrame, config: BinaryConfig = BinaryConfig()) -> DataFrame:
    """One row for each row of the id matrix. ``ids`` are little-endian of ``id_bytes`` bytes, ``position_ids`` of 2 or 4 alike."""
    path = config.tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        kind = np.dtype("<u2" if max(tok.size, config.tokens) <= 1 << 16 else "<u4")
        base, serial = TaskContext.get().partitionId() << 40, 0
        end, names = np.array([config.end_id], dtype=np.uint32), [x.split()[0] for x in ROWS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]

        def matrix(pieces: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
            nonlocal serial
            out = [[] for _ in names]
            for members in best_fit_decreasing([len(p[2]) for p in pieces], config.tokens):
                parts = [pieces[i] for i in members]
                ids, places = np.full(config.tokens, config.pad_id, dtype=kind), np.zeros(config.tokens, dtype=kind)
                ends = np.cumsum([0, *(len(p[2]) for p in parts)])
                ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
                places[: ends[-1]] = np.concatenate([np.arange(len(p[2])) for p in parts])
                row = (base + serial, int(ends[-1]), ids.tobytes(), ends.tolist(), places.tobytes(), [p[0] for p in parts], [p[1] for p in parts])
                for col, v in zip(out, (*row, kind.itemsize)):
                    col.append(v)
                serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=names)

        pieces, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate([tok.ids(text.as_py()), end])
                for start in range(0, len(ids), config.tokens):
                    pieces.append((doc_id.as_py(), start, ids[start : start + config.tokens]))
                held += len(ids)
                if held >= config.window_tokens:
                    yield matrix(pieces)
                    pieces, held = [], 0
        if pieces:
            yield matrix(pieces)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def unpacked(rows: DataFrame) -> DataFrame:
    """``doc_id, start, ids array<long>`` of every segment, read from the binary rows: the exact way back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], dtype=f"<u{r['id_bytes']}")
                for a, b, d, s in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
                    out.append({"doc_id": d, "start": s, "ids": ids[a:b].astype(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return rows.mapInArrow(run, "doc_id long, start long, ids array<long>")


def written_rows(docs: DataFrame, path: str, config: BinaryConfig = BinaryConfig()) -> DataFrame:
    """Writes the id matrix as Parquet to ``path``, a folder that the cluster shares, and reads it back."""
    packed_rows(docs, config).write.parquet(path)
    return docs.sparkSession.read.parquet(path)
