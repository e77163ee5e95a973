"""Packing under several limits at once: vector bin packing by the dot-product heuristic.

A piece needs tokens, one segment and some loss-bearing tokens; a sequence has a limit on each. An open sequence takes, again
and again, the waiting piece whose demand has the largest dot product with what the sequence has left, both as
shares of the limits, among those that fit. When none fits and tokens and a segment are left, the longest waiting piece is
cut to fill it. What exceeds a sequence's length is cut off in full sequences first.

Each task packs its own documents in windows of ``window_tokens``, so there is no shuffle and memory is bounded;
a sequence that a window leaves unfilled goes back to the next window's pieces. The last one of a task is cut into
sequences of powers of two, which need no padding.

Defined results: a null or empty text is its end token alone; rows that repeat or have a null doc_id are
packed like any other; an empty table gives no piece; other columns are ignored. The pieces of a document are gapless, each id in
exactly one. Which documents share a sequence depends on the input's partitions, and is the same when a
lost task runs again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.tokens import default_path, tokenizer


@dataclass(frozen=True)
class PackingConfig:
    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024
    window_tokens: int = 1 << 20
    end_id: int = 0
    tokenizer_path: str | None = None


class Pool:
    """Waiting pieces ``(doc, start, length)`` by kind, a kind being (tokens, loss-bearing tokens)."""

    def __init__(self):
        self.row: dict[tuple[int, int], int] = {}
        self.size, self.loss, self.count = (np.zeros(256, dtype=np.int64) for _ in range(3))
        self.waiting: list[list[tuple[int, int, int]]] = []

    def add(self, piece: tuple[int, int, int], loss: int) -> None:
        kind = (piece[2], loss)
        at = self.row.get(kind)
        if at is None:
            at = self.row[kind] = len(self.waiting)
            self.waiting.append([])
            if at == len(self.size):
                self.size, self.loss, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.loss, self.count))
            self.size[at], self.loss[at] = kind
        self.waiting[at].append(piece)
        self.count[at] += 1

    def take(self, at: int) -> tuple[int, int, int]:
        self.count[at] -= 1
        return self.waiting[at].pop()


class Packer:
    """Packs documents ``(token count, cumulative loss)``; ``cumulative[i]`` is the loss among the first i tokens, or None for all."""

    def __init__(self, config: PackingConfig):
        self.c, self.pool = config, Pool()
        self.loss_before: dict[int, np.ndarray | None] = {}

    def loss_of(self, doc: int, start: int, length: int) -> int:
        before = self.loss_before[doc]
        return length if before is None else int(before[start + length] - before[start])

    def _longest(self, doc: int, start: int, tokens: int, loss: int) -> int:
        """How many tokens from ``start`` on stay within both limits."""
        before = self.loss_before[doc]
        if before is None:
            return min(tokens, loss)
        return min(tokens, int(np.searchsorted(before, before[start] + loss, side="right")) - 1 - start)

    def offer(self, doc: int, n: int, loss_before: np.ndarray | None) -> list[list[tuple[int, int, int]]]:
        """Takes a document in; gives the full sequences that it fills alone."""
        self.loss_before[doc] = loss_before
        full, start = [], 0
        while n - start > self.c.tokens or (n - start and self.loss_of(doc, start, n - start) > self.c.loss_tokens):
            take = self._longest(doc, start, min(self.c.tokens, n - start), self.c.loss_tokens)
            if take == self.c.tokens:
                full.append([(doc, start, take)])
            else:
                self.pool.add((doc, start, take), self.loss_of(doc, start, take))
            start += take
        if n - start:
            self.pool.add((doc, start, n - start), self.loss_of(doc, start, n - start))
        return full

    def drain(self) -> Iterator[tuple[list[tuple[int, int, int]], bool]]:
        """Packs all that waits; yields (pieces, whether nothing was left to fill it with)."""
        c, p = self.c, self.pool
        limits = (c.tokens, c.segments, c.loss_tokens)
        while True:
            left, bin_ = list(limits), []
            while left[0] > 0 and left[1] > 0:
                k = len(p.waiting)
                size, loss, waits = p.size[:k], p.loss[:k], p.count[:k] > 0
                fits = waits & (size <= left[0]) & (loss <= left[2])
                if fits.any():
                    dot = size * (left[0] / limits[0] ** 2) + left[1] / limits[1] ** 2 + loss * (left[2] / limits[2] ** 2)
                    piece = p.take(int(np.argmax(np.where(fits, dot, -1.0))))
                elif waits.any():
                    doc, start, n = p.take(int(np.argmax(np.where(waits, size, -1))))
                    cut = self._longest(doc, start, min(left[0], n), left[2])
                    if cut <= 0:
                        p.add((doc, start, n), self.loss_of(doc, start, n))
                        break
                    piece = (doc, start, cut)
                    p.add((doc, start + cut, n - cut), self.loss_of(doc, start + cut, n - cut))
                else:
                    break
                bin_.append(piece)
                left[0] -= piece[2]
                left[1] -= 1
                left[2] -= self.loss_of(*piece)
            if not bin_:
                return
            yield bin_, left[0] > 0 and not p.count.any()


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cuts a sequence into sequences whose lengths are the powers of two in its length."""
    total = sum(n for *_, n in pieces)
    rest = list(pieces)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            need, out = 1 << bit, []
            while need:
                doc, start, n = rest.pop(0)
                take = min(n, need)
                out.append((doc, start, take))
                if take < n:
                    rest.insert(0, (doc, start + take, n - take))
                need -= take
            yield out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long"


def _packs(config: PackingConfig, with_turns: bool):
    path = config.tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = tokenizer(path), Packer(config)
        base, serial, docs, held = TaskContext.get().partitionId() << 40, 0, {}, 0
        end = np.array([config.end_id], dtype=np.uint32)

        def rows(sequences) -> pa.RecordBatch:
            nonlocal serial
            out = [[] for _ in range(9)]
            for pieces in sequences:
                offset = 0
                for at, (doc, start, n) in enumerate(pieces):
                    doc_id, ids = docs[doc]
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    row = (doc_id, start, n, crc, len(ids), base + serial, offset, at, packer.loss_of(doc, start, n))
                    for col, v in zip(out, row):
                        col.append(v)
                    offset += n
                serial += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in PIECES.split(", ")]
            )

        def packed(last: bool):
            nonlocal held, docs
            done, again = [], []
            for pieces, short in packer.drain():
                if not short:
                    done.append(pieces)
                elif last:
                    done.extend(powers_of_two(pieces))
                else:
                    again.extend(pieces)
            out = rows(done)
            docs = {d: docs[d] for d, *_ in again}
            packer.loss_before = {d: packer.loss_before[d] for d in docs}
            packer.pool = Pool()
            for piece in again:
                packer.pool.add(piece, packer.loss_of(*piece))
            held = sum(n for *_, n in again)
            return out

        count = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                before = None
                if with_turns:
                    parts = [(tok.ids(t["text"].as_py()), t["loss"].as_py()) for t in text]
                    parts.append((end, True))
                    ids = np.concatenate([p for p, _ in parts])
                    bears = np.concatenate([np.full(len(p), bool(b)) for p, b in parts])
                    before = np.concatenate([[0], np.cumsum(bears)])
                else:
                    ids = np.concatenate([tok.ids(text.as_py()), end])
                docs[count] = (doc_id.as_py(), ids)
                full = packer.offer(count, len(ids), before)
                if full:
                    yield rows(full)
                count += 1
                held += len(ids)
                if held >= config.window_tokens:
                    yield packed(False)
        yield packed(True)

    return run


def packed_documents(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """A row for each piece of ``docs(doc_id, text)``; every token of a document bears loss."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_packs(config, False), PIECES)


def packed_conversations(turns: DataFrame, config: PackingConfig = PackingConfig(loss_tokens=768)) -> DataFrame:
    """A row for each piece of ``conversations``: turns in order, loss on the assistant's tokens and the end token."""
    turn = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    own = turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return own.select("doc_id", F.transform("t", lambda t: F.struct(t["text"].alias("text"), t["loss"].alias("loss"))).alias("text")).mapInArrow(
        _packs(config, True), PIECES
    )
