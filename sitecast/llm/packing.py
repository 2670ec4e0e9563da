"""Packing of token streams into fixed windows (op 2).

Documents keep their order inside an input split.  Every id belongs to exactly one piece, and a
sequence holds at most ``window`` ids.  Where to cut is chosen by dynamic programming over the
boundaries of a block of text: a cut after a document is free, one after a sentence and one inside a
sentence cost a truncation penalty, each window a little, and an unfilled window costs its padding.  Since the padding of
the window (j, i] is ``window - (P[i] - P[j])``, the best predecessor of i minimises ``cost[j] + P[j]``
over the boundaries within one window: a sliding minimum, kept in a monotone queue.  A window whose
length is a power of two needs no padding, so the few boundaries at such distances are tried beside it.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import encoder, text_arrays, tokenizer


@dataclass(frozen=True)
class PackingParams:
    window: int = 1024
    end_id: int = 0
    #: Cost of a cut, in ids of padding.
    sentence_penalty: float = 1.0
    inner_penalty: float = 24.0
    #: Cost of a window, in ids of padding: short ones, which need none at a power of two, are no end in themselves.
    window_cost: float = 32.0
    #: Inside a long sentence a cut is possible after so many ids.
    inner_step: int = 32
    #: Ids that are planned at once; the last window of a block is planned again with the next.
    block: int = 1 << 18


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _exact(pos: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """For each boundary i (0 is the start) the earlier ones whose distance is a power of two: begins by i, and these."""
    pairs = []
    for k in range(window.bit_length()):
        j = np.searchsorted(pos, pos - (1 << k))
        i = np.flatnonzero(pos[j] == pos - (1 << k))
        pairs.append((i, j[i]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(i, kind="stable")
    return np.searchsorted(i[order], np.arange(len(pos) + 1)).tolist(), j[order].tolist()


def cuts(ends: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indexes into ``ends`` of the window ends that cost least in padding and ``penalty``, the cost of ending a window there.

    ends: ascending positions where a cut is possible, neighbours at most ``window`` apart; the last is
    always chosen.  ``window`` and powers of two below it need no padding.
    """
    n = len(ends)
    at = np.concatenate(([0], ends)).astype(np.int64)
    first, exact = _exact(at, window)
    pos, pen = at.tolist(), [0.0, *penalty.tolist()]
    cost, back = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for i in range(1, n + 1):
        p = pos[i]
        while pos[queue[0][1]] < p - window:
            queue.popleft()
        key, j = queue[0]
        best = key + window - p
        for m in exact[first[i] : first[i + 1]]:
            if cost[m] < best:
                best, j = cost[m], m
        cost[i] = best = best + pen[i]
        back[i], key = j, best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    chosen, i = [], n
    while i:
        chosen.append(i - 1)
        i = back[i]
    return chosen[::-1]


@functools.lru_cache
def sentence_ends(path: str) -> np.ndarray:
    """By token id: whether its text ends a sentence or a line."""
    t = tokenizer(path)
    size = t.get_vocab_size()
    text = t.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
    return np.array([x.rstrip(" ").endswith((".", "!", "?", "\n", "。")) for x in text] + [False], bool)


def _boundaries(ids: np.ndarray, doc_end: np.ndarray, stops: np.ndarray, p: PackingParams) -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(len(ids), p.inner_penalty, np.float32)
    kind[stops[np.minimum(ids, len(stops) - 1)]] = p.sentence_penalty
    kind[doc_end] = 0
    natural = kind < p.inner_penalty
    since = np.maximum.accumulate(np.where(natural, np.arange(len(ids)), -1))
    run = np.arange(len(ids)) - np.concatenate(([-1], since[:-1]))
    ok = natural | (run % p.inner_step == 0)
    ok[-1] = True
    at = np.flatnonzero(ok)
    return at + 1, kind[at]


class _Packer:
    """Packs one input split: feed documents, take columns of rows."""

    def __init__(self, stops: np.ndarray, first_id: int, p: PackingParams, keep_ids: bool):
        self.stops, self.p, self.next_id, self.keep_ids = stops, p, first_id, keep_ids
        self.docs = pa.array([], pa.int64())
        # Of the documents at hand: their ids, how many of them are left, how many came out before.
        self.ids, self.left, self.gone = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def feed(self, docs: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs = pa.concat_arrays([self.docs, docs])
        self.ids, self.left = np.concatenate((self.ids, ids)), np.concatenate((self.left, sizes))
        self.gone = np.concatenate((self.gone, np.zeros(len(sizes), np.int64)))

    def plan(self, last: bool) -> list[pa.Array] | None:
        """Rows of the windows that are settled; what the last window held waits for more unless ``last``."""
        if not len(self.ids):
            return None
        ends = np.cumsum(self.left)
        at, penalty = _boundaries(self.ids, ends - 1, self.stops, self.p)
        marks = at[cuts(at, penalty + self.p.window_cost, self.p.window)]
        if not last:
            marks = marks[:-1]
        done = int(marks[-1]) if len(marks) else 0
        edges = np.unique(np.concatenate(([0], ends[ends < done], marks)))
        begin, end = edges[:-1], edges[1:]
        window_of, doc_of = np.searchsorted(marks, begin, side="right"), np.searchsorted(ends, begin, side="right")
        raw = memoryview(self.ids.astype("<u4")).cast("B")
        parts = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        start = begin - (ends - self.left)[doc_of] + self.gone[doc_of]
        numbers = (start, end - begin, list(map(zlib.crc32, parts)), (self.left + self.gone)[doc_of], self.next_id + window_of, begin - np.concatenate(([0], marks))[window_of])
        rows = [self.docs.take(pa.array(doc_of)), *(pa.array(x, pa.int64()) for x in numbers), pa.array(parts if self.keep_ids else [None] * len(parts), pa.binary())]
        self.next_id += len(marks)
        k = int(np.searchsorted(ends, done, side="right"))
        self.docs, self.ids, self.left, self.gone = self.docs[k:], self.ids[done:], self.left[k:].copy(), self.gone[k:].copy()
        if len(self.left):
            cut = done - int(ends[k] - self.left[0])
            self.left[0] -= cut
            self.gone[0] += cut
        return rows


def pack(docs: DataFrame, tokenizer_path: str, params: PackingParams = PackingParams(), keep_ids: bool = True) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text); returns one row per piece.

    Null texts count as empty: their document is the end id alone.  A null doc_id stays null; repeated
    rows are packed once each.  Other columns are ignored.  An empty table gives no rows.  ``ids`` holds
    the piece's ids as little-endian unsigned 32-bit integers (null unless ``keep_ids``).
    ``sequence_id`` is the input split's number times 2**32 plus the window's number in it, so a lost
    task gives the same rows when it runs again.  Each split ends with at most one short window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(sentence_ends(tokenizer_path), TaskContext.get().partitionId() << 32, params, keep_ids)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch, texts in text_arrays(batches):
            packer.feed(batch.column(0), *encoder(tokenizer_path)(texts, params.end_id))
            if len(packer.ids) >= params.block and (rows := packer.plan(False)):
                yield pa.RecordBatch.from_arrays(rows, names=names)
        if rows := packer.plan(True):
            yield pa.RecordBatch.from_arrays(rows, names=names)
        encoder(tokenizer_path).rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
