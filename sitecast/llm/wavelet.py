"""Token ids in wavelet-matrix shards (op 6).

A shard holds the ids of consecutive documents (ascending doc_id) as bit planes.  Plane b keeps bit b
of every id, in the order that stably sorting by the higher planes gives; with the ones counted before
each 512-bit block, rank and select work on the stored bytes, so reading one id, counting an id in a
range and finding its occurrences touch one word per plane and never unpack the shard.

File format: a Parquet data set in the shared folder, one row per shard, its ``data`` one little-endian
block: magic ``WVM1``, planes (u4), ids (u8), zeros per plane (u8 each), then per plane the bits (u8
words, least significant bit first) and the ranks (u4 per 8 words).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitecast.llm.common import encoder, shared_dir, text_arrays

MAGIC = b"WVM1"
BLOCK_WORDS = 8
SHARD_SCHEMA = "split long, shard long, n_ids long, doc_ids array<long>, doc_sizes array<long>, data binary"


class WaveletMatrix:
    """Rank, select, access and counting on one encoded shard."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.planes = int(np.frombuffer(data, "<u4", 1, 4)[0])
        self.size = int(np.frombuffer(data, "<u8", 1, 8)[0])
        self.zeros = np.frombuffer(data, "<u8", self.planes, 16).astype(np.int64)
        words = -(-self.size // 64)
        blocks = -(-words // BLOCK_WORDS) + 1
        self.bits, self.ranks, at = [], [], 16 + 8 * self.planes
        for _ in range(self.planes):
            self.bits.append(np.frombuffer(data, "<u8", words, at))
            self.ranks.append(np.frombuffer(data, "<u4", blocks, at + 8 * words))
            at += 8 * words + 4 * blocks

    @staticmethod
    def encode(ids: np.ndarray) -> bytes:
        n = len(ids)
        planes = max(1, int(ids.max()).bit_length()) if n else 1
        cur = ids.astype(np.uint16 if planes <= 16 else np.uint32)
        words = -(-n // 64)
        body, zeros = [], []
        for b in range(planes - 1, -1, -1):
            one = (cur & cur.dtype.type(1 << b)) != 0
            packed = np.packbits(one, bitorder="little").tobytes().ljust(words * 8, b"\0")
            counts = np.bitwise_count(np.frombuffer(packed, "<u8"))
            per_block = np.add.reduceat(counts, np.arange(0, words, BLOCK_WORDS), dtype=np.uint32) if words else np.zeros(0, np.uint32)
            body += [packed, np.concatenate(([0], np.cumsum(per_block))).astype("<u4").tobytes()]
            low = np.compress(~one, cur)
            zeros.append(len(low))
            cur = np.concatenate((low, np.compress(one, cur)))
        return MAGIC + np.uint32(planes).tobytes() + np.uint64(n).tobytes() + np.array(zeros, "<u8").tobytes() + b"".join(body)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before position i."""
        word, block = i >> 6, i >> 9
        n = int(self.ranks[plane][block]) + int(np.bitwise_count(self.bits[plane][block * BLOCK_WORDS : word]).sum())
        return n + (int(self.bits[plane][word]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else n

    def access(self, i: int) -> int:
        out = 0
        for p in range(self.planes):
            one = int(self.bits[p][i >> 6]) >> (i & 63) & 1
            r = self._rank1(p, i)
            out, i = out << 1 | one, int(self.zeros[p]) + r if one else i - r
        return out

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the ids equal to ``value`` before position i stand after the last plane."""
        a, b = 0, i
        for p in range(self.planes):
            ra, rb = self._rank1(p, a), self._rank1(p, b)
            a, b = (int(self.zeros[p]) + ra, int(self.zeros[p]) + rb) if value >> (self.planes - 1 - p) & 1 else (a - ra, b - rb)
        return a, b

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``value`` in [start, stop)."""
        if value >> self.planes:
            return 0
        rank = lambda i: int(np.subtract(*self._range(value, i)[::-1]))
        return rank(self.size if stop is None else stop) - rank(start)

    def _select(self, plane: int, k: int, one: int) -> int:
        """Position of the k-th (from 0) bit equal to ``one``."""
        lo, hi = 0, self.size
        while lo < hi:
            mid = (lo + hi) // 2
            r = self._rank1(plane, mid + 1)
            lo, hi = (lo, mid) if (r if one else mid + 1 - r) > k else (mid + 1, hi)
        return lo

    def locate(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``."""
        i = self._range(value, 0)[0] + k
        for p in range(self.planes - 1, -1, -1):
            one = value >> (self.planes - 1 - p) & 1
            i = self._select(p, i - int(self.zeros[p]) if one else i, one)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        out = np.zeros(self.size, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            one = np.unpackbits(self.bits[p].view(np.uint8), bitorder="little", count=self.size).astype(bool)
            above = np.empty_like(out)
            above[np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))] = out
            out = above | one * out.dtype.type(1 << (self.planes - 1 - p))
        return out.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, shard_ids: int = 1 << 17) -> None:
    """Encode the texts of ``docs`` and write shards to ``path`` in ascending doc_id order.

    Null texts count as empty, null ids come first, repeated ids stand in the order of their texts;
    other columns are ignored and an empty table writes no shard.  Whole documents fill a shard until it
    holds ``shard_ids`` ids, so a shard outgrows that only by its last document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, shard, held, ids, sizes = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            columns = [[split], [shard], [sizes], [held], [[len(x) for x in ids]], [WaveletMatrix.encode(np.concatenate(ids))]]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for batch, texts in text_arrays(batches):
            flat, own = encoder(tokenizer_path)(texts, end_id)
            for doc, x in zip(batch.column(0).to_pylist(), np.split(flat, np.cumsum(own)[:-1]), strict=True):
                held.append(doc)
                ids.append(x)
                sizes += len(x)
                if sizes >= shard_ids:
                    yield out()
                    shard, held, ids, sizes = shard + 1, [], [], 0
        if held:
            yield out()
        encoder(tokenizer_path).rest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """One row per document of the shards at ``path``: doc_id, start, n_tokens, ids_crc32, ids (binary, unsigned 32-bit; null unless ``keep_ids``).

    ``start`` counts the ids before the document over all shards: sums per input split, of which there
    are as many as there were partitions, then inside a split and inside a shard.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select("split", "shard", "n_ids")
    splits = sizes.groupBy("split").agg(F.sum("n_ids").alias("n_ids"))
    before = splits.select("split", (F.sum("n_ids").over(Window.orderBy("split")) - F.col("n_ids")).alias("before_split"))
    in_split = Window.partitionBy("split").orderBy("shard")
    starts = sizes.withColumn("in_split", F.sum("n_ids").over(in_split) - F.col("n_ids")).join(before, "split")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix(row["data"]).decode().astype("<u4")
                ends = np.cumsum(row["doc_sizes"])
                begins, whole = ends - row["doc_sizes"], memoryview(ids).cast("B")
                raw = [whole[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [[row["split"]] * len(raw), [row["shard"]] * len(raw), row["doc_ids"], begins, row["doc_sizes"], list(map(zlib.crc32, raw)), raw if keep_ids else [None] * len(raw)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 6 + [pa.binary()], strict=True)], names=["split", "shard", "doc_id", "in_shard", "n_tokens", "ids_crc32", "ids"])

    docs = shards.select("split", "shard", "n_ids", "doc_ids", "doc_sizes", "data").mapInArrow(run, "split long, shard long, doc_id long, in_shard long, n_tokens long, ids_crc32 long, ids binary")
    start = F.col("before_split") + F.col("in_split") + F.col("in_shard")
    return docs.join(starts.drop("n_ids"), ["split", "shard"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True, **options) -> DataFrame:
    """Write ``docs`` as shards to the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}"
    write_shards(docs, tokenizer_path, path, **options)
    return read_shards(docs.sparkSession, path, keep_ids)
