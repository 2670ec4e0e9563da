"""Benchmark decontamination with an Aho-Corasick automaton (op 8).

The windows of all benchmark items become the keys of one automaton, which reads each normalised text
once and reports every window that ends at each position; where words begin in the normalised text leads
back to word numbers and to offsets in the original.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.llm.common import materialize, text_slices

#: A-Z to a-z; every other ASCII character that isn't a digit or a-z to a blank; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = "doc_id long, n_words long, hit_words array<long>, item_ids array<string>, spans array<struct<start: long, stop: long>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(items: list[tuple[str, str]], size: int) -> dict[str, tuple[int, list[str]]]:
    """Window text, words apart by one blank: (its words, its items)."""
    found: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            own = w[i : i + size]
            ids = found.setdefault(f" {b' '.join(own).decode('utf-8', 'surrogatepass')} ", (len(own), []))[1]
            if item not in ids:
                ids.append(item)
    return found


_built: dict[str, object] = {}


def automaton(items: list[tuple[str, str]], size: int, name: str):
    """Built once per Python worker for each block of items; only the newest is kept."""
    if name not in _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for key, value in windows(items, size).items():
            a.add_word(key, value)
        a.make_automaton()
        _built.clear()
        _built[name] = a
    return _built[name]


def _numbered(benchmark: DataFrame, max_chars: int) -> tuple[DataFrame, int]:
    """The items with words and the number of the block that each falls into, and how many blocks of about ``max_chars`` there are."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // max_chars))
    return rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def _scan(docs: DataFrame, items: list[tuple[str, str]], size: int) -> DataFrame:
    spark = docs.sparkSession
    name = hashlib.sha256(repr((size, items)).encode("utf-8", "surrogatepass")).hexdigest()
    sent = spark.sparkContext.broadcast(items)  # about the block's characters

    def hits(text: str, a) -> tuple[int, list[int], list[str], list[tuple[int, int]]]:
        words = words_of(text)
        if not words or not len(a):
            return len(words), [], [], []
        line = b" ".join(words).decode("utf-8", "surrogatepass")
        found = list(a.iter(f" {line} "))
        if not found:
            return len(words), [], [], []
        begins = np.cumsum([0, *(len(w.decode("utf-8", "surrogatepass")) + 1 for w in words)])
        edge = np.zeros(len(words) + 1, np.int64)
        ids: set[str] = set()
        for end, (n, own) in found:
            last = int(np.searchsorted(begins, end))  # the blank after the window stands before word number ``last``
            edge[last - n] += 1
            edge[last] -= 1
            ids.update(own)
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0).tolist()
        places = [m.span() for m in _WORD.finditer(text)]
        spans: list[tuple[int, int]] = []
        for _, run in itertools.groupby(enumerate(hit), lambda x: x[1] - x[0]):
            own = [x for _, x in run]
            spans.append((places[own[0]][0], places[own[-1]][1]))
        return len(words), hit, sorted(ids), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(sent.value, size, name)
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        for batch, texts in text_slices(batches):
            n, hit, ids, spans = zip(*(hits(t, a) for t in texts), strict=True)
            spans = [[{"start": x, "stop": y} for x, y in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip((n, hit, ids, spans), kinds, strict=True))], names=["doc_id", "n_words", "hit_words", "item_ids", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, max_chars: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, contaminated, hit_words, item_ids, spans.

    Texts are folded to lower case a-z, digits and non-ASCII characters.  A word inside any occurrence of
    a ``size``-word window of an item is hit; an item of fewer words is one window.  A document is
    contaminated when ``share`` times its hit words reach its words.  ``spans`` are the runs of hit words
    as code points of the original text.  Null texts have no words; items with a null id or text, or
    without words, are left out; a repeated item id counts once.  Documents are matched row by row, so
    repeated rows give repeated rows.  The items go out in blocks of about ``max_chars``, one at a time: no
    more than a block is in the driver, and an automaton holds no more.  With several, each reads all
    documents, its hits are written, and they meet by row.
    """
    items, n = _numbered(benchmark, max_chars)
    block = lambda i: [tuple(r) for r in items.where(F.col("block") == i).select("item_id", "text").orderBy("item_id", "text").collect()]
    if n == 1:
        found = _scan(docs, block(0), size)
    else:
        # Rows are numbered once and for all in a written table, and meet by their numbers.
        rows = docs.select(F.col("doc_id").cast("long").alias("own"), F.col("text").cast("string").alias("text")).withColumn("key", F.monotonically_increasing_id())
        rows = materialize(rows, "numbered")
        each = [materialize(_scan(rows.select(F.col("key").alias("doc_id"), "text"), block(i), size), "hits") for i in range(n)]
        every = each[0]
        for x in each[1:]:
            every = every.unionByName(x)
        met = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
        found = met.join(rows.select("key", "own"), met["doc_id"] == F.col("key")).select(F.col("own").alias("doc_id"), "n_words", "hit_words", "item_ids", "spans")
    n_hit = F.size("hit_words").cast("long")
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long"), "contaminated": (n_hit > 0) & (share * n_hit >= F.col("n_words"))})


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns whose id has no contaminated row (null ids: none that is null)."""
    bad = find_contamination(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
