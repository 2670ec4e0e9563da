"""Ranked lexical search with bag deduplication (op 12).

Only an item's own terms count for it, and a document's length counts through one integer m.  So documents
are cut down to the vocabulary of the items, those with the same term counts and the same m form a class,
found by a hash and held against the whole vectors, and a class is scored once.  A task keeps of each item
the classes that can hold one of its best documents; their members, of which ``top`` each can matter, are
expanded by ascending doc_id at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitecast.llm.common import delete, materialize, text_slices
from sitecast.llm.decontaminate import words_of

#: Sums of 64-bit integers stay exact in doubles below this.
_EXACT = 2**53


def _item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, term), once each: the terms of all rows of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            terms = [sorted({w.decode("utf-8", "surrogatepass") for w in words_of(t)}) for t in texts]
            rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([w for t in terms for w in t], pa.string())], names=["item_id", "term"])

    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, term string").distinct()


def bags(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row with a term: all its terms with repeats, and its counts of vocabulary terms by ascending number."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w.encode("utf-8", "surrogatepass"): i for w, i in sent.value.items()}
        for batch, texts in text_slices(batches):
            keep, sizes, terms, tfs = [], [], [], []
            for i, text in enumerate(texts):
                words = words_of(text)
                if not words:
                    continue
                counts = Counter(words)
                own = sorted((known[w], counts[w]) for w in counts.keys() & known.keys())
                keep.append(i)
                sizes.append(len(words))
                terms.append([t for t, _ in own])
                tfs.append([c for _, c in own])
            columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<bigint>")


def _classes(found: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(class, m, terms, tfs, members): one row for each distinct (tf vector, m) with a vocabulary term, and its ``top`` smallest doc_ids.

    The hash only deals the rows out; rows of a class agree in the whole vector and in m.  Null doc_ids come last.
    """
    m = F.lit(50) + F.floor(F.expr(f"(50 * n * {n_docs}L) div {n_terms}L"))
    own = found.where(F.size("terms") > 0).select("doc_id", m.cast("long").alias("m"), "terms", "tfs")
    own = own.withColumn("hash", F.xxhash64("terms", "tfs", "m"))
    # Limited before the shuffle too, so that a class of any size brings ``top`` rows a task.
    place = F.row_number().over(Window.partitionBy("hash", "m", "terms", "tfs").orderBy(F.col("doc_id").asc_nulls_last()))
    some = own.withColumn("place", place).where(F.col("place") <= top)
    one = some.groupBy("hash", "m", "terms", "tfs").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id"))).alias("p"))
    return one.select(F.monotonically_increasing_id().alias("class"), "m", "terms", "tfs", F.col("p.doc_id").alias("members"))


def _scored(classes: DataFrame, weights: dict[int, int], items_of: list[list[int]], n_items: int, top: int) -> DataFrame:
    """(item, class, first, score) of the classes that are among a task's ``top`` of an item, by score and smallest doc_id.

    A class that ``top`` others outrank by these can hold none of the best ``top`` documents.
    """
    sent = classes.sparkSession.sparkContext.broadcast((weights, items_of))  # one block's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term, held = sent.value
        weight = np.zeros(len(held), np.int64)
        weight[list(by_term)] = list(by_term.values())
        counts = np.array([len(x) for x in held], np.int64)
        flat = np.array([i for x in held for i in x], np.int64)
        starts = np.cumsum(counts) - counts
        best = [np.zeros(0, np.int64)] * 4  # item, score, first, class

        def kept(item: np.ndarray, score: np.ndarray, first: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
            order = np.lexsort((own, first, -score, item))
            item, score, first, own = item[order], score[order], first[order], own[order]
            begin = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, np.int64)
            rank = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
            few = rank < top
            return [item[few], score[few], first[few], own[few]]

        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                name, m, first = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
                terms, tfs = part.column(2), part.column(3)
                sizes = np.diff(terms.offsets.to_numpy())
                term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                each = counts[term]
                to = flat[np.repeat(starts[term] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))]
                cell = np.repeat(row, each) * n_items + to
                value = np.repeat(impact, each)
                if int(impact.max(initial=0)) * int(sizes.max(initial=0)) < _EXACT:
                    score = np.bincount(cell, weights=value, minlength=len(sizes) * n_items).astype(np.int64)
                else:
                    score = np.zeros(len(sizes) * n_items, np.int64)
                    np.add.at(score, cell, value)
                score = score.reshape(len(sizes), n_items)
                # A class below an item's ``top``-th score so far can't come in.
                least = np.ones(n_items, np.int64)
                full = np.flatnonzero(np.bincount(best[0], minlength=n_items) >= top)
                low = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(low, best[0], best[1])
                least[full] = low[full]
                r, i = np.nonzero(score >= least)
                new = [i, score[r, i], first[r], name[r]]
                best = kept(*(np.concatenate(x) for x in zip(best, new, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), pa.array(best[3]), pa.array(best[2]), pa.array(best[1])], names=["item", "class", "first", "score"])

    last = (1 << 63) - 1  # where a class has no member with an id
    return classes.select("class", "m", "terms", "tfs", F.coalesce(F.col("members")[0], F.lit(last)).alias("first")).mapInArrow(run, "item int, class long, first long, score long")


def _ranked(rows: DataFrame, top: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), *order))).where(F.col("rank") <= top)


def search(docs: DataFrame, benchmark: DataFrame, top: int = 50, block_terms: int = 200_000) -> DataFrame:
    """The ``top`` best documents of every item of ``benchmark`` (item_id, text): item_id, rank, doc_id, score.

    Terms, weights and scores as the contract has them, in integers but for the logarithm; only scores above 0
    are ranked, equal ones by ascending doc_id, null ids last.  Rows that share an item_id are one item with the
    terms of all (also those with a null id); items without a term, and empty tables, give no rows.  Each row of
    ``docs`` is a document, repeated ones too; null texts have no terms; other columns are ignored.

    Items go out in blocks of about ``block_terms`` (item, term) pairs; each reads all documents, and no more than a block's
    vocabulary is in the driver or broadcast.  Intermediate tables are written to the shared folder.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    pairs = materialize(_item_terms(benchmark), "item-terms")
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("size"))
    blocks = max(1, math.ceil((sizes.agg(F.sum("size")).first()[0] or 0) / block_terms))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    results = []
    for b in range(blocks):
        rows = pairs.where(F.col("block") == b).select("item_id", "term").collect()  # about block_terms rows
        ids = sorted({r[0] for r in rows}, key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(ids)}
        vocabulary = {w: i for i, w in enumerate(sorted({r[1] for r in rows}))}
        items_of: list[list[int]] = [[] for _ in vocabulary]
        for item, term in rows:
            items_of[vocabulary[term]].append(number[item])
        found = materialize(bags(docs, vocabulary), "bags")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if n_docs and ids:
            df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # one row a vocabulary term
            weights = {r.term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in df}
            classes = materialize(_classes(found, n_docs, n_terms, top), "classes")
            near = _ranked(_scored(classes, weights, items_of, len(ids), top), top, F.asc("first"), F.asc("class")).drop("rank")
            members = near.join(classes.select("class", "members"), "class").select("item", "score", F.explode("members").alias("doc_id"))
            names = spark.createDataFrame([(i, x) for x, i in number.items()], f"item int, item_id {kind}")
            best = _ranked(members, top, F.col("doc_id").asc_nulls_last()).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            results.append(materialize(best, "ranked"))
            delete(classes)
        delete(found)
    delete(pairs)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for x in results:
        out = out.unionByName(x)
    return out
