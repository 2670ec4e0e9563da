"""Language identification by cross-parsing entropy (op 9).

For each language a suffix automaton of a bounded sample of labelled text recognises every substring of
the sample.  A text is parsed greedily into the longest phrases that the sample holds; the language that
needs the fewest phrases, each weighed by log2 of the sample's length as a pointer into it costs, wins.

Texts are cut into pieces that advance in lockstep, one numpy step for all pieces and languages at once,
so that long texts cost no more per character than short ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitecast.llm.common import text_slices


@dataclass(frozen=True)
class LanguageParams:
    #: Bound of the sample: documents and characters for each language, and languages.
    sample_docs: int = 200
    sample_chars: int = 24_000
    max_languages: int = 64
    piece: int = 512


_NOT_LETTER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Lower case, every run of other characters one blank."""
    return _NOT_LETTER.sub(" ", text.lower())


def suffix_automaton(text: str) -> tuple[list[dict[str, int]], int]:
    """Transitions by state; state 0 is the start.  At most twice as many states as characters."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, len(nxt)


class Parser:
    """Phrase counts of texts under each language's sample."""

    def __init__(self, samples: dict[str, str], piece: int):
        self.langs, self.piece = sorted(samples), piece
        letters = sorted({c for s in samples.values() for c in s} | {" "})
        self.symbols = len(letters) + 1  # 0: a letter that no sample has
        self.code = np.zeros(0x110000, np.uint16)
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.cost = np.array([math.log2(len(samples[x]) + 2) for x in self.langs])
        tables, offset = [], 0
        for x in self.langs:
            nxt, n = suffix_automaton(samples[x])
            t = np.full((n, self.symbols), -1, np.int32)
            for state, moves in enumerate(nxt):
                for c, to in moves.items():
                    t[state, self.code[ord(c)]] = to
            # Where a phrase ends the parse goes on from the start: such moves are kept as odd numbers.
            start = np.where(t[0] < 0, 0, t[0])
            tables.append(np.where(t >= 0, (t + offset) * 2, (start + offset)[None, :] * 2 + 1))
            offset += n
        self.starts = np.cumsum([0, *(len(t) for t in tables)])[:-1].astype(np.int32)
        self.table = np.concatenate(tables).astype(np.int32).reshape(-1)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases by text and language; texts are folded."""
        owners, pieces = [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t), self.piece):
                owners.append(i)
                pieces.append(t[a : a + self.piece])
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not pieces:
            return out
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order])
        joined = np.frombuffer("".join(pieces[i] for i in order).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.code[joined]
        grid = np.zeros((int(sizes[0]), len(order)), np.uint16)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grid[at, np.repeat(np.arange(len(order)), sizes)] = codes
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # pieces longer than the step
        state = np.repeat(self.starts[:, None], len(order), axis=1)
        count = np.ones((len(self.langs), len(order)), np.int32)
        for step in range(int(sizes[0])):
            n = int(active[step])
            to = self.table[state[:, :n] * np.int32(self.symbols) + grid[step, :n]]
            count[:, :n] += to & 1
            state[:, :n] = to >> 1
        np.add.at(out, np.array([owners[i] for i in order]), count.T)
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        folded = [fold(t) for t in texts]
        cost = self.phrases(folded) * self.cost
        out = []
        for t, c in zip(folded, cost, strict=True):
            if not any(map(str.isalpha, t)) or not len(c):
                out.append(("und", 0.0))
                continue
            bits = c / len(t)
            odds = np.exp2(np.clip((bits.min() - bits) * min(len(t), 200), -60, 0))
            out.append((self.langs[int(np.argmin(bits))], float(1 / odds.sum())))
        return out


_parsers: dict[object, Parser] = {}


def samples(labelled: DataFrame, params: LanguageParams) -> dict[str, str]:
    """A bounded sample of text by language: of each, the documents whose ids hash lowest, in equal shares.

    Each ranked row carries its own piece of text, so rows that share an id count as rows and no more than
    ``max_languages`` * ``sample_docs`` pieces reach the driver, whatever repeats.
    """
    share = params.sample_chars // params.sample_docs
    # The middle of a document stands for it.
    text = F.expr(f"substring(text, greatest(1, int(length(text) / 2) - {2 * share}), {4 * share})")
    labelled = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    langs = sorted(r[0] for r in labelled.select("lang").distinct().limit(params.max_languages + 1).collect())
    if len(langs) > params.max_languages:
        raise ValueError(f"more than {params.max_languages} languages")
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = labelled.select("doc_id", "lang", text.alias("text")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= params.sample_docs).select("lang", "rank", "text").collect()
    out = {}
    for lang in langs:
        own = [fold(r.text).strip() for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.rank)]
        own = [x for x in own if x]
        if own:
            each = max(share, params.sample_chars // len(own))
            out[lang] = " ".join(x[:each] for x in own)[: params.sample_chars]
    return out


def identify(docs: DataFrame, labelled: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``; learns from ``labelled`` (doc_id, text, lang).

    ``und`` with score 0 where the text is null or has no letter, and everywhere if nothing is labelled.
    Only the text decides: equal texts get equal results.  Ties go to the first language by name.  Score
    is the winner's share of probability under the code lengths of up to 200 characters.
    """
    learned = samples(labelled, params)
    key = hash((tuple(sorted(learned.items())), params.piece))
    sent = docs.sparkSession.sparkContext.broadcast(learned)  # at most max_languages * sample_chars characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(sent.value, params.piece) if sent.value else None
        parser = _parsers[key]
        for batch, texts in text_slices(batches, 2_000_000):
            found = parser.predict(texts) if parser else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
