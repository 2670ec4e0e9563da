"""Edit-aware token counts (op 3).

A document that edits touch is held as a segment tree over its pre-tokens, with sums of characters and of
tokens; an added token of the tokenizer is a pre-token of its own.  An edit descends by characters to the pre-tokens it meets, encodes their new text again with a few
pre-tokens of context before and as many after as it takes until old and new boundaries coincide, and
updates the sums above them; the rest of the document is left alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import encoder, text_arrays, tokenizer

EDITS = "array<struct<start: long, stop: long, replacement: string>>"


@functools.lru_cache
def added_tokens(path: str) -> tuple[re.Pattern | None, int]:
    """A pattern of the tokens that are cut out before all else, and how many pre-tokens around an edit they may reach over."""
    tok = tokenizer(path)
    own = sorted({t.content for t in tok.get_added_tokens_decoder().values()}, key=lambda t: (-len(t), t))
    most = max((len(tok.pre_tokenizer.pre_tokenize_str(t)) for t in own), default=0)
    return re.compile("|".join(map(re.escape, own))) if own else None, max(2, most)


class TokenTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, path: str, sizes: dict[str, int]):
        self.tok, self.sizes = tokenizer(path), sizes
        self.added, self.context = added_tokens(path)
        pieces = self._split(text)
        self.base = 1
        while self.base < max(1, len(pieces)):
            self.base *= 2
        self.text = [p for p, _ in pieces] + [""] * (self.base - len(pieces))
        self.chars = np.zeros(2 * self.base, np.int64)
        self.tokens = np.zeros(2 * self.base, np.int64)
        self.chars[self.base : self.base + len(pieces)] = [len(p) for p, _ in pieces]
        self.tokens[self.base : self.base + len(pieces)] = [n for _, n in pieces]
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.encoded = 0

    def _split(self, text: str) -> list[tuple[str, int]]:
        """(pre-token, its tokens); the tokenizer's own pre-tokenizer and model between added tokens, which are one token each."""
        if self.added:
            out, done = [], 0
            for m in self.added.finditer(text):
                out += [*self._plain(text[done : m.start()]), (m.group(), 1)]
                done = m.end()
            return out + self._plain(text[done:])
        return self._plain(text)

    def _plain(self, text: str) -> list[tuple[str, int]]:
        out = []
        for spelled, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text):
            if spelled not in self.sizes:
                if len(self.sizes) > 300_000:
                    self.sizes.clear()
                self.sizes[spelled] = len(self.tok.model.tokenize(spelled))
            out.append((text[a:b], self.sizes[spelled]))
        return out

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it begins."""
        i, begin = 1, 0
        while i < self.base:
            i *= 2
            if at - begin >= self.chars[i]:
                begin += int(self.chars[i])
                i += 1
        return i - self.base, begin

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        i = self.base + leaf
        self.text[leaf], self.chars[i], self.tokens[i] = text, len(text), tokens
        i //= 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    def _before(self, leaf: int) -> int:
        """The nearest leaf to the left that holds text, or this one."""
        i = leaf - 1
        while i >= 0 and not self.text[i]:
            i -= 1
        return max(i, 0) if i >= 0 else leaf

    def replace(self, start: int, stop: int, new: str) -> None:
        """Replace the characters [start, stop), cut to the text, by ``new``."""
        total = int(self.chars[1])
        start = min(max(start, 0), total)
        stop = min(max(stop, start), total)
        if start == stop and not new:
            return
        first, begin = self._leaf(max(start - 1, 0)) if total else (0, 0)
        for _ in range(self.context):
            if (left := self._before(first)) != first:
                begin -= len(self.text[left])
                first = left
        last, last_begin = self._leaf(min(stop, total - 1)) if total else (0, 0)
        reach = self.context + 2
        while True:
            end, stretch = last, 0
            while end + 1 < self.base and stretch < reach:
                end += 1
                stretch += bool(self.text[end])
            old = [self.text[i] for i in range(first, end + 1)]
            region = "".join(old)
            text = region[: start - begin] + new + region[stop - begin :]
            pieces = self._split(text)
            whole = end + 1 >= self.base or begin + len(region) >= total
            # Old boundaries after the edit, in new places; pre-tokens at the end may be cut short.
            shift = len(new) - (stop - start)
            edges, at = {}, 0
            for k, t in enumerate(old):
                if k and at >= stop - begin:
                    edges[at + shift] = first + k
                at += len(t)
            at, take, upto = 0, None, None
            for k, (t, _) in enumerate(pieces[: max(0, len(pieces) - self.context)]):
                if at >= start - begin + len(new) and at in edges:
                    take, upto = k, edges[at]
                    break
                at += len(t)
            if take is not None or whole:
                break
            reach *= 2
        if take is None:
            take, upto = len(pieces), end + 1
        self.encoded += sum(len(t) for t, _ in pieces[:take])
        self._put(first, "".join(t for t, _ in pieces[:take]), sum(n for _, n in pieces[:take]))
        for leaf in range(first + 1, upto):
            if self.text[leaf] or self.chars[self.base + leaf]:
                self._put(leaf, "", 0)


def attach(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with an ``edits`` column from rows (doc_id, start, stop, replacement)."""
    own = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("edited")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("replacement").cast("string").alias("replacement"))).alias("edits"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(own, F.col("doc_id") == F.col("edited"), "left").drop("edited")


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, edits): doc_id, n_tokens, n_tokens_edited, n_edits, n_chars_encoded.

    ``edits`` holds replacements of code point ranges of the text as it stands; those that overlap one
    before them are cut to start where it ends; offsets beyond the text are cut to it; a null
    replacement deletes; null edits are none.  A null text counts as empty.  ``n_chars_encoded`` is what
    the edits made it encode again.  An empty table gives no rows; repeated rows give repeated rows;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[str, int] = {}
        encode = encoder(tokenizer_path)
        for batch, texts in text_arrays(batches):
            counts = encode(texts)[1].tolist()
            after, done, encoded = [], [], []
            for text, n, edits in zip(texts, counts, batch.column(2).to_pylist(), strict=True):
                own, at = [], 0
                for e in sorted((e for e in edits or [] if e), key=lambda e: (e["start"] or 0, e["stop"] or 0)):
                    begin = max(e["start"] or 0, at)
                    at = max(begin, e["stop"] or 0)
                    own.append((begin, at, e["replacement"] or ""))
                if own:
                    tree = TokenTree(text.as_py(), tokenizer_path, sizes)
                    for begin, end, new in reversed(own):
                        tree.replace(begin, end, new)
                    n, again = tree.total, tree.encoded
                else:
                    again = 0
                after.append(n)
                done.append(len(own))
                encoded.append(again)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (counts, after, done, encoded))], names=["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_chars_encoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_chars_encoded long")
