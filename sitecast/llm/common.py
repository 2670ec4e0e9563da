"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import itertools
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master.startswith("local"):  # one machine: any folder is shared
        return "file:///tmp/checkpoints/sitecast"
    return spark.conf.get("spark.sql.warehouse.dir") + "/sitecast_scratch"


def materialize(df: DataFrame, name: str, rows: int | None = None, each: int = 10_000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors don't recompute what led to it.

    Where about how many ``rows`` the last stage handles is known, it has a task and a file for every ``each`` of them,
    but no more than it would have.  Hadoop's local file system starts several processes for each file, and while one
    starts, the executor's memory counts twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / each)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove the files of a materialized DataFrame that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_slices(batches: Iterator[pa.RecordBatch], max_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that the texts of one piece hold about ``max_chars`` at most; null texts become empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        begin = size = 0
        for i, text in enumerate(texts):
            if i > begin and size + len(text or "") > max_chars:
                yield batch.slice(begin, i - begin), [t or "" for t in texts[begin:i]]
                begin, size = i, 0
            size += len(text or "")
        if begin < len(texts):
            yield batch.slice(begin), [t or "" for t in texts[begin:]]


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer file at ``path``, loaded once per Python worker; Spark supplies the parallelism."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def text_arrays(batches: Iterator[pa.RecordBatch], max_bytes: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """As ``text_slices``, but with the texts as an Arrow array, cut at about ``max_bytes``."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")).cast(pa.string()), "")
        sums = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        begin = 0
        while begin < len(texts):
            done = int(sums[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(sums, done + max_bytes, side="right")))
            yield batch.slice(begin, end - begin), texts.slice(begin, end - begin)
            begin = end


#: Marks that may follow a word; together with other marks they form a token run of their own.
_MARKS = ".,;:!?#$%&*()"
#: Letters below this have been letters in every version of the character tables that the library may hold.
_SETTLED = "\u0530"
#: Kinds of characters in a word.
_END, _LETTER, _MARK, _ODD = range(4)


def _byte_chars() -> np.ndarray:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    table = np.arange(256, dtype="<u2")
    table[rest] = 256 + np.arange(len(rest))
    return table


class _Runs(dict):
    """Ids of runs of marks, and of line ends before a word, remembered; there are few."""

    def __init__(self, path: str):
        super().__init__({"": []})
        self.path = path

    def __missing__(self, run: str) -> list[int]:
        if len(self) > 100_000:
            self.clear()
        # Of line ends before a word the last is a pre-token of its own.
        parts = [run[:-1], "\n"] if run[:1] == "\n" else [run]
        self[run] = ids = [i for x in encode(self.path, parts) for i in x]
        return ids


class Encoder:
    """Token ids of whole texts, remembered word by word.

    The byte-level tokenizer never lets a token cross from one word into the white space before the next,
    so where words are set apart by one blank or by line ends, the ids of a word, with what stands before
    it, don't depend on the rest.  Arrow splits the texts and numbers their words; the library is asked
    once for the new words of a batch, which are remembered.  Texts with any other white space, and those with added
    tokens, go to the library whole.  Beyond ``max_words`` the words met least often are forgotten, half of
    them at least, which bounds the memory.

    Keys: a word with the blank before it is itself, one after line ends starts with these, and the first
    of a text, which has nothing before it, starts with a blank, as no other can.
    """

    def __init__(self, path: str, max_words: int = 250_000):
        self.path, self.max_words, self.chars = path, max_words, _byte_chars()
        self.around = _Runs(path)
        self.model = tokenizer(path).model
        vocabulary, zero = tokenizer(path).get_vocab(), chr(self.chars[0])
        #: By id, whether the token starts with a blank; the id of byte 0, and whether it stands in no other token.
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank[[i for token, i in vocabulary.items() if token[0] == chr(self.chars[32])]] = True
        self.zero = vocabulary.get(zero)
        self.sole = [token for token in vocabulary if zero in token] == [zero]
        self.kinds = np.full(ord(_SETTLED) + 1, _ODD, np.uint8)
        self.kinds[[i for i in range(ord(_SETTLED)) if chr(i).isalpha()]] = _LETTER
        self.kinds[[ord(x) for x in _MARKS]] = _MARK
        self.kinds[0] = _END
        self._keep({}, np.zeros(0, np.int64))

    def _keep(self, known: dict[str, int], kept: np.ndarray) -> None:
        """Remember only the words ``known``, which had the numbers ``kept``."""
        self.known = known
        if not len(kept):
            self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.uses, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
            return
        self.flat, self.uses, self.apart, sizes = self._gather(kept), self.uses[kept] // 2, self.apart[kept], self.sizes[kept]
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes

    def _forget(self, most: int) -> None:
        """Remember only the words met most often, ``most`` at most."""
        least = 2
        while (self.uses >= least).sum() > most:
            least *= 2
        often = self.uses >= least
        words = itertools.compress(list(self.known), often.tolist())
        self._keep({w: i for i, w in enumerate(words)}, np.flatnonzero(often))

    def rest(self) -> None:
        """At the end of a task: give back what rare words took, so that a waiting worker holds little."""
        self._forget(50_000)
        pa.default_memory_pool().release_unused()

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """The numbers of distinct words; the next free ones for those that aren't known, which are learned."""
        found = np.array(list(map(self.known.get, keys, itertools.repeat(-1))), np.int64)
        missing = found < 0
        if missing.any():
            new = list(itertools.compress(keys, missing.tolist()))
            free = range(len(self.known), len(self.known) + len(new))
            found[missing] = free
            self.known.update(zip(new, free, strict=True))
            self._learn(new)
        return found

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words numbered ``at``, in order."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _plain(self, key: str) -> tuple[str, str, str] | None:
        """Line ends, letters with the blank before them, and marks, if the word is nothing else."""
        if key.isalpha() and (key.isascii() or max(key) < _SETTLED):
            return "", f" {key}", ""
        rest = key.lstrip("\n") if key[:1] == "\n" else key
        bare = rest[1:] if rest[:1] == " " else rest
        stem = bare.rstrip(_MARKS)
        if not stem.isalpha() or not (stem.isascii() or max(stem) < _SETTLED):
            return None
        return key[: len(key) - len(rest)], stem if rest is not bare or rest is not key else f" {stem}", bare[len(stem) :]

    def _learn(self, new: list[str]) -> None:
        plain, behind = self._together(new)
        starts = np.flatnonzero(self.blank[behind])
        if len(starts) != plain.sum():
            raise ValueError("a word without a token that starts with its blank")
        other, own = self._one_by_one(list(itertools.compress(new, (~plain).tolist())))
        sizes, begins = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        sizes[plain], begins[plain] = np.diff(starts, append=len(behind)), starts + len(self.flat)
        sizes[~plain], begins[~plain] = own[0], own[1] + len(self.flat) + len(behind)
        apart = np.zeros(len(new), bool)
        apart[~plain] = own[2]
        self.starts, self.sizes, self.apart = np.concatenate((self.starts, begins)), np.concatenate((self.sizes, sizes)), np.concatenate((self.apart, apart))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        self.flat = np.concatenate((self.flat, behind, other))

    def _together(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which words are letters behind a blank, with marks behind them or not, and the ids of all these, one after another.

        Letters and marks are pre-tokens of their own.  Between them stands byte 0, which no token but its own holds, so
        that the model takes many at once.
        """
        points = np.frombuffer("\0".join([*new, ""]).encode("utf-32-le"), "<u4")
        kind = self.kinds[np.minimum(points, len(self.kinds) - 1)]
        ends = np.flatnonzero(kind == _END)
        if len(ends) != len(new) or not self.sole:  # a word holds byte 0
            return np.zeros(len(new), bool), np.zeros(0, np.uint32)
        begins = np.concatenate(([0], ends[:-1] + 1))
        odd = kind == _ODD
        odd[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _MARK)
        odd = np.cumsum(odd)
        plain = (kind[begins] == _LETTER) & (odd[ends] == odd[begins])
        keep = np.repeat(plain, ends - begins + 1)
        points, kind = points[keep], kind[keep]
        before = np.concatenate(([_END], kind[:-1])) if len(kind) else kind
        words, tails = np.flatnonzero(before == _END), np.flatnonzero((kind == _MARK) & (before == _LETTER))
        points = np.insert(points, np.concatenate((words, tails)), np.repeat(np.array([32, 0], "<u4"), (len(words), len(tails))))
        raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        spelled, tokenize = self.chars[raw].tobytes().decode("utf-16-le"), self.model.tokenize
        edges = [0, *np.flatnonzero(raw == 0)[63::64].tolist(), len(raw)]
        ids = np.array([t.id for a, b in itertools.pairwise(edges) for t in tokenize(spelled[a:b])], np.uint32)
        return plain, ids[ids != self.zero]

    def _one_by_one(self, new: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of words at the start of a text or behind line ends, and of odd ones: their sizes, where they start, and which send their text to the library."""
        split = list(map(self._plain, new))
        plain = np.fromiter((p is not None for p in split), bool, len(new))
        leads, stems, tails = zip(*filter(None, split), strict=True) if plain.any() else ((), (), ())
        # Letters as the model has their bytes; no word holds byte 0, which keeps them apart.
        raw = np.frombuffer("\0".join(stems).encode(), np.uint8)
        spelled = self.chars[raw].tobytes().decode("utf-16-le").split(chr(self.chars[0]))
        flat: list[int] = []
        ends, tokenize, around = [0], self.model.tokenize, self.around
        for lead, word, tail in zip(leads, spelled, tails):  # noqa: B905 - an empty list splits to one empty word
            flat += [t.id for t in tokenize(word)]
            if lead or tail:
                flat[ends[-1] : ends[-1]] = around[lead]
                flat += around[tail]
            ends.append(len(flat))
        apart = np.zeros(len(new), bool)
        hard, texts = np.flatnonzero(~plain).tolist(), []
        for i in hard:
            key = new[i]
            rest = key.lstrip("\n") if key[:1] == "\n" else key[1:] if key[:1] == " " else key
            # One word, line ends alone, or an empty text; else the text must go to the library whole.
            apart[i] = "<|" in rest or rest.split() != [rest] if rest else not key
            texts.append("" if apart[i] else key[1:] if key[:1] == " " else key if key[:1] == "\n" else f" {key}")
        for own in encode(self.path, texts):
            flat += own
            ends.append(len(flat))
        order = np.empty(len(new), np.int64)
        order[np.concatenate((np.flatnonzero(plain), np.array(hard, np.int64)))] = np.arange(len(new))
        edges = np.array(ends, np.int64)
        return np.array(flat, np.uint32), (np.diff(edges)[order], edges[order], apart)

    def __call__(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with ``end_id`` behind it unless that is None, and how many each has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > self.max_words:
            self._forget(self.max_words // 2)
        split = pc.split_pattern(pc.replace_substring_regex(texts, "(\n+)", r" \1"), " ")
        words, begins = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        begins = begins - begins[0]
        keys = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = words.indices.to_numpy()
        at = self._numbers(keys)[codes]
        firsts, place = np.unique(codes[begins[:-1]], return_inverse=True)
        at[begins[:-1]] = self._numbers([f" {keys[i]}" for i in firsts.tolist()])[place]
        self.uses += np.bincount(at, minlength=len(self.uses))
        flat = self._gather(at)
        sizes = np.add.reduceat(self.sizes[at], begins[:-1])
        if len(whole := np.flatnonzero(np.add.reduceat(self.apart[at], begins[:-1]))):
            each = np.split(flat, np.cumsum(sizes)[:-1])
            for i, x in zip(whole.tolist(), encode(self.path, texts.take(pa.array(whole)).to_pylist()), strict=True):
                each[i], sizes[i] = np.array(x, np.uint32), len(x)
            flat = np.concatenate(each)
        if end_id is not None:
            flat, sizes = np.insert(flat, np.cumsum(sizes), end_id), sizes + 1
        return flat, sizes


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that tasks share what it remembers."""
    if path not in _encoders:
        pa.set_memory_pool(pa.system_memory_pool())  # which gives what a batch took back to the executor
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
