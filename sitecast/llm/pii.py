"""Personal data with a skip-chain conditional random field (op 5).

Base patterns find addresses and numbers.  Candidate tokens are variables: neighbours are tied in a chain, and
tokens of the same normalised form, however far apart, along their occurrences (each to the next, so a form with
n occurrences costs n - 1 ties).  Node potentials come from the token's shape and what stands before it; ties
favour equal labels.  Found mentions are observed variables.  Every other mention of their form has ties of its own
to the nearest of each kind, whose message no number of bare mentions between weakens, and so, more loosely, has
every mention of a similar form: the same but for separators or one edit, or the same last digits.  Where nothing is
found, a form's addresses written with ``at`` and numbers after a word for telephones have such ties to its other
mentions.  These ties reward agreement on a kind only, so bare mentions can't outvote what tells of one.
Loopy belief propagation spreads the evidence, so that a mention that the patterns miss (a number without its
prefix, an address spelled with ``at``, the local part of a found address) takes the label of the entity
that it repeats, however often it is repeated.  Where found mentions of a form differ in kind, the most
frequent is tied in full, of equally frequent ones the first of ``KINDS``, and others by a third of their share of it.

Where no variable prefers a kind to nothing by itself, symmetric ties can't make one do so: no label passes one half,
and such texts aren't propagated.

No rows are labelled with personal data, so the potentials are parameters, not fitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import text_slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


@dataclass(frozen=True)
class FieldParams:
    #: Log potentials: a token that no base span holds, its shape, a word before it; ties in the chain and over equal forms.
    outside: float = -2.0
    shape: float = 0.8
    cue: float = 1.0
    chain: float = 0.2
    skip: float = 3.0
    #: A whole address written with ``at``, a number of 9 to 15 digits right after a word for telephones, the likeness to a found mention.
    spelled: float = 4.0
    called: float = 1.5
    similar: float = 2.4
    rounds: int = 8
    #: Characters that a form must have to be tied over a distance.
    least_form: int = 7
    #: And to count as similar to another.
    least_similar: int = 9
    accept: float = 0.5


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without trying every start: an address needs its @, before which the local part runs back."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 if n > 4 else n * 2
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


#: Candidate tokens: addresses in words, runs of digits with separators, and words with marks or digits in them.
_TOKEN = re.compile(r"\w[\w.+-]*(?: ?[\[(]at[\])] ?|@)[\w.-]*\w|\+?[0-9(][0-9 ().-]*[0-9]|\w+(?:[._-]\w+)+|\w*[0-9]\w*")
_CUES = re.compile(r"(?i)(?:mail|e-mail|phone|tel|call|fax|card|contact|address|user|ip)\W{0,3}\Z")


def _form(token: str) -> str:
    """Digits alone where they prevail, else the lower-case token with ``at`` written out as @."""
    digits = re.sub(r"[^0-9]", "", token)
    if len(digits) >= 7 and not re.search(r"[^\W\d_]", token):
        return digits[-10:] if len(digits) >= 10 else digits
    return re.sub(r" ?[\[(]at[\])] ?", "@", token).lower()


_SPELLED = re.compile(r"\w[\w.+-]* ?[\[(]at[\])] ?[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_CALL = re.compile(r"(?i)(?:phone|tel|call|fax)\W{0,3}\Z")
#: Numbers that begin with a date aren't taken for telephones.
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}([-./])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([-./])(?:0?[1-9]|1[0-2])\2(?:19|20)[0-9]{2})(?![0-9])")
#: What a text must hold to be read by the field where the patterns found nothing.
_HINT = re.compile(r"(?i)[\[(]at[\])]|(?:phone|tel|call|fax)\W{0,3}\+?[0-9(][0-9 ().-]{7,}[0-9]")


def _near_forms(form: str) -> set[str]:
    """Keys of which similar forms share one: without separators, with one character less, the last seven digits."""
    bare = re.sub(r"[._+-]", "", form.split("@")[0] if "@" in form else form)
    if form.isdigit():
        return {form[-7:], *(form[:i] + form[i + 1 :] for i in range(len(form)))}
    return {bare, *(bare[:i] + bare[i + 1 :] for i in range(len(bare)))}


def propagate(node: np.ndarray, u: np.ndarray, v: np.ndarray, tie: np.ndarray, rounds: int, kinds_only: np.ndarray | None = None) -> np.ndarray:
    """Marginal probabilities by damped loopy belief propagation; ties (u, v) add ``tie`` to equal labels' log potential.

    Ties marked in ``kinds_only`` add nothing where both ends have the last label.  A label whose potential is -inf is ruled out.
    """
    gain = np.repeat(np.expm1(tie)[:, None], node.shape[1], axis=1)
    if kinds_only is not None:
        gain[kinds_only, -1] = 0.0
    src, dst, gain = np.concatenate((u, v)), np.concatenate((v, u)), np.concatenate((gain, gain))
    back = np.concatenate((np.arange(len(u)) + len(u), np.arange(len(u))))
    message = np.zeros((len(src), node.shape[1]))
    for _ in range(rounds):
        belief = node.copy()
        np.add.at(belief, dst, message)
        cavity = belief[src] - message[back]
        e = np.exp(cavity - cavity.max(axis=1, keepdims=True))
        new = np.log(e.sum(axis=1, keepdims=True) + gain * e)
        message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
    belief = node.copy()
    np.add.at(belief, dst, message)
    odds = np.exp(belief - belief.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _told(told: np.ndarray, bare: np.ndarray, says: np.ndarray, skip: float) -> list[tuple[int, int, float, bool]]:
    """Ties of each of ``bare`` to the nearest of ``told`` by kind, in full to the kind most of them tell of."""
    out: list[tuple[int, int, float, bool]] = []
    counts = says[told].sum(axis=0)
    for k in np.flatnonzero(counts).tolist():
        own = told[says[told, k]]
        after = np.searchsorted(own, bare)
        before, after = own[np.maximum(after - 1, 0)], own[np.minimum(after, len(own) - 1)]
        nearest = np.where(np.abs(bare - before) <= np.abs(after - bare), before, after)
        tie = skip if k == counts.argmax() else skip * float(counts[k] / counts.max()) / 3
        out += [(x, y, tie, True) for x, y in zip(nearest.tolist(), bare.tolist(), strict=True)]
    return out


def field_spans(text: str, base: list[tuple[int, int, int]], p: FieldParams) -> list[tuple[int, int, int]]:
    """Added spans of a text; none overlaps a base span."""
    if not base and p.outside + p.shape + p.cue <= 0 and not _HINT.search(text):
        return []  # no token can prefer a kind
    tokens = [m.span() for m in _TOKEN.finditer(text) if m.end() - m.start() >= 2]
    if not tokens:
        return []
    spans = sorted((a, b, k) for k, a, b in base)
    starts = np.array([a for a, _, _ in spans], np.int64)
    n, labels = len(tokens), len(KINDS)
    node = np.full((n, labels + 1), p.outside)
    node[:, labels] = 0.0  # the last label: nothing personal
    inside, says = np.zeros(n, bool), np.zeros((n, labels), bool)  # observed; which kinds a mention tells its form's others of
    forms: dict[str, list[int]] = {}
    whole: list[str] = []
    for i, (a, b) in enumerate(tokens):
        word = text[a:b]
        for q in range(max(0, int(np.searchsorted(starts, b)) - 4), min(len(spans), int(np.searchsorted(starts, b)) + 1)):
            if spans[q][0] < b and a < spans[q][1]:
                says[i, spans[q][2]] = inside[i] = True
        if not inside[i]:
            digits = sum(c.isdigit() for c in word)
            if "@" in word or "at" in word and re.search(r"[\[(]at[\])]", word):
                node[i, 0] += p.shape
                if _SPELLED.fullmatch(word):
                    node[i, 0] += p.spelled
                    says[i, 0] = True
            if digits >= 9 and not _DATE.match(word):
                node[i, 3] += p.shape
                if digits <= 15 and not re.search(r"[^\W\d_]", word) and _CALL.search(text, max(0, a - 12), a):
                    node[i, 3] += p.called
                    says[i, 3] = True
            if digits >= 13:
                node[i, 2] += p.shape
            if word.count(".") == 3 and digits >= 4:
                node[i, 1] += p.shape
            if _CUES.search(text, max(0, a - 12), a):
                node[i, :labels] += p.cue
        whole.append(f := _form(word))
        for form in {f, f.split("@")[0]}:
            if len(form) >= p.least_form:
                forms.setdefault(form, []).append(i)
    if not says.any() and node[:, :labels].max() <= 0:
        return []
    node[inside] = np.where(np.pad(says[inside], ((0, 0), (0, 1))), 0.0, -np.inf)
    edges = [(i, i + 1, p.chain, False) for i in range(n - 1)]
    repeated = inside.copy()
    for held in forms.values():
        if len(held) > 1:
            at = np.array(held)
            told, bare = at[inside[at]], at[~inside[at]]
            edges += [(x, y, p.skip, False) for x, y in zip(bare.tolist(), bare[1:].tolist(), strict=False)]
            if len(told):
                repeated[bare] = True
            else:
                told, bare = at[says[at].any(axis=1)], at[~says[at].any(axis=1)]
            edges += _told(told, bare, says, p.skip)
    found: dict[str, int] = {}
    for i in np.flatnonzero(inside).tolist():
        if len(whole[i]) >= p.least_similar:
            for form in _near_forms(whole[i]):
                found.setdefault(form, i)
    for i in np.flatnonzero(~repeated).tolist():
        if found and len(whole[i]) >= p.least_similar and (near := [found[f] for f in _near_forms(whole[i]) | {whole[i]} if f in found]):
            edges.append((min(near, key=lambda j: (int(says[j].argmax()), j)), i, p.similar, True))
    u, v, w, kinds_only = (np.array(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
    odds = propagate(node, u, v, w, p.rounds, kinds_only)
    out = []
    for i in np.flatnonzero(~inside & (odds[:, :labels].max(axis=1) > p.accept)).tolist():
        out.append((int(odds[i, :labels].argmax()), *tokens[i]))
    return out


def find_pii(docs: DataFrame, p: FieldParams = FieldParams()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base and found (arrays of structs kind, start, stop), redacted.

    ``base`` has the patterns' spans by kind, then start; ``found`` also the field's, none of which
    overlaps one of them.  ``redacted`` is the text with every span (leftmost first where two overlap)
    replaced by its kind in brackets.  A null text has no spans and stays null; an empty table gives no
    rows; repeated rows give repeated rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch, texts in text_slices(batches):
            null = batch.column(1).is_null().to_pylist()
            every, found, clean = [], [], []
            for text, none in zip(texts, null, strict=True):
                base = base_spans(text)
                spans = sorted(base + field_spans(text, base, p))
                every.append([{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in base])
                found.append([{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in spans])
                clean.append(None if none else redacted(text, p, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, kind), pa.array(found, kind), pa.array(clean, pa.string())], names=["doc_id", "base", "found", "redacted"])

    span = "array<struct<kind: string, start: long, stop: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {span}, found {span}, redacted string")


def digest(found: DataFrame) -> DataFrame:
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))



def redact(docs: DataFrame, p: FieldParams = FieldParams()) -> DataFrame:
    """``docs`` with all its columns and rows, every span in ``text`` replaced by its kind; ``n_chars``, if there, counts the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            at = batch.schema.get_field_index("text")
            null = batch.column(at).is_null().to_pylist()
            new = [None if none else redacted(text, p) for text, none in zip(texts, null, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def redacted(text: str, p: FieldParams, spans: list[tuple[int, int, int]] | None = None) -> str:
    if spans is None:
        base = base_spans(text)
        spans = base + field_spans(text, base, p)
    pieces, done = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= done:
            pieces += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*pieces, text[done:]])
