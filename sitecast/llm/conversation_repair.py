"""Conversation structure repair by depth-first branch-and-bound (op 11).

A repaired conversation's role initials are ``(s?(ua)+)?``.  Each row is kept, given another role or deleted,
and empty user or assistant turns are inserted; the cheapest edits win, and of these the ASCII-least audit.

Rows reach a task sorted by conversation and turn and stream through it.  A conversation is searched in
blocks of rows: from each of the four states that a repaired prefix can end in (nothing, s, u, a), an
explicit stack explores the edits of one block depth first.  A suffix bound (forced deletions, truncated
turns, and half of the illegal neighbours that are left, since one edit mends two at most) cuts branches
that can't reach the incumbents, and a dominance table a node, (row, state), cuts prefixes with a worse
(cost, audit).  Between blocks stand four labels: cost, audit and a running hash of the repaired text, so
a conversation of any length takes one block of texts in memory, and its search is linear in its length.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"

#: What may follow each state; 's' only opens a conversation.
_NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
_ENDS = ("", "a")
_ROLE = {"u": "user", "a": "assistant"}
#: States in the order in which labels are kept.
STATES = ("", "s", "u", "a")

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

Label = tuple[int, str]


@dataclass
class Block:
    """The rows of one block as the search sees them: initial of the role, forced deletion, truncation."""

    initials: list[str]
    forced: list[bool]
    truncated: list[bool]
    last: bool
    bounds: list[dict[str, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        """Least cost of the rows from i on after each state: never above what they cost in truth."""
        n = len(self.initials)
        fixed, pairs, head = 0, 0, ""  # of the live rows behind: what they cost in any case, their illegal pairs, the first
        self.bounds = [{}] * (n + 1)
        for i in range(n, -1, -1):
            if i < n:
                if self.forced[i]:
                    fixed += DELETE
                else:
                    fixed += TRUNCATED * self.truncated[i]
                    own = self.initials[i]
                    pairs += (head not in _NEXT.get(own, "")) if head else self.last and own != "a"
                    head = own or "?"
            self.bounds[i] = {s: fixed + 2 * math.ceil((pairs + ((head not in _NEXT[s]) if head else self.last and s not in _ENDS)) / 2) for s in STATES}


def search(block: Block, enter: str) -> dict[str, Label]:
    """The cheapest (cost, audit) of ``block`` after state ``enter`` for each state that it can end in.

    In the last block only ends that close a conversation count, and only the best of them is certain to be found.
    """
    n, bounds = len(block.initials), block.bounds
    ends = _ENDS if block.last else STATES
    best: dict[str, Label] = {}
    table: dict[tuple[int, str], Label] = {}

    def hopeless(i: int, state: str, cost: int) -> bool:
        """No end can be reached more cheaply than its incumbent (of the last block's ends only the best counts); at equal cost the audit still decides."""
        least = cost + bounds[i][state]
        if block.last:
            return any(least > c for c, _ in best.values())
        return len(best) == len(reachable) and all(least > c for c, _ in best.values())

    # An end that no edits reach has no incumbent to wait for: from a state other than "" none leads back to it, nor to s.
    if enter == "":
        live = [x for x, f in zip(block.initials, block.forced, strict=True) if not f]
        reachable = [e for e in ends if e != "s" or "s" in live]
    else:
        reachable = [e for e in ends if e in ("u", "a") or e == enter]
    stack: list[tuple[int, str, int, str]] = [(0, enter, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if hopeless(i, state, cost):
            continue
        seen = table.get((i, state))
        if seen is not None and seen <= (cost, audit):
            continue
        table[i, state] = (cost, audit)
        if i == n and state in ends and ((old := best.get(state)) is None or (cost, audit) < old):
            best[state] = (cost, audit)
        branches: list[tuple[int, str, int, str]] = []
        if i < n:
            branches.append((i + 1, state, cost + DELETE, audit + "D"))
            if not block.forced[i]:
                add, own = TRUNCATED * block.truncated[i], block.initials[i]
                if own and own in _NEXT[state]:
                    branches.append((i + 1, own, cost + KEEP + add, audit + "K"))
                other = "u" if "u" in _NEXT[state] else "a"
                if own != other:
                    branches.append((i + 1, other, cost + REROLE + add, audit + "R"))
        for to in _NEXT[state]:
            if to in _ROLE:
                branches.append((i, to, cost + INSERT, audit + "I"))
        # The most promising branch is searched first, so that good incumbents come early.
        branches.sort(key=lambda b: (b[2] + bounds[b[0]][b[1]], b[3]), reverse=True)
        stack += branches
    return best


def apply(state: str, audit: str, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that ``audit`` makes of ``rows`` after ``state``."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text = rows[at]
            state, at = role[:1], at + 1
        else:
            state = "u" if "u" in _NEXT[state] else "a"
            role, text = _ROLE[state], ""
            if edit == "R":
                text, at = rows[at][1], at + 1
        yield role, text


class Repair:
    """One conversation's rows as they stream by; holds a block of them at most."""

    def __init__(self, block_rows: int, block_chars: int):
        self.block_rows, self.block_chars = block_rows, block_chars
        self.rows: list[tuple[str, str]] = []
        self.forced: list[bool] = []
        self.truncated: list[bool] = []
        self.chars = 0
        #: By state: cost, the audit behind what all states share, running hash, whether a turn was written.
        self.labels: dict[str, tuple[int, str, object, bool]] = {"": (0, "", hashlib.sha256(), False)}
        self.shared: list[str] = []
        self.blank = self.duplicate = self.cut = self.illegal = self.turns = 0
        self.low = self.high = self.role = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if len(self.rows) >= self.block_rows or self.chars + len(text) > self.block_chars and self.rows:
            self._close(False)
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        duplicate = duplicate and not blank
        truncated = truncated and not blank and not duplicate
        self.blank, self.duplicate, self.cut = self.blank + blank, self.duplicate + duplicate, self.cut + truncated
        self.illegal += self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au")
        self.role = role
        self.rows.append((role, text))
        self.forced.append(blank or duplicate)
        self.truncated.append(truncated)
        self.chars += len(text)

    def _close(self, last: bool) -> None:
        block = Block([r[:1] for r, _ in self.rows], self.forced, self.truncated, last)
        found: dict[str, tuple[tuple[int, str], str, str]] = {}
        for state, (cost, audit, _, _) in self.labels.items():
            for end, (more, own) in search(block, state).items():
                whole = (cost + more, audit + own)
                if end not in found or whole < found[end][0]:
                    found[end] = (whole, state, own)
        now = {}
        for end, ((cost, audit), state, own) in found.items():
            _, _, digest, begun = self.labels[state]
            digest = digest.copy()
            for role, text in apply(state, own, self.rows):
                digest.update(("\n" * begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True
            now[end] = (cost, audit, digest, begun)
        same = os.path.commonprefix([audit for _, audit, _, _ in now.values()])
        self.shared.append(same)
        self.labels = {end: (cost, audit[len(same) :], digest, begun) for end, (cost, audit, digest, begun) in now.items()}
        self.rows, self.forced, self.truncated, self.chars = [], [], [], 0

    def result(self) -> tuple[int, int, int, int, int, int, str, str]:
        self._close(True)
        cost, audit, digest, _ = min(self.labels.values(), key=lambda x: x[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.cut, self.illegal, cost, "".join(self.shared) + audit, digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after the damage that crc32 of ``conv_id:turn`` modulo 20 names; nulls are one space.

    A row that is dropped stays as a mark (``gone``), so that its conversation isn't forgotten.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).when(kind != 0, or_space("text"))
    role = F.when(kind == 4, "user").when(kind != 0, or_space("role"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def _flagged(rows: DataFrame) -> DataFrame:
    """``rows`` with blank, truncated, and duplicate: the conversation has the same role and text at a smaller turn, or again at this one.

    Equal rows are counted by a SHA-256 of role and text; of equal rows at their first turn ``again`` leaves
    one as the first.  Only repeated ones meet the rows, so texts move for the join only where many repeat.
    """
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # null turns first
    keyed = rows.where("not gone").select(F.col("conv_id").alias("own"), mark.alias("mark"), order.alias("first"))
    repeated = keyed.groupBy("own", "mark").agg(F.count("*").alias("n"), F.min("first").alias("first")).where("n > 1").drop("n")
    marked = rows.withColumns({"of": F.when(~F.col("gone"), mark), "at": order})
    met = marked.join(repeated, marked["conv_id"].eqNullSafe(repeated["own"]) & (marked["of"] == repeated["mark"]), "left")
    stem = F.rtrim("text", F.lit(_SPACE))
    late = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return met.select("conv_id", "turn", "role", "text", "gone", (stem == "").alias("blank"), (~F.substring(stem, -1, 1).rlike("[.!?]")).alias("truncated"), late.alias("late"), F.col("first").isNotNull().alias("again"))


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(conversations: DataFrame, block_rows: int = 64, block_chars: int = 4_000_000) -> DataFrame:
    """One row per conversation of ``conversations`` (conv_id, turn, role, text) after ``damaged``.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (K keep, R rerole, D delete, I insert) and
    repaired_sha256.  Rows are ordered by turn, null turns first, then role and text; equal rows count each.  Null
    roles and texts are one space (so a null text is blank, and a null role fits nowhere unless it is changed);
    rows with a null conv_id are one conversation.  Empty roles have no initial and can't be kept.  A conversation whose rows are all dropped has zeros, an
    empty audit and the hash of nothing; an empty table gives no rows; other columns are ignored.

    One shuffle brings a conversation's rows to one task, sorted; a hash of its text is sequential by
    definition, so a single huge conversation is one task, which streams it: ``block_rows`` rows or about
    ``block_chars`` characters and four labels are all that it holds, beside the audit that it returns.
    """
    rows = _flagged(damaged(conversations))
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        now: Repair | None = None
        conv: object = None
        before: tuple | None = None
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for own, turn, role, text, gone, blank, truncated, late, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or own != conv:
                    if now is not None:
                        out.append((conv, *now.result()))
                    now, conv, before = Repair(block_rows, block_chars), own, None
                if not gone:
                    # Of equal rows at their first turn, which stand side by side, the first is no duplicate.
                    twice = again and not late and before == (turn, role, text)
                    before = (turn, role, text) if again else None
                    now.add(turn, role, text, blank, late or twice, truncated)
            if len(out) > 2000:
                yield packed()
                out = []
        if now is not None:
            out.append((conv, *now.result()))
        if out:
            yield packed()

    return sorted_rows.mapInArrow(run, SCHEMA)
