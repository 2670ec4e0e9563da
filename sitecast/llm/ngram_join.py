"""N-gram Jaccard join by PartEnum signatures (op 4).

A document is the set of its five-word shingles.  Two sets of sizes s <= r with a Jaccard similarity of
at least t differ in at most (1-t)/(1+t) * (r+s) elements.  Sets are dealt into size bands of ratio t, so
that similar sets fall into one band or neighbouring ones, and each set is signed for its own band and
for the next.  For a band with at most k differences the shingle domain is dealt by a hash into n parts,
and a set's signature for a part is a hash of its elements there: one difference spoils one part only.

Up to six differences the domain has k + 3 parts and each three of them give a signature, one of which
is the same for certain.  Beyond, each part that isn't empty gives one.  With n = k + 1 parts one must
be untouched, but k differences also fall together: they leave about n * exp(-k/n) parts alone, so for
large k fewer, larger parts do.  n is the least with 16 untouched parts on average (or, near k + 1, so
large that the untouched ones aren't all empty), which misses a pair just at the threshold with a chance
near exp(-16), and closer pairs far less.  Larger parts hardly ever hold a common passage and nothing
else, so documents that merely share a passage don't meet.

Signatures meet in buckets, as packed arrays.  Each set is checked against the leader of its signature
group, the member that shares most signatures, on the exact sets.  Then components are taken.  In
families (the sets tried against one leader) that still hold several, every set that isn't linked to the
leader is compared with members of other components through the elements by which both differ from what
most of the family holds (see ``_residues``), so that a large family of near copies costs no pairs but those that differ
in the same way.  Members so close to the core that they need no such element are linked to the closest one (see
``_near_core``).  Nothing is capped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecast.llm.common import delete, materialize, text_slices
from sitecast.llm.components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Words(dict):
    """64-bit hash of each word, remembered; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: dict[bytes, int], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles (all its words if fewer)."""
    own = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, n)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    s = h[: n - size + 1] * _MULT[0]
    for j in range(1, size):
        s = s + h[j : n - size + 1 + j] * _MULT[j % len(_MULT)]
    return np.unique(_mix(s))


def node_of(s: np.ndarray) -> int:
    """A set's identity: 63 bits of its hash, so that equal sets are one node."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def band_of(n: int, threshold: float) -> int:
    return int(math.floor(math.log(n) / -math.log(threshold) + 1e-9))


def differences(band: int, threshold: float) -> int:
    """Most elements by which similar sets differ, one in ``band`` and the other there or in the band below."""
    most = math.floor(threshold ** -(band + 1) + 1e-6) + 1
    return math.floor((1 - threshold) / (1 + threshold) * 2 * most + 1e-9)


def parts_of(k: int, sure: float | None = 16.0) -> int:
    """Parts of the domain for k differences: enough that one is untouched and not empty, but for a chance of exp(-sure); None: k + 1."""
    if sure is None:
        return k + 1
    n = max(1, k // 8)
    while n < k + 1 and n * math.exp(-k / n) < sure:
        n += max(1, n // 40)
    return n if n < k + 1 else max(k + 1, math.ceil(k * math.exp(sure / 4 / k)))


class Signer:
    """Signatures of sets under one threshold; remembers each band's partition.

    Up to ``few`` differences the domain has k + 3 parts and every 3 of them give a signature, of which
    one is untouched for certain.  Beyond, every part that isn't empty gives one.  With ``sure`` None there
    are k + 1 parts, and empty ones give a signature too, so that no pair can be missed.
    """

    def __init__(self, threshold: float, few: int = 6, sure: float | None = 16.0):
        self.threshold, self.few, self.sure, self.bands = threshold, few, sure, {}

    def _band(self, band: int) -> tuple[int, np.uint64, np.ndarray | None]:
        if band not in self.bands:
            k = differences(band, self.threshold)
            salt = np.uint64(xxhash.xxh3_64_intdigest(b"band %d" % band))
            if k <= self.few:
                chosen = list(itertools.combinations(range(k + 3), 3))
                table = np.zeros((len(chosen), k + 3), np.uint64)
                for i, own in enumerate(chosen):
                    table[i, list(own)] = 1
                self.bands[band] = k + 3, salt, table
            else:
                self.bands[band] = parts_of(k, self.sure), salt, None
        return self.bands[band]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """64-bit signatures of a set for its own band and the next."""
        own, out = band_of(len(s), self.threshold), []
        for band in (own, own + 1):
            n, salt, table = self._band(band)
            x = _mix(s + salt)
            part = ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
            total = np.zeros(n, np.uint64)
            np.add.at(total, part, _mix(x ^ salt))
            if table is not None:
                where, total = np.arange(len(table)), table @ total
            else:
                where = np.arange(n) if self.sure is None else np.flatnonzero(np.bincount(part, minlength=n))
                total = total[where]
            out.append(_mix(total + _mix(where.astype(np.uint64) + salt)))
        return np.concatenate(out)


def _sets(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _identified(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch, texts in text_slices(batches):
            sets = [shingle_set(t, words, size) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "node"])

    return _sets(docs).mapInArrow(run, "doc_id long, n_shingles long, node long")


#: Of the sets that share a signature in one task so many go to its bucket; the rest are only counted there.
LOCAL = 64


def _bucketed(docs: DataFrame, size: int, threshold: float, buckets: int, sure: float | None) -> DataFrame:
    """Packed (signature, node, set size) entries by bucket; a task signs equal sets once.

    Of a signature that many sets of one task have, the first LOCAL go to the signature's bucket, the first
    of them with the number of the others.  These go to buckets from ``buckets`` on, by their nodes, so
    that no bucket grows with a family.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sign, seen = _Words(), Signer(threshold, sure=sure), set()
        sigs, nodes, sizes, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            sig = np.concatenate(sigs)
            count = np.array([len(x) for x in sigs])
            node, n = np.repeat(np.array(nodes, np.int64), count), np.repeat(np.array(sizes, np.int32), count)
            sig = ((sig >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | sig & np.uint64(0xFFFFFFFF)
            order = np.argsort(sig, kind="stable")
            sig, node, n = sig[order], node[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            many = np.diff(np.append(first, len(sig)))
            rank = np.arange(len(sig)) - np.repeat(first, many)
            others = np.zeros(len(sig), np.int32)
            others[first] = np.maximum(0, many - LOCAL)
            bucket = (sig >> np.uint64(32)).astype(np.int64)
            if (aside := rank >= LOCAL).any():
                bucket[aside] = buckets + node[aside] % buckets
                order = np.argsort(bucket, kind="stable")
                sig, node, n, others, bucket = sig[order], node[order], n[order], others[order], bucket[order]
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(sig)]
            pieces = list(zip(edges, edges[1:], strict=False))
            own = [int(bucket[a]) for a, _ in pieces]
            # Inside its bucket the low half names a signature; numbers of others stand only where there are any.
            sets = [[x[a:b].tobytes() for a, b in pieces] for x in (sig.astype("<u4"), node.astype("<i8"), n.astype("<i4"))]
            more = [(sig[a:b] >> np.uint64(32)).astype("<u4").tobytes() if k >= buckets else others[a:b].astype("<u4").tobytes() if others[a:b].any() else b"" for k, (a, b) in zip(own, pieces, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([own, *sets, more], [pa.int64()] + [pa.binary()] * 4, strict=True)], names=["bucket", "sigs", "nodes", "sizes", "more"])

        for _, texts in text_slices(batches):
            for t in texts:
                s = shingle_set(t, words, size)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                sigs.append(sign(s))
                nodes.append(node)
                sizes.append(len(s))
                held += len(sigs[-1])
            if held > 3_000_000:
                yield out()
                sigs, nodes, sizes, held = [], [], [], 0
        if sigs:
            yield out()

    return _sets(docs).mapInArrow(run, "bucket long, sigs binary, nodes binary, sizes binary, more binary")


def _shared(bucketed: DataFrame, buckets: int) -> DataFrame:
    """(sig, node, n, held) entries whose signature several sets have; held counts the sets (0 for those beside their bucket)."""

    def run(key: tuple, piece: pa.Table) -> pa.Table:
        column = lambda name, kind: np.frombuffer(b"".join(piece.column(name).to_pylist()), kind)
        sig, node, n = column("sigs", "<u4").astype(np.int64), column("nodes", "<i8"), column("sizes", "<i4")
        if key[0].as_py() >= buckets:
            sig |= column("more", "<u4").astype(np.int64) << 32
            return pa.table({"sig": sig, "node": node, "n": n.astype(np.int64), "held": np.zeros(len(sig), np.int64)})
        sig |= np.int64(key[0].as_py()) << 32
        counts = zip(piece.column("sigs").to_pylist(), piece.column("more").to_pylist(), strict=True)
        others = np.concatenate([np.frombuffer(m, "<u4") if m else np.zeros(len(x) // 4, np.uint32) for x, m in counts])
        order = np.lexsort((node, sig))
        sig, node, n, others = sig[order], node[order], n[order], others[order]
        _, group = np.unique(sig, return_inverse=True)
        more = np.bincount(group, weights=others, minlength=1).astype(np.int64)
        first = np.ones(len(sig), bool)
        first[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, n, group = sig[first], node[first], n[first], group[first]
        held = (np.bincount(group, minlength=1) + more)[group]
        keep = held > 1
        return pa.table({"sig": sig[keep], "node": node[keep], "n": n[keep].astype(np.int64), "held": held[keep].astype(np.int64)})

    return bucketed.groupBy("bucket").applyInArrow(run, "sig long, node long, n long, held long")


def _sets_of(pairs: DataFrame, docs: DataFrame, rows: DataFrame, size: int, most: int) -> DataFrame:
    """(node, shingles) of the ``most`` sets at most in ``pairs``; only their texts are read again."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = wanted.join(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node").select(F.col("doc_id").alias("wanted")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        for _, texts in text_slices(batches):
            nodes, raw = [], []
            for t in texts:
                s = shingle_set(t, words, size)
                if len(s) and (node := node_of(s)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    nodes.append(node)
                    raw.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], names=["node", "shingles"])

    texts = _sets(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    return materialize(texts.mapInArrow(run, "node long, shingles binary"), "sets", most, 1_000)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.dropDuplicates(["node"])  # both joins read the one exchange of it
    return pairs.join(one.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(one.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether the exact sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(common * 1_000_000 >= round(threshold * 1_000_000) * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return materialize(_with_sets(pairs, sets).select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long, linked boolean"), "links", pairs.count(), 2_000)


def _cores(family: DataFrame, sets: DataFrame, sample: int) -> DataFrame:
    """For each leader a set that its family is measured against: what most of up to ``sample`` members hold.

    Any set would give right results; one close to the members leaves small differences.  ``seen`` lists
    the elements that several sampled members hold, for an order that puts rarer ones first.
    """
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))
    some = family.select("a", "b").withColumn("rank", rank).where(F.col("rank") <= sample).join(sets.dropDuplicates(["node"]).select(F.col("node").alias("b"), "shingles"), "b")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
        e, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.table({"a": [key[0].as_py()], "core": [e[2 * n > len(held)].tobytes()], "seen": [e[n > 1].tobytes()]}, schema=pa.schema([("a", pa.int64()), ("core", pa.binary()), ("seen", pa.binary())]))

    return some.select("a", "shingles").groupBy("a").applyInArrow(run, "a long, core binary, seen binary")


def _residues(family: DataFrame, sets: DataFrame, threshold: float, sample: int = 64) -> DataFrame:
    """Prefix entries of each member's difference from its family's core: (a, e, node, root, linked, n, m, at).

    At 0 stands an entry without an element for each member, even one that equals the core.

    With X, Y and A the differences of x, y and leader a from the core, |x ^ y| = |X ^ Y|, and sets within
    k of each other need t = (|X| + |Y| - k) / 2 common elements of X and Y (none up to 0: see ``_near_core``).  In any order that holds for
    the family, their first common element stands no later than |X| - t + 1 in X, which is k + 1 at most.
    If x isn't linked to a, then |X| > k(x, a) - |A|, and the same bound for Y comes to about
    (|Y| + |A|) / 2 + 1.  The order is: outside the core and rare, outside and less rare, missing from it.
    """
    r = (1 - threshold) / (1 + threshold)
    cores = _cores(family, sets, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for a, b, root, linked, x, y, c, s in zip(*(batch.column(i) for i in range(8)), strict=True):
                lead, own, core, seen = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y, c, s))
                new, gone = np.setdiff1d(own, core, assume_unique=True), np.setdiff1d(core, own, assume_unique=True)
                rare = ~np.isin(new, seen, assume_unique=True)
                m = len(new) + len(gone)
                off = len(np.setxor1d(lead, core, assume_unique=True))
                most = math.floor(r * (len(own) + len(own) / threshold) + 1e-9) + 1
                if linked.as_py():
                    most = min(most, math.floor((m + off + r * max(0, len(own) - len(lead))) / 2) + 2)
                e = np.concatenate((np.zeros(1, np.uint64), new[rare], new[~rare], gone))[: most + 1].astype(np.int64)
                full = lambda v, e=e: np.full(len(e), v, np.int64)
                out.append((full(a.as_py()), e, full(b.as_py()), full(root.as_py()), full(int(linked.as_py())), full(len(own)), full(m), np.arange(len(e))))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "e", "node", "root", "linked", "n", "m", "at"])

    rows = _with_sets(family, sets).join(cores, "a").select("a", "b", "root", "linked", "sa", "sb", "core", "seen")
    return rows.mapInArrow(run, "a long, e long, node long, root long, linked long, n long, m long, at long")


def _near_core(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of one family whose differences X and Y from the core have |X| + |Y| <= k.

    |x ^ y| <= |X| + |Y|, so all of them are links.  With s = |X| - r * |x| (in integers, as the exact check
    has the threshold) the condition is s(x) + s(y) <= 0.  The member with the least s meets it with x and
    with y whenever they meet it with each other, so links to it alone join all that such pairs join.
    """
    t = round(threshold * 1_000_000)
    scored = members.select("a", "node", "root", (F.col("m") * (1_000_000 + t) - F.col("n") * (1_000_000 - t)).alias("s"))
    best = scored.groupBy("a").agg(F.min(F.struct("s", "node", "root")).alias("c"))
    met = scored.join(best, "a").where((F.col("root") != F.col("c.root")) & (F.col("s") + F.col("c.s") <= 0))
    return met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _nearest(entries: DataFrame) -> DataFrame:
    """Of each element's entries the one with the smallest difference from the core."""
    best = F.min_by(F.struct("node", "root", "linked", "n", "m", "at"), F.struct("m", "node")).alias("s")
    return entries.groupBy("a", "e").agg(best).select("a", "e", "s.*")


def _rerooted(entries: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """``entries`` under new components, without the families that have become one."""
    now = entries.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = now.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("a")
    return materialize(now.join(split, "a", "left_semi"), "entries", rows, 50_000)


def _shared_ways(entries: DataFrame, against: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components, one not linked to its leader, that a common entry leaves possible."""
    side = lambda df, s: df.select("a", "e", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "linked", "n", "m", "at")))
    k = F.floor((1 - threshold) / (1 + threshold) * (F.col("n_x") + F.col("n_y")) + 1e-9)
    room = F.least(F.col("m_x") - F.col("at_x"), F.col("m_y") - F.col("at_y")) + 1
    met = side(entries.where("linked = 0"), "x").join(side(against, "y"), ["a", "e"]).where((F.col("root_x") != F.col("root_y")) & (2 * room >= F.col("m_x") + F.col("m_y") - k) & _able("n_x", "n_y", threshold))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _able(a: str, b: str, threshold: float) -> Column:
    """Sizes that can reach the threshold."""
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def join_components(docs: DataFrame, size: int = 5, threshold: float = 0.8, entries_per_bucket: int = 1_000_000, sure: float | None = 16.0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, node.

    Component_id is the smallest doc_id reachable over links.  A null or wordless text has no shingles,
    links with nothing and is its own component; equal texts are one node and link.  A null doc_id never
    names a component unless nothing else is there.  Repeated rows give repeated rows; other columns are
    ignored; an empty table gives no rows.  ``sure`` None is the exact mode, with k + 1 parts and many more
    signatures; else a pair just at the threshold is missed with a chance of exp(-sure), above six differences.
    """
    spark = docs.sparkSession
    rows = materialize(_identified(docs, size), "shingle-sizes")
    # About 0.45 signatures a shingle: so many buckets that each holds a bounded number of entries.
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.5 * total / entries_per_bucket))
    shared = materialize(_shared(_bucketed(docs, size, threshold, buckets, sure), buckets), "shared")

    # First round: every set against its group's leader, the set that shares most signatures.
    fame = shared.groupBy("node").agg(F.sum("held").alias("fame"))
    lead = shared.join(fame, "node").groupBy("sig").agg(F.max(F.struct("fame", "node")).alias("lead")).select("sig", F.col("lead.node").alias("a"))
    pairs = materialize(shared.join(lead, "sig").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs", shared.count())
    delete(shared)
    n = pairs.count()
    sets = _sets_of(pairs, docs, rows, size, min(2 * n, rows.count()))
    tried = _verified(pairs, sets, threshold)
    delete(pairs)
    links = tried.where("linked").select("a", "b")
    roots = components(links, rows=n)

    # Second round: in families that still hold several components, members that differ from the leader in the same way.
    tagged = tried.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    tagged = tagged.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left").withColumn("root_a", F.coalesce("root_a", "a"))
    split = tagged.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("members > 1 and lo <> hi").select("a")
    family = tagged.join(split, "a", "left_semi")
    residues = materialize(_residues(family, sets, threshold), "entries", n, 1_000)
    n_entries = residues.count()
    entries = residues.where("at > 0")
    # First only against each element's nearest holders, which links most that can be; then the rest against all.
    apart = materialize(_shared_ways(entries, _nearest(entries), threshold), "pairs", n_entries, 50_000)
    found = _verified(apart, sets, threshold)
    close = materialize(_near_core(residues.where("at = 0"), threshold), "links", n)
    links = links.unionByName(found.where("linked").select("a", "b")).unionByName(close)
    n += apart.count() + close.count()
    delete(roots)
    roots = components(links, rows=n)
    entries = _rerooted(entries, roots, n_entries)
    more = _shared_ways(entries, entries, threshold).join(apart, ["a", "b"], "left_anti")
    more = materialize(more, "pairs", n_entries, 50_000)
    last = _verified(more, sets, threshold).where("linked").select("a", "b")
    if last.limit(1).count():
        delete(roots)
        roots = components(links.unionByName(last), rows=n + more.count())
    for done in (sets, tried, residues, apart, found, close, entries, more, last):
        delete(done)

    # Smallest doc_id of each class of equal sets, then of each component.
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = classes.join(roots, "node")
    named = linked.groupBy("root").agg(F.min("least").alias("component")).join(roots, "root").select("node", "component")
    named = classes.join(named, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "node")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns that name their component: of each group its smallest doc_id; null ids stay."""
    gone = join_components(docs, **options).where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]), "left_anti")
