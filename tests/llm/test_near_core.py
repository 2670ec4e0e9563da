"""Families whose leader stands off the core: members that reach each other but not the leader are linked."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from sitecast.llm import ngram_join

#: Found by a model of the signatures, their leaders and the differences from the core.
SEEDS = (4090, 5783, 7573, 8850, 11628, 17057)


def family(seed: int) -> list[str]:
    rng = random.Random(seed)
    base = [f"f{seed}w{i}" for i in range(rng.randint(14, 44))]

    def edited(text: list[str], k: int) -> list[str]:
        own = list(text)
        for _ in range(k):
            at = rng.choice([0, 0, 1, 2, len(own) - 1, len(own) - 1, len(own) - 2, rng.randrange(len(own))])
            own[at] = f"f{seed}e{rng.randrange(10**6)}"
        return own

    lead, x, y = edited(base, rng.randint(2, 3)), edited(base, rng.randint(0, 1)), edited(base, rng.randint(0, 2))
    return [" ".join(v) for v in (lead, x, y, edited(lead, rng.randint(1, 2)), edited(lead, rng.randint(1, 2)))]


def by_all_pairs(sets: dict[int, frozenset]) -> dict[int, int]:
    least = {d: d for d in sets}
    while True:
        before = dict(least)
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def test_leaders_off_the_core(spark):
    rows, want = [], {}
    for i, seed in enumerate((*SEEDS, *range(30))):
        texts = {i * 10 + j: t for j, t in enumerate(family(seed))}
        rows += texts.items()
        want |= by_all_pairs({d: frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for d, t in texts.items()})
    found = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_links_near_the_core(spark):
    """Differences of 0, 9 and 10 from a core of about 90 (k = 20) are linked to the nearest; 30 is not, nor what is one already."""
    rows = [(1, 1, 1, 90, 0), (1, 2, 2, 90, 9), (1, 3, 3, 90, 10), (1, 4, 4, 90, 21), (1, 5, 1, 90, 1), (2, 6, 6, 90, 10), (2, 7, 7, 90, 10), (3, 8, 8, 90, 10), (3, 9, 9, 90, 11)]
    members = spark.createDataFrame(rows, "a long, node long, root long, n long, m long")
    assert sorted(map(tuple, ngram_join._near_core(members, 0.8).select("a", "b").where(F.col("a") < F.col("b")).collect())) == [(1, 2), (1, 3), (6, 7)]
