"""The bound on matching blocks, and how many exact ratios it saves."""

import random
from difflib import SequenceMatcher

import numpy as np

from sitecast.operators import registry as R


def longest(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_the_bound_is_the_longest_common_subsequence():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde 1") for _ in range(rng.choice((0, 1, 5, 20, 63, 64)))) for _ in range(400)]
    a, b = np.array(words, object), np.array(rng.sample(words, len(words)), object)
    assert R.common_at_most(a, b).tolist() == [longest(x, y) for x, y in zip(a, b, strict=True)]
    long = np.array(["a" * 70, "ab", "é"], object)
    assert R.common_at_most(long, np.array(["b" * 66, "ba" * 50, "ü"], object)).tolist() == [66, 2, 1]


def test_few_exact_ratios_are_left():
    """Of pairs that share enough letters for the cut, the order of the letters refuses nine in ten."""
    rng = random.Random(2)
    syllables = [a + b for a in "bcdkmnprstwz" for b in "aeiouy"]
    names = ["".join(rng.choice(syllables) for _ in range(rng.randint(3, 6))) for _ in range(1200)]
    cut, able, passed, right = 0.62, 0, 0, 0
    letters = {n: {c: n.count(c) for c in set(n)} for n in names}
    pairs = [(x, y) for x, y in ((rng.choice(names), rng.choice(names)) for _ in range(60_000)) if 2 * sum(min(k, letters[y].get(c, 0)) for c, k in letters[x].items()) >= cut * (len(x) + len(y))]
    a, b = (np.array(c, object) for c in zip(*pairs, strict=True))
    keep = 2 * R.common_at_most(a, b) >= (cut - 1e-9) * np.array([len(x) + len(y) for x, y in pairs])
    for (x, y), k in zip(pairs, keep, strict=True):
        able, passed = able + 1, passed + int(k)
        if SequenceMatcher(None, x, y).ratio() >= cut:
            right += 1
            assert k
    print(able, passed, right)
    assert passed * 10 < able and right
