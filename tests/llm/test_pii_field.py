"""The skip-chain field against exact marginals, and what it adds."""

from __future__ import annotations

import itertools

import numpy as np

from sitecast.llm import pii


def test_propagation_is_exact_on_trees():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, k = 6, 3
        node = rng.normal(0, 1.5, (n, k))
        u = np.array([rng.integers(0, i) for i in range(1, n)])
        v, tie = np.arange(1, n), rng.uniform(0, 2, n - 1)
        weight = np.zeros((n, k))
        for labels in itertools.product(range(k), repeat=n):
            x = np.array(labels)
            weight[np.arange(n), x] += np.exp(node[np.arange(n), x].sum() + tie[x[u] == x[v]].sum())
        assert np.allclose(pii.propagate(node, u, v, tie, 60), weight / weight.sum(axis=1, keepdims=True), atol=1e-6)


def added(text: str) -> list[tuple[str, str]]:
    return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.field_spans(text, pii.base_spans(text), pii.FieldParams())]


def test_mentions_that_no_pattern_finds():
    assert added("reach jane.roe [at] mail.org today") == [("email", "jane.roe [at] mail.org")]
    assert added("please call 988 555 24 85 or not") == [("phone", "988 555 24 85")]
    assert added("call +1 988 555 2485 now; the old 5552485 too") == []
    assert added("write johnny.doe@x.org; see johnny_doe for more") == [("email", "johnny_doe")]
    assert added("write johnny.doe@x.org; johnyy.doe answers") == [("email", "johnyy.doe")]


def test_plain_numbers_and_words_are_left_alone():
    assert added("in 1999 about 123456789 people met at 10.30, see fig. 4-2 and a_b_c") == []
    assert added("mail a@b.cd and meet at noon, order 20240101 of 12345678") == []
    assert added("") == [] and added("(at) [at] at") == []


def test_dates_are_no_telephones():
    params = pii.FieldParams()
    for text in ("tel 2024-01-01 10:00", "call 2024.12.31 09", "phone: 31.12.2024 17", "tel 01/02/1999"):
        assert pii.field_spans(text, pii.base_spans(text), params) == [], text
    for text in ("tel 555 0134 778", "call 2024-0101-10", "phone 1999 13 45 67"):
        assert [k for k, _, _ in pii.field_spans(text, pii.base_spans(text), params)] == [3], text


def test_ties_to_kinds_are_exact_on_trees_and_labels_can_be_observed():
    rng = np.random.default_rng(5)
    for _ in range(10):
        n, k = 5, 3
        node = rng.normal(0, 1.5, (n, k))
        node[0] = [-np.inf, 0.0, -np.inf]
        u = np.array([rng.integers(0, i) for i in range(1, n)])
        v, tie, only = np.arange(1, n), rng.uniform(0, 2, n - 1), rng.random(n - 1) < 0.5
        weight = np.zeros((n, k))
        for labels in itertools.product(range(k), repeat=n):
            x = np.array(labels)
            weight[np.arange(n), x] += np.exp(node[np.arange(n), x].sum() + tie[(x[u] == x[v]) & ~(only & (x[u] == k - 1))].sum())
        assert np.allclose(pii.propagate(node, u, v, tie, 60, only), weight / weight.sum(axis=1, keepdims=True), atol=1e-6)


def test_mentions_of_a_form_that_no_pattern_finds_are_tied():
    for n in (1, 2, 3, 30):
        assert added("please call 988 555 24 85 now" + "; then 9885552485 again" * n) == [("phone", "988 555 24 85"), *[("phone", "9885552485")] * n]
        assert added("so jane.roe said; " * n + "reach jane.roe [at] mail.org") == [*[("email", "jane.roe")] * n, ("email", "jane.roe [at] mail.org")]
        assert added("order 9885552485 and again; " * n) == []


def test_found_mentions_send_messages(monkeypatch):
    seen = []
    real = pii.propagate

    def watched(node, u, v, tie, *rest):
        seen.append((node, set(zip(u.tolist(), v.tolist(), strict=True))))
        return real(node, u, v, tie, *rest)

    monkeypatch.setattr(pii, "propagate", watched)
    assert added("write john.doe@x.org; then john.doe came") == [("email", "john.doe")]
    node, ties = seen[0]
    # The bare mention has the potentials of any such word; what it is told comes by the tie alone.
    assert (0, 1) in ties and node[1].tolist() == [-2.0] * 4 + [0.0] and np.isneginf(node[0]).sum() == 4


def test_found_mentions_that_differ_in_kind():
    both = "ip 100.100.100.20 or +1.001001002 0; "
    for text in (both + "see 10010010020 now", both * 12 + "see 10010010020 now", "ip 100.100.100.20; " + both + "see 10010010020 now"):
        assert added(text) == [("ip", "10010010020")], text
    assert added(both + "+1.001001002 0; see 10010010020 now") == [("phone", "10010010020")]
