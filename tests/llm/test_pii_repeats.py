"""Every bare mention of a found entity takes its label, however many there are."""

from __future__ import annotations

import pytest

from sitecast.llm.pii import FieldParams, base_spans, field_spans, redacted


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100])
@pytest.mark.parametrize("found, bare, kind", [("john.doe@x.org", "john.doe", 0), ("john.doe@x.org", "john.doe(at)x.org", 0), ("+1 202 555 0143", "2025550143", 3), ("+482025550143", "202-555-0143", 3), ("4111-1111-1111-1111", "1111 1111 11", 2)])
@pytest.mark.parametrize("last", [False, True])
def test_all_repeats_are_found(n, found, bare, kind, last):
    words = [f"and then {bare} was seen" for _ in range(n)]
    text = " . ".join([*words, f"write {found} now"] if last else [f"write {found} now", *words])
    got = field_spans(text, base_spans(text), FieldParams())
    assert [k for k, _, _ in got] == [kind] * n and all(text[a:b] == bare for _, a, b in got)
    assert bare not in redacted(text, FieldParams())


def test_other_forms_stay():
    text = "write john.doe@x.org now . " + " . ".join("and jane.roe saw 2025550143 with john.doe" for _ in range(20))
    assert redacted(text, FieldParams()).count("jane.roe") == 20 and redacted(text, FieldParams()).count("2025550143") == 20
    assert "john.doe" not in redacted(text, FieldParams())
