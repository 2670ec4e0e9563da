"""Conversation repair, lexical search and url filters against brute-force versions, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from sitecast.llm import conversation_repair as C
from sitecast.llm import lexical_search as S
from sitecast.llm import url_filter as U

SCHEMA = "conv_id long, turn long, role string, text string, own long, mark string, first long, gaps long, n long"


def every_repair(rows: list[tuple[str, bool, bool]], most: int) -> dict[str, tuple[int, str]]:
    """Of all edit sequences up to a cost, by brute force: the least (cost, audit) for each end."""
    best: dict[str, tuple[int, str]] = {}

    def go(i: int, state: str, cost: int, audit: str) -> None:
        if cost > most:
            return
        if i == len(rows):
            best[state] = min(best.get(state, (cost, audit)), (cost, audit))
        for to in "ua":
            if {"": "u", "s": "u", "u": "a", "a": "u"}[state] == to:
                go(i, to, cost + 2, audit + "I")
        if i == len(rows):
            return
        own, forced, cut = rows[i]
        go(i + 1, state, cost + 3, audit + "D")
        if not forced:
            if own and (own == "s" and state == "" or own == {"": "u", "s": "u", "u": "a", "a": "u"}[state]):
                go(i + 1, own, cost + cut, audit + "K")
            go(i + 1, {"": "u", "s": "u", "u": "a", "a": "u"}[state], cost + 2 + cut, audit + "R")

    go(0, "", 0, "")
    return best


def test_search_finds_the_cheapest_least_audit():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.choice("suauax") if rng.random() < 0.95 else "", rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 5))]
        rows = [(r, f, c and not f) for r, f, c in rows]
        truth = every_repair(rows, 3 * len(rows) + 2)
        best = min(v for s, v in truth.items() if s in ("", "a"))
        columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], []]
        found = C.search(C.Block(*columns, True), "")
        assert min(found.values()) == best, rows
        ends = C.search(C.Block(*columns, False), "")
        assert {s: v for s, v in ends.items() if v[0] <= 3 * len(rows) + 2} == truth, rows


def reference_repair(rows: list[tuple]) -> dict:
    """All columns of the contract for one table, by definition."""
    space = lambda x: " " if x is None else str(x)
    found = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in kept:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
            seen.add((role, text))
        # A shortest path over (row, state), costs and audits together.
        layer = {"": (0, "", ())}
        step = {"": "u", "s": "u", "u": "a", "a": "u"}

        def grow(layer):
            for _ in range(3):
                for s, (cost, audit, out) in list(layer.items()):
                    new = (cost + 2, audit + "I", (*out, ({"u": "user", "a": "assistant"}[step[s]], "")))
                    if step[s] not in layer or new[:2] < layer[step[s]][:2]:
                        layer[step[s]] = new
            return layer

        for (_, role, text), fault in zip(kept, faults, strict=True):
            nxt: dict = {}
            for s, (cost, audit, out) in grow(layer).items():
                moves = [(s, cost + 3, audit + "D", out)]
                if fault not in ("blank", "duplicate"):
                    add = fault == "truncated"
                    if role[:1] and (role[0] == "s" and s == "" or role[0] == step[s]):
                        moves.append((role[0], cost + add, audit + "K", (*out, (role, text))))
                    moves.append((step[s], cost + 2 + add, audit + "R", (*out, ({"u": "user", "a": "assistant"}[step[s]], text))))
                for to, c, a, o in moves:
                    if to not in nxt or (c, a) < nxt[to][:2]:
                        nxt[to] = (c, a, o)
            layer = nxt
        cost, audit, out = min(v for s, v in grow(layer).items() if s in ("", "a"))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


def conversations() -> list[tuple]:
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", None, ""))
            if rng.random() < 0.7:
                role = ("user", "assistant")[turn % 2]
            text = rng.choice(("Fine.", "Is it?", "cut off", "", None, " \n\t", "It ends. \x0b\r", f"No {rng.randint(0, 99)}!", "é. ", "x "))
            rows.append((conv, turn + (rng.random() < 0.1) if rng.random() < 0.95 else None, role, text))
    for turn in range(300):  # long: several blocks
        rows.append((1000, turn, rng.choice(("user", "assistant", "system")) if turn % 7 == 0 else ("user", "assistant")[turn % 2], rng.choice(("Yes.", "no", f"{turn}.", f"{turn}!"))))
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (2000, 7, "user", "again."), (2000, 7, "user", "again."), (2000, 3, "user", "again.")]
    drop = next(t for t in range(1000) if zlib.crc32(f"3000:{t}".encode()) % 20 == 0)
    return [*rows, (3000, drop, "user", "gone.")]


@pytest.mark.parametrize("block_rows", [1, 5, 64])
def test_repair_equals_the_definition(spark, block_rows):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "m", 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    found = {r[0]: tuple(r[1:]) for r in C.repair(table, block_rows=block_rows).collect()}
    truth = reference_repair(rows)
    assert found == truth
    assert found[3000] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_an_empty_table(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversations_are_searched_in_linear_time():
    rng = random.Random(9)
    own = C.Repair(64, 1 << 20)
    for turn in range(20_000):
        own.add(turn, rng.choice(("user", "assistant")), f"{turn}.", rng.random() < 0.1, False, rng.random() < 0.1)
        assert len(own.rows) <= 64
    result = own.result()
    assert len(result[6]) >= 20_000 and max(len(x[1]) for x in own.labels.values()) < 100


WORDS = "the river lake Stone bridge 2024 été naïve x".split()


def texts() -> list[tuple]:
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    docs += [(500 + i, "river lake river") for i in range(80)] + [(300, None), (301, ""), (302, "... --"), (None, "river lake river"), (5, docs[5][1]), (303, "x " * 5000), (304, "THE,the;The_ÉTÉ")]
    return docs


def ranked(docs: list[tuple], items: list[tuple], top: int) -> set[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, collections.Counter(words(t))) for i, t in docs if words(t)]
    n, total, df = len(bags), sum(sum(b.values()) for _, b in bags), collections.Counter(w for _, b in bags for w in b)
    terms = collections.defaultdict(set)
    for item, t in items:
        terms[item] |= set(words(t))
    out = set()
    for item, own in terms.items():
        scores = []
        for doc, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 20 * m)) for w in own if b[w])
            scores.append((-score, doc is None, doc or 0, doc))
        out |= {(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:top], 1) if s < 0}
    return out


ITEMS = [(1, "The river"), (2, "été naïve NAÏVE 2024"), (3, "absent"), (4, None), (5, "..."), (None, "lake"), (6, "stone"), (6, "Bridge"), (7, "the the x")]


@pytest.mark.parametrize("block", [200_000, 3])
def test_search_equals_the_definition(spark, block):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts()], "doc_id long, text string, n long, terms long, score long").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = S.search(docs, items, block_terms=block).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == ranked(texts(), ITEMS, 50)


def test_search_in_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert S.search(docs.limit(0), items).collect() == [] and S.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in S.search(docs, items).collect()] == [("i", 1, 1, 287 * (10**9 // (1000 + 20 * 100)))]


def page(i, url, *links):
    return (i, url, "".join(f'<p><A class=x HREF = "{x}">t</a></p>' for x in links), "h", "r", 1.0)


def pages() -> list[tuple]:
    rows = [
        page(1, "https://www.example.com/en/1", "http://good.org/x"),
        page(2, "http://A.example.com/en/2?x=/es/"),
        page(3, "http://shop.com", "//bad.net/es/"),
        page(4, "ftp://bad.net/es/9"),
        page(5, "http://bad.net/fr/9"),
        page(6, "http://bad.net/en/9"),
        page(7, "http://fan.org/1", "https://BAD.net/", "http://bad.net/de/", "http://bad.net:80/"),
        page(8, "http://good.org/2"),
        page(9, "http://m.fan.org#/es/"),
        page(10, "http://other.org?u=http://bad.net"),
        page(11, None),
        page(12, "no scheme"),
        page(13, "://"),
        page(14, "http://net/es/ü#f"),
        page(15, "http://mixed.net/en/", "http://shop.com/a"),
        page(16, "http://mixed.net/es/"),
        (17, "http://null.org/a", None, "h", "r", 1.0),
        page(18, "http://com/"),
        page(19, "http://comcom/"),
    ]
    return [*rows, rows[6], page(None, "http://fan.org/2")]


def judged(rows: list[tuple]) -> list[tuple]:
    """By definition: dense power iteration over the hosts."""
    params, rules = U.LinkParams(), sorted(U.RULES, key=lambda r: -len(r[1] + r[2]))
    parsed = []
    for i, url, html, *_ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        rule = next((r for r in rules if (host == r[1] or host.endswith(f".{r[1]}")) and path.startswith(r[2])), None)
        links = [x.lower() for x in re.findall(r'HREF = "(?:https?:)?//([^/?#"]+)', html or "")]
        parsed.append((i, host, path, rule, links))
    hosts = collections.defaultdict(list)
    for _, host, _, rule, _ in parsed:
        if host:
            hosts[host].append(rule)
    edges = collections.Counter((h, x) for _, h, _, _, links in parsed for x in links if h and x != h)
    for h in hosts:
        above = h.partition(".")[2]
        if above in hosts:
            edges[h, above] += 1
            edges[above, h] += 1
    scores = []
    for forward in (True, False):
        own = collections.Counter()
        for (a, b), n in edges.items():
            own[(a, b) if forward else (b, a)] += n
        ends = {x for e in edges for x in e}
        mass = {h: sum(r is not None and r[0] == forward for r in rs) / len(rs) for h, rs in hosts.items()}
        total = {h: m for h, m in mass.items() if h not in ends}
        front = {h: m * (1 - params.damping) for h, m in mass.items() if h in ends}
        for k in range(params.rounds + 1):
            for h, m in front.items():
                total[h] = total.get(h, 0) + m
            nxt = collections.Counter()
            for h, m in front.items():
                out = {b: n for (a, b), n in own.items() if a == h} or {h: 1}
                for b, n in out.items():
                    nxt[b] += m * params.damping * n / sum(out.values())
            front = nxt
        scores.append(total)
    trust, distrust = scores
    result = []
    for i, host, path, rule, _ in parsed:
        d = round(distrust.get(host, 0), 9)
        bad = d >= params.threshold and d > round(trust.get(host, 0), 9)
        result.append((i, host, path, rule and rule[1] + rule[2], ("allow" if rule[0] else "block") if rule else "block" if bad else "allow"))
    return result


def test_urls_equal_the_definition(spark):
    table = spark.createDataFrame(pages(), "page_id long, url string, html string, host string, rule string, allowed double").repartition(3)
    found = [tuple(r) for r in U.judge(table).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r))
    assert sorted(found, key=key) == sorted(judged(pages()), key=key)
    verdict = {r[0]: r[4] for r in found}
    assert verdict[6] == "block"  # of its own seeds
    assert verdict[7] == "block"  # links to it
    assert verdict[8] == "allow" and verdict[10] == "allow" and verdict[11] == "allow"


def test_urls_of_an_empty_table(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
